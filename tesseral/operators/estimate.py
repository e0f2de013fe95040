"""Estimates from whole sets of calls or alignments: burden, contamination, alignment properties."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.functions import genomics as gn
from tesseral.functions import logprob as lp
from tesseral.session import Scratch, running

#: Thresholds of the burden curve and centres of its histogram.
CURVE_STEPS = 99
HIST_CENTRES, HIST_HALF = tuple(0.05 + 0.05 * i for i in range(19)), 0.05


def burden(df: DataFrame, mode: str, prob: Column, vaf: str, kind: str, coding_size: int, sample: str = "sample", cutoff: float = 0.2) -> DataFrame:
    """Expected number of variants per megabase of coding sequence, by ``kind``.

    ``prob`` is the linear probability that the variant is there.  Modes: ``curve`` and
    ``table`` (of frequencies from 0 to 1 in 99 steps, variants at or above: ``min_vaf``),
    ``hist`` (bins of 0.1 around 19 centres, half open: ``vaf``) and ``multibar`` (per sample,
    from the cutoff to below 1).  Variants without frequency don't count.

    The curve needs no join of thresholds and variants: each variant counts at the highest
    threshold it reaches, and the few sums of a kind are added up from the top.
    """
    base = df.where(F.col(vaf).isNotNull() & ~F.isnan(F.col(vaf).cast("double"))).select(F.col(kind).alias("vartype"), F.col(vaf).cast("double").alias("v"), prob.alias("p"), *([F.col(sample).alias("sample")] if mode == "multibar" else []))
    per_mb = 1e6 / coding_size
    if mode == "multibar":
        return base.where((F.col("v") >= cutoff) & (F.col("v") < 1)).groupBy("vartype", "sample").agg((F.sum("p") * per_mb).alias("mb")).withColumn("vaf", F.lit(cutoff))
    if mode == "hist":
        bins = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(c - HIST_HALF).alias("lo"), F.lit(c + HIST_HALF).alias("hi")) for c in HIST_CENTRES))
        hit = base.select("vartype", "p", F.explode(F.filter(bins, lambda b: (F.col("v") >= b["lo"]) & (F.col("v") < b["hi"]))).alias("b"))
        return hit.groupBy("vartype", F.col("b.c").alias("vaf")).agg((F.sum("p") * per_mb).alias("mb"))
    if mode not in ("curve", "table"):
        raise ValueError(f"unknown mode {mode}")
    step = lambda k: k.cast("double") / CURVE_STEPS
    near = F.floor(F.col("v") * CURVE_STEPS).cast("int")
    # rounding may put the product on the wrong side of the threshold itself
    reached = F.when(step(near + 1) <= F.col("v"), near + 1).when(step(near) > F.col("v"), near - 1).otherwise(near)
    sums = base.withColumn("k", F.least(reached, F.lit(CURVE_STEPS))).where("k >= 0").groupBy("vartype", "k").agg(F.sum("p").alias("s"))
    spread = sums.groupBy("vartype").agg(F.map_from_entries(F.collect_list(F.struct("k", "s"))).alias("m"), F.max("k").alias("top"))  # at most 100 sums
    at = spread.select("vartype", F.explode(F.expr("transform(sequence(0, top), i -> named_struct('i', i, 's', aggregate(sequence(i, top), 0D, (a, j) -> a + coalesce(m[j], 0D))))")).alias("x"))
    return at.select("vartype", step(F.col("x.i")).alias("min_vaf"), (F.col("x.s") * per_mb).alias("mb"))


def vaf_histogram(df: DataFrame, vaf: str) -> DataFrame:
    """Number of variants per hundredth of frequency."""
    return df.where(F.col(vaf).isNotNull()).groupBy((F.floor(F.col(vaf) * 100) / F.lit(100.0)).alias("vaf")).agg(F.count("*").alias("n"))


#: Contamination grid, assumed largest somatic frequencies, and the least probability of a candidate.
CONTAMINATION_STEPS, MAX_SOMATIC, LEAST_DENOVO = 100, (0.25, 0.5, 0.75, 1.0), 0.95


def contamination(df: DataFrame, vaf: str, vaf_dist: str, prob_denovo: str, prior_cells: tuple[float, int] | None = None) -> DataFrame:
    """Posterior density of the contamination of a sample, from its de novo variants.

    ``vaf_dist`` is an array of (vaf, density) in order of vaf, with log densities, ``vaf``
    the most likely frequency.  ``prior_cells`` is an earlier estimate and the number of
    cells it came from.  Result: ``contamination``, ``max_somatic`` and ``ln_density``, for
    101 contaminations and 4 assumptions on the largest somatic frequency, normalised.

    Equal variants are counted first; each is met with the 404 grid points where it stands
    and only sums are shuffled.
    Between two frequencies of a distribution the density is interpolated linearly.
    """
    spark = df.sparkSession
    rows = df.where((F.col(prob_denovo) >= LEAST_DENOVO) & F.col(vaf_dist).isNotNull() & F.col(vaf).isNotNull()).select(F.col(vaf).alias("v"), F.col(vaf_dist).alias("d"), F.col(prob_denovo).alias("p")).groupBy("v", "d", "p").agg(F.count("*").alias("n"))
    top = rows.agg(F.max("v")).first()[0]
    grid = spark.createDataFrame([(k / CONTAMINATION_STEPS, m) for k in range(CONTAMINATION_STEPS + 1) for m in MAX_SOMATIC], "contamination double, max_somatic double")
    if top is None or top == 0:
        lls = grid.withColumn("ll", F.lit(0.0))
    else:
        met = rows.crossJoin(F.broadcast(grid))  # a fixed number of points
        x = F.col("max_somatic") * (1 - F.col("contamination")) * F.col("v") / F.lit(float(top))
        ln_pdf = F.when(F.col("contamination") == 1, lp.one_minus(lp.ln(F.col("p")))).otherwise(interpolated(F.col("d"), x))
        none = F.bool_or(F.col("l") == lp.NEG_INF)
        lls = met.select("contamination", "max_somatic", "n", ln_pdf.alias("l")).groupBy("contamination", "max_somatic").agg(F.when(none, lp.zero()).otherwise(F.sum(F.when(F.col("l") == lp.NEG_INF, 0.0).otherwise(F.col("l") * F.col("n")))).alias("ll"))
    prior = F.lit(0.0)
    if prior_cells:
        share, n = prior_cells
        k = round(share * n)
        c = F.col("contamination")
        choose = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        part = lambda count, p: F.when(F.lit(count) == 0, F.lit(0.0)).otherwise(F.lit(float(count)) * lp.ln(p))
        prior = F.lit(choose) + part(k, c) + part(n - k, 1 - c)
    joint = lls.withColumn("j", F.col("ll") + prior)
    # Simpson's rule over the contaminations
    at = F.round(F.col("contamination") * CONTAMINATION_STEPS).cast("int")
    weight = F.when(at.isin(0, CONTAMINATION_STEPS), 1).when(at % 2 == 1, 4).otherwise(2) / F.lit(3.0 * CONTAMINATION_STEPS)
    total = joint.agg(lp.sum_exp_array(F.collect_list(F.col("j") + F.ln(weight))).alias("t"))  # 404 rows
    return joint.crossJoin(F.broadcast(total)).select("contamination", "max_somatic", F.when(F.col("j") == lp.NEG_INF, lp.zero()).otherwise(F.col("j") - F.col("t")).alias("ln_density"))


def interpolated(dist: Column, x: Column) -> Column:
    """Log density of an array of (vaf, density), in order of vaf, at x: interpolated in linear space, zero outside."""
    below, above = F.filter(dist, lambda d: d["vaf"] <= x), F.filter(dist, lambda d: d["vaf"] >= x)
    lo, hi = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    share = (x - lo["vaf"]) / F.nullif(hi["vaf"] - lo["vaf"], F.lit(0.0))
    mixed = F.exp(lo["density"]) * (1 - share) + F.exp(hi["density"]) * share
    return F.when(lo.isNull() | hi.isNull(), lp.zero()).when(lo["vaf"] == hi["vaf"], lo["density"]).otherwise(lp.ln(mixed))


def trimmed_mean_sd(df: DataFrame, keys: Sequence[str], value: str, lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """Mean and sample standard deviation of the values within two percentiles, both inclusive."""
    ends = df.groupBy(*(F.col(k).alias(f"__k_{k}") for k in keys)).agg(F.percentile(value, F.lit(lower)).alias("__lo"), F.percentile(value, F.lit(upper)).alias("__hi"))
    joined = df.join(ends, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]) if keys else df.crossJoin(F.broadcast(ends))
    return joined.where(F.col(value).between(F.col("__lo"), F.col("__hi"))).groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n"))


#: Counts below which a rate is not estimated, and the default rates of gaps.
LEAST_TRANSITIONS = 100
DEFAULT_GAPS = {"insertion": 2.8e-6, "deletion": 5.1e-6, "insertion_extend": 0.0, "deletion_extend": 0.0}
BASES = ("A", "C", "G", "T")


def transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """Counts of successive states (``source``, ``target``) within each key, e.g. a read."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select(F.lag(state).over(w).alias("source"), F.col(state).alias("target")).where("source is not null").groupBy("source", "target").agg(F.count("*").alias("n"))


def gap_rates(counts: DataFrame) -> DataFrame:
    """One row of gap rates from transition counts over states MatchA.., GapX, GapY, HopAX..: start and extend of insertion (X) and deletion (Y).

    Start: from a match to the gap over all from a match.  Extend: from the gap to itself
    over all from it.  With fewer than 100 of either the defaults hold (``estimated`` false).
    """
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    match = F.col("source").startswith("Match")
    usual = ~F.col("target").isin("Other") & ~F.col("source").isin("Other")
    parts = {}
    for name, gap in (("insertion", "GapX"), ("deletion", "GapY")):
        parts[name] = (n(match & (F.col("target") == gap)), n(match & usual))
        parts[f"{name}_extend"] = (n((F.col("source") == gap) & (F.col("target") == gap)), n((F.col("source") == gap) & usual))
    sums = counts.agg(*(x.alias(f"{k}_{w}") for k, v in parts.items() for w, x in zip(("hits", "all"), v)))
    enough = F.lit(True)
    for k in parts:
        enough = enough & (F.col(f"{k}_hits") >= LEAST_TRANSITIONS)
    return sums.select(enough.alias("estimated"), *(F.when(enough, F.col(f"{k}_hits") / F.col(f"{k}_all")).otherwise(F.lit(DEFAULT_GAPS[k])).alias(k) for k in parts))


def hop_rates(counts: DataFrame) -> DataFrame:
    """Homopolymer rates per base from transition counts: start and extend over all from the base's match, for X and Y; extend equals start.

    Null where start and extend are fewer than 100.
    """
    out = []
    for b in BASES:
        for side in ("X", "Y"):
            hop, match = f"Hop{b}{side}", f"Match{b}"
            hits = F.coalesce(F.sum(F.when((F.col("target") == hop) & F.col("source").isin(match, hop), F.col("n"))), F.lit(0))
            every = F.sum(F.when((F.col("source") == match) & (F.col("target") != "Other"), F.col("n")))
            out.append(F.struct(F.lit(b).alias("base"), F.lit(side).alias("side"), F.when(hits >= LEAST_TRANSITIONS, hits / every).alias("rate")))
    return counts.agg(F.array(*out).alias("a")).select(F.explode("a").alias("r")).select("r.base", "r.side", "r.rate", F.col("r.rate").alias("extend_rate"))


def error_model(df: DataFrame, ref_len: str, read_len: str, n: str) -> DataFrame:
    """Share of each difference of homopolymer lengths; only counts of at least 10 make the total."""
    total = df.agg(F.sum(F.when(F.col(n) >= 10, F.col(n))).alias("t"))
    grouped = df.groupBy(F.greatest(F.least(F.col(ref_len) - F.col(read_len), F.lit(32767)), F.lit(-32768)).alias("diff")).agg(F.sum(n).alias("s"))
    return grouped.crossJoin(F.broadcast(total)).select("diff", (F.col("s") / F.col("t")).alias("prob"))


def cigar_states(cigar: Column) -> Column:
    """Operations of a CIGAR text as array of (op, len), without clips and padding."""
    return F.filter(gn.cigar_ops(cigar), lambda x: x["op"].isin("M", "I", "D", "N", "=", "X"))


def cigar_counts(df: DataFrame, cigar: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of gaps by signed length (insertions positive) and of matches by length: ``kind``, ``length``, ``n``."""
    op = F.explode(cigar_states(F.col(cigar)))
    rows = df.select(*keys, op.alias("o"))
    kind = F.when(F.col("o.op").isin("I", "D"), "gap").when(F.col("o.op").isin("M", "=", "X"), "match")
    return rows.select(*keys, kind.alias("kind"), F.when(F.col("o.op") == "D", -F.col("o.len")).otherwise(F.col("o.len")).alias("length")).where("kind is not null").groupBy(*keys, "kind", "length").agg(F.count("*").alias("n"))


def alignment_maxima(df: DataFrame, cigar: str, mapq: str, read_len: str, keys: Sequence[str] = ()) -> DataFrame:
    """Largest mapping quality, read length, insertion, deletion and share of soft clip, and how many alignments have a clip or are not regular."""
    ops = gn.cigar_ops(F.col(cigar))
    parts = df.select(*keys, F.col(mapq).alias("q"), F.col(read_len).alias("l"), gn.longest_operation(ops, "I").alias("i"), gn.longest_operation(ops, "D").alias("d"), gn.softclip_length(ops).alias("s"), F.exists(ops, lambda x: x["op"].isin("I", "D", "S", "H")).alias("irregular"))
    return parts.groupBy(*keys).agg(
        F.max("q").alias("max_mapq"), F.max("l").alias("max_read_len"), F.max("i").alias("max_ins"), F.max("d").alias("max_del"), F.max(F.try_divide("s", "l")).alias("frac_max_softclip"),
        F.count_if(F.col("s") > 0).alias("n_softclips"), F.count_if("irregular").alias("n_not_regular"), F.count("*").alias("n"),
    )


#: Transitions that the estimate is for, probabilities it must hold for, and transitions per alignment.
VALID_TRANSITIONS, TARGETS, PER_ALIGNMENT = 82, (0.25, 1e-1, 1e-2, 1e-3, 1e-4, 1e-5), 100


def alignments_needed(precision: float, confidence: float, available: int | None = None, relative: bool = False) -> int:
    """Alignments from which transition probabilities come out within ``precision``; with the finite correction if there are so many."""
    z = NormalDist().inv_cdf(1 - confidence / VALID_TRANSITIONS / 2)
    b = z * z  # the quantile of the chi-squared distribution with one degree of freedom
    most = 0
    for p in TARGETS:
        d, v = precision * p if relative else precision, p * (1 - p)
        if available is None:
            n = b * v / d**2
        else:
            total = available * PER_ALIGNMENT
            n = b * total * v / (d**2 * (total - 1) + b * v)
        most = max(most, math.ceil(n / PER_ALIGNMENT))
    return most


def reciprocal_regression(df: DataFrame, vaf: str) -> DataFrame:
    """Slope and intercept of the cumulative number of variants over 1 / frequency, from the most frequent on."""
    points = df.where(F.col(vaf) > 0).groupBy((1 / F.col(vaf)).alias("x")).agg(F.count("*").alias("n"))
    cum = running(Scratch(df.sparkSession), points, ["x"], {"y": F.col("n")})
    return cum.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def largest_with_ties(df: DataFrame, value: str) -> DataFrame:
    """All rows with the largest value."""
    return df.join(F.broadcast(df.agg(F.max(value).alias("__m"))), F.col(value) == F.col("__m")).drop("__m")


def scatter_pairs(df: DataFrame, key: Sequence[str], sample: str, vaf: str, x: str, ys: Sequence[str]) -> DataFrame:
    """Frequencies of sample x against each of the samples ys, per variant: ``x``, ``y``, ``y_sample``; without either there is no pair.

    One pass: a variant's frequencies are aggregated by sample.
    """
    wanted = df.where(F.col(sample).isin(x, *ys) & F.col(vaf).isNotNull())
    at = wanted.groupBy(*key).agg(F.max(F.when(F.col(sample) == x, F.col(vaf))).alias("x"), *(F.max(F.when(F.col(sample) == y, F.col(vaf))).alias(f"__{i}") for i, y in enumerate(ys)))
    pairs = F.explode(F.array(*(F.struct(F.lit(y).alias("s"), F.col(f"__{i}").alias("v")) for i, y in enumerate(ys))))
    return at.where("x is not null").select(*key, "x", pairs.alias("p")).where("p.v is not null").select(*key, "x", F.col("p.v").alias("y"), F.col("p.s").alias("y_sample"))


def depth_factor(df: DataFrame, a: str, b: str) -> float:
    """Ratio of the mean depths of two columns."""
    got = df.agg(F.avg(a).alias("a"), F.avg(b).alias("b")).first()
    return float(got["a"]) / float(got["b"])

