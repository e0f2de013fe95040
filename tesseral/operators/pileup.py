"""Features of pileups: what all observations of a variant in a sample show together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.functions import genomics as gn
from tesseral.functions import logprob as lp

#: Depth below which a pseudo observation is added, and its probability.
LOW_DEPTH, PSEUDO = 20, 0.5


def expected_depth(df: DataFrame, keys: Sequence[str], ln_map: str) -> DataFrame:
    """``dp``: the rounded sum of the probabilities to be mapped right; a half, up to rounding of the sum, goes up."""
    return df.groupBy(*keys).agg(F.round(F.round(F.sum(F.exp(ln_map)), 9)).cast("int").alias("dp"))


def log_product(df: DataFrame, keys: Sequence[str], x: Column, out: str = "ln_likelihood") -> DataFrame:
    """Log of the product of probabilities: their logs added up; one impossible factor makes it impossible."""
    none = F.coalesce(F.bool_or(x == lp.NEG_INF), F.lit(False))
    return df.groupBy(*keys).agg(F.when(none, lp.zero()).otherwise(F.sum(F.when(x == lp.NEG_INF, 0.0).otherwise(x))).alias(out))


def major_feature(df: DataFrame, keys: Sequence[str], feature: str, out: str = "major") -> DataFrame:
    """The most frequent value per key, if it occurs more than once and more often than any other; else null.

    Null values don't count.  Values are counted first, so that no task sees more of a key
    than its distinct values; the two largest counts decide.
    """
    counts = df.groupBy(*keys, feature).agg(F.count(feature).alias("__n"))
    top = F.max_by(F.when(F.col("__n") > 0, F.col(feature)), "__n").alias("__f")
    best = counts.groupBy(*keys).agg(F.max("__n").alias("__best"), top)
    ties = counts.join(best.withColumnsRenamed({k: f"__k_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__n") == F.col("__best")])
    n = ties.groupBy(*keys).agg(F.count("*").alias("__ties"), F.max("__n").alias("__n"), F.max("__f").alias("__f"))
    return n.select(*keys, F.when((F.col("__ties") == 1) & (F.col("__n") > 1), F.col("__f")).alias(out))


def adjust_singletons(df: DataFrame, variant: Sequence[str], ln_alt: str, ln_ref: str) -> DataFrame:
    """Sets both probabilities to one half where a variant's samples have just one observation for the alternative allele.

    Counted per variant and joined back, so that a deep variant isn't gathered in one window.
    """
    favours = F.col(ln_alt) > F.col(ln_ref)
    n = df.groupBy(*(F.col(k).alias(f"__k_{k}") for k in variant)).agg(F.count_if(favours).alias("__n"))
    joined = df.join(n, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in variant])
    alone = (F.col("__n") == 1) & favours
    half = lp.ln(F.lit(0.5))
    return joined.select(*(F.when(alone, half).otherwise(F.col(c)).alias(c) if c in (ln_alt, ln_ref) else F.col(c) for c in df.columns))


def average_mapping(df: DataFrame, keys: Sequence[str], prob_map: str, max_prob: float, out: str = "prob_map_adj") -> DataFrame:
    """Mean mapping probability of each pileup, where any but the largest counts as one half.

    Pileups of fewer than 20 get a pseudo observation of one half.  Linear probabilities.
    """
    own = F.when(F.abs(F.col(prob_map) - max_prob) <= 1e-12, F.col(prob_map)).otherwise(F.lit(PSEUDO))
    few = F.count("*") < LOW_DEPTH
    return df.groupBy(*keys).agg(((F.sum(own) + F.when(few, PSEUDO).otherwise(0.0)) / (F.count("*") + F.when(few, 1).otherwise(0))).alias(out))


def generalized_cigar(df: DataFrame, keys: Sequence[str], item: Column, rank: Column | None = None, out: str = "cigar") -> DataFrame:
    """Items of a pileup with their counts as ``<count><item>...``; ordered by ``rank``, then most frequent first, then by item.

    Items are counted first: a key's list has only its distinct items.
    """
    counts = df.select(*keys, item.alias("__i")).where("__i is not null").groupBy(*keys, "__i").agg(F.count("*").alias("__n"))
    order = rank if rank is not None else F.lit(0)
    parts = F.array_sort(F.collect_list(F.struct(order.alias("r"), (-F.col("__n")).alias("n"), F.col("__i").alias("i"))))
    return counts.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: F.concat((-x["n"]).cast("string"), x["i"])), "").alias(out))


def support_letter(ln_ours: Column, ln_other: Column, is_max: Column) -> Column:
    """Letter of the evidence for one allele, in capitals where the mapping quality is the highest; E for none either way."""
    factor = lp.bayes_factor(ln_ours, ln_other)
    letter = lp.evidence_letter(factor, F.abs(factor - 1) <= 1e-15)
    return F.when(is_max, F.upper(letter)).otherwise(F.lower(letter))


def simple_observations(df: DataFrame, keys: Sequence[str], alt_allele: bool, ln_alt: str = "ln_alt", ln_ref: str = "ln_ref", is_max: str = "is_max_mapq") -> DataFrame:
    """Short text of the observations for one allele: the letters of their evidence, counted."""
    a, r = F.col(ln_alt), F.col(ln_ref)
    ours = df.where(a > r if alt_allele else a <= r)
    item = support_letter(a if alt_allele else r, r if alt_allele else a, F.col(is_max))
    return generalized_cigar(ours, keys, item, F.when(F.col("__i").startswith("R"), 2).when(F.col("__i").endswith("E"), 1).otherwise(0), "saobs" if alt_allele else "srobs")


def observation_code(ln_alt: str = "ln_alt", ln_ref: str = "ln_ref") -> Column:
    """Nine symbols of an observation: evidence, edits to a third allele, pairing, alternative locus, strand, orientation, position, clip, homopolymer."""
    a, r = F.col(ln_alt), F.col(ln_ref)
    factor_a, factor_r = lp.bayes_factor(a, r), lp.bayes_factor(r, a)
    score = F.when(factor_a > factor_r, F.concat(F.lit("A"), lp.evidence_letter(factor_a, F.abs(factor_a - 1) <= 1e-15))).when(factor_r > factor_a, F.concat(F.lit("R"), lp.evidence_letter(factor_r, F.abs(factor_r - 1) <= 1e-15))).otherwise(F.lit("E"))
    pick = lambda c, pairs, other: _choose(F.col(c), pairs, other)
    return F.concat(
        F.when(F.col("is_max_mapq"), F.upper(score)).otherwise(F.lower(score)),
        F.coalesce(F.col("third_allele_evidence").cast("string"), F.lit(".")),
        F.when(F.col("paired"), "p").otherwise("s"),
        pick("alt_locus", {"Major": "#", "Some": "*"}, "."),
        pick("strand", {"Both": "*", "Reverse": "-", "Forward": "+"}, "."),
        pick("read_orientation", {"F1R2": ">", "F2R1": "<", "None": "*"}, "!"),
        pick("read_position", {"Major": "^"}, "*"),
        F.when(F.col("softclipped"), "$").otherwise("."),
        F.when(F.coalesce(F.col("homopolymer_len"), F.lit(0)) != 0, "*").otherwise("."),
    )


def _choose(c: Column, pairs: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in pairs.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def merge_mates(left: dict[str, Column], right: dict[str, Column]) -> dict[str, Column]:
    """Allele support of a pair from that of its mates: ln_alt, ln_ref, strand, read_position, homopolymer_len, third (null fields of a missing mate).

    Probabilities multiply; the position is that of the mate for the alternative allele, or
    none where both are and differ; strands unite.
    """
    there = right["ln_alt"].isNotNull()
    la, ra = left["ln_alt"] > left["ln_ref"], right["ln_alt"] > right["ln_ref"]
    null = F.lit(None).cast("int")
    position = F.when(la & ra, F.when(left["read_position"].eqNullSafe(right["read_position"]), left["read_position"]).otherwise(null)).when(~la & ra, right["read_position"]).otherwise(left["read_position"])
    third = F.when(left["third"].isNotNull() & right["third"].isNotNull(), left["third"] + right["third"]).otherwise(F.coalesce(left["third"], right["third"]))
    length = F.when(left["strand"] == "None", right["homopolymer_len"]).when(right["strand"] != "None", F.coalesce(left["homopolymer_len"], right["homopolymer_len"])).otherwise(left["homopolymer_len"])
    both = {"ln_alt": left["ln_alt"] + right["ln_alt"], "ln_ref": left["ln_ref"] + right["ln_ref"], "strand": gn.merge_strands(left["strand"], right["strand"]), "read_position": position, "homopolymer_len": length, "third": third}
    return {k: F.when(there, v).otherwise(left[k]) for k, v in both.items()}


def haplotype_support(supports: Column) -> Column:
    """Log probabilities (alt, ref) of a haplotype from those of its variants, an array of (ln_alt, ln_ref).

    The haplotype is alternative if all variants are; it is reference if at least one is, summed
    over the number of reference alleles: an array that grows by one with each variant.
    """
    start = F.array(F.lit(0.0))

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc)
        return F.transform(
            F.sequence(F.lit(0), n),
            lambda k: lp.add(F.when(k < n, F.get(acc, k) + x["ln_alt"]).otherwise(lp.zero()), F.when(k > 0, F.get(acc, k - 1) + x["ln_ref"]).otherwise(lp.zero())),
        )

    counts = F.aggregate(supports, start, step)
    ln_alt = F.aggregate(supports, F.lit(0.0), lambda acc, x: acc + x["ln_alt"])
    return F.struct(ln_alt.alias("ln_alt"), lp.sum_exp_array(F.slice(counts, F.lit(2), F.greatest(F.size(counts) - 1, F.lit(0)))).alias("ln_ref"))


def mark_most(df: DataFrame, keys: Sequence[str], event: str, score: str) -> DataFrame:
    """The event of the highest score per key; of equal ones the first by name."""
    return df.groupBy(*keys).agg(F.min_by(event, F.struct((-F.col(score)).alias("s"), F.col(event).alias("e"))).alias("best_event"), F.max(score).alias("best_score"))


def normalise(df: DataFrame, keys: Sequence[str], score: str, out: str = "posterior") -> DataFrame:
    """Log posterior of each row: its score minus the log sum over its key; scores of a key are a scenario's events."""
    return df.withColumn(out, F.col(score) - lp.sum_exp_over(F.col(score), Window.partitionBy(*keys)))


def ranked_events(df: DataFrame, keys: Sequence[str], event: str, score: str) -> DataFrame:
    """Events of each key as one text, the most probable first."""
    parts = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(event).alias("e"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["e"]), ",").alias("events"))


def homopolymer_model(df: DataFrame, length: str, prob: str) -> DataFrame:
    """Chance of each length of an indel at a homopolymer, given that there is one: lengths of -128 to 127 but 0, normalised."""
    valid = df.where((F.col(length) != 0) & F.col(length).between(-128, 127))
    total = valid.agg(F.sum(prob).alias("__t"))
    return valid.crossJoin(F.broadcast(total)).select(F.col(length), (lp.ln(F.col(prob)) - lp.ln(F.col("__t"))).alias("ln_prob"))
