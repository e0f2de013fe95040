"""Event posteriors of a scenario.

The scenario is compiled on the driver to a grid: one row per combination of frequencies that
an event allows, with its quadrature weight and prior.  Observations are evaluated once per
distinct frequency of their sample (and of the sample that contaminates it) and summed per
variant; then each variant has a vector of bounded length, from which the grid is gathered.

Without artifacts an observation's likelihood is linear in the share of the alternative
allele: observations are shuffled once, in order of their variants, and worked out for all
frequencies as they stream by; no pileup is gathered, and no row per frequency is made.
Otherwise rows of observations times frequencies are summed by partial aggregates.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.formula.normal import condition_holds
from tesseral.formula.scenario import Scenario
from tesseral.formula.syntax import Change
from tesseral.functions import genomics as gn
from tesseral.model import bias, likelihood
from tesseral.model import observations as ob
from tesseral.model.priors import ZERO, Prior
from tesseral.session import Scratch

#: Rows of a grid; scenarios with more need a coarser resolution.
MOST_GRID = 500_000
#: Fixed value: a pileup with more observations than this, all for the reference, rules out every frequency above zero.
CLEAR_REFERENCE = 10
#: Cells (rows times points or frequencies) that are worked out at once.
CELLS = 500_000
#: Observations that are multiplied before a logarithm is taken, and the least product that has surely lost nothing.
RUN, LEAST_PRODUCT = 16, 1e-280


@dataclass
class Grid:
    """Rows in order of their event; ``ops`` number the distinct frequencies per sample."""

    events: list[str]
    samples: list[str]
    event_of: np.ndarray
    vafs: np.ndarray
    log_weight: np.ndarray
    op_of: np.ndarray
    rules_out: np.ndarray
    change_of: np.ndarray
    changes: list[tuple[Change, ...]]
    ops: list[tuple[str, float, float | None]] = field(default_factory=list)


def compile_grid(scenario: Scenario, contig: str = "all", vartype: str = "SNV", absent_only: bool = True, heterozygosity: float | None = None, somatic_rate: float | None = None) -> Grid:
    """All combinations of frequencies of the events, absence first, with weight times prior.

    Intervals are integrated by Simpson's rule at the sample's resolution; points count
    whole.  An event's frequencies are those within the samples' universes.
    """
    scenario.validate(contig)
    prior = Prior(scenario, contig, vartype, absent_only, heterozygosity, somatic_rate)
    prior.check()
    samples = list(scenario.samples)
    events = ["absent", *(e for e in scenario.events if e != "absent")]
    rows: list[tuple] = []
    changes: list[tuple[Change, ...]] = [()]
    for k, e in enumerate(events):
        if e == "absent":
            choices = [([[(0.0, 0.0, False)]] * len(samples), ())]
        else:
            choices = []
            for b in scenario.boxes(e, contig):
                per = []
                for s in samples:
                    r = b.region(s) & scenario.universe(s, contig)
                    above = all(p > 0 for p in r.points)
                    nodes = [(p, 0.0, above) for p in r.points]
                    for v in r.intervals:
                        nodes += [(x, w, v.lo > 0) for x, w in likelihood.simpson_weights(v.lo, v.hi, scenario.samples[s].resolution)]
                    per.append(nodes)
                choices.append((per, tuple(sorted(b.conditions, key=str))))
        for per, conditions in choices:
            if len(rows) + np.prod([float(len(p)) for p in per]) > MOST_GRID:
                raise ValueError(f"the grid of event {e} has more than {MOST_GRID} points: give its samples a coarser resolution")
            kinds = tuple(c for c in conditions if isinstance(c, Change))
            if kinds not in changes:
                changes.append(kinds)
            for combo in itertools.product(*per):
                vafs = tuple(x[0] for x in combo)
                if all(condition_holds(c, dict(zip(samples, vafs)), None) for c in conditions if not isinstance(c, Change)):
                    w = sum(x[1] for x in combo) + prior(vafs)
                    if w > ZERO:
                        rows.append((k, vafs, w, tuple(x[2] for x in combo), changes.index(kinds)))
    ops: dict[tuple, int] = {}
    op_of = []
    for _, vafs, *_ in rows:
        at = dict(zip(samples, vafs))
        op_of.append([ops.setdefault((s, at[s], at[scenario.samples[s].contaminated_by] if scenario.samples[s].contaminated_by else None), len(ops)) for s in samples])
    by_sample = sorted(ops, key=lambda x: samples.index(x[0]))  # the frequencies of a sample stand together
    number = np.empty(len(ops), int)
    number[[ops[x] for x in by_sample]] = np.arange(len(ops))
    return Grid(
        events, samples, np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float).reshape(len(rows), len(samples)), np.array([r[2] for r in rows]),
        number[np.array(op_of, dtype=int).reshape(len(rows), len(samples))], np.array([r[3] for r in rows]).reshape(len(rows), len(samples)), np.array([r[4] for r in rows]), changes, by_sample,
    )


def frequency_likelihoods(obs: DataFrame, scenario: Scenario, grid: Grid, artifacts: tuple[str, ...] = ()) -> DataFrame:
    """variant, artifact (its number, 0 for none), op and log likelihood: the sum over observations, per distinct frequency of the grid.

    ``obs`` must be standard; with artifacts it must be a written table with the
    ``ok_<artifact>`` columns: an artifact is evaluated, with an expression of its own, only
    where it is to be considered.
    """
    spark = obs.sparkSession
    table = spark.createDataFrame([(s, i, float(v), None if by is None else float(by), scenario.samples[s].contamination) for i, (s, v, by) in enumerate(grid.ops)], "s string, op int, vaf double, vaf_by double, fraction double")
    met = obs.join(F.broadcast(table), F.col("sample") == F.col("s"))  # as many rows as the compiled scenario has frequencies

    def value(artifact: str | None):
        own = likelihood.observation(F.col("vaf"), artifact)
        if not any(by is not None for _, _, by in grid.ops):
            return own
        return F.when(F.col("vaf_by").isNull(), own).otherwise(likelihood.contaminated(F.col("vaf"), F.col("vaf_by"), F.col("fraction"), artifact))

    parts = None
    for k, a in enumerate(["none", *artifacts]):
        mine = met if k == 0 else met.where(F.col(f"ok_{a}"))
        one = mine.groupBy("variant", F.lit(k).alias("artifact"), "op").agg(F.sum(value(a if artifacts else None)).alias("ll"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def posteriors(obs: DataFrame, scenario: Scenario, variants: DataFrame | None = None, contig: str = "all", vartype: str = "SNV", absent_only: bool = True, biases: bias.Applicable | None = None, variant: str = "variant", sample: str = "sample", densities: bool = True) -> DataFrame:
    """Posterior of every event per variant, with the most likely frequencies.

    Result: ``variant``, ``prob_<event>`` for absence, each event and the artifacts (PHRED),
    ``best_event``, ``artifact`` (its symbols where an artifact is the likeliest
    explanation, else dots) and per sample ``af_<s>``, ``afd_<s>`` (frequencies and their log
    densities where all other samples stay at their estimates) and ``dp_<s>``, the expected
    number of rightly mapped observations.  Without ``densities`` there are no ``afd_<s>``.

    ``variants`` (``variant``, ``ref_allele``, ``alt_allele``) is needed where an event
    names a substitution.  A sample without observations of a variant has likelihood one.
    """
    artifacts = biases.artifacts() if biases else ()
    grid = compile_grid(scenario, contig, vartype, absent_only)
    base = ob.standard(obs, variant, sample).where(F.col("sample").isin(*grid.samples))
    kind = dict(base.dtypes)["variant"]
    afd = "array<struct<vaf:double,density:double>>"
    schema = ", ".join([f"variant {kind}", *(f"`prob_{e}` double" for e in grid.events), "prob_artifact double, best_event string, artifact string", *(f"`af_{s}` double, {f'`afd_{s}` {afd}, ' if densities else ''}`dp_{s}` double" for s in grid.samples)])
    masks = [c for c in grid.changes if c]
    if masks and variants is None:
        raise ValueError("events name substitutions: the variants' alleles are needed")
    if artifacts or masks:
        got = _from_sums(base, scenario, grid, artifacts, masks, variants, densities, schema)
    else:
        got = _from_stream(base, scenario, grid, densities, schema)
    return got.withColumns({f"dp_{s}": F.round(F.round(F.col(f"dp_{s}"), 9)).cast("int") for s in grid.samples})


def _from_sums(base: DataFrame, scenario: Scenario, grid: Grid, artifacts: tuple[str, ...], masks: list, variants: DataFrame | None, densities: bool, schema: str) -> DataFrame:
    """Posteriors from a row per variant with its log likelihoods of every artifact and frequency."""
    spark = base.sparkSession
    if artifacts:
        base = bias.learned(base)
        ok = bias.judged(bias.pileup_counts(base))
        base = Scratch(spark).table(base.join(ok.withColumnRenamed("variant", "__v"), F.col("variant") == F.col("__v")).drop("__v"))
    n_ops, n_samples = len(grid.ops), len(grid.samples)
    vectors = frequency_likelihoods(base, scenario, grid, artifacts).groupBy("variant").agg(F.collect_list(F.struct("artifact", "op", "ll")).alias("v"))  # at most artifacts x frequencies
    vectors = vectors.select("variant", F.col("v.artifact").alias("v_artifact"), F.col("v.op").alias("v_op"), F.col("v.ll").alias("v_ll"))
    per_sample = base.groupBy("variant", "sample").agg(F.count("*").alias("n"), F.sum(F.exp("ln_map")).alias("dp"), F.bool_and(ob.positive_ref()).alias("ref"))
    facts = per_sample.groupBy(F.col("variant").alias("__v")).agg(
        *(F.coalesce(F.max(F.when(F.col("sample") == s, (F.col("n") > CLEAR_REFERENCE) & F.col("ref"))), F.lit(False)).alias(f"clear_{i}") for i, s in enumerate(grid.samples)),
        *(F.coalesce(F.max(F.when(F.col("sample") == s, F.col("dp"))), F.lit(0.0)).alias(f"dp_{i}") for i, s in enumerate(grid.samples)),
    )
    joined = vectors.join(facts, F.col("variant") == F.col("__v")).drop("__v")
    if masks:
        r, a = F.col("ref_allele"), F.col("alt_allele")
        one = (F.length(r) == 1) & (F.length(a) == 1)
        hit = lambda c: F.coalesce(one & gn.in_iupac(c.ref, r) & gn.in_iupac(c.alt, a), F.lit(False)) == F.lit(c.positive)
        allowed = variants.select(F.col("variant").alias("__v"), F.array(F.lit(True), *(F.forall(F.array(*(hit(c) for c in cs)), lambda x: x) for cs in masks)).alias("allowed"))
        joined = joined.join(allowed, F.col("variant") == F.col("__v"), "left").drop("__v")
    names = ["none", *artifacts]
    shared = spark.sparkContext.broadcast(grid)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        step = max(1, 4 * CELLS // max(1, len(g.event_of)))
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                n = part.num_rows
                cube = np.full((len(names), n, n_ops), np.nan)
                flat = {c: part.column(f"v_{c}").flatten().to_numpy(zero_copy_only=False) for c in ("artifact", "op", "ll")}
                cube[flat["artifact"], np.repeat(np.arange(n), pc.list_value_length(part.column("v_op")).to_numpy()), flat["op"]] = flat["ll"]
                clear = np.column_stack([part.column(f"clear_{i}").to_numpy(zero_copy_only=False) for i in range(n_samples)])
                dp = np.column_stack([part.column(f"dp_{i}").to_numpy() for i in range(n_samples)])
                allowed = part.column("allowed").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)[:, g.change_of] if masks else None
                yield _explained(g, names, part.column("variant"), cube, clear, dp, allowed, densities)

    return joined.mapInArrow(evaluate, schema)


def _from_stream(base: DataFrame, scenario: Scenario, grid: Grid, densities: bool, schema: str) -> DataFrame:
    """Posteriors from observations in order of their variants, of which one variant's sums at most are carried on."""
    number = F.lit(0)
    for i, s in enumerate(grid.samples):
        number = F.when(F.col("sample") == s, i).otherwise(number)
    terms = base.select(
        "variant", number.cast("int").alias("sample"), (F.col("p_map") * F.col("q_alt")).alias("alt"), (F.col("p_map") * F.col("q_ref")).alias("ref"), (F.col("p_mismap") * F.col("q_missed")).alias("wrong"),
        F.exp("ln_sample_alt").alias("chance"), "ln_top", "p_map", F.coalesce(ob.positive_ref(), F.lit(True)).alias("for_ref"),
    )
    fractions = [scenario.samples[s].contamination for s in grid.samples]
    shared = base.sparkSession.sparkContext.broadcast(grid)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        step = max(1, CELLS // max(1, len(g.event_of), len(g.ops)))
        explain = lambda p: _explained(g, ["none"], p.variant, p.ll[None], (p.n > CLEAR_REFERENCE) & p.ref, p.dp, None, densities)
        carried = None
        for b in batches:
            for lo in range(0, b.num_rows, step):
                got = _Pileups.of(b.slice(lo, step), g, fractions)
                if carried is not None:
                    if carried.variant[0].equals(got.variant[0]):
                        got.add_first(carried)
                    else:
                        yield explain(carried)
                carried = got.part(len(got.n) - 1, len(got.n))
                if len(got.n) > 1:
                    yield explain(got.part(0, len(got.n) - 1))
        if carried is not None:
            yield explain(carried)

    return terms.repartition("variant").sortWithinPartitions("variant", "sample").mapInArrow(evaluate, schema)


@dataclass
class _Pileups:
    """Per variant: log likelihoods of all frequencies (0 without observations), and per sample the count of observations, of rightly mapped ones, and whether all are for the reference."""

    variant: pa.Array
    ll: np.ndarray
    n: np.ndarray
    dp: np.ndarray
    ref: np.ndarray

    @staticmethod
    def of(rows: pa.RecordBatch, g: Grid, fractions: list[float]) -> _Pileups:
        """From rows in order of variant and sample."""
        v = rows.column("variant")
        new = np.ones(len(v), bool)
        new[1:] = pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)
        of, n, n_samples = np.cumsum(new) - 1, int(new.sum()), len(g.samples)
        c = {k: rows.column(k).to_numpy(zero_copy_only=False) for k in ("sample", "alt", "ref", "wrong", "chance", "ln_top", "p_map", "for_ref")}
        per = lambda weights=None: np.bincount(of * n_samples + c["sample"], weights, n * n_samples).reshape(n, n_samples)
        ll = np.zeros((n, len(g.ops)))
        for s, name in enumerate(g.samples):
            ops = [i for i, x in enumerate(g.ops) if x[0] == name]
            at = np.flatnonzero(c["sample"] == s)
            if len(at) and len(ops):
                own, by = np.array([g.ops[i][1] for i in ops]), [g.ops[i][2] for i in ops]
                by = None if by[0] is None else np.array(by)
                ll[np.unique(of[at]), ops[0] : ops[-1] + 1] = _log_products(of[at], *(c[k][at] for k in ("alt", "ref", "wrong", "chance", "ln_top")), own, by, fractions[s])
        return _Pileups(v.filter(pa.array(new)), ll, per(), per(c["p_map"]), per((~c["for_ref"]).astype(float)) == 0)

    def part(self, a: int, z: int) -> _Pileups:
        return _Pileups(self.variant.slice(a, z - a), self.ll[a:z], self.n[a:z], self.dp[a:z], self.ref[a:z])

    def add_first(self, other: _Pileups) -> None:
        """Add what the one variant of ``other`` has to the first one here."""
        self.ll[0] += other.ll[0]
        self.n[0] += other.n[0]
        self.dp[0] += other.dp[0]
        self.ref[0] &= other.ref[0]


def _log_products(owner: np.ndarray, alt: np.ndarray, ref: np.ndarray, wrong: np.ndarray, chance: np.ndarray, ln_top: np.ndarray, own: np.ndarray, by: np.ndarray | None, fraction: float) -> np.ndarray:
    """Log likelihoods of each owner (ascending) at each frequency: its observations are multiplied in runs, with a logarithm per run."""
    scale = np.maximum(alt, ref) + wrong  # then no factor is above one
    scale = np.where(scale > 0, scale, 1.0)
    terms = np.column_stack([alt, ref, wrong]) / scale[:, None]
    even = chance.min() == chance.max()
    shares = np.vstack([*_shares(own, by, fraction, chance[:1, None]), np.ones((1, len(own)))]) if even else None

    def factor(rows: np.ndarray) -> np.ndarray:
        if even:
            return terms[rows] @ shares
        from_alt, from_ref = _shares(own, by, fraction, chance[rows, None])
        return terms[rows, 0, None] * from_alt + terms[rows, 1, None] * from_ref + terms[rows, 2, None]

    def folded(first: np.ndarray, size: np.ndarray, each, fold) -> np.ndarray:
        """Of runs in descending order of size."""
        out = each(factor(first))
        for k in range(1, size[0]):
            m = int(np.searchsorted(-size, -k))
            fold(out[:m], each(factor(first[:m] + k)), out=out[:m])
        return out

    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
    first = np.flatnonzero(rank % RUN == 0)
    size = np.diff(np.r_[first, len(owner)])
    order = np.argsort(-size, kind="stable")
    with np.errstate(divide="ignore", invalid="ignore"):
        products = folded(first[order], size[order], lambda x: x, np.multiply)
        lost = np.flatnonzero(~(products.min(axis=1) >= LEAST_PRODUCT))
        lls = np.log(products)
        if len(lost):
            lls[lost] = folded(first[order][lost], size[order][lost], np.log, np.add)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    lls = lls[back] + np.add.reduceat(ln_top + np.log(scale), first)[:, None]
    return lls if len(first) == len(starts) else np.add.reduceat(lls, np.searchsorted(first, starts), axis=0)


def _shares(own: np.ndarray, by: np.ndarray | None, fraction: float, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of both alleles among what is sampled, see ``likelihood.effective_alt``; ``chance`` is a column."""
    reach = lambda v: np.where(v == 1, 1.0, np.minimum(v * chance, 1.0))
    a = reach(own)
    if by is None:
        return a, 1 - a
    b = reach(by)
    return (1 - fraction) * a + fraction * b, (1 - fraction) * (1 - a) + fraction * (1 - b)


def _explained(g: Grid, names: list[str], variant: pa.Array, cube: np.ndarray, clear: np.ndarray, dp: np.ndarray, allowed: np.ndarray | None, densities: bool) -> pa.RecordBatch:
    """Posterior rows of variants from their log likelihoods by artifact (number of its name), variant and frequency."""
    n, n_samples = len(variant), len(g.samples)
    first = np.searchsorted(g.event_of, np.arange(len(g.events)))
    last = np.searchsorted(g.event_of, np.arange(len(g.events)), side="right")
    ruled_out = np.zeros((n, len(g.event_of)), bool) if clear.any() else None
    if ruled_out is not None:
        for s in range(n_samples):
            ruled_out |= clear[:, s : s + 1] & g.rules_out[:, s][None, :]
    joint = []
    for k in range(len(names)):
        ll = np.where(np.isnan(cube[k]), 0.0, cube[k]) if np.isnan(cube[k].min(initial=0.0)) else cube[k]
        j = np.take(ll, g.op_of[:, 0], axis=1)
        for s in range(1, n_samples):
            j += np.take(ll, g.op_of[:, s], axis=1)
        j += g.log_weight
        if ruled_out is not None:
            j[ruled_out] = -np.inf
        if allowed is not None:
            j[~allowed] = -np.inf
        if k:
            j[:, : last[0]] = -np.inf  # absence has no artifact
            j[np.isnan(cube[k]).all(axis=1)] = -np.inf
            j -= np.log(len(names) - 1)
        joint.append(j)
    by_event = np.stack([np.stack([_lse(j[:, f:z]) for f, z in zip(first, last)], axis=1) for j in joint])  # artifact, variant, event
    marginal = _lse(by_event.transpose(1, 0, 2).reshape(n, -1))[:, None]
    with np.errstate(invalid="ignore"):
        post = by_event[0] - marginal
        of_artifact = _lse(by_event[1:].transpose(1, 0, 2).reshape(n, -1)) - marginal[:, 0] if len(names) > 1 else np.full(n, -np.inf)
    is_artifact = of_artifact > post.max(axis=1)
    per_event = np.maximum(by_event[0], _lse_axis0(by_event[1:])) if len(names) > 1 else by_event[0]
    best = per_event.argmax(axis=1)
    # the likeliest point of the best event, and the artifact it has
    at, kind, top = np.zeros(n, int), np.zeros(n, int), np.full(n, -np.inf)
    for e in np.unique(best):
        for k, j in enumerate(joint):
            rows = np.flatnonzero((best == e) & (is_artifact | (k == 0)))
            if not len(rows) or first[e] == last[e]:
                continue
            point = first[e] + j[rows, first[e] : last[e]].argmax(axis=1)
            here = j[rows, point]
            better = (here > top[rows]) | (k == 0)
            at[rows[better]], kind[rows[better]], top[rows[better]] = point[better], k, here[better]
    out = {"variant": variant} | {f"prob_{name}": pa.array(_phred(post[:, e])) for e, name in enumerate(g.events)}
    out |= {"prob_artifact": pa.array(_phred(of_artifact)), "best_event": pa.array(np.array(g.events, object)[best], pa.string()), "artifact": pa.array(np.array([bias.SYMBOLS[x] for x in names], object)[kind], pa.string())}
    for s, name in enumerate(g.samples):
        out[f"af_{name}"] = pa.array(np.where(kind == 0, g.vafs[at, s], 0.0))
        if densities:
            out[f"afd_{name}"] = _lines(g, s, at, kind == 0, joint[0], marginal[:, 0])
        out[f"dp_{name}"] = pa.array(dp[:, s])
    return pa.RecordBatch.from_pydict(out)


def _lines(g: Grid, s: int, at: np.ndarray, wanted: np.ndarray, joint: np.ndarray, marginal: np.ndarray) -> pa.Array:
    """Frequencies of a sample, ascending, and log densities where the other samples stay at a point; of possible points at the same frequency the last one counts."""
    n = len(at)
    fixed = np.delete(g.vafs, s, axis=1)
    parts, counts = [], np.zeros(n, int)
    for p in np.unique(at[wanted]):
        rows = np.flatnonzero(wanted & (at == p))
        points = np.flatnonzero((fixed == fixed[p]).all(axis=1))
        points = points[np.argsort(g.vafs[points, s], kind="stable")]
        kept = np.isfinite(joint[np.ix_(rows, points)])
        again = np.flatnonzero(np.diff(g.vafs[points, s]) == 0)
        seen = kept.copy()  # this one or a later one at the frequency
        for i in again[::-1]:
            kept[:, i] &= ~seen[:, i + 1]
            seen[:, i] |= seen[:, i + 1]
        counts[rows] = kept.sum(axis=1)
        parts.append((rows, points, kept))
    offsets = np.r_[0, np.cumsum(counts)]
    vafs, density = np.empty(offsets[-1]), np.empty(offsets[-1])
    for rows, points, kept in parts:
        r, c = np.nonzero(kept)
        to = offsets[rows][r] + (np.cumsum(kept, axis=1) - 1)[r, c]
        vafs[to], density[to] = g.vafs[points[c], s], joint[rows[r], points[c]] - marginal[rows[r]]
    items = pa.StructArray.from_arrays([pa.array(vafs), pa.array(density)], ["vaf", "density"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items, mask=pa.array(~wanted))


def _lse(x: np.ndarray) -> np.ndarray:
    """ln of the sum of exp over the last axis; minus infinity for nothing."""
    if x.shape[-1] == 0:
        return np.full(x.shape[0], -np.inf)
    top = x.max(axis=-1)
    safe = np.where(np.isfinite(top), top, 0.0)
    parts = x - safe[..., None]
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(parts, out=parts).sum(axis=-1))


def _lse_axis0(x: np.ndarray) -> np.ndarray:
    return _lse(np.moveaxis(x, 0, -1).reshape(-1, x.shape[0])).reshape(x.shape[1:])


def _phred(x: np.ndarray) -> np.ndarray:
    return np.maximum(-x * (10.0 / np.log(10.0)), 0.0) + 0.0
