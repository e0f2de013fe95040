"""Row filters and set-level filters on calls.

Calls are one row per allele with one PHRED column per event.  Filters keep or drop rows;
those that decide once per haplotype event do so without a shuffle of anything else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.functions import genomics as gn
from tesseral.functions import logprob as lp
from tesseral.session import Scratch, running


def by_type(df: DataFrame, kind: str, column: str = "vartype", length: str | None = None, shortest: int | None = None, longest: int | None = None) -> DataFrame:
    """Rows of one variant type; a length range [shortest, longest) counts for INS and DEL and only if both ends are given."""
    keep = F.upper(F.col(column)) == kind.upper()
    if length and shortest is not None and longest is not None and kind.upper() in ("INS", "DEL"):
        keep = keep & (F.abs(F.col(length).cast("long")) >= shortest) & (F.abs(F.col(length).cast("long")) < longest)
    return df.where(keep)


def known_events(df: DataFrame, events: Sequence[str]) -> list[str]:
    """PHRED columns of the requested events; unknown ones are skipped, and none left is an error."""
    have = {c.upper(): c for c in df.columns}
    out = [have[f"PROB_{e}".upper()] for e in events if f"PROB_{e}".upper() in have]
    if not out:
        raise ValueError(f"none of the events {list(events)} is among the columns")
    return out


def event_probability(columns: Sequence[str]) -> Column:
    """Log probability that one of the events holds, from PHRED columns; missing ones count as zero, all missing is null."""
    logs = [F.coalesce(lp.phred_to_ln(F.col(c)), lp.zero()) for c in columns]
    any_there = F.lit(False)
    for c in columns:
        any_there = any_there | F.col(c).isNotNull()
    total = lp.cap(lp.sum_exp_array(F.array(*logs)))
    return F.when(any_there, total)


def presence_probability(absent: str, artifact: str) -> Column:
    """Log of one minus the probability of absence or artifact."""
    return lp.one_minus(event_probability([absent, artifact]))


def once_per_event(df: DataFrame, keep: Column, event: str, order: Sequence[str]) -> DataFrame:
    """Filter where all records of an event follow the decision on its first record; records without event decide alone.

    Only rows that have an event go through the aggregation that finds the first record.
    """
    if not order:
        raise ValueError("which record of an event is the first needs an order")
    marked = df.withColumn("__keep", keep)
    alone = marked.where(F.col(event).isNull()).where("__keep").drop("__keep")
    tied = marked.where(F.col(event).isNotNull())
    first = tied.groupBy(F.col(event).alias("__event")).agg(F.min_by("__keep", F.struct(*order)).alias("__first")).where("__first")
    return alone.unionByName(tied.join(first, F.col(event) == F.col("__event"), "left_semi").drop("__keep"))


#: Probabilities that differ by no more than this share are equal to a threshold.
NEAR = 1e-12


def _at_least(p: Column, level: Column) -> Column:
    return (p >= level) | (F.abs(p - level) <= NEAR * F.greatest(F.abs(p), F.abs(level)))


def _smart(df: DataFrame, events: Sequence[str], absent: str, artifact: str, retain_artifacts: bool) -> tuple[Column, Column]:
    """Log probabilities of presence and of the events; wanted artifacts count as an event instead of absence."""
    columns = known_events(df, events)
    if retain_artifacts:
        return lp.one_minus(event_probability([absent])), event_probability([*columns, artifact])
    return presence_probability(absent, artifact), event_probability(columns)


def fdr_local(
    df: DataFrame, events: Sequence[str], alpha: float, smart: bool = False, absent: str = "PROB_ABSENT", artifact: str = "PROB_ARTIFACT", retain_artifacts: bool = False, vartype: str | None = None, event: str | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """Keep calls whose probability of the events is at least 1 - alpha.

    Smart: the calls must be present with that probability, and the events must together be
    more likely than not; with ``retain_artifacts`` artifacts are wanted.  With ``vartype``
    only records of that type (column ``vartype``) are kept; records of an ``event`` follow
    the first in ``order``.
    """
    level = F.lit(1 - alpha)
    if smart:
        present, p = _smart(df, events, absent, artifact, retain_artifacts)
        keep = _at_least(F.exp(present), level) & (F.exp(p) > 0.5)
    else:
        keep = _at_least(F.exp(event_probability(known_events(df, events))), level)
    if vartype:
        keep = keep & (F.upper("vartype") == vartype.upper())
    keep = F.coalesce(keep, F.lit(False))
    return once_per_event(df, keep, event, order) if event else df.where(keep)


def fdr_curve(df: DataFrame, error: str, unit: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Expected false discovery rate when all calls up to each error probability are kept.

    Result, one row per distinct error probability: ``error``, ``n_calls``, ``fdr`` (of all
    calls up to it) and ``first_fdr`` (with only the first of the calls of this error).
    Records of one haplotype ``unit`` count once, with the error of the first in ``order``.
    The curve is a running sum over slices of the order in parallel.
    """
    if unit:
        if not order:
            raise ValueError("which record of a unit is the first needs an order")
        alone = df.where(F.col(unit).isNull()).select(F.col(error).alias("error"))
        tied = df.where(F.col(unit).isNotNull()).groupBy(unit).agg(F.min_by(error, F.struct(*order)).alias("error")).select("error")
        errors = alone.unionByName(tied)
    else:
        errors = df.select(F.col(error).alias("error"))
    points = errors.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))
    got = running(Scratch(df.sparkSession), points, ["error"], {"n_calls": F.col("n"), "errors": F.col("n") * F.col("error")})
    before_n, before_e = F.col("n_calls") - F.col("n"), F.col("errors") - F.col("n") * F.col("error")
    return got.select("error", "n_calls", (F.col("errors") / F.col("n_calls")).alias("fdr"), ((before_e + F.col("error")) / (before_n + 1)).alias("first_fdr"))


def fdr_threshold(curve: DataFrame, alpha: float) -> DataFrame:
    """One row: the largest error probability of whose calls the first is still within alpha; null if none.

    Calls of equal error are kept or dropped together.
    """
    return curve.where(F.col("first_fdr") <= alpha * (1 + NEAR)).agg(F.max("error").alias("threshold"))


def fdr_global(df: DataFrame, error: Column, alpha: float, event: str | None = None, order: Sequence[str] = (), also: Column | None = None) -> DataFrame:
    """Keep calls so that the expected false discovery rate of the kept set is at most alpha.

    alpha of one keeps all calls.  ``also`` is a further condition on each row, as the smart
    mode has.  Records of an event follow its first record in ``order``.
    """
    if alpha >= 1:
        return df if also is None else df.where(also)
    scratch = Scratch(df.sparkSession)
    marked = scratch.table(df.withColumn("__error", error))
    threshold = fdr_threshold(fdr_curve(marked, "__error", event, order), alpha).first()[0]
    keep = F.coalesce(F.col("__error") <= F.lit(threshold).cast("double"), F.lit(False))
    if also is not None:
        keep = keep & also
    kept = once_per_event(marked, keep, event, order) if event else marked.where(keep)
    return kept.drop("__error")


def fdr_global_smart(df: DataFrame, events: Sequence[str], alpha: float, absent: str = "PROB_ABSENT", artifact: str = "PROB_ARTIFACT", retain_artifacts: bool = False, event: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Control the rate of absent calls among the kept ones; the events must be more likely than not."""
    present, p = _smart(df, events, absent, artifact, retain_artifacts)
    return fdr_global(df, F.exp(lp.one_minus(present)), alpha, event, order, F.exp(p) > 0.5)


def trimmed_alleles(df: DataFrame, record: Sequence[str], keep: Column, alleles: Sequence[str], order: str) -> DataFrame:
    """Records of one row per allele, put together again with the alleles that are kept, in ``order``; records without any are gone."""
    def in_order(a: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(a).alias("a")))), lambda x: x["a"]).alias(a)

    return df.where(keep).groupBy(*record).agg(*(in_order(a) for a in alleles))  # alleles of a record


def posterior_odds(df: DataFrame, target: Sequence[str], other: Sequence[str], below: str) -> DataFrame:
    """Keep calls whose evidence for other events against the target ones is below a Kass-Raftery class; missing values drop the row."""
    factor = lp.bayes_factor(event_probability(known_events(df, other)), event_probability(known_events(df, target)))
    return df.where(lp.evidence_level(factor) < lp.KASS_RAFTERY_ORDER[below])


def standard_orientation_only(df: DataFrame, orientation: str = "read_orientation", small: Column | None = None, consider: bool = True) -> DataFrame:
    """Drop observations of non-standard orientation, for small variants and where orientation bias is considered."""
    if not consider:
        return df
    keep = gn.standard_orientation(F.col(orientation))
    return df.where(keep if small is None else keep | ~small)


def filtered_out(df: DataFrame, keys: Sequence[str], orientation: str = "read_orientation") -> DataFrame:
    """Per pileup, how many observations the orientation filter removes."""
    return df.groupBy(*keys).agg(F.count_if(~gn.standard_orientation(F.col(orientation))).alias("n_filtered_out"))


def contamination_candidates(df: DataFrame, keys: Sequence[str], is_contaminant: Column, is_alt: Column, is_strong_alt: Column, depth: int = 10) -> DataFrame:
    """Keys where the contaminant has enough reads, all of them reference, and the sample enough reads with strong alternative support."""
    return (
        df.groupBy(*keys)
        .agg(
            F.count_if(is_contaminant).alias("n_contaminant"),
            F.count_if(~is_contaminant).alias("n_sample"),
            F.coalesce(F.bool_or(is_contaminant & is_alt), F.lit(False)).alias("__alt_there"),
            F.coalesce(F.bool_or(~is_contaminant & is_strong_alt), F.lit(False)).alias("__strong"),
        )
        .where((F.col("n_contaminant") >= depth) & (F.col("n_sample") >= depth) & ~F.col("__alt_there") & F.col("__strong"))
        .drop("__alt_there", "__strong")
    )


def coding_only(df: DataFrame, ann: str = "ann") -> DataFrame:
    """Records with an annotation on a protein-coding transcript that changes the protein."""
    fields = lambda a: F.split(a, r"\|")
    items = F.split(F.col(ann), r"[,;\n]")
    keep = F.exists(items, lambda a: (F.get(fields(a), F.lit(7)) == "protein_coding") & (F.coalesce(F.get(fields(a), F.lit(13)), F.lit("")) != ""))
    return df.where(keep)


def substitution_only(df: DataFrame, ref_code: str, alt_code: str, ref: str, alt: str, negate: bool = False) -> DataFrame:
    """Single-base changes that match ambiguity codes; with ``negate`` those that don't."""
    hit = gn.in_iupac(ref_code, F.col(ref)) & gn.in_iupac(alt_code, F.col(alt)) & (F.length(ref) == 1) & (F.length(alt) == 1)
    return df.where(~hit if negate else hit)


def pair_quality(df: DataFrame, left_mapq: str, right_mapq: str) -> DataFrame:
    """Pairs of which no mate has mapping quality zero; a missing mate doesn't matter."""
    return df.where((F.coalesce(F.col(left_mapq), F.lit(1)) != 0) & (F.coalesce(F.col(right_mapq), F.lit(1)) != 0))


def informative(df: DataFrame, strand: str, imprecise: str) -> DataFrame:
    """Observations with a strand, or of an imprecise variant."""
    return df.where((F.col(strand) != "None") | F.col(imprecise))


def methylation_reads(df: DataFrame, flag: str) -> DataFrame:
    """Reads with one of the flags that methylation candidates accept."""
    return df.where(F.col(flag).isin(*gn.METHYLATION_FLAGS))


def custom(df: DataFrame, *filters: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Candidate filters of the user, one after the other."""
    for f in filters:
        df = f(df)
    return df


def propagate(df: DataFrame, wanted: Sequence[str], own: Sequence[str]) -> DataFrame:
    """Columns of the result plus those that the user wants carried along, each once, if there."""
    return df.select(*own, *(c for c in dict.fromkeys(wanted) if c in df.columns and c not in own))


#: Columns of observations that calls don't keep.
OBSERVATION_COLUMNS = (
    "prob_mapping", "prob_mismapping", "prob_mapping_adj", "prob_mismapping_adj", "prob_alt", "prob_ref", "prob_missed_allele",
    "prob_sample_alt", "prob_double_overlap", "prob_single_overlap", "prob_hit_base", "strand", "read_orientation", "read_position",
    "softclipped", "paired", "is_max_mapq", "alt_locus", "homopolymer_indel_len", "third_allele_evidence",
    "prob_observable_at_homopolymer_artifact", "prob_observable_at_homopolymer_variant", "fragment_id",
)


def without_observations(df: DataFrame) -> DataFrame:
    """A call table without the columns of its observations."""
    return df.drop(*OBSERVATION_COLUMNS)
