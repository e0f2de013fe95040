"""Observations: one row per fragment, variant and sample, with log probabilities.

``standard`` gives a table all columns of the model, neutral where it has none, so that a
table with mapping and allele probabilities alone can be evaluated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.functions import logprob as lp

LN_HALF = math.log(0.5)
#: Mapping probability from which an observation maps uniquely, classes of support.
UNIQUE = math.log(0.95)
STRONG, POSITIVE = lp.KASS_RAFTERY_ORDER["strong"], lp.KASS_RAFTERY_ORDER["positive"]

#: Column, type and neutral value.
COLUMNS: tuple[tuple[str, str, object], ...] = (
    ("ln_map", "double", 0.0),
    ("ln_alt", "double", None),
    ("ln_ref", "double", None),
    ("ln_sample_alt", "double", 0.0),
    ("ln_single", "double", 0.0),
    ("ln_double", "double", 0.0),
    ("ln_hit_base", "double", 0.0),
    ("strand", "string", "None"),
    ("read_orientation", "string", "None"),
    ("read_position", "string", "Some"),
    ("softclipped", "boolean", False),
    ("homopolymer_len", "int", None),
    ("ln_homopolymer_artifact", "double", None),
    ("ln_homopolymer_variant", "double", None),
    ("alt_locus", "string", "None"),
    ("is_max_mapq", "boolean", True),
)


def standard(obs: DataFrame, variant: str = "variant", sample: str = "sample") -> DataFrame:
    """variant, sample and all model columns; ``ln_missed`` and ``ln_mismap`` are derived where missing.

    Beside the logs come the linear ``p_map`` and ``p_mismap``, and ``q_alt``, ``q_ref`` and
    ``q_missed`` as multiples of the likelier allele's ``exp(ln_top)``.  Rows without variant or with a null allele or mapping probability don't count.
    """
    have = set(obs.columns)
    out = obs.select(
        F.col(variant).alias("variant"),
        (F.col(sample) if sample in have else F.lit("sample")).alias("sample"),
        *((F.coalesce(F.col(c), F.lit(d)) if d is not None else F.col(c)).cast(t).alias(c) if c in have else F.lit(d).cast(t).alias(c) for c, t, d in COLUMNS),
        *(F.col(c) for c in ("ln_mismap", "ln_missed") if c in have),
    )
    out = out.where("variant is not null and ln_alt is not null and ln_ref is not null and ln_map is not null")
    out = impossible_to_half(out)
    out = out.withColumn("ln_top", F.greatest("ln_alt", "ln_ref"))
    scaled = {c: F.exp(F.col(f"ln_{c}") - F.col("ln_top")) for c in ("alt", "ref")}
    out = out.withColumns({"q_alt": scaled["alt"], "q_ref": scaled["ref"], "p_map": F.exp("ln_map")})
    missed = F.exp(F.col("ln_missed") - F.col("ln_top")) if "ln_missed" in have else (F.col("q_alt") + F.col("q_ref")) / 2
    mismap = F.exp("ln_mismap") if "ln_mismap" in have else 1 - F.col("p_map")
    return out.withColumns({"q_missed": missed, "p_mismap": mismap}).drop("ln_missed", "ln_mismap")


def impossible_to_half(obs: DataFrame) -> DataFrame:
    """Where both alleles are impossible each gets one half."""
    both = (F.col("ln_alt") == lp.NEG_INF) & (F.col("ln_ref") == lp.NEG_INF)
    half = F.lit(LN_HALF)
    return obs.withColumn("__both", both).withColumn("ln_alt", F.when(F.col("__both"), half).otherwise(F.col("ln_alt"))).withColumn("ln_ref", F.when(F.col("__both"), half).otherwise(F.col("ln_ref"))).drop("__both")


def missed_allele(ln_alt: Column, ln_ref: Column) -> Column:
    """Log probability of the allele at the true place of a mismapped read: the mean of both."""
    return lp.add(ln_alt, ln_ref) - math.log(2.0)


def support(ours: str, other: str) -> Column:
    """Evidence class of one allele against the other."""
    return lp.evidence_level(lp.bayes_factor(F.col(ours), F.col(other)))


def strong_alt() -> Column:
    return support("ln_alt", "ln_ref") >= STRONG


def strong_ref() -> Column:
    return support("ln_ref", "ln_alt") >= STRONG


def positive_ref() -> Column:
    return support("ln_ref", "ln_alt") >= POSITIVE


def unique_mapping() -> Column:
    return F.col("ln_map") >= UNIQUE
