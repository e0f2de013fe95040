"""Event posteriors of discrete scenarios over allele frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.functions import logprob as lp

#: Fixed value: a pileup with more observations than this, all for the reference, rules out every frequency above zero.
CLEAR_REFERENCE = 10


def observation_likelihood(vaf: float, p_map: Column, p_alt: Column, p_ref: Column) -> Column:
    """Log likelihood of one observation without bias; a mismapped one has the mean of both alleles."""
    return lp.ln(p_map * (vaf * p_alt + (1 - vaf) * p_ref) + (1 - p_map) * (p_alt + p_ref) / 2)


def discrete_posteriors(obs: DataFrame, variant: str, events: dict[str, Sequence[float]], p_map: str = "p_map", p_alt: str = "p_alt", p_ref: str = "p_ref") -> DataFrame:
    """Posterior of each event of a one-sample scenario with a flat prior.

    ``events`` names sets of allele frequencies; the event ``absent`` (frequency 0) is
    implied.  Result: the variant, ``prob_<event>`` (PHRED), ``af`` (the most likely
    frequency; the smallest of equal ones) and ``dp``, the number of observations.
    Observations without variant or with a null probability don't count.  No bias is
    considered, so there is no artifact event.
    """
    universe = {"absent": (0.0,)} | {k: tuple(v) for k, v in events.items()}
    vafs = sorted({v for vs in universe.values() for v in vs})
    m, a, r = F.col(p_map), F.col(p_alt), F.col(p_ref)
    usable = obs.where(F.col(variant).isNotNull() & m.isNotNull() & a.isNotNull() & r.isNotNull())
    at = {v: F.col(f"__l{i}") for i, v in enumerate(vafs)}
    got = usable.groupBy(variant).agg(
        F.count("*").alias("dp"),
        F.bool_and(lp.evidence_level(lp.bayes_factor(lp.ln(r), lp.ln(a))) >= lp.KASS_RAFTERY_ORDER["positive"]).alias("__ref"),
        *(F.sum(observation_likelihood(v, m, a, r)).alias(f"__l{i}") for i, v in enumerate(vafs)),
    )
    clear = F.col("__ref") & (F.col("dp") > CLEAR_REFERENCE)
    # an event that has frequency 0 too is not ruled out, nor are its frequencies
    stays = {v for vs in universe.values() if min(vs) == 0 for v in vs}
    joint = {n: at[vs[0]] if len(vs) == 1 else lp.sum_exp_array(F.array(*(at[v] for v in vs))) for n, vs in universe.items()}
    named = got.select(
        variant,
        "dp",
        *((x if v in stays else F.when(clear, lp.zero()).otherwise(x)).alias(f"__l{i}") for i, (v, x) in enumerate(at.items())),
        *((x if min(universe[n]) == 0 else F.when(clear, lp.zero()).otherwise(x)).alias(f"__e_{n}") for n, x in joint.items()),
    )
    named = named.withColumn("__all", lp.sum_exp_array(F.array(*(F.col(f"__e_{n}") for n in universe))))
    best = F.array_max(F.array(*(F.struct(x.alias("x"), F.lit(-v).alias("v")) for v, x in at.items())))
    return named.select(variant, *(lp.ln_to_phred(F.col(f"__e_{n}") - F.col("__all")).alias(f"prob_{n}") for n in universe), (-best["v"] + 0.0).alias("af"), "dp")
