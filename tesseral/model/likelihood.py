"""Likelihood of observations given allele frequencies, as Catalyst expressions.

The alleles' probabilities are scaled by the larger one (``observations.standard``), so that the
sums of an observation are linear ones that can't underflow, with one logarithm at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesseral.functions import logprob as lp
from tesseral.model import bias


def effective_alt(vaf: Column, ln_sample_alt: Column) -> Column:
    """Chance to sample the alternative allele: frequency times that of a feasible fragment; at frequency one all are alternative."""
    return F.when(vaf == 1, F.lit(1.0)).otherwise(F.least(vaf * F.exp(ln_sample_alt), F.lit(1.0)))


def mapped(vaf: Column, artifact: str | None = None) -> Column:
    """Likelihood of an observation that is mapped right, as a multiple of ``exp(ln_top)``; without an artifact no bias is considered."""
    alt = effective_alt(vaf, F.col("ln_sample_alt"))
    from_alt, from_ref = F.col("q_alt"), F.col("q_ref")
    if artifact is not None:
        from_alt, from_ref = from_alt * F.exp(bias.total(bias.alt_parts(artifact))), from_ref * F.exp(bias.total(bias.ref_parts(artifact)))
    return alt * from_alt + (1 - alt) * from_ref


def observation(vaf: Column, artifact: str | None = None) -> Column:
    """Log likelihood of a standard observation at an allele frequency, in a sample of its own."""
    return _with_mismapped(mapped(vaf, artifact), artifact)


def contaminated(vaf: Column, vaf_by: Column, fraction: Column | float, artifact: str | None = None) -> Column:
    """Log likelihood in a sample of which a fraction comes from another one."""
    f = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return _with_mismapped((1 - f) * mapped(vaf, artifact) + f * mapped(vaf_by, artifact), artifact)


def _with_mismapped(right: Column, artifact: str | None) -> Column:
    wrong = F.col("p_mismap") * F.col("q_missed")
    if artifact is not None:
        wrong = wrong * F.exp(bias.total(bias.any_parts()))
    return F.col("ln_top") + lp.ln(F.col("p_map") * right + wrong)


def simpson_weights(lo: float, hi: float, resolution: float) -> list[tuple[float, float]]:
    """Nodes of an interval, at most ``resolution`` apart and at least 3, with their log weights."""
    m = max(2, math.ceil((hi - lo) / resolution - 1e-9))
    m += m % 2
    h = (hi - lo) / m
    return [(lo + h * k, math.log(h / 3 * (1 if k in (0, m) else 4 if k % 2 else 2))) for k in range(m + 1)]
