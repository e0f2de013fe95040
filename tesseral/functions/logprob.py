"""Probabilities in log space as Catalyst expressions.

Natural logarithms throughout; a probability of zero is minus infinity, never null, and
null stays null.  Spark's ``ln(0)`` is null and its NaN sorts above everything, so every
logarithm goes through the helpers here.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LN10 = math.log(10.0)
LN2 = math.log(2.0)
NEG_INF = float("-inf")
#: Fixed value: how far a sum of probabilities may exceed one by rounding.
OVERSHOOT = 1e-3


def zero() -> Column:
    """Log of probability zero."""
    return F.lit(NEG_INF).cast("double")


def one() -> Column:
    """Log of probability one."""
    return F.lit(0.0)


def ln(p: Column) -> Column:
    """Log of a probability; zero gives minus infinity, a negative number null."""
    return F.when(p == 0, zero()).otherwise(F.ln(p))


def prob(x: Column) -> Column:
    """Probability of a log probability."""
    return F.exp(x)


def phred_to_ln(q: Column) -> Column:
    """Log probability of a PHRED score; an infinite score is probability zero."""
    return -q.cast("double") * (LN10 / 10.0)


def ln_to_phred(x: Column) -> Column:
    """PHRED score of a log probability, never below zero."""
    return F.greatest(-x * (10.0 / LN10), F.lit(0.0)) + 0.0


def phred_to_prob(q: Column) -> Column:
    """Linear probability of a PHRED score."""
    return F.pow(F.lit(10.0), -q.cast("double") / 10.0)


def prob_to_phred(p: Column) -> Column:
    """PHRED score of a linear probability; infinity for zero."""
    return ln_to_phred(ln(p))


def one_minus(x: Column) -> Column:
    """ln(1 - exp(x)) for x <= 0, by the form that keeps digits at either end."""
    return F.when(x >= 0, zero()).when(x > -LN2, F.ln(-F.expm1(x))).otherwise(F.log1p(-F.exp(x)))


def add(a: Column, b: Column) -> Column:
    """ln(exp(a) + exp(b)); null if either is null.

    Each operand stands three times in the expression: nest it by way of a column.
    """
    far = F.abs(a - b)  # NaN for two zeros, infinite for one
    return F.when(a == b, a + LN2).otherwise(F.greatest(a, b) + F.log1p(F.exp(-far)))


def subtract(a: Column, b: Column) -> Column:
    """ln(exp(a) - exp(b)) for a >= b."""
    return F.when(b == NEG_INF, a).otherwise(a + one_minus(b - a))


def cap(x: Column, epsilon: float = OVERSHOOT) -> Column:
    """A log probability that rounding pushed over zero, brought back; beyond ``epsilon`` it is an error."""
    return F.when(x <= 0, x).when(x <= epsilon, F.lit(0.0)).when(x > epsilon, F.raise_error(F.lit("a probability exceeds one")).cast("double"))


#: Width of the bands in which ``sum_exp_by`` adds up: sums within one stay in range.
BAND = 512.0


def sum_exp_by(df: DataFrame, keys: Sequence[str], x: Column, out: str) -> DataFrame:
    """Per key, ln of the sum of exp(x), however deep the values lie.

    Values are added up within bands of their size, each shifted to its band, by partial
    aggregates; then the bands of a key, a few, are put together from the highest.  Null
    values don't count; minus infinity if no value is above it.
    """
    band = F.when(x == NEG_INF, F.lit(None).cast("double")).otherwise(F.floor(x / BAND).cast("double"))
    shifted = df.where(x.isNotNull()).select(*keys, x.alias("__x"), band.alias("__b"))
    sums = shifted.groupBy(*keys, "__b").agg(F.sum(F.when(F.col("__b").isNotNull(), F.exp(F.col("__x") - F.col("__b") * BAND)).otherwise(0.0)).alias("__s"))
    logs = F.when(F.col("__b").isNull(), zero()).otherwise(F.col("__b") * BAND + F.ln("__s"))
    return sums.groupBy(*keys).agg(F.collect_list(logs).alias("__l")).withColumn(out, sum_exp_array(F.col("__l"))).drop("__l")  # a row per band


def sum_exp_over(x: Column, window) -> Column:
    """ln of the sum of exp(x) over a window, shifted by the largest value so nothing under- or overflows."""
    top = F.max(x).over(window)
    shifted = F.sum(F.exp(x - top)).over(window)
    return F.when(top == NEG_INF, zero()).otherwise(top + F.ln(shifted))


def sum_exp_array(xs: Column) -> Column:
    """ln of the sum of exp of an array's elements; minus infinity for an empty array."""
    top = F.array_max(xs)
    total = F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.when(F.size(xs) == 0, zero()).when(top == NEG_INF, zero()).otherwise(top + F.ln(total))


#: Upper bounds of the evidence classes of a Bayes factor, and their letters.
KASS_RAFTERY = ((1.0, "none", "N"), (3.0, "barely", "B"), (20.0, "positive", "P"), (150.0, "strong", "S"), (math.inf, "very strong", "V"))
KASS_RAFTERY_ORDER = {name: i for i, (_, name, _) in enumerate(KASS_RAFTERY)}


def bayes_factor(a: Column, b: Column) -> Column:
    """exp(a - b); one if both are zero probabilities."""
    return F.when((a == NEG_INF) & (b == NEG_INF), F.lit(1.0)).otherwise(F.exp(a - b))


def evidence_level(factor: Column) -> Column:
    """Number of the evidence class of a Bayes factor: 0 none, 1 barely, 2 positive, 3 strong, 4 very strong."""
    return F.when(factor <= 1, 0).when(factor <= 3, 1).when(factor <= 20, 2).when(factor <= 150, 3).when(factor.isNotNull(), 4)


def evidence_letter(factor: Column, equal: Column | None = None) -> Column:
    """Letter of the evidence class; E where both hypotheses are equal."""
    letters = F.when(factor <= 1, "N").when(factor <= 3, "B").when(factor <= 20, "P").when(factor <= 150, "S").when(factor.isNotNull(), "V")
    return letters if equal is None else F.when(equal, "E").otherwise(letters)


def strongest_evidence(prob_alt: Column, prob_ref: Column) -> Column:
    """Which allele an observation favours and how strongly: ``A?``, ``R?`` with a class letter, or ``E``."""
    alt, ref = bayes_factor(prob_alt, prob_ref), bayes_factor(prob_ref, prob_alt)
    return F.when(prob_alt == prob_ref, "E").when(prob_alt > prob_ref, F.concat(F.lit("A"), evidence_letter(alt))).otherwise(F.concat(F.lit("R"), evidence_letter(ref)))
