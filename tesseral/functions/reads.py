"""Functions of reads and fragments that built-in expressions can't say: Arrow-batched UDFs."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.functions.genomics import IUPAC

_ERF = np.frompyfunc(math.erf, 1, 1)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF(np.asarray(x, dtype=float) / math.sqrt(2)).astype(float))


def isize_pmf(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Chance of whole insert sizes under a normal distribution: that of half a base around them."""
    return _normal_cdf((x + 0.5 - mean) / sd) - _normal_cdf((x - 0.5 - mean) / sd)


@F.pandas_udf(T.DoubleType())
def _isize(x: pd.Series, mean: pd.Series, sd: pd.Series) -> pd.Series:
    with np.errstate(divide="ignore"):
        return pd.Series(np.log(isize_pmf(x.to_numpy(float), mean.to_numpy(float), sd.to_numpy(float))))


def isize_pmf_ln(x: Column, mean: Column, sd: Column) -> Column:
    """Log probability of an insert size; minus infinity beyond the numbers' reach."""
    return _isize(x, mean, sd)


def isize_support(size: Column, mean: Column, sd: Column, shift: Column) -> Column:
    """Log probabilities (ref, alt) of a fragment's size if the alternative allele shifts sizes by ``shift``.

    Both are one where one is beyond the numbers' reach while the size isn't within a
    standard deviation of the other's mean: it can't tell then.
    """
    ref, alt = isize_pmf_ln(size, mean, sd), isize_pmf_ln(size, mean + shift, sd)
    zero = F.lit(float("-inf"))
    near = lambda m: F.abs(size - m) <= sd
    lost = ((ref == zero) & ~near(mean + shift)) | ((alt == zero) & ~near(mean))
    return F.struct(F.when(lost, 0.0).otherwise(ref).alias("ln_ref"), F.when(lost, 0.0).otherwise(alt).alias("ln_alt"))


def fragment_sampling(length: int, left: int, right: int, left_feasible: int, right_feasible: int, mean: float, sd: float) -> float:
    """Log chance that a fragment which holds the locus shows an allele that must be enclosed.

    Expected over the insert sizes within six deviations: feasible starts with the allele
    over those without it.
    """
    middle, reach = math.floor(mean + 0.5), math.ceil(sd) * 6
    x = np.arange(max(0, middle - reach), middle + reach)
    below = lambda a, b: np.maximum(np.asarray(a) - b, 0)
    inner = below(below(x, left), right)
    bad_alt = below(left, left_feasible) + below(right, right_feasible) + inner + 1
    bad_ref = below(inner + 1, length)
    ok = (x > 0) & (x > bad_alt) & (x > bad_ref)
    if not ok.any():
        return -math.inf
    p = isize_pmf(x[ok].astype(float), mean, sd) * (x[ok] - bad_alt[ok]) / (x[ok] - bad_ref[ok])
    return min(0.0, math.log(p.sum())) if p.sum() > 0 else -math.inf


@F.pandas_udf(T.DoubleType())
def _fragment(length: pd.Series, left: pd.Series, right: pd.Series, lf: pd.Series, rf: pd.Series, mean: pd.Series, sd: pd.Series) -> pd.Series:
    known: dict[tuple, float] = {}
    out = []
    for key in zip(length, left, right, lf, rf, mean, sd):
        if key not in known:
            known[key] = fragment_sampling(*key)
        out.append(known[key])
    return pd.Series(out, dtype=float)


def fragment_sampling_ln(length: Column, left: Column, right: Column, left_feasible: Column, right_feasible: Column, mean: Column, sd: Column) -> Column:
    return _fragment(length, left, right, left_feasible, right_feasible, mean, sd)


#: Methylation motifs in ambiguity codes.
MOTIFS = ("CG", "GATC", "CHG", "CHH")


def motif_sequences(motif: str) -> list[str]:
    """The sequences that a motif in ambiguity codes stands for."""
    out = [""]
    for c in motif:
        out = [s + b for s in out for b in IUPAC[c]]
    return out


def motif_positions(text: Column, *motifs: str) -> Column:
    """Starts (from 0) of the motifs in a text, from left to right without overlap; letter case matters."""
    found = re.compile("|".join(s for m in motifs for s in motif_sequences(m)))

    @F.pandas_udf("array<int>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [m.start() for m in found.finditer(t)] for t in texts])

    return find(text)


def methylation_calls(seq: str, mm: str, ml: list[int], reverse: bool) -> dict[int, float] | None:
    """Place in the read and probability of each 5mC call of its tags; None where they don't fit the read.

    Positions count the read's C, of the original strand: on a reversed read its G from the
    end.  Calls of other modifications use up their probabilities only.
    """
    out: dict[int, float] = {}
    k = 0
    for block in mm.split(";"):
        head, _, rest = block.partition(",")
        skips = [int(x) for x in rest.split(",") if x.isdigit()]
        if head.startswith(("C+m", "C-m")) and rest:
            places = [i for i, b in enumerate(seq) if b == ("G" if reverse else "C")]
            if reverse:
                places.reverse()
            at = 0
            for s in skips:
                at += s
                if at >= len(places):
                    return None
                out[places[at]] = ((ml[k] if k < len(ml) else 0) + 0.5) / 256
                at += 1
                k += 1
        else:
            k += len(skips)
    return out


@F.pandas_udf(T.MapType(T.IntegerType(), T.DoubleType()))
def methylation_map(seq: pd.Series, mm: pd.Series, ml: pd.Series, reverse: pd.Series) -> pd.Series:
    """``methylation_calls`` of reads; null without tags."""
    return pd.Series([None if s is None or m is None or q is None else methylation_calls(s, m, [int(x) for x in q], bool(r)) for s, m, q, r in zip(seq, mm, ml, reverse)])


def homopolymer_stretch(base: str, seq: str) -> int:
    """How many letters at the start of a sequence are the base."""
    b = base.upper()
    return next((i for i, c in enumerate(seq) if c.upper() != b), len(seq))


def is_homopolymer(seq: str) -> bool:
    return len(set(seq.upper())) <= 1


def homopolymer_indel(ref: str, alt: str) -> int | None:
    """Length of the one homopolymer indel (insertions positive) by which two alleles differ, else None.

    The alleles may differ by that indel alone; it must consist of one base, which goes on
    next to it.
    """
    longer, shorter, sign = (alt, ref, 1) if len(alt) > len(ref) else (ref, alt, -1)
    n = len(longer) - len(shorter)
    if n == 0 or n > 127:
        return None
    for at in range(len(shorter) + 1):
        if longer[:at] == shorter[:at] and longer[at + n :] == shorter[at:]:
            piece = longer[at : at + n]
            if is_homopolymer(piece) and (homopolymer_stretch(piece[0], longer[at + n :]) or homopolymer_stretch(piece[0], longer[:at][::-1])):
                return sign * n
    return None


@F.pandas_udf(T.IntegerType())
def homopolymer_indel_len(ref: pd.Series, alt: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or a is None else homopolymer_indel(r, a) for r, a in zip(ref, alt)], dtype="Int64")
