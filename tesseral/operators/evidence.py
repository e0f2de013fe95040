"""Support of alleles by reads: directly from their bases, or by realignment.

Bases at a locus come from the CIGAR as Catalyst expressions.  Realignment (edit distance,
pair hidden Markov model) has no built-in form: it runs in Arrow batches, one read and its
allele windows at a time, and windows have a fixed length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.functions import genomics as gn
from tesseral.functions import logprob as lp

LN_HALF = math.log(0.5)
#: Fixed value: bases of the reference at either side of a locus that a realignment sees, as a multiple of those of the read.
REFERENCE_SHARE = 1.5
#: Default chances of gaps in a read, and the band beyond the edit distance.
INSERTION, DELETION, EXTRA_BAND = 2.8e-6, 5.1e-6, 4


def read_position(ops: Column, start: Column, pos: Column) -> Column:
    """Place in the read (from 0) of a reference position; null where it is deleted, skipped or not covered.

    ``ops`` is an array of (op, len), ``start`` the position of the first aligned base.
    """
    first = F.struct(start.cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.lit(None).cast("long").alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        aligned, query = x["op"].isin("M", "=", "X"), x["op"].isin("M", "=", "X", "I", "S")
        reference = x["op"].isin("M", "=", "X", "D", "N")
        inside = aligned & (pos >= acc["r"]) & (pos < acc["r"] + x["len"])
        return F.struct(
            F.when(reference, acc["r"] + x["len"]).otherwise(acc["r"]).alias("r"),
            F.when(query, acc["q"] + x["len"]).otherwise(acc["q"]).alias("q"),
            F.when(inside, acc["q"] + (pos - acc["r"])).otherwise(acc["hit"]).alias("hit"),
        )

    return F.aggregate(ops, first, step, lambda acc: acc["hit"])


def base_at(seq: Column, place: Column) -> Column:
    """Letter of a sequence at a place (from 0), in capitals; null outside."""
    base = F.upper(F.substr(seq, (place + 1).cast("int"), F.lit(1)))
    return F.when(base != "", base)


def snv_support(base: Column, qual: Column, ref: Column, alt: Column) -> Column:
    """Log probabilities (ln_ref, ln_alt) of a base at a substitution, and ``third``: 1 if it is of a third allele.

    A base that isn't the alternative one counts as the reference, whatever it is, so that
    sites of several alleles are not biased; an N counts as the true reference.
    """
    third = (base != "N") & (base != F.upper(alt)) & (base != F.upper(ref))
    against = F.when((base != "N") & (base != F.upper(alt)), base).otherwise(ref)
    return F.struct(gn.read_base_ln(base, against, qual).alias("ln_ref"), gn.read_base_ln(base, alt, qual).alias("ln_alt"), F.when(third, F.lit(1)).alias("third"))


def reference_site_support(base: Column, qual: Column, ref: Column) -> Column:
    """The same at a site where any other base is alternative: the chance of a miscall against its complement."""
    miscall = lp.phred_to_ln(qual)
    same = base == F.upper(ref)
    return F.struct(F.when(same, lp.one_minus(miscall)).otherwise(miscall).alias("ln_ref"), F.when(same, miscall).otherwise(lp.one_minus(miscall)).alias("ln_alt"))


def mnv_support(bases: Column, quals: Column, ref: Column, alt: Column, ln_error: Column) -> Column:
    """The same of several adjacent bases: products over them.

    ``bases`` and ``quals`` are arrays along the variant.  A read for the alternative allele
    with more differences to it than its error rate explains is of a third one: its own
    bases take the place of the reference then, and ``third`` counts the differences.
    """
    n = F.size(bases)
    letters = lambda s: F.split(F.upper(s), "")
    each = F.zip_with(F.zip_with(bases, quals, lambda b, q: F.struct(b.alias("b"), q.alias("q"))), F.arrays_zip(letters(ref).alias("r"), letters(alt).alias("a")), lambda x, y: F.struct(x["b"].alias("b"), x["q"].alias("q"), y["r"].alias("r"), y["a"].alias("a")))
    total = lambda f: F.aggregate(each, F.lit(0.0), lambda acc, x: acc + f(x))
    ln_ref, ln_alt = total(lambda x: gn.read_base_ln(x["b"], x["r"], x["q"])), total(lambda x: gn.read_base_ln(x["b"], x["a"], x["q"]))
    own = total(lambda x: gn.read_base_ln(x["b"], x["b"], x["q"]))
    edits = F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when((x["b"] != "N") & (x["b"] != x["a"]), 1).otherwise(0))
    third = (ln_alt > ln_ref) & (edits > 0) & (edits > n * F.exp(ln_error))
    return F.struct(F.when(third, own).otherwise(ln_ref).alias("ln_ref"), ln_alt.alias("ln_alt"), F.when(third, edits).alias("third"))


def strand_if_told(ln_ref: Column, ln_alt: Column, strand: Column) -> Column:
    """Strand of an observation that tells the alleles apart, else None."""
    return F.when(ln_ref != ln_alt, strand).otherwise(F.lit("None"))


def candidate_window(place: Column, read_len: Column, window: int) -> Column:
    """Stretches (read_start, read_stop, ref_before, ref_after) around a place in a read that a realignment sees; null outside the read.

    The reference gets one and a half times the read's window.
    """
    here = (place >= 0) & (place < read_len)
    w = math.ceil(window * REFERENCE_SHARE)
    return F.when(here, F.struct(F.greatest(place - window, F.lit(0)).alias("read_start"), F.least(place + window + 1, read_len).alias("read_stop"), F.lit(w).alias("ref_before"), F.lit(w).alias("ref_after")))


def allele_windows(before: Column, ref: Column, after: Column, kind: Column, alt: Column, length: Column) -> Column:
    """The stretch of reference around a locus with the alternative allele put in.

    ``before`` and ``after`` are the bases at either side, ``ref`` those that the variant
    replaces.  Deletions leave them out, insertions, substitutions and replacements put
    ``alt`` in, inversions turn them round, duplications double them.
    """
    ref_or_nothing = F.coalesce(ref, F.lit(""))
    middle = F.when(kind == "DEL", F.lit("")).when(kind == "INS", F.concat(ref_or_nothing, alt)).when(kind.isin("SNV", "MNV", "REP"), alt).when(kind == "INV", gn.reverse_complement(ref_or_nothing)).when(kind == "DUP", F.concat(ref_or_nothing, ref_or_nothing)).otherwise(ref_or_nothing)
    return F.concat(before, middle, after)


def edit_distance(read: str, window: str) -> tuple[int, int, int]:
    """Fewest edits of a read against any stretch of a window, with the first and one past the last base of that stretch.

    Semi-global alignment, one vector operation per base of the read; of equal ends the
    leftmost is taken.
    """
    n = len(window)
    w = np.frombuffer(window.encode("latin-1", "replace").upper(), np.uint8)
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    offset = np.arange(n + 1)
    for i, c in enumerate(read.encode("latin-1", "replace").upper(), 1):
        diagonal, up = row[:-1] + (w != c), row[1:] + 1
        best = np.concatenate([[i], np.minimum(diagonal, up)])
        came = np.concatenate([[0], np.where(diagonal <= up, begin[:-1], begin[1:])])
        low = np.minimum.accumulate(best - offset)  # gaps in the window: the cheapest way from the left
        source = np.maximum.accumulate(np.where(best - offset == low, offset, 0))
        row, begin = low + offset, came[source]
    end = int(row.argmin())
    return int(row[end]), int(begin[end]), end


def pair_hmm(read: str, quals: np.ndarray, window: str, ln_ins: float = math.log(INSERTION), ln_del: float = math.log(DELETION), ln_ins_more: float = -math.inf, ln_del_more: float = -math.inf, band: int | None = None) -> float:
    """Log probability of a read given an allele's window, over all alignments with free ends of the window.

    States: match, a base of the read without one of the window, and the other way round; a
    miscall falls on each other base with a third of its chance.  ``band`` limits how far
    an alignment strays from the diagonal on which the window's start is aligned.
    """
    p_ins, p_del, p_ins2, p_del2 = math.exp(ln_ins), math.exp(ln_del), math.exp(ln_ins_more), math.exp(ln_del_more)
    keep = 1 - p_ins - p_del
    n = len(window)
    w = np.frombuffer(window.encode("latin-1", "replace").upper(), np.uint8)
    q = np.asarray(quals, dtype=float)
    miss = 10 ** (-q / 10)
    match, ins, dele = np.full(n + 1, 1.0 / max(1, n)), np.zeros(n + 1), np.zeros(n + 1)
    scale = 0.0
    for j, c in enumerate(read.encode("latin-1", "replace").upper()):
        emit = np.full(n, 0.25) if c == ord("N") else np.where(w == c, 1 - miss[j], miss[j] * gn.MISCALL_SHARE)
        new_match = np.zeros(n + 1)
        new_match[1:] = emit * (keep * match[:-1] + (1 - p_ins2) * ins[:-1] + (1 - p_del2) * dele[:-1])
        new_ins = miss[j] * (p_ins * match + p_ins2 * ins)
        new_dele = np.zeros(n + 1)
        new_dele[1:] = p_del * new_match[:-1]
        if p_del2 > 0:
            for i in range(1, n + 1):
                new_dele[i] += p_del2 * new_dele[i - 1]
        if band is not None and j >= band:
            off = np.arange(n + 1) < j - band
            new_match[off] = new_ins[off] = new_dele[off] = 0.0
        total = new_match.sum() + new_ins.sum() + new_dele.sum()
        if total == 0:
            return -math.inf
        match, ins, dele = new_match / total, new_ins / total, new_dele / total
        scale += math.log(total)
    rest = match.sum() + ins.sum()
    return scale + math.log(rest) if rest > 0 else -math.inf


def allele_likelihoods(read: str, quals: np.ndarray, ref_windows: list[str], alt_windows: list[str], exact: bool = True) -> tuple[float, float, int]:
    """Log probabilities (ref, alt) of a read, normalised to sum to one, and the edits to the alternative allele.

    Of several windows of one allele those with the fewest edits are evaluated and the
    likeliest counts.  Without ``exact`` only the stretch of the best alignment, with a few
    bases more, is evaluated.
    """

    def best(windows: list[str]) -> tuple[float, int]:
        found = [(edit_distance(read, x), x) for x in windows]
        least = min(f[0][0] for f in found)
        values = []
        for (d, a, z), x in found:
            if d == least:
                x = x if exact else x[max(0, a - d - EXTRA_BAND) : z + d + EXTRA_BAND]
                values.append(pair_hmm(read, quals, x))
        return max(values), least

    r, _ = best(ref_windows)
    a, edits = best(alt_windows)
    if r == a == -math.inf:
        return LN_HALF, LN_HALF, edits
    top = max(r, a)
    total = top + math.log(math.exp(r - top) + math.exp(a - top))
    return r - total, a - total, edits


_SUPPORT = T.StructType([T.StructField("ln_ref", T.DoubleType()), T.StructField("ln_alt", T.DoubleType()), T.StructField("edits", T.IntegerType())])


@F.pandas_udf(_SUPPORT)
def realigned_support(read: pd.Series, quals: pd.Series, ref_window: pd.Series, alt_window: pd.Series) -> pd.DataFrame:
    """Support of the alleles by reads that are realigned to the windows of both; a read without a base or window is undecided."""
    rows = []
    for s, q, r, a in zip(read, quals, ref_window, alt_window):
        if not s or not r or not a:
            rows.append((LN_HALF, LN_HALF, None))
        else:
            rows.append(allele_likelihoods(s, np.full(len(s), 30.0) if q is None else np.asarray(q, float), [r], [a]))
    return pd.DataFrame(rows, columns=["ln_ref", "ln_alt", "edits"]).astype({"edits": "Int64"})


@F.pandas_udf(T.IntegerType())
def fewest_edits(read: pd.Series, window: pd.Series) -> pd.Series:
    """Fewest edits of a read against any stretch of a window; null without either."""
    return pd.Series([None if r is None or w is None else edit_distance(r, w)[0] for r, w in zip(read, window)], dtype="Int64")


def third_allele(read: str, window: str, error_rate: float) -> str | None:
    """A read's own sequence in place of the stretch it aligns to, if it has more edits than its errors explain; else null."""
    d, a, z = edit_distance(read, window)
    return window[:a] + read + window[z:] if d > len(read) * error_rate else None


def breakends_of(kind: Column, contig: Column, start: Column, length: Column, ref_first: Column, ref_last: Column) -> Column:
    """An inversion or a duplication as breakend alleles: array of (contig, pos, spec), positions from 0.

    An inversion joins both its ends turned round; a duplication its end to its start.
    """
    last = start + length - 1
    spec = lambda fmt, *cs: F.format_string(fmt, *cs)
    one = lambda p, s: F.struct(contig.alias("contig"), p.cast("long").alias("pos"), s.alias("spec"))
    inversion = F.array(
        one(start - 1, spec("%s]%s:%d]", ref_first, contig, last + 1)),
        one(last, spec("%s]%s:%d]", ref_last, contig, start)),
        one(start, spec("[%s:%d[%s", contig, last + 2, ref_first)),
        one(last + 1, spec("[%s:%d[%s", contig, start + 1, ref_last)),
    )
    duplication = F.array(one(last, spec("%s[%s:%d[", ref_last, contig, start + 1)), one(start, spec("]%s:%d]%s", contig, last + 1, ref_first)))
    return F.when(kind == "INV", inversion).when(kind == "DUP", duplication)


def walk_breakends(breakends: list[tuple[int, int, str]], length: int) -> list[tuple[int, int, bool]]:
    """Segments (start, stop, reversed) of the alternative allele of one contig's breakend group, from the left.

    ``breakends`` are (pos, mate, form) with positions from 0 and the form ``t[``, ``t]``,
    ``]t`` or ``[t`` of the joint: bases up to ``pos`` or from it on, joined to what begins
    at or ends in ``mate``.  The walk goes on to the next joint in its direction and ends at
    an end of the contig, or where it would use a joint again.
    """
    joints = sorted(breakends)
    out, at, reverse, used = [], 0, False, set()
    while True:
        if not reverse:
            ahead = [(p, m, f) for p, m, f in joints if p >= at and f[0] == "t" and (p, m, f) not in used]
            if not ahead:
                out.append((at, length, False))
                return out
            p, m, f = ahead[0]
            out.append((at, p + 1, False))
        else:
            ahead = [(p, m, f) for p, m, f in joints if p <= at and f[1] == "t" and (p, m, f) not in used]
            if not ahead:
                out.append((0, at + 1, True))
                return out
            p, m, f = ahead[-1]
            out.append((p, at + 1, True))
        used.add((p, m, f))
        at, reverse = m, "]" in f


def spliced(seq: str, segments: list[tuple[int, int, bool]]) -> str:
    """Sequence of the segments of an allele."""
    turn = str.maketrans("ACGTacgt", "TGCAtgca")
    return "".join(seq[a:z][::-1].translate(turn) if r else seq[a:z] for a, z, r in segments)


@F.pandas_udf(T.DoubleType())
def pair_hmm_ln(read: pd.Series, quals: pd.Series, window: pd.Series) -> pd.Series:
    """Log probability of a read given an allele's window, over all alignments; null without either."""
    return pd.Series([None if not r or not w else pair_hmm(r, np.full(len(r), 30.0) if q is None else np.asarray(q, float), w) for r, q, w in zip(read, quals, window)], dtype=float)
