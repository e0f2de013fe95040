"""Formulas as Catalyst predicates over columns of allele frequencies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesseral.formula.normal import Box
from tesseral.formula.regions import Region
from tesseral.formula.syntax import Change
from tesseral.functions import genomics as gn


def in_region(region: Region, vaf: Column) -> Column:
    """Whether a frequency lies in a region; null is in none."""
    out = vaf.isin(*region.points) if region.points else F.lit(False)
    for v in region.intervals:
        lo = vaf > v.lo if v.lo_open else vaf >= v.lo
        hi = vaf < v.hi if v.hi_open else vaf <= v.hi
        out = out | (lo & hi)
    return F.coalesce(out, F.lit(False))


def holds(boxes: Sequence[Box], vafs: Mapping[str, Column], ref: Column | None = None, alt: Column | None = None) -> Column:
    """Whether a formula in normal form holds for the frequencies of a row (and its substitution)."""
    out = F.lit(False)
    for b in boxes:
        here = F.lit(True)
        for s, r in b.regions:
            here = here & in_region(r, vafs[s])
        for c in sorted(b.conditions, key=str):
            if isinstance(c, Change):
                if ref is None or alt is None:
                    raise ValueError("the formula names a substitution: alleles are needed")
                hit = F.coalesce((F.length(ref) == 1) & (F.length(alt) == 1) & gn.in_iupac(c.ref, ref) & gn.in_iupac(c.alt, alt), F.lit(False))
                here = here & (hit if c.positive else ~hit)
            else:
                here = here & gn.fold_holds(gn.log2_fold_change(vafs[c.a], vafs[c.b]), c.op, c.value)
        out = out | here
    return out
