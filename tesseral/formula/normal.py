"""Normal form of formulas: disjoint boxes of one region per sample.

Named expressions are expanded, negations moved into the atoms (complements in the sample's
universe) and conjunctions multiplied out; boxes that differ in one sample only are merged,
and what boxes share is kept in the first of them, so that no frequencies count twice.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from tesseral.formula.regions import FULL, Region
from tesseral.formula.syntax import And, Atom, Change, Constant, Fold, FormulaError, Name, Not, Or
from tesseral.functions.genomics import COMPARE, FLIPPED, NEGATED


@dataclass(frozen=True)
class Box:
    """Regions of some samples, in order of their names, and further conditions; all hold together."""

    regions: tuple[tuple[str, Region], ...]
    conditions: frozenset = frozenset()

    def region(self, sample: str) -> Region:
        return dict(self.regions).get(sample, FULL)

    def with_region(self, sample: str, region: Region) -> Box:
        d = dict(self.regions)
        d[sample] = region
        return Box(tuple(sorted(d.items(), key=lambda kv: kv[0])), self.conditions)

    def __str__(self) -> str:
        parts = [f"{s}:({r})" for s, r in self.regions] + sorted(str(c) for c in self.conditions)
        return " & ".join(parts) or "true"


def expand(tree, expressions: Mapping[str, object], seen: tuple[str, ...] = ()):
    """The tree with named expressions put in, also nested ones; a cycle or unknown name is an error."""
    if isinstance(tree, Name):
        if tree.name not in expressions:
            raise FormulaError(f"undefined expression {tree.name}")
        if tree.name in seen:
            raise FormulaError(f"expression {tree.name} contains itself")
        return expand(expressions[tree.name], expressions, (*seen, tree.name))
    if isinstance(tree, Not):
        return Not(expand(tree.operand, expressions, seen))
    if isinstance(tree, (And, Or)):
        return type(tree)(tuple(expand(x, expressions, seen) for x in tree.operands))
    return tree


def push_negations(tree, universe: Callable[[str], Region], negate: bool = False):
    """The tree without negations: De Morgan, opposite comparisons, complements in the universe."""
    if isinstance(tree, Not):
        return push_negations(tree.operand, universe, not negate)
    if isinstance(tree, (And, Or)):
        kind = type(tree) if not negate else (Or if isinstance(tree, And) else And)
        return kind(tuple(push_negations(x, universe, negate) for x in tree.operands))
    if not negate:
        return tree
    if isinstance(tree, Constant):
        return Constant(not tree.value)
    if isinstance(tree, Change):
        return Change(tree.ref, tree.alt, not tree.positive)
    if isinstance(tree, Fold):
        return Fold(tree.a, tree.b, NEGATED[tree.op], tree.value)
    if isinstance(tree, Atom):
        return Atom(tree.sample, universe(tree.sample) - tree.region)
    raise FormulaError(f"can't negate {tree}")


def _ordered(fold: Fold) -> Fold:
    return fold if fold.a <= fold.b else Fold(fold.b, fold.a, FLIPPED[fold.op], 0.0 - fold.value)


def _meet(a: Box, b: Box) -> Box | None:
    regions = dict(a.regions)
    for s, r in b.regions:
        regions[s] = regions[s] & r if s in regions else r
        if regions[s].is_empty():
            return None
    conditions = a.conditions | b.conditions
    for c in conditions:
        if isinstance(c, Change) and Change(c.ref, c.alt, not c.positive) in conditions:
            return None
        if isinstance(c, Fold) and Fold(c.a, c.b, NEGATED[c.op], c.value) in conditions:
            return None
    return Box(tuple(sorted(regions.items(), key=lambda kv: kv[0])), conditions)


def _boxes(tree) -> list[Box]:
    if isinstance(tree, Atom):
        return [] if tree.region.is_empty() else [Box(((tree.sample, tree.region),))]
    if isinstance(tree, Constant):
        return [Box(())] if tree.value else []
    if isinstance(tree, Fold):
        return [Box((), frozenset([_ordered(tree)]))]
    if isinstance(tree, Change):
        return [Box((), frozenset([tree]))]
    if isinstance(tree, Or):
        return merge([b for x in tree.operands for b in _boxes(x)])
    out = [Box(())]
    for x in tree.operands:
        out = merge([m for a, b in itertools.product(out, _boxes(x)) if (m := _meet(a, b)) is not None])
    return out


def _slim(box: Box) -> Box:
    return Box(tuple((s, r) for s, r in box.regions if not r.is_full()), box.conditions)


def merge(boxes: list[Box]) -> list[Box]:
    """Boxes with covered ones dropped and those that differ in one sample only united."""
    boxes = list(dict.fromkeys(_slim(b) for b in boxes))
    again = True
    while again:
        again = False
        for a, b in itertools.combinations(boxes, 2):
            samples = {s for s, _ in a.regions + b.regions}
            if a.conditions <= b.conditions and all(a.region(s).covers(b.region(s)) for s in samples):
                gone, new = (b,), None
            elif b.conditions <= a.conditions and all(b.region(s).covers(a.region(s)) for s in samples):
                gone, new = (a,), None
            else:
                differ = [s for s in samples if a.region(s) != b.region(s)]
                if a.conditions != b.conditions or len(differ) != 1:
                    continue
                s = differ[0]
                gone, new = (a, b), _slim(a.with_region(s, a.region(s) | b.region(s)))
            boxes = [x for x in boxes if x not in gone] + ([new] if new and new not in boxes else [])
            again = True
            break
    return sorted(boxes, key=str)


def _minus(a: Box, b: Box) -> list[Box]:
    """Boxes that hold all of a outside b; further conditions of b count as a dimension each."""
    if _meet(a, b) is None:
        return [a]
    out, rest = [], a
    for s, r in b.regions:
        outside = rest.region(s) - r
        if not outside.is_empty():
            out.append(rest.with_region(s, outside))
        rest = rest.with_region(s, rest.region(s) & r)
    for c in sorted(b.conditions - a.conditions, key=str):
        opposite = Change(c.ref, c.alt, not c.positive) if isinstance(c, Change) else Fold(c.a, c.b, NEGATED[c.op], c.value)
        out.append(Box(rest.regions, rest.conditions | {opposite}))
        rest = Box(rest.regions, rest.conditions | {c})
    return out


def disjoint(boxes: list[Box]) -> list[Box]:
    """Boxes without common frequencies that hold the same as the given ones."""
    out: list[Box] = []
    for b in boxes:
        parts = [b]
        for done in out:
            parts = [x for p in parts for x in _minus(p, done)]
        out += parts
    return merge(out) if len(out) == len(boxes) else sorted((_slim(b) for b in out), key=str)


def normalise(tree, universe: Callable[[str], Region], expressions: Mapping[str, object] | None = None) -> list[Box]:
    """Disjoint boxes of a formula; none if it can't hold."""
    return disjoint(_boxes(push_negations(expand(tree, expressions or {}), universe)))


def holds(boxes: list[Box], vafs: Mapping[str, float], snv: tuple[str, str] | None = None) -> bool:
    """Whether frequencies (and a substitution) are within one of the boxes."""
    return any(all(r.holds(vafs[s]) for s, r in b.regions) and all(condition_holds(c, vafs, snv) for c in b.conditions) for b in boxes)


def condition_holds(c, vafs: Mapping[str, float], snv: tuple[str, str] | None) -> bool:
    from math import log2

    from tesseral.functions.genomics import IUPAC

    if isinstance(c, Change):
        return (snv is not None and snv[0] in IUPAC[c.ref] and snv[1] in IUPAC[c.alt]) == c.positive
    a, b = vafs[c.a], vafs[c.b]
    change = 0.0 if a == b == 0 else (float("inf") if b == 0 else float("-inf") if a == 0 else log2(a) - log2(b))
    if c.op in ("==", "!="):
        near = abs(change - c.value) <= 1e-12 * max(1.0, abs(c.value)) if abs(change) != float("inf") else False
        return near == (c.op == "==")
    return COMPARE[c.op](change, c.value)


def cells(boxes: list[Box], samples: list[str]) -> dict[str, list[float]]:
    """Per sample one frequency out of every stretch that no boundary of the boxes divides."""
    out = {}
    for s in samples:
        ends = {0.0, 1.0}
        for b in boxes:
            r = b.region(s)
            ends |= set(r.points) | {e for v in r.intervals for e in (v.lo, v.hi)}
        e = sorted(ends)
        out[s] = sorted({*e, *((a + b) / 2 for a, b in itertools.pairwise(e))})
    return out


def overlap(a: list[Box], b: list[Box]) -> bool:
    """Whether two formulas share frequencies; fold changes are taken as able to hold together unless opposite."""
    return any(_meet(x, y) is not None for x in a for y in b)


def equivalent(a: list[Box], b: list[Box]) -> bool:
    """Whether two formulas without fold changes and substitutions hold for the same frequencies."""
    samples = sorted({s for x in a + b for s, _ in x.regions})
    grid = cells(a + b, samples)
    return all(holds(a, dict(zip(samples, p)), None) == holds(b, dict(zip(samples, p)), None) for p in itertools.product(*(grid[s] for s in samples)))
