"""Sets of allele frequencies: points and intervals with open or closed ends.

Points carry mass of their own and intervals a density, so a region keeps both apart; a
point inside one of its intervals belongs to the interval.
"""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True, order=True)
class Interval:
    """Frequencies between two different ends."""

    lo: float
    hi: float
    lo_open: bool = False
    hi_open: bool = False

    def holds(self, x: float) -> bool:
        return (self.lo < x or (self.lo == x and not self.lo_open)) and (x < self.hi or (self.hi == x and not self.hi_open))

    def __str__(self) -> str:
        return f"{']' if self.lo_open else '['}{self.lo},{self.hi}{'[' if self.hi_open else ']'}"


@dataclass(frozen=True)
class Region:
    """Distinct points and disjoint intervals, each in ascending order."""

    points: tuple[float, ...] = ()
    intervals: tuple[Interval, ...] = ()

    @staticmethod
    def of(points=(), intervals=()) -> Region:
        """The canonical region: overlapping intervals are merged, empty ones dropped, covered points absorbed."""
        points = set(points)
        parts: list[Interval] = []
        for v in intervals:
            if v.lo == v.hi and not (v.lo_open or v.hi_open):
                points.add(v.lo)
            elif v.lo < v.hi:
                parts.append(v)
        merged: list[Interval] = []
        for v in sorted(parts, key=lambda v: (v.lo, v.lo_open)):
            if merged and (v.lo < merged[-1].hi or (v.lo == merged[-1].hi and not (v.lo_open and merged[-1].hi_open))):
                last = merged.pop()
                hi, hi_open = max((last.hi, not last.hi_open), (v.hi, not v.hi_open))
                merged.append(Interval(last.lo, hi, last.lo_open, not hi_open))
            else:
                merged.append(v)
        return Region(tuple(sorted(p for p in points if not any(v.holds(p) for v in merged))), tuple(merged))

    @staticmethod
    def point(x: float) -> Region:
        return Region((float(x),))

    def holds(self, x: float) -> bool:
        return x in self.points or any(v.holds(x) for v in self.intervals)

    def is_empty(self) -> bool:
        return not self.points and not self.intervals

    def is_full(self) -> bool:
        return self.intervals == (Interval(0.0, 1.0),)

    def __and__(self, other: Region) -> Region:
        points = [p for p in self.points if other.holds(p)] + [p for p in other.points if self.holds(p)]
        parts = []
        for a in self.intervals:
            for b in other.intervals:
                lo, lo_open = max((a.lo, a.lo_open), (b.lo, b.lo_open))
                hi, closed = min((a.hi, not a.hi_open), (b.hi, not b.hi_open))
                if lo <= hi:
                    parts.append(Interval(lo, hi, lo_open, not closed))
        return Region.of(points, parts)

    def __or__(self, other: Region) -> Region:
        return Region.of(self.points + other.points, self.intervals + other.intervals)

    def __sub__(self, other: Region) -> Region:
        parts = list(self.intervals)
        for cut in [Interval(p, p) for p in other.points] + list(other.intervals):
            rest = []
            for v in parts:
                hi, closed = min((v.hi, not v.hi_open), (cut.lo, cut.lo_open))
                left = Interval(v.lo, hi, v.lo_open, not closed)
                lo, lo_open = max((v.lo, v.lo_open), (cut.hi, not cut.hi_open))
                right = Interval(lo, v.hi, lo_open, v.hi_open)
                rest += [x for x in (left, right) if x.lo < x.hi or (x.lo == x.hi and not (x.lo_open or x.hi_open))]
            parts = rest
        return Region.of([p for p in self.points if not other.holds(p)], parts)

    def covers(self, other: Region) -> bool:
        return (other - self).is_empty()

    def __str__(self) -> str:
        return " | ".join([*(str(p) for p in self.points), *(str(v) for v in self.intervals)]) or "false"


FULL = Region((), (Interval(0.0, 1.0),))
EMPTY = Region()


def relation(a: Interval, b: Interval) -> str:
    """How interval a lies to b: Equal, Contained, Contains, Start (only a's start is in b), End (only its end) or None.

    An end shared by both counts as on the outer side of neither: a then begins or ends in b.
    """
    if a == b:
        return "Equal"
    if a.hi < b.lo or a.lo > b.hi or (a.hi == b.lo and (a.hi_open or b.lo_open)) or (a.lo == b.hi and (a.lo_open or b.hi_open)):
        return "None"
    starts_in = a.lo > b.lo or (a.lo == b.lo and a.lo_open and not b.lo_open)
    ends_in = a.hi < b.hi or (a.hi == b.hi and a.hi_open and not b.hi_open)
    return {(True, True): "Contained", (True, False): "Start", (False, True): "End", (False, False): "Contains"}[starts_in, ends_in]


#: Fixed value: pileups with fewer observations leave interval ends as they are.
LEAST_OBSERVATIONS = 10


def observable(v: Interval, n: int) -> tuple[float, float]:
    """Ends of an interval moved inwards to frequencies that ``n`` observations can show."""
    if n < LEAST_OBSERVATIONS or n * (v.hi - v.lo) <= 1:
        return v.lo, v.hi
    upper = n * v.hi
    upper = math.floor(upper - 1 if v.hi_open and upper % 1 == 0 else upper)
    hi = upper / n if upper else v.hi
    lower = n * v.lo
    if v.lo_open and lower % 1 == 0:
        tries = [math.ceil(lower + d) / n for d in (1, 0)]
        lo = next((x for x in tries if x <= 1 and x <= hi), math.ceil(lower) / n)
    else:
        lo = math.ceil(lower) / n
    return (v.lo if lo >= hi else lo), hi
