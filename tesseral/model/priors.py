"""Prior probability of a combination of allele frequencies in all samples of a scenario.

Priors are computed on the driver, once per distinct combination of the scenario's grid, and
broadcast with it; nothing here depends on the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache
from itertools import product

from tesseral.formula.scenario import Scenario, ScenarioError

ZERO = -math.inf


def log_sum(xs: Sequence[float]) -> float:
    top = max(xs, default=ZERO)
    return top if top == ZERO else top + math.log(math.fsum(math.exp(x - top) for x in xs))


def log_not(x: float) -> float:
    """ln(1 - exp(x))."""
    if x >= 0:
        return ZERO
    return math.log(-math.expm1(x)) if x > -math.log(2) else math.log1p(-math.exp(x))


def _same(a: float, b: float) -> bool:
    return math.isclose(a, b, rel_tol=2.3e-16, abs_tol=2.3e-16)


def ln(p: float) -> float:
    return math.log(p) if p > 0 else ZERO


def somatic(ln_rate: float, vaf: float) -> float:
    """Flat over frequencies above zero, with the mutation rate; the rest of it for zero."""
    return log_not(ln_rate) if _same(vaf, 0.0) else ln_rate


def population(n_alt: int, n_all: int, ln_heterozygosity: float) -> float:
    """Chance of n_alt copies in a population sample: heterozygosity over n_alt; what remains for none."""
    if n_alt > 0:
        return ln_heterozygosity - math.log(n_alt)
    return log_not(log_sum([ln_heterozygosity - math.log(m) for m in range(1, n_all + 1)]))


def _drawn(n: int, marked: int, drawn: int, hits: int) -> float:
    """Hypergeometric chance of ``hits`` marked ones among ``drawn`` out of n."""
    if hits > marked or drawn - hits > n - marked:
        return ZERO
    return ln(math.comb(marked, hits) * math.comb(n - marked, drawn - hits) / math.comb(n, drawn))


def mendelian(parent_ploidies: tuple[int, int], child_ploidy: int, parent_alts: tuple[int, int], child_alt: int, rate: float) -> float:
    """Chance of a child's copies from those of its parents; copies beyond are mutations.

    A parent of odd ploidy passes on the smaller or the greater half.
    """

    def halves(n: int) -> list[int]:
        return [n // 2] if n % 2 == 0 else [n // 2, n // 2 + 1]

    terms, fits = [], False
    for a, b in product(halves(parent_ploidies[0]), halves(parent_ploidies[1])):
        if a + b != child_ploidy:
            continue
        fits = True
        for i, k in product(range(min(parent_alts[0], a) + 1), range(min(parent_alts[1], b) + 1)):
            new = child_alt - i - k
            if new >= 0:
                terms.append(_drawn(parent_ploidies[0], parent_alts[0], a, i) + _drawn(parent_ploidies[1], parent_alts[1], b, k) + (ln(rate) * new if new else 0.0))
    if not fits:
        raise ScenarioError(f"ploidies of parents {parent_ploidies} don't give a child of {child_ploidy}")
    return log_sum(terms)


class Prior:
    """Prior of a scenario on one contig and for one variant type.

    With ``absent_only`` all possible combinations but absence share its complement.
    ``heterozygosity`` and ``somatic_rate`` of the variant itself come before those of the
    scenario.
    """

    def __init__(self, scenario: Scenario, contig: str = "all", vartype: str = "SNV", absent_only: bool = False, heterozygosity: float | None = None, somatic_rate: float | None = None):
        self.scenario, self.contig, self.absent_only = scenario, contig, absent_only
        self.names = list(scenario.samples)
        self.at = {n: i for i, n in enumerate(self.names)}
        fraction = scenario.species.type_fraction(vartype)
        self.uniform = [scenario.samples[n].universe is not None for n in self.names]
        self.ploidy = [scenario.ploidy(n, contig) for n in self.names]
        self.universe = [scenario.universe(n, contig) for n in self.names]
        het = heterozygosity if heterozygosity is not None else None if scenario.species.heterozygosity is None else scenario.species.heterozygosity * fraction
        self.ln_het = None if het is None else ln(het)
        rates = [somatic_rate if somatic_rate is not None else None if scenario.somatic_rate(n) is None else scenario.somatic_rate(n) * fraction for n in self.names]
        self.ln_somatic = [None if r is None else ln(r) for r in rates]
        self.germline = [None if scenario.germline_rate(n) is None else scenario.germline_rate(n) * fraction for n in self.names]
        self.parents = [scenario.samples[n].inheritance for n in self.names]
        self._full = lru_cache(maxsize=None)(self._calculate)

    def check(self) -> None:
        """Inheritance needs the ploidies and rates that it works with."""
        for i, n in enumerate(self.names):
            how = self.parents[i]
            if how is None:
                continue
            if any(self.ploidy[self.at[p]] is None for p in how.parents):
                raise ScenarioError(f"the parents of {n} need a ploidy")
            if how.kind == "mendelian" and self.germline[i] is None:
                raise ScenarioError(f"{n} needs a germline mutation rate")
            if how.kind == "subclonal" and self.ln_somatic[i] is None:
                raise ScenarioError(f"{n} needs a somatic mutation rate")

    def __call__(self, vafs: Sequence[float]) -> float:
        """Log prior of one frequency per sample, in the order of their names."""
        vafs = tuple(float(v) for v in vafs)
        full = self._full(vafs)
        if not self.absent_only or all(self.uniform) or not any(vafs) or full == ZERO:
            return full
        return log_not(self._full((0.0,) * len(vafs)))

    def _germline_choices(self, i: int, vaf: float) -> list[float]:
        """Germline frequencies that sample i may have below its total."""
        n = self.ploidy[i]
        if n == 0 and vaf != 0:
            return []
        if self.uniform[i]:
            return [0.0] if self.universe[i].holds(vaf) else []
        if self.ln_somatic[i] is not None:
            if n is None:
                raise ScenarioError(f"{self.names[i]} has a somatic mutation rate but no ploidy")
            return [k / n for k in range(n + 1)] if n else [0.0]
        if n is not None and self.ln_het is not None:
            return [vaf] if n and _same(vaf * n, round(vaf * n)) or vaf == 0 else []
        raise ScenarioError(f"not enough about {self.names[i]} for a prior, and no universe")

    def _calculate(self, vafs: tuple[float, ...]) -> float:
        choices = [self._germline_choices(i, v) for i, v in enumerate(vafs)]
        return log_sum([self._given(vafs, g) for g in product(*choices)])

    def _given(self, vafs: tuple[float, ...], germline: tuple[float, ...]) -> float:
        out = 0.0
        if self.ln_het is not None:
            free = [i for i in range(len(vafs)) if self.parents[i] is None and self.ploidy[i] is not None and not self.uniform[i]]
            out += population(sum(round(self.ploidy[i] * germline[i]) for i in free), sum(self.ploidy[i] for i in free), self.ln_het)
        for i, how in enumerate(self.parents):
            if self.uniform[i]:
                continue
            rate, own = self.ln_somatic[i], vafs[i] - germline[i]
            if how is None:
                out += 0.0 if rate is None else somatic(rate, own)
            elif how.kind == "mendelian":
                ps = [self.at[p] for p in how.parents]
                count = lambda j: round(germline[j] * self.ploidy[j])
                out += mendelian((self.ploidy[ps[0]], self.ploidy[ps[1]]), self.ploidy[i], (count(ps[0]), count(ps[1])), count(i), self.germline[i])
                out += 0.0 if rate is None else somatic(rate, own)
            else:
                out += self._from_one(i, self.at[how.parents[0]], how, vafs, germline)
        return out

    def _from_one(self, i: int, p: int, how, vafs, germline) -> float:
        """Clonal and subclonal inheritance keep the germline; what is somatic depends on the kind."""
        if not _same(germline[i], germline[p]):
            return ZERO
        rate, own, of_parent = self.ln_somatic[i], vafs[i] - germline[i], vafs[p] - germline[p]
        kept = 0.0 if _same(own, of_parent) else ZERO
        if how.kind == "subclonal":
            if rate is None:
                return kept
            return somatic(rate, vafs[i]) if vafs[p] == 0 and germline[i] == 0 else 0.0
        if how.somatic:
            if rate is None:
                return kept
            return 0.0 if of_parent != 0 else somatic(rate, own)
        return 0.0 if rate is None else somatic(rate, own)


def prior_table(scenario: Scenario, contig: str = "all", vartype: str = "SNV", points: int = 5) -> list[tuple]:
    """(frequencies, linear prior) of every combination of the universes; intervals by ``points`` even steps."""
    prior = Prior(scenario, contig, vartype)

    def of(sample: str) -> list[float]:
        u = scenario.universe(sample, contig)
        steps = [v.lo + (v.hi - v.lo) * k / (points - 1) for v in u.intervals for k in range(points)]
        return sorted({*u.points, *steps})

    return [(vafs, math.exp(prior(vafs))) for vafs in product(*(of(s) for s in scenario.samples))]
