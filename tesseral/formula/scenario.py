"""Scenarios: samples, species, expressions and events of one analysis, read from YAML."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from itertools import combinations, pairwise
from pathlib import Path

import yaml

from tesseral.formula import normal
from tesseral.formula.regions import FULL, Interval, Region
from tesseral.formula.syntax import And, Atom, FormulaError, parse_formula, parse_universe


class ScenarioError(ValueError):
    """A scenario whose parts don't fit together."""


#: How much rarer than single-base changes the other variant types are, and the default resolution.
INDEL_FRACTION, MNV_FRACTION, SV_FRACTION = 0.0125, 0.001, 0.01
RESOLUTION = 0.01
_INDELS, _STRUCTURAL = ("INS", "DEL", "REP"), ("INV", "BND", "DUP")


def _known(d: Mapping, allowed: set[str], what: str) -> Mapping:
    extra = set(d) - allowed
    if extra:
        raise ScenarioError(f"unknown keys {sorted(extra)} in {what}")
    return d


@dataclass(frozen=True)
class Inheritance:
    """mendelian from two parents, or clonal or subclonal from one."""

    kind: str
    parents: tuple[str, ...]
    somatic: bool = False


@dataclass(frozen=True)
class Species:
    heterozygosity: float | None = None
    germline_mutation_rate: float | None = None
    somatic_rate: float | None = None
    indel: float = INDEL_FRACTION
    mnv: float = MNV_FRACTION
    sv: float = SV_FRACTION
    ploidy: object = None

    def type_fraction(self, vartype: str) -> float:
        return self.indel if vartype in _INDELS else self.mnv if vartype == "MNV" else self.sv if vartype in _STRUCTURAL else 1.0


@dataclass(frozen=True)
class Sample:
    name: str
    contaminated_by: str | None = None
    contamination: float = 0.0
    resolution: float = RESOLUTION
    universe: object = None
    somatic_rate: float | None = None
    germline_mutation_rate: float | None = None
    ploidy: object = None
    sex: str | None = None
    inheritance: Inheritance | None = None


def _by_contig(value, contig: str, what: str):
    if not isinstance(value, Mapping):
        return value
    if contig in value:
        return value[contig]
    if "all" in value:
        return value["all"]
    raise ScenarioError(f"no {what} for contig {contig}")


@dataclass
class Scenario:
    """Samples are in the order of their names; every event is also an expression, ``absent`` one too."""

    samples: dict[str, Sample]
    events: dict[str, object]
    expressions: dict[str, object] = field(default_factory=dict)
    species: Species = field(default_factory=Species)

    @staticmethod
    def from_yaml(text: str) -> Scenario:
        d = _known(yaml.safe_load(text), {"species", "samples", "expressions", "events"}, "scenario")
        samples = {}
        for name, s in sorted((d.get("samples") or {}).items()):
            s = _known(s or {}, {"contamination", "resolution", "universe", "somatic-effective-mutation-rate", "germline-mutation-rate", "ploidy", "sex", "inheritance"}, f"sample {name}")
            mix = _known(s.get("contamination") or {}, {"by", "fraction"}, f"contamination of {name}")
            resolution = float(s.get("resolution", RESOLUTION))
            if not 0 < resolution < 1:
                raise ScenarioError(f"resolution of {name} must be between 0 and 1")
            heritage = None
            if s.get("inheritance"):
                ((kind, how),) = s["inheritance"].items()
                parents = tuple(how["from"]) if kind == "mendelian" else (how["from"],)
                if kind not in ("mendelian", "clonal", "subclonal") or len(parents) != (2 if kind == "mendelian" else 1):
                    raise ScenarioError(f"inheritance of {name} is neither mendelian, clonal nor subclonal")
                heritage = Inheritance(kind, parents, bool(how.get("somatic", False)))
            universe = s.get("universe")
            if universe is not None:
                universe = {str(k): parse_universe(v) for k, v in universe.items()} if isinstance(universe, Mapping) else parse_universe(universe)
            samples[name] = Sample(name, mix.get("by"), float(mix.get("fraction", 0.0)), resolution, universe, _number(s.get("somatic-effective-mutation-rate")), _number(s.get("germline-mutation-rate")), s.get("ploidy"), s.get("sex"), heritage)
        if not samples:
            raise ScenarioError("a scenario needs a sample")
        sp = _known(d.get("species") or {}, {"heterozygosity", "germline-mutation-rate", "somatic-effective-mutation-rate", "variant-fractions", "ploidy", "genome-size"}, "species")
        fractions = _known(sp.get("variant-fractions") or {}, {"indel", "mnv", "sv"}, "variant-fractions")
        species = Species(
            _number(sp.get("heterozygosity")), _number(sp.get("germline-mutation-rate")), _number(sp.get("somatic-effective-mutation-rate")),
            float(fractions.get("indel", INDEL_FRACTION)), float(fractions.get("mnv", MNV_FRACTION)), float(fractions.get("sv", SV_FRACTION)), sp.get("ploidy"),
        )
        events = {str(k): parse_formula(v) for k, v in sorted((d.get("events") or {}).items())}
        out = Scenario(samples, events, {str(k): parse_formula(v) for k, v in (d.get("expressions") or {}).items()}, species)
        for name, f in events.items():
            out.expressions.setdefault(name, f)
        out.expressions.setdefault("absent", out.absent())
        for s in samples.values():
            for other in (s.contaminated_by, *(s.inheritance.parents if s.inheritance else ())):
                if other is not None and other not in samples:
                    raise ScenarioError(f"{s.name} refers to unknown sample {other}")
        return out

    @staticmethod
    def from_path(path: str) -> Scenario:
        return Scenario.from_yaml(Path(path).read_text())

    def absent(self):
        """The formula of absence: frequency 0 in every sample."""
        return And(tuple(Atom(s, Region.point(0.0)) for s in self.samples))

    def ploidy(self, sample: str, contig: str) -> int | None:
        """The sample's own ploidy, else that of its species, by sex where that is given."""
        s = self.samples[sample]
        if s.ploidy is not None:
            return _by_contig(s.ploidy, contig, f"ploidy of {sample}")
        p = self.species.ploidy
        if isinstance(p, Mapping) and any(isinstance(v, Mapping) for v in p.values()):
            if s.sex is None:
                raise ScenarioError(f"the species' ploidy is given by sex, but {sample} has none")
            if s.sex not in p:
                raise ScenarioError(f"no ploidy for sex {s.sex}")
            p = p[s.sex]
        return None if p is None else _by_contig(p, contig, "ploidy of the species")

    def somatic_rate(self, sample: str) -> float | None:
        own = self.samples[sample].somatic_rate
        return self.species.somatic_rate if own is None else own

    def germline_rate(self, sample: str) -> float | None:
        own = self.samples[sample].germline_mutation_rate
        return self.species.germline_mutation_rate if own is None else own

    def universe(self, sample: str, contig: str = "all") -> Region:
        """Possible frequencies: the given universe, else those of the ploidy, with what lies between where the sample mutates."""
        if sample not in self.samples:
            raise ScenarioError(f"unknown sample {sample}")
        s = self.samples[sample]
        if s.universe is not None:
            return _by_contig(s.universe, contig, f"universe of {sample}")
        n = self.ploidy(sample, contig)
        if n is None:
            if s.somatic_rate is None:
                raise ScenarioError(f"{sample} needs a universe, a ploidy or a somatic mutation rate")
            return FULL
        points = sorted({k / n for k in range(n + 1)} if n else {0.0})
        between = [Interval(a, b, True, True) for a, b in pairwise(points)] if s.somatic_rate is not None else []
        return Region.of(points, between)

    def boxes(self, event: str, contig: str = "all") -> list[normal.Box]:
        """Normal form of an event; unknown samples in it are an error."""
        out = normal.normalise(self.events[event], lambda s: self.universe(s, contig), self.expressions)
        unknown = {s for b in out for s, _ in b.regions} - set(self.samples)
        unknown |= {s for b in out for c in b.conditions for s in (getattr(c, "a", None), getattr(c, "b", None)) if s} - set(self.samples)
        if unknown:
            raise ScenarioError(f"event {event} refers to unknown samples {sorted(unknown)}")
        return out

    def validate(self, contig: str = "all") -> None:
        """Events must not share frequencies within the universe of their samples."""
        limits = normal.Box(tuple((s, self.universe(s, contig)) for s in self.samples))
        forms = {e: [m for b in self.boxes(e, contig) if (m := normal._meet(b, limits)) is not None] for e in self.events if e != "absent"}
        for a, b in combinations(forms, 2):
            if forms[a] and forms[b] and not any(x.conditions for x in forms[a] + forms[b]) and normal.overlap(forms[a], forms[b]):
                raise ScenarioError(f"events {a} and {b} overlap")


def _number(x) -> float | None:
    return None if x is None else float(x)


#: Fixed value: the scenario of a tumor and its normal sample.
TUMOR_NORMAL = """
samples:
  tumor:
    resolution: 0.01
    contamination:
      by: normal
      fraction: {impurity}
    universe: "[0.0,1.0]"
  normal:
    resolution: 0.1
    universe: "[0.0,0.5[ | 0.5 | 1.0"
events:
  somatic_tumor: "tumor:]0.0,1.0] & normal:0.0"
  somatic_normal: "tumor:]0.0,1.0] & normal:]0.0,0.5["
  germline_het: "tumor:]0.0,1.0] & normal:0.5"
  germline_hom: "tumor:]0.0,1.0] & normal:1.0"
"""


def tumor_normal(purity: float) -> Scenario:
    """The built-in scenario of a tumor of some purity and its normal sample."""
    if not 0 < purity <= 1:
        raise ScenarioError("purity must be above 0 and at most 1")
    return Scenario.from_yaml(TUMOR_NORMAL.format(impurity=1.0 - purity))


__all__ = ["FormulaError", "Scenario", "ScenarioError", "tumor_normal"]
