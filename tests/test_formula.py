import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesseral.formula import normal
from tesseral.formula.regions import FULL, Interval, Region, observable, relation
from tesseral.formula.scenario import Scenario, ScenarioError, tumor_normal
from tesseral.formula.syntax import FormulaError, parse_formula, parse_universe

ENDS = [k / 8 for k in range(9)]
INTERVALS = st.builds(lambda a, b, c, d: Interval(min(a, b), max(a, b), c, d), st.sampled_from(ENDS), st.sampled_from(ENDS), st.booleans(), st.booleans())
REGIONS = st.builds(Region.of, st.lists(st.sampled_from(ENDS), max_size=3), st.lists(INTERVALS, max_size=3))
PROBES = sorted({*ENDS, *(k / 16 for k in range(17))})


@settings(max_examples=300, deadline=None)
@given(REGIONS, REGIONS)
def test_regions_agree_with_membership(a, b):
    for x in PROBES:
        assert (a & b).holds(x) == (a.holds(x) and b.holds(x))
        assert (a | b).holds(x) == (a.holds(x) or b.holds(x))
        assert (a - b).holds(x) == (a.holds(x) and not b.holds(x))


ATOMS = st.builds(lambda s, r: f"{s}:{r}", st.sampled_from("ab"), st.sampled_from(["0.0", "0.5", "]0.25,0.75]", "[0.0,0.5[", "{0.5, 1.0}"]))
FORMULAS = st.recursive(ATOMS, lambda inner: st.one_of(st.builds(lambda x: f"!({x})", inner), st.builds(lambda x, y: f"({x} & {y})", inner, inner), st.builds(lambda x, y: f"({x} | {y})", inner, inner)), max_leaves=6)


def plain(tree, vafs):
    kind = type(tree).__name__
    if kind == "Atom":
        return tree.region.holds(vafs[tree.sample])
    if kind == "Not":
        return not plain(tree.operand, vafs)
    return (all if kind == "And" else any)(plain(x, vafs) for x in tree.operands)


@settings(max_examples=150, deadline=None)
@given(FORMULAS)
def test_normal_form_holds_where_the_formula_does_and_boxes_are_disjoint(text):
    tree = parse_formula(text)
    boxes = normal.normalise(tree, lambda s: FULL)
    for a, b in itertools.product(PROBES[::2] + [0.3, 0.6], repeat=2):
        hits = sum(normal.holds([x], {"a": a, "b": b}) for x in boxes)
        assert hits == int(plain(tree, {"a": a, "b": b}))


def test_vectors_of_normal_forms():
    s = Scenario.from_yaml(
        """
species:
  heterozygosity: 0.001
  germline-mutation-rate: 1e-3
  ploidy: {male: {all: 2, X: 1, Y: 1}, female: {all: 2, X: 2, Y: 0}}
  genome-size: 3.5e9
samples:
  tumor: {sex: female, somatic-effective-mutation-rate: 1e-6, inheritance: {clonal: {from: normal, somatic: false}}, contamination: {by: normal, fraction: 0.11}}
  normal: {sex: female, somatic-effective-mutation-rate: 1e-10}
expressions:
  loh: "normal:0.5 & tumor:1.0"
  loh_or_amplification: "normal:0.5 & tumor:[0.9,1.0["
events:
  germline: "(normal:0.5 | normal:1.0) & !($loh | $loh_or_amplification)"
  expected: "(normal:0.5 & tumor:{0.0, 0.5}) | (normal:0.5 & tumor:]0.0,0.5[) | (normal:0.5 & tumor:]0.5,0.9[) | normal:1.0"
"""
    )
    limits = [normal.Box(tuple((n, s.universe(n)) for n in s.samples))]
    within = lambda e: [m for b in s.boxes(e) if (m := normal._meet(b, limits[0]))]
    assert normal.equivalent(within("germline"), within("expected"))
    one = lambda text: normal.normalise(parse_formula(text), lambda x: FULL)
    assert one("n:[0.0,0.7] & n:[0.3,1.0]") == one("n:[0.3,0.7]")
    assert one("(n:[0.0, 0.25] | n:[0.5,0.75]) | (n:[0.25,0.5] | n:[0.75,1.0]) | n:[0.1,0.4] | n:0.1") == one("n:[0.0,1.0]")
    assert (Region.of((), [Interval(0.0, 0.7, False, True)]) & Region.of((), [Interval(0.3, 1.0)])).intervals == (Interval(0.3, 0.7, False, True),)


def test_syntax_errors():
    for bad in ("a:0.5 & b:0.5 | c:0.5", "a:2.0", "a:{0.5}", "a:", "a:0.5 b:0.5", "$x &", "l2fc(a, b) > x"):
        with pytest.raises(FormulaError):
            parse_formula(bad)
    with pytest.raises(FormulaError):
        parse_universe("0.5 & 0.6")


def test_scenario_errors():
    for text in ("samples: {a: {universe: '0.5', nonsense: 1}}\nevents: {}", "samples: {a: {universe: '0.5', resolution: 1.0}}\nevents: {}", "samples: {a: {universe: '0.5', contamination: {by: z, fraction: 0.1}}}\nevents: {}"):
        with pytest.raises(ScenarioError):
            Scenario.from_yaml(text)
    s = Scenario.from_yaml('samples: {a: {universe: {all: "0.5", X: "1.0"}}}\nevents: {e: "b:0.5"}')
    assert s.universe("a", "X").points == (1.0,) and s.universe("a", "7").points == (0.5,)
    with pytest.raises(ScenarioError):
        s.boxes("e")
    with pytest.raises(ScenarioError):
        tumor_normal(0.0)


def test_observable_ends_and_relations():
    assert observable(Interval(0.0, 1.0, True), 5) == (0.0, 1.0)
    assert observable(Interval(0.0, 1.0, True), 10) == (0.1, 1.0)
    assert observable(Interval(0.25, 0.5, False, True), 20) == (0.25, 0.45)
    assert relation(Interval(0.0, 0.5), Interval(0.0, 1.0)) == "End"
    assert relation(Interval(0.5, 1.0), Interval(0.0, 1.0)) == "Start"
    assert relation(Interval(0.0, 0.5, False, True), Interval(0.5, 1.0)) == "None"
