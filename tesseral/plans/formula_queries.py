"""Queries of the formula language: each construct as a predicate on frequencies, and its passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.formula import columns, normal
from tesseral.formula.regions import observable
from tesseral.formula.scenario import Scenario, tumor_normal
from tesseral.formula.syntax import FormulaError, parse_formula, parse_universe
from tesseral.plans import views as v

SCENARIO = """
samples:
  f: {universe: "[0.0,1.0]", resolution: 0.1}
  o: {universe: "0.0 | 0.5 | 1.0 | ]0.0,0.5["}
expressions:
  low: "f:[0.0,0.5]"
  odd: "!$low"
events:
  both: "f:]0.0,1.0] & o:]0.0,1.0]"
"""


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part and status the share of its lines of high discount, 0 without lines; with two letters as alleles."""
    high = F.col("l_discount") > 0.045
    share = lambda s: F.coalesce(F.count_if(high & (F.col("l_linestatus") == s)) / F.nullif(F.count_if(F.col("l_linestatus") == s), F.lit(0)), F.lit(0.0))
    got = v.read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(share("F").alias("f"), share("O").alias("o"))
    letter = lambda c: F.element_at(F.array(*(F.lit(x) for x in "ACGT")), (c % 4 + 1).cast("int"))
    return got.withColumns({"ref": letter(F.col("l_partkey")), "alt": letter(F.floor(F.col("l_partkey") / 4))})


def _where(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    scenario = Scenario.from_yaml(SCENARIO)
    boxes = normal.normalise(parse_formula(text), scenario.universe, scenario.expressions)
    table = _frequencies(spark, sf_dir)
    return table.where(columns.holds(boxes, {"f": F.col("f"), "o": F.col("o")}, F.col("ref"), F.col("alt"))).select("l_partkey")


#: Construct, formula and the same as SQL.
CONSTRUCTS = {
    "i_formula_atom": ("f:0.5", "f = 0.5"),
    "i_formula_set": ("f:{0.0, 0.5, 1.0}", "f IN (0, 0.5, 1)"),
    "i_formula_range": ("f:]0.2,0.8[", "f > 0.2 AND f < 0.8"),
    "i_formula_and": ("f:[0.0,0.5] & o:]0.0,1.0]", "f <= 0.5 AND o > 0"),
    "i_formula_or": ("f:0.0 | (o:1.0 | f:[0.9,1.0])", "f = 0 OR o = 1 OR f >= 0.9"),
    "i_formula_not": ("!(f:[0.0,0.3[ & o:0.0)", "f >= 0.3 OR (o > 0 AND o <= 0.5) OR o = 1"),
    "i_formula_expression": ("$odd & !f:1.0", "f > 0.5 AND f < 1"),
    "i_formula_change": ("(A>G) & f:]0.0,1.0]", "ref = 'A' AND alt = 'G' AND f > 0"),
    "i_formula_iupac": ("!(R>Y) & f:0.0", "NOT (ref IN ('A', 'G') AND alt IN ('C', 'T')) AND f = 0"),
    "i_formula_cmp": ("f >= o", "CASE WHEN f = 0 AND o = 0 THEN true WHEN o = 0 THEN true WHEN f = 0 THEN false ELSE log2(f) - log2(o) >= 0 END"),
    "i_formula_l2fc": ("l2fc(f, o) < -0.5 & o:]0.0,1.0]", "o > 0 AND (f = 0 OR log2(f) - log2(o) < -0.5)"),
    "i_formula_constants": ("(f:0.0 & true) | false /* nothing */", "f = 0"),
}


def _construct(text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _where(spark, sf_dir, text)

    return query


def i_formula_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of parts for which each formula holds: all constructs in one pass over the frequencies."""
    scenario = Scenario.from_yaml(SCENARIO)
    table = _frequencies(spark, sf_dir)
    hits = [F.count_if(columns.holds(normal.normalise(parse_formula(t), scenario.universe, scenario.expressions), {"f": F.col("f"), "o": F.col("o")}, F.col("ref"), F.col("alt"))).alias(n) for n, (t, _) in CONSTRUCTS.items()]
    return table.agg(*hits)


def i2_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousandths that lie in a universe of a point, a range and a set."""
    u = parse_universe("0.25 | ]0.5,0.75] | {0.0, 1.0}")
    return spark.createDataFrame([(k,) for k in range(1001) if u.holds(k / 1000)], "thousandth int")


def i4_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested expressions resolve, cycles and unknown names don't."""
    forms = {"a": parse_formula("$b & f:0.5"), "b": parse_formula("o:0.0"), "c": parse_formula("$d"), "d": parse_formula("!$c")}

    def ok(name: str) -> bool:
        try:
            normal.expand(parse_formula(f"${name}"), forms)
            return True
        except FormulaError:
            return False

    return spark.createDataFrame([(n, ok(n)) for n in ("a", "b", "c", "nowhere")], "name string, resolves boolean")


def i7_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested ranges of one sample come out as two."""
    s = Scenario.from_yaml('samples: {normal: {universe: "[0.0,1.0]"}}\nevents: {full: "(normal:[0.0, 0.25] | normal:[0.5,0.6]) | ((normal:[0.25,0.5] | normal:[0.7,0.9]) | normal:[0.9,1.0]) | normal:]0.8,0.9[ | normal:0.75"}')
    (box,) = s.boxes("full")
    return spark.createDataFrame([(i.lo, i.hi) for i in box.region("normal").intervals], "lo double, hi double")


def i10_universes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Universes by ploidy and somatic rate on three contigs, counted in points and ranges."""
    s = Scenario.from_yaml("""
species: {ploidy: {male: {all: 2, X: 1, Y: 1}, female: {all: 2, X: 2, Y: 0}}}
samples: {a: {sex: male}, b: {sex: female, somatic-effective-mutation-rate: 1e-6}}
events: {e: "a:0.5"}""")
    rows = [(n, c, len(s.universe(n, c).points), len(s.universe(n, c).intervals)) for n in "ab" for c in ("1", "X", "Y")]
    return spark.createDataFrame(rows, "sample string, contig string, n_points int, n_ranges int")


def i11_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint boxes of the events of the built-in tumor and normal scenario."""
    s = tumor_normal(0.75)
    rows = [(e, str(b)) for e in s.events for b in s.boxes(e)]
    return spark.createDataFrame(rows, "event string, box string")


def i12_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event of the built-in scenario that holds each pair of frequencies of a grid."""
    s = tumor_normal(0.75)
    boxes = {e: s.boxes(e) for e in s.events}
    rows = [(t, n, next((e for e, b in boxes.items() if normal.holds(b, {"tumor": t / 10, "normal": n / 10})), None)) for t in range(11) for n in range(11)]
    return spark.createDataFrame(rows, "tumor int, normal int, event string")


def i13_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether scenarios are refused for events that overlap."""
    rows = []
    for name, second in (("same", "s:[0.0,0.5]"), ("touching", "s:]0.5,1.0]"), ("inside", "s:0.3")):
        s = Scenario.from_yaml(f'samples: {{s: {{universe: "[0.0,1.0]"}}}}\nevents: {{a: "s:[0.0,0.5]", b: "{second}"}}')
        try:
            s.validate()
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, refused boolean")


def i14_observable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of ]0,1], [0.25,0.5[ and ]0.33,0.34] that pileups of several depths can show."""
    from tesseral.formula.regions import Interval

    rows = [(n, k, *observable(i, n)) for n in (5, 10, 20, 37) for k, i in enumerate((Interval(0.0, 1.0, True), Interval(0.25, 0.5, False, True), Interval(0.33, 0.34, True)))]
    return spark.createDataFrame(rows, "n int, k int, lo double, hi double")


QUERIES = {n: _construct(t) for n, (t, _) in CONSTRUCTS.items()} | v.named(i_formula_events, i2_universe, i4_expand, i7_merge, i10_universes, i11_paths, i12_contains, i13_overlaps, i14_observable)

_FREQ = """hi AS (SELECT *, l_discount > 0.045 AS h FROM lineitem), fr AS (SELECT l_partkey, coalesce(count(*) FILTER (h AND l_linestatus = 'F') / nullif(count(*) FILTER (l_linestatus = 'F'), 0), 0) AS f,
    coalesce(count(*) FILTER (h AND l_linestatus = 'O') / nullif(count(*) FILTER (l_linestatus = 'O'), 0), 0) AS o, (['A', 'C', 'G', 'T'])[l_partkey % 4 + 1] AS ref, (['A', 'C', 'G', 'T'])[l_partkey // 4 % 4 + 1] AS alt FROM hi GROUP BY l_partkey)"""
ORACLE = {n: f"WITH {_FREQ} SELECT l_partkey FROM fr WHERE {w}" for n, (_, w) in CONSTRUCTS.items()} | {
    "i_formula_events": f"WITH {_FREQ} SELECT " + ", ".join(f"count(*) FILTER ({w}) AS {n}" for n, (_, w) in CONSTRUCTS.items()) + " FROM fr",
    "i2_universe": "SELECT CAST(range AS INT) AS thousandth FROM range(1001) WHERE range IN (0, 250, 1000) OR (range > 500 AND range <= 750)",
    "i4_expand": "SELECT unnest(['a', 'b', 'c', 'nowhere']) AS name, unnest([true, true, false, false]) AS resolves",
    "i7_merge": "SELECT unnest([0.0::DOUBLE, 0.7]) AS lo, unnest([0.6::DOUBLE, 1.0]) AS hi",
    "i10_universes": "SELECT unnest(['a', 'a', 'a', 'b', 'b', 'b']) AS sample, unnest(['1', 'X', 'Y', '1', 'X', 'Y']) AS contig, unnest([3, 2, 2, 3, 3, 1]) AS n_points, unnest([0, 0, 0, 2, 2, 0]) AS n_ranges",
    "i11_paths": "SELECT unnest(['germline_het', 'germline_hom', 'somatic_normal', 'somatic_tumor']) AS event, unnest(['normal:(0.5) & tumor:(]0.0,1.0])', 'normal:(1.0) & tumor:(]0.0,1.0])', 'normal:(]0.0,0.5[) & tumor:(]0.0,1.0])', 'normal:(0.0) & tumor:(]0.0,1.0])']) AS box",
    "i12_contains": "SELECT CAST(t AS INT) AS tumor, CAST(n AS INT) AS normal, CASE WHEN t = 0 THEN NULL WHEN n = 0 THEN 'somatic_tumor' WHEN n < 5 THEN 'somatic_normal' WHEN n = 5 THEN 'germline_het' WHEN n = 10 THEN 'germline_hom' END AS event FROM (SELECT unnest(range(11)) AS t), (SELECT unnest(range(11)) AS n)",
    "i13_overlaps": "SELECT unnest(['same', 'touching', 'inside']) AS name, unnest([true, false, true]) AS refused",
}
