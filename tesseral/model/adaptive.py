"""Integrals over a frequency whose grid follows each variant's own density.

The search for the maximum runs for all variants at once: each round evaluates three new
frequencies per variant as sums over its observations (partial aggregates, so that no pileup
is gathered), and narrows each variant's bracket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.model import likelihood
from tesseral.model import observations as ob
from tesseral.session import Scratch


def adaptive_integral(obs: DataFrame, lo: float, hi: float, resolution: float, variant: str = "variant") -> DataFrame:
    """``variant``, ``ln_integral`` of the likelihood over [lo, hi], ``best`` (the frequency of the highest point visited) and ``n_points``.

    Bracketing: of the ends, the middle and the middles of both halves the likeliest is kept
    with its neighbours until the bracket is within ``resolution``; then a point in the arm
    left first and three at either side of the middle, a resolution apart, are added.  The
    integral is by trapezoids over all points visited.
    """
    base = ob.standard(obs, variant).withColumnRenamed("variant", "__v")
    scratch = Scratch(obs.sparkSession)
    rounds = max(1, math.ceil(math.log2(max((hi - lo) / resolution, 1.0))) + 2)
    kind = dict(base.dtypes)["__v"]

    def evaluate(state: DataFrame, xs: list[Column]) -> DataFrame:
        """The state with (x, ll) of further points added to ``seen``."""
        asked = state.select(F.col("variant"), *(x.alias(f"x{i}") for i, x in enumerate(xs)))
        met = base.join(asked, F.col("__v") == F.col("variant"))
        sums = met.groupBy("variant").agg(*(F.max(f"x{i}").alias(f"x{i}") for i in range(len(xs))), *(F.sum(likelihood.observation(F.col(f"x{i}"))).alias(f"l{i}") for i in range(len(xs))))
        new = F.array(*(F.struct(F.col(f"x{i}").alias("x"), F.col(f"l{i}").alias("ll")) for i in range(len(xs))))
        got = sums.select(F.col("variant").alias("__k"), new.alias("__new"))
        return state.join(got, F.col("variant") == F.col("__k")).withColumn("seen", F.concat("seen", "__new")).drop("__k", "__new")

    empty = F.array().cast("array<struct<x:double,ll:double>>")
    state = base.select(F.col("__v").cast(kind).alias("variant")).distinct().withColumns({"left": F.lit(float(lo)), "right": F.lit(float(hi)), "seen": empty})
    state = scratch.table(evaluate(state, [F.lit(float(lo)), F.lit(float(hi))]).withColumn("middle", F.lit((lo + hi) / 2)))
    at = lambda x: F.element_at(F.filter("seen", lambda p: p["x"] == x), 1)["ll"]
    for k in range(rounds):
        left, right = F.col("left"), F.col("right")
        middle = (left + right) / 2
        narrow = (right - left >= resolution) & (left < right) if k else F.lit(True)
        live = state.where(narrow)
        if k and live.isEmpty():
            break
        m1, m2 = (left + middle) / 2, (middle + right) / 2
        step = evaluate(live, [middle, m1, m2])
        points = [left, m1, m2, right]
        values = [at(x) for x in points]
        top = F.greatest(*values)
        best = F.when(values[0] == top, 0).when(values[1] == top, 1).when(values[2] == top, 2).otherwise(3)
        pick = lambda i: F.when(i <= 0, points[0]).when(i == 1, points[1]).when(i == 2, points[2]).otherwise(points[3])
        moved = step.withColumns({"middle": middle, "__l": pick(best - 1), "__r": pick(best + 1)}).withColumns({"left": F.col("__l"), "right": F.col("__r")}).drop("__l", "__r")
        fresh = scratch.table(moved.unionByName(state.where(~narrow)))
        scratch.keep_only(fresh)
        state = fresh
    first = (lo + hi) / 2
    arm = F.when(F.col("middle") < first, (first + hi) / 2).otherwise((lo + first) / 2)
    low, high = F.greatest(F.col("middle") - 3 * resolution, F.lit(float(lo))), F.least(F.col("middle") + 3 * resolution, F.lit(float(hi)))
    near = [low + (F.col("middle") - low) * i / 3 for i in range(3)] + [F.col("middle") + (high - F.col("middle")) * i / 3 for i in (1, 2, 3)]
    state = evaluate(state, [arm, *near])
    points = F.array_sort(F.array_distinct("seen"))
    state = state.withColumn("p", points)
    top = F.array_max(F.transform("p", lambda x: x["ll"]))
    state = state.withColumn("__top", top)
    area = F.expr("aggregate(sequence(2, size(p)), 0D, (a, i) -> a + (p[i - 1].x - p[i - 2].x) * (exp(p[i - 1].ll - __top) + exp(p[i - 2].ll - __top)) / 2)")
    best = F.expr("filter(p, x -> x.ll = __top)[0].x")
    return state.select("variant", (F.col("__top") + F.ln(area)).alias("ln_integral"), best.alias("best"), F.size("p").alias("n_points"))
