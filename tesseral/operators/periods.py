"""Continuous periods and gaps of intervals per entity.

Within a tile of positions the starts and the ends are sorted independently: before the
start of rank k + 1 there is a gap where it exceeds the end of rank k.  Tiles make the
sort of an entity with any number of intervals a distributed one; how far earlier tiles
reach is carried into each tile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.session import Scratch

#: Positions per tile.  After a tile's intervals are reduced to one per start it holds at most so many.
TILE = 1 << 20


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"__{k}"])
    return cond


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, tile: int = TILE) -> DataFrame:
    """The keys, ``kind``, ``first_pos`` and ``last_pos`` of all periods and gaps.

    Intervals are closed at both ends and of whole numbers; those that overlap or directly
    adjoin form one period, and between two successive periods of an entity is a gap.
    Intervals with a null end or an end before their start cover nothing.  Repeated rows
    change nothing; an entity with null keys is an entity like any other.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    keys = list(keys)
    base = df.select(*keys, F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("s is not null and e is not null and e >= s")
    # of the intervals with one start only the longest matters; this sums up on the map side
    longest = base.groupBy(*keys, "s").agg(F.max("e").alias("e")).withColumn("tile", F.expr(f"s div {int(tile)}") - F.when(F.col("s") < 0, 1).otherwise(0))
    ranked = longest.groupBy(*keys, "tile").agg(F.sort_array(F.collect_list("s")).alias("S"), F.sort_array(F.collect_list("e")).alias("E"))
    local = ranked.select(
        *keys,
        "tile",
        F.expr("filter(S, (x, i) -> i = 0 or try_subtract(x, 1L) > E[i - 1])").alias("starts"),
        F.expr("filter(E, (x, i) -> i = size(E) - 1 or try_subtract(S[i + 1], 1L) > x)").alias("ends"),
        F.expr("E[size(E) - 1]").alias("reach"),
    )
    local = scratch.table(local)
    slim = local.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("tile").alias("__tile"), "reach")
    entity = Window.partitionBy(*(f"__{k}" for k in keys))
    before = entity.orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = slim.select(*(f"__{k}" for k in keys), "__tile", F.max("reach").over(before).alias("carry"), F.max("reach").over(entity).alias("final"))
    seen = local.join(carried, _same(local, carried, [*keys, "tile"])).select(*keys, "tile", "starts", "ends", "carry", "final")
    seen = seen.withColumn("swallowed", F.expr("size(filter(starts, x -> carry is not null and try_subtract(x, 1L) <= carry))")).where("swallowed < size(starts)")
    seen = seen.withColumn("gap_end", F.expr("greatest(carry, if(swallowed > 0, ends[swallowed - 1], null))"))
    seen = scratch.table(seen)
    scratch.keep_only(seen)
    inner = F.expr(
        """filter(flatten(transform(starts, (x, i) -> array(
             named_struct('kind', 'period', 'first_pos', if(i >= swallowed and i < size(starts) - 1, x, null), 'last_pos', ends[i]),
             named_struct('kind', 'gap', 'first_pos', case when i > swallowed then ends[i - 1] + 1 when i = swallowed then gap_end + 1 end, 'last_pos', try_subtract(x, 1L))
           ))), r -> r.first_pos is not null)"""
    )
    within = seen.select(*keys, F.explode(inner).alias("r")).select(*keys, "r.kind", "r.first_pos", "r.last_pos")
    following = Window.partitionBy(*keys).orderBy("tile")
    open_end = seen.select(*keys, "tile", F.expr("starts[size(starts) - 1]").alias("first_pos"), "gap_end", "final")
    across = open_end.select(*keys, F.lit("period").alias("kind"), "first_pos", F.coalesce(F.lead("gap_end").over(following), "final").alias("last_pos"))
    return within.unionByName(across)


def structural_spans(calls: DataFrame) -> DataFrame:
    """callset_id, chrom, pos and last_pos that a structural record covers (svtype DEL, DUP, INV or CNV)."""
    last = F.coalesce(F.col("end_pos"), F.expr("try_add(pos, abs(cast(svlen as bigint)))"))
    return calls.where(F.col("svtype").isin("DEL", "DUP", "INV", "CNV") & F.col("chrom").isNotNull()).select("callset_id", "chrom", "pos", last.alias("last_pos"))
