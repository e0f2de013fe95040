"""Groups of records that are linked directly or through others.

Deterministic Borůvka hooking: in each round every component selects its smallest
outgoing edge, the trees that this forms collapse by pointer doubling, and the edges
are relabelled and deduplicated; it ends when no edge is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.session import Scratch, lookup

#: Rows of one key from which a look-up takes the way for hot keys.
HOT_ROWS = 200_000


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", hot_rows: int = HOT_ROWS) -> DataFrame:
    """node and component (the smallest node of its group) of every node that has an edge.

    Edges have no direction; repeated edges count once; an edge with a null end is left
    out and a node with only a loop to itself forms its own component.

    An edge between components a < b has the rank (a, b), so the smallest outgoing edge
    of a component leads to its smallest neighbour.  Ranks differ, hence the chosen edges
    form trees, in each of which just one edge is chosen from both ends: its smaller end
    is the root and the smallest node of the tree.  Every round at least halves the
    components that still have edges, and the tables of a round are written, so that no plan
    grows with the rounds.  All steps are aggregations with partial sums on the
    map side and look-ups that a hub can't clog; each ends in a written table.
    """
    scratch = Scratch(edges.sparkSession)
    ends = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).dropna()
    every = scratch.table(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    live = every.where("u <> v")
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        chosen = scratch.table(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent")))
        # the edge chosen from both ends: its smaller end becomes the root; all others already skip one step
        up = lookup(scratch, chosen, "parent", chosen, "node", "parent", "up", hot_rows)
        rooted = F.col("node") == F.col("up")
        tree = scratch.table(up.select("node", F.when(rooted & (F.col("node") < F.col("parent")), F.col("node")).when(rooted, F.col("parent")).otherwise(F.col("up")).alias("parent"), (~rooted).alias("open")))
        # a step over the mutual edge may have led to the larger end; its own parent is the root then
        while not tree.where("open").isEmpty():
            up = lookup(scratch, tree, "parent", tree, "node", "parent", "up", hot_rows)
            doubled = scratch.table(up.select("node", F.col("up").alias("parent"), (F.col("up") != F.col("parent")).alias("open")))
            scratch.drop(tree)
            tree = doubled
        rounds.append(tree)
        one = scratch.table(lookup(scratch, live, "u", tree, "node", "parent", "a", hot_rows))
        two = lookup(scratch, one, "v", tree, "node", "parent", "b", hot_rows)
        left_over = scratch.table(two.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        scratch.keep_only(every, left_over, *rounds)
        live = left_over
    loops = every.where("u = v").select(F.col("u").alias("node"))
    if not rounds:
        return loops.select("node", F.col("node").alias("component"))
    # labels from the last round to the first: each round's table is looked up once, in the smaller one after it
    labels = rounds.pop().select("node", F.col("parent").alias("component"))
    while rounds:
        step = lookup(scratch, rounds.pop().select("node", "parent"), "parent", labels, "node", "component", "next", hot_rows)
        labels = scratch.table(step.select("node", F.coalesce("next", "parent").alias("component")))
    if loops.isEmpty():
        return labels
    alone = loops.join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return labels.unionByName(alone)


def _name(c):
    """A name without white space at its ends; blank and the dot are missing."""
    bare = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when((bare != "") & (bare != "."), bare)


def name_ties(records: DataFrame, record: str = "call_id", scope: str = "callset_id", name: str = "id", group: str = "event", mates: str = "mateid", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges (u, v) that tie records of one scope through names.

    Records are tied if they bear the same name, the same group name, or one's list of
    mates (comma-separated) has the other's name.  Instead of all pairs, every record gets
    one edge to the smallest record that bears the name: a star with the same components.
    A mate that no record of the scope bears ties nothing.  Rows with a null record or
    scope tie nothing.
    """
    base = records.select(F.col(record).alias("r"), F.col(scope).alias("s"), F.col(name).alias("n"), F.col(group).alias("g"), F.col(mates).alias("m")).where("r is not null and s is not null")
    own = F.struct(F.lit("i").alias("kind"), _name(F.col("n")).alias("name"), F.lit(True).alias("bears"))
    event = F.struct(F.lit("e").alias("kind"), _name(F.col("g")).alias("name"), F.lit(True).alias("bears"))
    mate = F.transform(F.split(F.coalesce("m", F.lit("")), ","), lambda x: F.struct(F.lit("i").alias("kind"), _name(x).alias("name"), F.lit(False).alias("bears")))
    rows = base.select("r", "s", F.explode(F.concat(F.array(own, event), mate)).alias("x")).where("x.name is not null").select("r", F.struct("s", "x.kind", "x.name").alias("key"), "x.bears").distinct()
    scratch = Scratch(records.sparkSession)
    rows = scratch.table(rows)
    first = scratch.table(rows.groupBy("key").agg(F.min(F.when(F.col("bears"), F.col("r"))).alias("first"), F.count("*").alias("n")).where("first is not null and n > 1").select("key", "first"))
    return lookup(scratch, rows.select("r", "key"), "key", first, "key", "first", "v", hot_rows).where("v is not null and r <> v").select(F.col("r").alias("u"), "v").distinct()


def tied_groups(records: DataFrame, record: str = "call_id", scope: str = "callset_id", name: str = "id", group: str = "event", mates: str = "mateid", hot_rows: int = HOT_ROWS) -> DataFrame:
    """record and group_id (smallest record of the group) of each record in a group of two or more."""
    ties = name_ties(records, record, scope, name, group, mates, hot_rows)
    return connected_components(ties, "u", "v", hot_rows).select(F.col("node").alias(record), F.col("component").alias("group_id"))


def all_groups(records: DataFrame, record: str = "call_id", **columns) -> DataFrame:
    """record and group_id of every record; one without ties is its own group."""
    tied = tied_groups(records, record, **columns)
    every = records.select(F.col(record)).where(F.col(record).isNotNull()).distinct()
    return every.join(tied, record, "left").select(record, F.coalesce("group_id", record).alias("group_id"))
