"""Percentiles of very large columns by mergeable digests of a dyadic tree.

Values are quantised to a bounded ordered universe: the leading bits of their floating
point form, which sort like the numbers.  Counts sit at the leaves of the dyadic tree
over that universe; compression moves the counts of light siblings to their parent.
Two digests merge by adding the counts of equal nodes, whatever day, file or partition
they come from.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.session import Scratch

#: Bits of the universe: sign, 11 of the exponent, 12 of the fraction.
BITS = 24
#: A quantised value stands for an interval whose ends differ by at most this share.
VALUE_ERROR = 2.0**-12
#: Default bound of the rank error, as a share of the values of the group.
RANK_ERROR = 0.005
#: Nodes of one group that a task merges at most; a group with more is first merged in parts.
NODES_PER_TASK = 1_000_000
#: Values, and nodes of digests, that a task holds before it compresses, or hands over, all its groups.
HELD_VALUES, HELD_NODES = 2_000_000, 4_000_000
DEFAULT_PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def quantise(values: np.ndarray) -> np.ndarray:
    """Leaf (0 .. 2**BITS - 1) of each finite value, in the order of the values; -0.0 counts as 0.0."""
    raw = (values.astype(np.float64) + 0.0).view(np.int64)
    ordered = np.where(raw < 0, ~raw, raw ^ np.int64(-(2**63))).view(np.uint64)
    return (ordered >> np.uint64(64 - BITS)).astype(np.int64)


def value_of(leaf: np.ndarray) -> np.ndarray:
    """The smallest value in magnitude of each leaf's interval; exact for whole numbers up to 2**13."""
    lo = np.asarray(leaf, dtype=np.uint64) << np.uint64(64 - BITS)
    positive = lo >= np.uint64(2**63)
    up = lo | np.uint64(2 ** (64 - BITS) - 1)
    raw = np.where(positive, lo ^ np.uint64(2**63), ~up)
    return raw.view(np.float64) if raw.dtype == np.uint64 else raw.astype(np.uint64).view(np.float64)


def compress(nodes: np.ndarray, counts: np.ndarray, total: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Compress a digest: nodes are heap numbers (root 1, leaves from 2**BITS), counts theirs.

    From the leaves up, two siblings and their parent become the parent where they hold at
    most ``total / budget`` together.  At most ``3 * budget`` nodes stay, and each level adds
    at most ``total / budget`` to the rank error: ``BITS / budget`` as a share of the total.
    """
    most = total // budget
    if most < 1:
        return nodes, counts
    level = np.floor(np.log2(nodes.astype(np.float64))).astype(np.int64)
    kept_nodes, kept_counts = [], []
    carry_n, carry_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for depth in range(BITS, 0, -1):
        here = level == depth
        n, inverse = np.unique(np.concatenate([nodes[here], carry_n]), return_inverse=True)
        c = np.zeros(len(n), np.int64)
        np.add.at(c, inverse, np.concatenate([counts[here], carry_c]))
        parent, family = np.unique(n >> 1, return_inverse=True)
        both = np.zeros(len(parent), np.int64)
        np.add.at(both, family, c)
        above = level == depth - 1
        at = np.searchsorted(parent, nodes[above])
        known = (at < len(parent)) & (parent[np.minimum(at, max(0, len(parent) - 1))] == nodes[above]) if len(parent) else np.zeros(above.sum(), bool)
        with_parent = both.copy()
        np.add.at(with_parent, at[known], counts[above][known])
        light = with_parent <= most
        stay = ~light[family]
        kept_nodes.append(n[stay])
        kept_counts.append(c[stay])
        carry_n, carry_c = parent[light], both[light]
    root = level == 0
    n, c = np.concatenate([nodes[root], carry_n]), np.concatenate([counts[root], carry_c])
    if len(n):
        kept_nodes.append(np.array([1]))
        kept_counts.append(np.array([c.sum()]))
    return np.concatenate(kept_nodes).astype(np.int64), np.concatenate(kept_counts).astype(np.int64)


def query(nodes: np.ndarray, counts: np.ndarray, shares: Sequence[float]) -> np.ndarray:
    """Values at the given shares (0 to 1) of a digest, by the postorder of its nodes."""
    depth = np.floor(np.log2(nodes.astype(np.float64))).astype(np.int64)
    right = ((nodes + 1) << (BITS - depth)) - 1 - (1 << BITS)
    order = np.lexsort((-depth, right))
    ranks = np.cumsum(counts[order])
    total = ranks[-1]
    at = np.searchsorted(ranks, [max(1, int(np.ceil(s * total))) for s in shares], side="left")
    return value_of(right[order][np.minimum(at, len(ranks) - 1)])


def budget_of(rank_error: float) -> int:
    return max(1, int(np.ceil(BITS / rank_error)))


def digest_table(df: DataFrame, keys: Sequence[str], value: str, rank_error: float = RANK_ERROR) -> DataFrame:
    """Digest of a numeric column, or of the elements of an array column, per group: one merged digest of ``split_digests``."""
    scratch = Scratch(df.sparkSession)
    parts = split_digests(scratch, df, keys, value, rank_error)
    return _merged(scratch, parts, list(keys), budget_of(rank_error))


def value_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float] = DEFAULT_PERCENTILES, rank_error: float = RANK_ERROR) -> DataFrame:
    """``percentiles`` of a column straight from the digests of its splits."""
    scratch = Scratch(df.sparkSession)
    names = list(keys)
    parts = _within_tasks(scratch, split_digests(scratch, df, names, value, rank_error), names, budget_of(rank_error))
    return percentiles(parts.select(*names, "node", "count"), names, shares, rank_error)


def split_digests(scratch: Scratch, df: DataFrame, keys: Sequence[str], value: str, rank_error: float = RANK_ERROR) -> DataFrame:
    """Digests of the groups in each split of the input, a written table with the split's number in ``__part``.

    Result: the keys, ``node`` and ``count``, at most one row per group and node.  Null and
    NaN and infinite values don't count; a group without usable values has no row.  Null
    keys form a group of their own.

    Each input split makes compressed digests of its own groups; only their nodes are
    shuffled, and a group that holds most of the rows sends no more nodes per split than
    any other.
    """
    types = dict(df.dtypes)
    budget = budget_of(rank_error)
    names = list(keys)
    array = types[value].startswith("array")
    plain = F.transform(F.col(value), lambda x: x.cast("double")) if array else F.col(value).cast("double")
    schema = ", ".join([f"`{k}` {types[k]}" for k in names] + ["`__part` int", "node bigint", "count bigint"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        held: dict[tuple, list[np.ndarray]] = {}
        one: dict[tuple, tuple] = {}
        n_held = 0

        def fold_in() -> None:
            for g, pieces in held.items():
                n, c = np.unique(np.concatenate(pieces), return_counts=True)
                n, c = n + (1 << BITS), c.astype(np.int64)
                if g in one:
                    n, c = add_nodes(np.concatenate([one[g][0], n]), np.concatenate([one[g][1], c]))
                one[g] = compress(n, c, int(c.sum()), budget)
            held.clear()

        def hand_over() -> Iterator[pd.DataFrame]:
            if one:
                size = [len(n) for n, _ in one.values()]
                out = {k: pd.Series(np.repeat(np.array([g[i] for g in one], dtype=object), size), dtype=object) for i, k in enumerate(names)}
                yield pd.DataFrame(out | {"__part": part, "node": np.concatenate([n for n, _ in one.values()]), "count": np.concatenate([c for _, c in one.values()])})
            one.clear()

        for b in batches:
            for g, rows in b.groupby(names, dropna=False, sort=False) if names else [((), b)]:
                g = tuple(None if pd.isna(x) else x for x in (g if isinstance(g, tuple) else (g,)))
                if array:
                    pieces = [np.asarray(x, dtype=np.float64) for x in rows["__v"] if x is not None and len(x)]
                    v = np.concatenate(pieces) if pieces else np.zeros(0)
                else:
                    v = rows["__v"].to_numpy(dtype=np.float64, na_value=np.nan)
                v = v[np.isfinite(v)]
                if len(v):
                    held.setdefault(g, []).append(quantise(v))
                    n_held += len(v)
                if n_held > HELD_VALUES:
                    fold_in()
                    n_held = 0
                    if sum(len(n) for n, _ in one.values()) > HELD_NODES:
                        yield from hand_over()
        fold_in()
        yield from hand_over()

    return scratch.table(df.select(*names, plain.alias("__v")).where("__v is not null").mapInPandas(run, schema))


def add_nodes(nodes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes with the sum of their counts."""
    n, inverse = np.unique(nodes, return_inverse=True)
    c = np.zeros(len(n), np.int64)
    np.add.at(c, inverse, counts)
    return n, c


def _combine(names: Sequence[str], budget: int):
    """Merge the digests of a group and compress the result."""

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        n, c = add_nodes(pdf["node"].to_numpy(np.int64), pdf["count"].to_numpy(np.int64))
        n, c = compress(n, c, int(c.sum()), budget)
        head = {k: pd.Series([pdf[k].iloc[0]] * len(n), dtype=object) for k in pdf.columns if k in names or k == "__part"}
        return pd.DataFrame(head | {"node": n, "count": c})

    return combine


def _within_tasks(scratch: Scratch, parts: DataFrame, names: list[str], budget: int) -> DataFrame:
    """Written digests of which no group has more nodes than a task should hold.

    A group with more has its parts merged in ways by part first: node addition and
    compression keep the bound, whatever the order.
    """
    types = dict(parts.dtypes)
    while True:
        most = parts.groupBy(*names).count().agg(F.max("count")).first()[0] or 0
        ways = -(-most // NODES_PER_TASK)
        if ways <= 1:
            return parts
        dealt = parts.withColumn("__part", F.pmod(F.xxhash64("__part"), F.lit(2 * ways)).cast("int"))
        schema = ", ".join([*(f"`{k}` {types[k]}" for k in names), "`__part` int, node bigint, count bigint"])
        fewer = scratch.table(dealt.groupBy(*names, "__part").applyInPandas(_combine(names, budget), schema))
        scratch.keep_only(fewer)
        if (fewer.groupBy(*names).count().agg(F.max("count")).first()[0] or 0) >= most:
            return fewer
        parts = fewer


def _merged(scratch: Scratch, parts: DataFrame, names: list[str], budget: int) -> DataFrame:
    """One compressed digest per group from written digests with their ``__part``."""
    types = dict(parts.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in names), "node bigint, count bigint"])
    return _within_tasks(scratch, parts, names, budget).select(*names, "node", "count").groupBy(*names).applyInPandas(_combine(names, budget), schema)


def merge(tables: Sequence[DataFrame], keys: Sequence[str], rank_error: float = RANK_ERROR) -> DataFrame:
    """Merge digests of several days, files or runs by adding the counts of equal nodes.

    The keys may be fewer than those of the tables, e.g. without the day.  A node that is no
    leaf holds at most its digest's total over the budget; sums and compression keep that,
    so that the merged digest has the error bound and the size of any other.
    """
    names = list(keys)
    parts = None
    for i, t in enumerate(tables):
        finer = [c for c in t.columns if c not in (*names, "node", "count")]
        part = F.pmod(F.xxhash64(F.lit(i), *finer), F.lit(1 << 30)).cast("int").alias("__part")
        one = t.select(*names, part, "node", "count")
        parts = one if parts is None else parts.unionByName(one)
    scratch = Scratch(parts.sparkSession)
    return _merged(scratch, scratch.table(parts), names, budget_of(rank_error))


def percentiles(digests: DataFrame, keys: Sequence[str], shares: Sequence[float] = DEFAULT_PERCENTILES, rank_error: float = RANK_ERROR) -> DataFrame:
    """Percentiles of each group of a digest table, with their error bound.

    Result: the keys, ``share``, ``value``, ``n_values``, ``most_rank_error`` (in values)
    and ``value_error`` (relative).  The true rank of ``value``, up to its quantisation, is
    within ``most_rank_error`` of ``share * n_values``.

    One group's nodes are answered in one task: a digest has at most 3 * BITS / rank_error;
    several digests of a group count as one.
    """
    types = dict(digests.dtypes)
    names = list(keys)
    schema = ", ".join([f"`{k}` {types[k]}" for k in names] + ["share double", "value double", "n_values bigint", "most_rank_error bigint", "value_error double"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = pdf["count"].to_numpy(np.int64)
        total = int(counts.sum())
        v = query(pdf["node"].to_numpy(np.int64), counts, shares)
        head = {k: pd.Series([pdf[k].iloc[0]] * len(shares), dtype=object) for k in names}
        return pd.DataFrame(head | {"share": list(shares), "value": v, "n_values": total, "most_rank_error": int(np.ceil(total * rank_error)), "value_error": VALUE_ERROR})

    return digests.groupBy(*names).applyInPandas(answer, schema)
