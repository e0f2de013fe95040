"""Per-key results where a handful of keys hold most rows.

Keys are dictionary-encoded per input split and their rows scattered into dense
accumulator arrays; only those arrays, in blocks of keys, are shuffled and summed.  The
work of a task depends on the rows of its split alone, however unevenly keys occur.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.session import Scratch, running

#: Keys one split accumulates before it hands its arrays over and starts anew.
KEYS_PER_ARRAY = 1 << 18
#: Keys of equal row count that one task picks the smallest from; more are ranked in slices.
TIES_IN_ONE_TASK = 100_000


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _start(how: str, whole: bool) -> float | int:
    """What an accumulator holds before any value."""
    if how not in ("min", "max"):
        return 0
    if whole:
        return np.iinfo(np.int64).max if how == "min" else np.iinfo(np.int64).min
    return np.inf if how == "min" else -np.inf


def _scatter(codes: np.ndarray, size: int, values: np.ndarray, how: str) -> np.ndarray:
    whole = values.dtype == np.int64
    if how == "sum":
        about = np.bincount(codes, weights=values, minlength=size)
        if not whole:
            return about
        if np.abs(about).max(initial=0) > 9.2e18:
            raise ArithmeticError("a sum of whole numbers exceeds 64 bits")
        out = np.zeros(size, np.int64)
        np.add.at(out, codes, values)
        return out
    out = np.full(size, _start(how, whole), dtype=values.dtype)
    (np.minimum if how == "min" else np.maximum).at(out, codes, values)
    return out


def dense_aggregate(df: DataFrame, key: str, sums: Sequence[str] = (), minima: Sequence[str] = (), maxima: Sequence[str] = (), blocks: int | None = None, null_key: bool = False) -> DataFrame:
    """Row counts, and sums, minima and maxima of numeric columns, per value of ``key``.

    Result: ``key_value`` (of the key's type), ``n_rows`` and for each asked column
    ``n_<c>`` (values that are neither null nor NaN), ``sum_<c>``, ``min_<c>``, ``max_<c>``
    (null if there is no value): whole numbers stay whole numbers of 64 bits, and a sum beyond
    them is an error; others are doubles, summed in no fixed order.  A null key is not a
    value: its rows are left out, or with ``null_key`` counted in a row of their own.  An empty
    table gives no row.

    The dictionary never has to fit anywhere as a whole: a split hands its arrays over in
    blocks of keys by hash, and block by block they are aligned and added.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    wanted = [(c, h) for h, cs in (("sum", sums), ("min", minima), ("max", maxima)) for c in cs]
    columns = list(dict.fromkeys(c for c, _ in wanted))
    types = dict(df.dtypes)
    whole = {c: types[c] in _WHOLE for c in columns}
    of_field = {f"{h}_{c}": (h, c) for c, h in wanted}
    whole_field = lambda f: f not in of_field or whole[of_field[f][1]]
    fields = [f"n_{c}" for c in columns] + [f"{h}_{c}" for c, h in wanted]
    schema = T.StructType(
        [T.StructField("block", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("n_rows", T.ArrayType(T.LongType()))]
        + [T.StructField(f, T.ArrayType(T.LongType() if whole_field(f) else T.DoubleType())) for f in fields]
    )

    def empty(f: str) -> np.ndarray:
        return np.zeros(0, np.int64 if f == "n_rows" or whole_field(f) else np.float64)


    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of: dict = {}
        acc = {f: empty(f) for f in ["n_rows", *fields]}

        def hand_over() -> Iterator[pa.RecordBatch]:
            names = pa.array(list(code_of), type=None if not code_of else key_type)
            of_block = np.array([_block_of(k, blocks) for k in code_of], dtype=np.int64)
            order = np.argsort(of_block, kind="stable")
            where, first = np.unique(of_block[order], return_index=True)
            ends = np.append(first[1:], len(order))
            out = {"block": pa.array(where, pa.int32())}
            offsets = pa.array(np.append(first, ends[-1]), pa.int32())
            out["keys"] = pa.ListArray.from_arrays(offsets, names.take(pa.array(order)))
            out["n_rows"] = pa.ListArray.from_arrays(offsets, pa.array(acc["n_rows"][order].astype(np.int64)))
            for f in fields:
                out[f] = pa.ListArray.from_arrays(offsets, pa.array(acc[f][order]))
            yield pa.RecordBatch.from_pydict(out)
            code_of.clear()
            for f in acc:
                acc[f] = empty(f)

        key_type = None
        for b in batches:
            col = b.column(0)
            key_type = col.type
            live = np.ones(len(col), bool) if null_key else np.asarray(col.is_valid())
            if not live.any():
                continue
            local = col.filter(pa.array(live)).dictionary_encode(null_encoding="encode")
            to_code = np.array([code_of.setdefault(k, len(code_of)) for k in local.dictionary.to_pylist()], dtype=np.int64)
            codes = to_code[np.asarray(local.indices)]
            size = len(code_of)
            for f in acc:
                fill = _start(of_field[f][0], whole_field(f)) if f in of_field else 0
                acc[f] = np.concatenate([acc[f], np.full(size - len(acc[f]), fill, dtype=acc[f].dtype)])
            acc["n_rows"] += np.bincount(codes, minlength=size)
            for i, c in enumerate(columns, 1):
                x = b.column(i)
                ok = np.asarray(x.is_valid())[live]
                v = x.fill_null(0).to_numpy(zero_copy_only=False)[live]
                if not whole[c]:
                    ok &= ~np.isnan(v)
                acc[f"n_{c}"] += np.bincount(codes[ok], minlength=size)
                for c2, h in wanted:
                    if c2 == c:
                        part = _scatter(codes[ok], size, v[ok], h)
                        acc[f"{h}_{c}"] = acc[f"{h}_{c}"] + part if h == "sum" else (np.minimum if h == "min" else np.maximum)(acc[f"{h}_{c}"], part)
            if size >= KEYS_PER_ARRAY:
                yield from hand_over()
        if code_of:
            yield from hand_over()

    def add_up(table: pa.Table) -> pa.Table:
        keys = table.column("keys").combine_chunks()
        flat = keys.flatten() if isinstance(keys, pa.ListArray) else pa.chunked_array([k.flatten() for k in keys.chunks]).combine_chunks()
        encoded = flat.dictionary_encode(null_encoding="encode")
        if isinstance(encoded, pa.ChunkedArray):
            encoded = encoded.combine_chunks()
        codes, size = np.asarray(encoded.indices), len(encoded.dictionary)
        values = {f: np.concatenate([np.asarray(c.flatten()) for c in table.column(f).chunks]) for f in ["n_rows", *fields]}
        out = {"key_value": encoded.dictionary, "n_rows": pa.array(_scatter(codes, size, values["n_rows"], "sum"))}
        count = {c: _scatter(codes, size, values[f"n_{c}"], "sum") for c in columns}
        for c in columns:
            out[f"n_{c}"] = pa.array(count[c])
        for c, h in wanted:
            v = _scatter(codes, size, values[f"{h}_{c}"], h)
            out[f"{h}_{c}"] = pa.array(v, mask=count[c] == 0)
        return pa.table(out)

    final = T.StructType(
        [T.StructField("key_value", kind), T.StructField("n_rows", T.LongType())] + [T.StructField(f"n_{c}", T.LongType()) for c in columns] + [T.StructField(f"{h}_{c}", T.LongType() if whole[c] else T.DoubleType()) for c, h in wanted]
    )
    slim = df.select(F.col(key).alias("__key"), *(F.col(c).cast("bigint" if whole[c] else "double").alias(f"__{c}") for c in columns))
    return slim.mapInArrow(split, schema).groupBy("block").applyInArrow(add_up, final)


def _block_of(key: object, blocks: int) -> int:
    """Block of a key; the same in every process, unlike Python's own hash of strings."""
    import zlib

    return zlib.crc32(repr(key).encode()) % blocks


def fewest_majority_keys(counts: DataFrame, total: int, key: str = "key_value", rows: str = "n_rows") -> DataFrame:
    """The fewest keys that together hold more than half of ``total`` rows.

    Keys are taken by descending row count, ties by ascending key.  If all keys together
    hold no more than half, all of them are returned; of an empty table none.

    Instead of a running sum over all keys, the keys are first grouped by their row count:
    of N rows there are at most sqrt(2 N) different counts, a bound on what one task sees.
    """
    by_count = counts.groupBy(F.col(rows).alias("c")).agg(F.count("*").alias("k"))
    order = Window.orderBy(F.col("c").desc())
    upto = by_count.withColumn("upto", F.sum(F.col("c") * F.col("k")).over(order)).where(F.col("upto") * 2 > total)
    edge = upto.orderBy(F.col("c").desc()).limit(1).collect()
    if not edge:
        return counts
    c, before = edge[0]["c"], edge[0]["upto"] - edge[0]["c"] * edge[0]["k"]
    ties = (total // 2 - before) // c + 1
    tied = counts.where(F.col(rows) == c)
    if ties <= TIES_IN_ONE_TASK:
        first = tied.orderBy(key).limit(int(ties))
    else:
        first = running(Scratch(counts.sparkSession), tied, [key], {"__rank": F.lit(1)}).where(F.col("__rank") <= ties).drop("__rank")
    return counts.where(F.col(rows) > c).unionByName(first)


def majority_keys(df: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """``field_name`` and ``key_value`` (as string) of the fewest keys with more than half of all rows.

    All stored rows count in the total, also those whose key is null; null is not a value.
    """
    scratch = Scratch(df.sparkSession)
    counts = scratch.table(dense_aggregate(df.select(F.col(key)), key, null_key=True))
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    keys = counts.where(F.col("key_value").isNotNull())
    return fewest_majority_keys(keys, total).select(F.lit(name or key).alias("field_name"), F.col("key_value").cast("string").alias("key_value"))
