"""Session helpers: the shared scratch folder and tables that cut lineage.

Iterative operators must not grow their plan without end, and must survive the
loss of an executor.  They therefore write intermediate tables to the folder
that the session names in ``spark.checkpoint.dir``, which all executors share.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_FOLDER: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only where the session names none, as in tests on one machine, a temporary
    folder is made; it goes when the interpreter ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _OWN_FOLDER:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="tesseral-"))
        atexit.register(shutil.rmtree, _OWN_FOLDER[0], True)
    return "file://" + _OWN_FOLDER[0]


class Scratch:
    """Written tables of one operator run, each dropped once it is superseded.

    What a result still reads is deleted by ``clean_up`` or when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/tesseral-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        self._n = 0

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return it as a table read back, without lineage."""
        path = f"{self.root}/{self._n}"
        self._n += 1
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(schema).parquet(path)
        self._paths[id(back)] = (back, path)
        if self._n == 1:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(p)
            _OPEN.append((self.spark, self.root))
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            got = self._paths.pop(id(t), None)
            if got:
                _delete(self.spark, got[1])

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables but those that the result reads."""
        kept = {id(t) for t in tables}
        self.drop(*(t for t, _ in list(self._paths.values()) if id(t) not in kept))


_OPEN: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean_up() -> None:
    """Delete all written tables of this process; results that read them must have been consumed."""
    while _OPEN:
        _delete(*_OPEN.pop())


#: Keys that ``lookup`` broadcasts at most: of N rows no other key has more than N / HOT_KEYS.
HOT_KEYS = 100_000


def lookup(scratch: Scratch, left: DataFrame, key: str, table: DataFrame, table_key: str, value: str, out: str, hot_rows: int = 200_000) -> DataFrame:
    """Left join of ``left`` with a table of unique keys that a hot key can't clog.

    Keys with more than ``hot_rows`` rows on the left, ``HOT_KEYS`` of them at most, are
    looked up in a broadcast of their entries alone; in the join that follows their rows
    have no key and are dealt over all partitions.  Adds column ``out`` (null where the
    table has no entry); a null key finds nothing and its row stays.  ``left`` stands once
    in the plan that comes out.
    """
    small = table.select(F.col(table_key).alias("__k"), F.col(value).alias("__v"))
    hot = left.groupBy(F.col(key).alias("__k")).count().where((F.col("count") > hot_rows) & F.col("__k").isNotNull())
    hot = scratch.table(hot.orderBy(F.col("count").desc()).limit(HOT_KEYS).select("__k"))
    if hot.isEmpty():
        scratch.drop(hot)
        return left.join(small, F.col(key) == F.col("__k"), "left").withColumn(out, F.col("__v")).drop("__k", "__v")
    found = small.join(F.broadcast(hot), "__k").select("__k", "__v")
    entries = scratch.table(hot.join(F.broadcast(found), "__k", "left").select(F.col("__k").alias("__hk"), F.col("__v").alias("__hv")))
    marked = left.join(F.broadcast(entries), F.col(key) == F.col("__hk"), "left")
    is_hot = F.col("__hk").isNotNull()
    marked = marked.withColumn("__cold", F.when(~is_hot, F.col(key))).withColumn("__deal", F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(1 << 20)) + 1).otherwise(F.lit(0)))
    met = marked.join(small.withColumn("__zero", F.lit(0).cast("bigint")), (F.col("__cold") == F.col("__k")) & (F.col("__deal") == F.col("__zero")), "left")
    return met.withColumn(out, F.when(is_hot, F.col("__hv")).otherwise(F.col("__v"))).drop("__hk", "__hv", "__cold", "__deal", "__k", "__v", "__zero")


#: Repeated keys that ``drop_repeats`` broadcasts at most; beyond, all rows are shuffled.
REPEATED_KEYS = 500_000


def drop_repeats(scratch: Scratch, df: DataFrame, keys: Sequence[str], most_keys: int = REPEATED_KEYS) -> DataFrame:
    """One row of each key; rows with a null in their key count as repeats only where the whole row is equal.

    Only the keys are counted over all rows; wide rows are shuffled only where their key
    occurs more than once.
    """
    keys = list(keys)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    repeated = scratch.table(df.where(whole).groupBy(*keys).count().where("count > 1").select(*(F.col(k).alias(f"__r_{k}") for k in keys)))
    nulls = df.where(~whole).distinct()
    keyed = df.where(whole)
    n = repeated.limit(most_keys + 1).count()
    if n == 0:
        return keyed.unionByName(nulls)
    if n > most_keys:
        return keyed.dropDuplicates(keys).unionByName(nulls)
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__r_{k}"))
    once = keyed.join(F.broadcast(repeated), same, "left_anti")
    again = keyed.join(F.broadcast(repeated), same, "left_semi").dropDuplicates(keys)
    return once.unionByName(again).unionByName(nulls)


def running(scratch: Scratch, df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Running sums over one global order, without one task that sees all rows.

    Rows are put in slices of the order (written once, so that the slices stay the same);
    the sums of the slices before are added to each.  Rows equal in ``order`` come in any
    sequence, each with its own sum.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    added = df
    for n, x in sums.items():
        added = added.withColumn(f"__s_{n}", x)
    sliced = scratch.table(added.repartitionByRange(*order).withColumn("__slice", F.spark_partition_id()))
    totals = sliced.groupBy("__slice").agg(*(F.sum(f"__s_{n}").alias(f"__t_{n}") for n in sums))
    over = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    before = totals.select(F.col("__slice").alias("__b"), *(F.sum(f"__t_{n}").over(over).alias(f"__p_{n}") for n in sums))
    inner = Window.partitionBy("__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = sliced.join(F.broadcast(before), F.col("__slice") == F.col("__b"))
    for n in sums:
        own = F.sum(f"__s_{n}").over(inner)
        out = out.withColumn(n, F.when(F.col(f"__p_{n}").isNull(), own).otherwise(own + F.col(f"__p_{n}")))
    return out.select(*df.columns, *sums)


def within_keys(scratch: Scratch, df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column] | None = None, highest: dict[str, Column] | None = None, previous: dict[str, str] | None = None, following: dict[str, str] | None = None) -> DataFrame:
    """Running values within keys, in an order, without one task per key.

    Rows are cut in slices of (keys, order), so that a hot key is spread over many; what a
    key carries from one slice to the next is worked out on a row per slice and key.  Adds
    ``sums`` (up to and with each row; null counts as zero), ``highest`` (largest value of
    the rows before), ``previous`` and ``following`` (a column of the neighbouring rows).
    Rows equal in keys and order come in any sequence.  A null key is a key.
    """
    sums, highest, previous, following = sums or {}, highest or {}, previous or {}, following or {}
    keys, order = list(keys), list(order)
    added = {f"__s_{n}": F.coalesce(x, F.lit(0)) for n, x in sums.items()} | {f"__h_{n}": x for n, x in highest.items()}
    sliced = scratch.table(df.withColumns(added).repartitionByRange(*keys, *order).withColumn("__slice", F.spark_partition_id()) if added else df.repartitionByRange(*keys, *order).withColumn("__slice", F.spark_partition_id()))
    rank = F.struct(*order)
    parts = [F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums] + [F.max(f"__h_{n}").alias(f"__h_{n}") for n in highest]
    parts += [F.max_by(F.struct(c), rank).alias(f"__p_{n}") for n, c in previous.items()] + [F.min_by(F.struct(c), rank).alias(f"__f_{n}") for n, c in following.items()]
    per = sliced.groupBy("__slice", *keys).agg(*(parts or [F.count("*").alias("__n")]))
    across = Window.partitionBy(*keys).orderBy("__slice")  # a row per slice
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(
        F.col("__slice").alias("__c_slice"),
        *(F.col(k).alias(f"__k_{k}") for k in keys),
        *(F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__cs_{n}") for n in sums),
        *(F.max(f"__h_{n}").over(before).alias(f"__ch_{n}") for n in highest),
        *(F.lag(f"__p_{n}").over(across).alias(f"__cp_{n}") for n in previous),
        *(F.lead(f"__f_{n}").over(across).alias(f"__cf_{n}") for n in following),
    )
    same = F.col("__slice") == F.col("__c_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = sliced.join(carry, same)
    here = Window.partitionBy("__slice", *keys).orderBy(*order)
    upto, earlier = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    new = {n: F.sum(f"__s_{n}").over(upto) + F.col(f"__cs_{n}") for n in sums}
    new |= {n: F.greatest(F.max(f"__h_{n}").over(earlier), F.col(f"__ch_{n}")) for n in highest}
    new |= {n: F.coalesce(F.lag(F.struct(c)).over(here), F.col(f"__cp_{n}"))[c] for n, c in previous.items()}
    new |= {n: F.coalesce(F.lead(F.struct(c)).over(here), F.col(f"__cf_{n}"))[c] for n, c in following.items()}
    return joined.select(*df.columns, *(x.alias(n) for n, x in new.items()))
