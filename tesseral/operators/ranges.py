"""Interval joins and ordered operators over positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.session import Scratch, within_keys


def overlap_class(start: Column, end: Column, locus_start: Column, locus_end: Column) -> Column:
    """How a read (half open) lies to a locus: Enclosing, Left, Right, Enclosed or None.

    Left: it begins at or before the locus and ends at its start or within it.  Right: it
    begins within and ends at its end or beyond.  A read that begins within and ends before
    the end is enclosed.
    """
    before = start <= locus_start
    return (
        F.when(before & (end >= locus_end), "Enclosing")
        .when(before & (end >= locus_start), "Left")
        .when(before, "None")
        .when((end >= locus_end) & (start < locus_end), "Right")
        .when((end <= locus_end), "Enclosed")
        .otherwise("None")
    )


def range_relation(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column, a_open: tuple[Column, Column] | None = None, b_open: tuple[Column, Column] | None = None) -> Column:
    """How range a lies to range b: Equal, Contained, Contains, Start (only a's start is in b), End (only its end) or None.

    Ends are closed unless given as open (left, right).  A start shared by both is not in b,
    unless a's is open and b's is not; likewise an end.
    """
    no = F.lit(False)
    (al, ar), (bl, br) = a_open or (no, no), b_open or (no, no)
    apart = (a_hi < b_lo) | (a_lo > b_hi) | ((a_hi == b_lo) & (ar | bl)) | ((a_lo == b_hi) & (al | br))
    starts_in = (a_lo > b_lo) | ((a_lo == b_lo) & al & ~bl)
    ends_in = (a_hi < b_hi) | ((a_hi == b_hi) & ar & ~br)
    same = (a_lo == b_lo) & (a_hi == b_hi) & (al == bl) & (ar == br)
    return F.when(same, "Equal").when(apart, "None").when(starts_in & ends_in, "Contained").when(starts_in, "Start").when(ends_in, "End").otherwise("Contains")


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str], bin_width: int, hot_factor: int = 1) -> DataFrame:
    """Pairs of overlapping half-open intervals with equal keys.

    Both sides are spread over bins of ``bin_width`` positions and joined on key and bin; a
    pair that shares several bins is kept in the one where the later of the two starts, so no
    deduplication is needed.  ``hot_factor`` salts: left rows are dealt to so many parts, to
    each of which the right rows of the bin are sent.  Columns of the right side keep their
    names, so they must differ from those on the left but for the keys.  Empty intervals and
    null ends or keys join nothing.
    """
    (ls, le), (rs, re_) = left_range, right_range

    def bins(df: DataFrame, s: str, e: str) -> DataFrame:
        first, last = F.floor(F.col(s) / bin_width), F.floor((F.col(e) - 1) / bin_width)
        return df.where(F.col(s).isNotNull() & (F.col(e) > F.col(s))).withColumn("__bin", F.explode(F.sequence(first, last)))

    a = bins(left, ls, le)
    b = bins(right, rs, re_).withColumnsRenamed({k: f"__r_{k}" for k in keys}).withColumnRenamed("__bin", "__r_bin")
    cond = F.col("__bin") == F.col("__r_bin")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__r_{k}"))
    if hot_factor > 1:
        a = a.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(hot_factor)).cast("int"))
        b = b.withColumn("__r_salt", F.explode(F.sequence(F.lit(0), F.lit(hot_factor - 1))))
        cond = cond & (F.col("__salt") == F.col("__r_salt"))
    met = a.join(b, cond).where((F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)) & (F.col("__bin") == F.floor(F.greatest(F.col(ls), F.col(rs)) / bin_width)))
    return met.drop("__bin", "__r_bin", "__salt", "__r_salt", *(f"__r_{k}" for k in keys))


def coalesce_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, slack: int = 0) -> DataFrame:
    """Intervals of one key merged where the next begins at most ``slack`` after the reach so far: keys, first_start, last_end, n."""
    scratch = Scratch(df.sparkSession)
    slim = df.select(*keys, start, end)
    reached = within_keys(scratch, slim, keys, [start, end], highest={"__reach": F.col(end)})
    # of equal intervals one may open a run, and must come first
    marked = reached.withColumn("__goes_on", F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach") + slack), 0).otherwise(1))
    runs = within_keys(scratch, marked.drop("__reach"), keys, [start, end, "__goes_on"], sums={"__run": 1 - F.col("__goes_on")})
    return runs.groupBy(*keys, "__run").agg(F.min(start).alias("first_start"), F.max(end).alias("last_end"), F.count("*").alias("n")).drop("__run")


def sessionize(df: DataFrame, keys: Sequence[str], order: str, gap: Column | float, tie: Sequence[str] = (), out: str = "session") -> DataFrame:
    """Number (from 0) of the session of each row: a new one begins where the step to the previous row exceeds ``gap``."""
    scratch = Scratch(df.sparkSession)
    stepped = within_keys(scratch, df, keys, [order, *tie], previous={"__before": order})
    marked = stepped.withColumn("__new", F.when(F.col(order) - F.col("__before") > gap, 1).otherwise(0)).drop("__before")
    return within_keys(scratch, marked, keys, [order, *tie], sums={out: F.col("__new")}).drop("__new")


def neighbours(df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] = ()) -> DataFrame:
    """Adds ``previous`` and ``following`` value of ``order`` within the keys."""
    return within_keys(Scratch(df.sparkSession), df, keys, [order, *tie], previous={"previous": order}, following={"following": order})


def run_lengths(df: DataFrame, keys: Sequence[str], order: Sequence[str], item: str) -> DataFrame:
    """Runs of equal adjacent items: keys, run_no (from 1), item, run_length; null items are equal to one another."""
    scratch = Scratch(df.sparkSession)
    boxed = df.withColumn("__boxed", F.struct(item))
    stepped = within_keys(scratch, boxed, keys, order, previous={"__before": "__boxed"})
    new = F.when(F.col("__before").isNotNull() & F.col(f"__before.{item}").eqNullSafe(F.col(item)), 0).otherwise(1)
    runs = within_keys(scratch, stepped.withColumn("__new", new).drop("__before", "__boxed"), keys, order, sums={"run_no": F.col("__new")})
    return runs.groupBy(*keys, "run_no").agg(F.first(item).alias("item"), F.count("*").alias("run_length"))


def with_neighbours_at_locus(df: DataFrame, locus: Sequence[str], item: str, index: str) -> DataFrame:
    """Adds ``others``: the items of all other rows of the same locus, in order of ``index``, which numbers the rows.

    An equal item of another row is another item.  All rows of a locus meet in one list, so
    a locus must hold no more than its variants.
    """
    w = Window.partitionBy(*locus)
    return df.withColumn("__all", F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(item).alias("x"))).over(w))).withColumn("others", F.transform(F.filter("__all", lambda e: e["i"] != F.col(index)), lambda e: e["x"])).drop("__all")


def require_sorted(df: DataFrame, keys: Sequence[str], order: str, ordinal: str) -> DataFrame:
    """The rows, or an error when the plan runs where one's position is before that of the previous ordinal of its key."""
    stepped = within_keys(Scratch(df.sparkSession), df, keys, [ordinal], previous={"__before": order})
    fine = F.col("__before").isNull() | (F.col(order) >= F.col("__before"))
    return stepped.where(F.assert_true(fine, F.lit("records are not sorted")).isNull()).drop("__before")


def dense_ids(df: DataFrame, scope: Sequence[str], item: str, order: str, out: str = "dense_id") -> DataFrame:
    """Numbers items per scope (from 0) by their first appearance."""
    first = df.groupBy(*scope, item).agg(F.min(order).alias("__first"))
    return record_index(first, scope, ["__first", item], out).drop("__first")


def record_index(df: DataFrame, scope: Sequence[str], order: Sequence[str], out: str = "record_index") -> DataFrame:
    """0-based running index of rows within a scope."""
    return within_keys(Scratch(df.sparkSession), df, scope, order, sums={out: F.lit(1)}).withColumn(out, F.col(out) - 1)


def best_with_ties(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """All rows that have the smallest score of their key."""
    best = df.groupBy(*keys).agg(F.min(score).alias("__best"))
    return df.join(best.withColumnsRenamed({k: f"__b_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in keys] + [F.col(score) == F.col("__best")]).drop("__best", *(f"__b_{k}" for k in keys))


def subsample(df: DataFrame, keys: Sequence[str], unit: str, most: int, seed: int = 42) -> DataFrame:
    """Keep each unit with the chance that leaves about ``most`` per key; the same units in every run."""
    depth = df.groupBy(*keys).agg(F.count("*").alias("__depth")).withColumnsRenamed({k: f"__d_{k}" for k in keys})
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(unit), F.lit(seed)), 11)) / F.lit(float(1 << 53))
    joined = df.join(depth, [F.col(k).eqNullSafe(F.col(f"__d_{k}")) for k in keys])
    return joined.where((F.col("__depth") <= most) | (uniform < F.lit(float(most)) / F.col("__depth"))).drop("__depth", *(f"__d_{k}" for k in keys))


def lookup_with_fallback(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, out: str, common: str = "all") -> DataFrame:
    """Value of a key, or of the entry ``all``.  The table must be small: one row per contig at most."""
    own = F.broadcast(table.select(F.col(table_key).alias("__k"), F.col(value).alias("__v")))
    fallback = F.broadcast(table.where(F.col(table_key) == common).agg(F.max(value).alias("__all")))
    return df.join(own, F.col(key) == F.col("__k"), "left").crossJoin(fallback).withColumn(out, F.coalesce("__v", "__all")).drop("__k", "__v", "__all")


def mate_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per fragment: ``left`` is its first row, ``right`` its last other row or null."""
    rank = F.struct(*order)
    payload = F.struct(*columns)
    both = df.groupBy(*keys).agg(F.min_by(payload, rank).alias("left"), F.max_by(payload, rank).alias("__right"), F.count("*").alias("__n"))
    return both.withColumn("right", F.when(F.col("__n") > 1, F.col("__right"))).drop("__right", "__n")


def zip_samples(frames: dict[str, DataFrame], keys: Sequence[str], check: bool = True) -> DataFrame:
    """One row per variant key with each sample's columns as a struct.

    With ``check`` a key that a sample lacks, or has twice, is an error when the plan runs.
    """
    tagged = None
    for name, df in frames.items():
        payload = [c for c in df.columns if c not in keys]
        part = df.select(*keys, F.lit(name).alias("sample"), F.struct(*payload).alias("data"))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    names = sorted(frames)
    zipped = tagged.groupBy(*keys).agg(*(F.max(F.when(F.col("sample") == n, F.col("data"))).alias(n) for n in names), *(F.count_if(F.col("sample") == n).alias(f"__n_{n}") for n in names))
    if check:
        complete = F.lit(True)
        for n in names:
            complete = complete & (F.col(f"__n_{n}") == 1)
        zipped = zipped.where(F.assert_true(complete, F.lit("samples have different records")).isNull())
    return zipped.drop(*(f"__n_{n}" for n in names))


def with_missing_samples(pileups: DataFrame, key: str, sample: str, samples: Sequence[str], observations: str) -> DataFrame:
    """A pileup of every sample for every key: an empty one where the sample has none."""
    every = pileups.select(key).distinct().withColumn(sample, F.explode(F.array(*(F.lit(s) for s in samples))))
    kind = dict(pileups.dtypes)[observations]
    return every.join(pileups, [key, sample], "left").withColumn(observations, F.coalesce(observations, F.array().cast(kind)))


def event_groups(df: DataFrame, event: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Records of each event as one array in order, with the index of the last; records without event have none.

    A group is the variants of one haplotype, a handful.
    """
    members = F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order))))
    return df.where(F.col(event).isNotNull()).groupBy(event).agg(members.alias("members"), F.count("*").alias("n_members"), F.max(F.struct(*order)).alias("last_record"))


def share_event_result(df: DataFrame, event: str, order: Sequence[str], results: Sequence[str]) -> DataFrame:
    """All records of an event get the results of its first record; others keep theirs."""
    tied = df.where(F.col(event).isNotNull())
    first = tied.groupBy(F.col(event).alias("__event")).agg(F.min_by(F.struct(*results), F.struct(*order)).alias("__first"))
    shared = tied.join(first, F.col(event) == F.col("__event")).drop("__event")
    for r in results:
        shared = shared.withColumn(r, F.col(f"__first.{r}"))
    return df.where(F.col(event).isNull()).unionByName(shared.drop("__first"))


def with_reference_base(df: DataFrame, contigs: DataFrame, contig: str, pos: str, length: int = 1, out: str = "ref_base", tile: int = 1 << 16) -> DataFrame:
    """Bases of the reference at a position (from 0), from contigs (``contig``, ``seq``) cut in tiles.

    Tiles overlap by ``length``, so that a lookup is an equality join on contig and tile
    that no long contig makes heavy.  Null beyond the contig's end.
    """
    n = F.greatest(F.ceil(F.length("seq") / F.lit(tile)).cast("int"), F.lit(1))
    tiles = contigs.select(F.col("contig").alias("__c"), "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("__t")).select("__c", "__t", F.expr(f"substring(seq, __t * {tile} + 1, {tile + length})").alias("__s"))
    at = F.col(pos)
    base = F.expr(f"substring(__s, cast(pmod(`{pos}`, {tile}) as int) + 1, {length})")
    return df.join(tiles, (F.col(contig) == F.col("__c")) & (F.floor(at / F.lit(tile)) == F.col("__t")), "left").withColumn(out, F.when(F.length(base) == length, base)).drop("__c", "__t", "__s")
