"""Queries of the joins and of the operators over positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.functions import genomics as gn
from tesseral.model import bias
from tesseral.operators import ranges
from tesseral.plans import views as v


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = v.read(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("int")).alias("stop"))


def _loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier gets the parts of its region of keys as loci."""
    parts = v.read(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey"), (F.col("p_partkey") % 10 + 1).alias("contig"), F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size") % 9).alias("hi"))


def a3_locus_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and type at one minute, as variants of a locus."""
    events = v.read(spark, sf_dir, "events").withColumn("minute", F.date_trunc("minute", "ts"))
    got = ranges.with_neighbours_at_locus(events, ["event_type", "minute"], "user_id", "event_id")
    return got.select("event_id", F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others"))


def a3_sorted_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event numbers are in order within their user: all rows pass the guard."""
    events = v.read(spark, sf_dir, "events").withColumn("n", F.col("event_id"))
    return ranges.require_sorted(events, ["user_id"], "n", "event_id").groupBy("user_id").agg(F.count("*").alias("n"))


def a6_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranges.coalesce_intervals(_reads(spark, sf_dir), ["contig"], "start", "stop", 3)
    return got.select("contig", "first_start", "last_end", "n")


def c1_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of reads and loci, counted per locus."""
    met = ranges.range_join(_reads(spark, sf_dir), _loci(spark, sf_dir), ["contig"], ("start", "stop"), ("lo", "hi"), 64, 4)
    return met.groupBy("p_partkey").agg(F.count("*").alias("n"), F.min("start").alias("first_start"))


def c1_overlap_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranges.overlap_class(F.col("start"), F.col("stop"), F.lit(60), F.lit(80))
    return _reads(spark, sf_dir).where("start < 200").groupBy(got.alias("overlap")).agg(F.count("*").alias("n"))


def c2_mate_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranges.mate_pairs(_reads(spark, sf_dir), ["l_orderkey"], ["l_linenumber", "start", "stop"], ["start", "stop"])
    return got.select("l_orderkey", F.col("left.start").alias("left_start"), F.col("right.stop").alias("right_stop"))


def c3_zip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last line of each order as two samples that must have the same orders."""
    lines = v.read(spark, sf_dir, "lineitem")
    first = lines.groupBy("l_orderkey").agg(F.min("l_quantity").alias("x"))
    last = lines.groupBy("l_orderkey").agg(F.max("l_quantity").alias("x"))
    got = ranges.zip_samples({"a": first, "b": last}, ["l_orderkey"])
    return got.select("l_orderkey", F.col("a.x").alias("a_x"), F.col("b.x").alias("b_x"))


def c4_sample_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines by status: a status that an order lacks has an empty pileup."""
    lines = v.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.collect_list("l_quantity").alias("obs"))
    got = ranges.with_missing_samples(lines, "l_orderkey", "l_linestatus", ["F", "O"], "obs")
    return got.select("l_orderkey", "l_linestatus", F.size("obs").alias("n"))


def c5_group_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each event of the domain's calls, within its call set."""
    calls = v.once_calls(spark, sf_dir).withColumn("haplotype", F.concat_ws("/", F.col("callset_id").cast("string"), gn.haplotype_id(F.trim("event"), F.lit(None).cast("string"), F.lit(None).cast("string"))))
    calls = calls.where("event is not null and trim(event) <> '' and trim(event) <> '.'")
    got = ranges.event_groups(calls, "haplotype", ["call_id"], ["pos"])
    return got.select("haplotype", "n_members", F.col("last_record.call_id").alias("last_call"), F.array_join(F.transform("members", lambda m: m["call_id"].cast("string")), ",").alias("members"))


def c6_broadcast_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer share the price of its first one."""
    orders = v.read(spark, sf_dir, "orders").withColumn("unit", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")))
    return ranges.share_event_result(orders, "unit", ["o_orderkey"], ["o_totalprice"]).select("o_orderkey", "o_totalprice")


def c8_fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([("ASIA", 3), ("EUROPE", 1), ("all", 2)], "contig string, n int")
    return ranges.lookup_with_fallback(v.read(spark, sf_dir, "region"), table, "r_name", "contig", "n", "ploidy").select("r_name", "ploidy")


def c9_reference_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two letters of each document at a place, with the documents as contigs in tiles."""
    docs = v.read(spark, sf_dir, "documents").where("text is not null")
    contigs = docs.select(F.col("doc_id").alias("contig"), F.col("text").alias("seq"))
    loci = docs.select("doc_id", (F.col("doc_id") % 400).cast("int").alias("pos"))
    return ranges.with_reference_base(loci, contigs, "doc_id", "pos", 2, "bases", 128).select("doc_id", "pos", F.hex(F.encode("bases", "utf-8")).alias("bases"))


def c12_threshold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines at or above each of eleven discounts: counted at the highest one each reaches, added up from the top."""
    step = F.round(F.col("l_discount") * 100).cast("int")
    sums = v.read(spark, sf_dir, "lineitem").groupBy(step.alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    at = F.explode(F.expr("transform(sequence(0, 10), i -> named_struct('k', i, 'n', aggregate(sequence(i, 10), 0L, (a, j) -> a + coalesce(m[j], 0L))))"))
    return sums.select(at.alias("x")).select("x.k", "x.n")


_DOMAINS = {"strand": ["none", "+", "-"], "orientation": ["none", ">", "<"], "position": ["none", "^"], "softclip": ["none", "$"], "homopolymer": ["none", "*"], "alt_locus": ["none", "*"]}


def c13_bias_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses with just one artifact out of the product of all dimensions."""
    rows = [tuple(h[d] for d in _DOMAINS) for h in bias.single_artifacts(_DOMAINS)]
    return spark.createDataFrame(rows, ", ".join(f"{d} string" for d in _DOMAINS))


def l1_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = v.read(spark, sf_dir, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    got = ranges.sessionize(events, ["user_id"], "sec", 3600.0, ["event_id"])
    return got.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def l2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.neighbours(v.read(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id", "previous", "following")


QUERIES = v.named(
    a3_locus_neighbours, a3_sorted_guard, a6_coalesce, c1_range_join, c1_overlap_class, c2_mate_pair, c3_zip_join, c4_sample_outer, c5_group_assembly, c6_broadcast_result, c8_fallback_lookup, c9_reference_base, c12_threshold_join,
    c13_bias_product, l1_sessionize, l2_neighbours,
)

_READS = "reads AS (SELECT l_orderkey, l_linenumber, l_suppkey AS contig, l_partkey AS start, l_partkey + CAST(l_quantity AS INT) AS stop FROM lineitem)"
_LOCI = "loci AS (SELECT p_partkey, p_partkey % 10 + 1 AS contig, p_partkey AS lo, p_partkey + p_size % 9 AS hi FROM part)"
ORACLE = {
    "a3_locus_neighbours": """WITH e AS (SELECT event_id, event_type, user_id, date_trunc('minute', ts) AS m FROM events)
        SELECT a.event_id, coalesce(string_agg(b.user_id::VARCHAR, ',' ORDER BY b.event_id), '') AS others FROM e a LEFT JOIN e b ON a.event_type = b.event_type AND a.m = b.m AND a.event_id <> b.event_id GROUP BY a.event_id""",
    "a3_sorted_guard": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
    "a6_coalesce": f"""WITH {_READS}, m AS (SELECT *, max(stop) OVER (PARTITION BY contig ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM reads),
        h AS (SELECT *, CASE WHEN reach IS NULL OR start > reach + 3 THEN 1 ELSE 0 END AS new FROM m), g AS (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY start, stop, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM h) SELECT contig, min(start) AS first_start, max(stop) AS last_end, count(*) AS n FROM g GROUP BY contig, k""",
    "c1_range_join": f"WITH {_READS}, {_LOCI} SELECT p_partkey, count(*) AS n, min(start) AS first_start FROM reads r JOIN loci l ON r.contig = l.contig AND r.start < l.hi AND l.lo < r.stop AND l.hi > l.lo AND r.stop > r.start GROUP BY p_partkey",
    "c1_overlap_class": f"""WITH {_READS} SELECT CASE WHEN start <= 60 THEN CASE WHEN stop >= 80 THEN 'Enclosing' WHEN stop >= 60 THEN 'Left' ELSE 'None' END WHEN stop >= 80 AND start < 80 THEN 'Right' WHEN stop <= 80 THEN 'Enclosed' ELSE 'None' END AS overlap, count(*) AS n
        FROM reads WHERE start < 200 GROUP BY 1""",
    "c2_mate_pair": f"""WITH {_READS} SELECT l_orderkey, first(start ORDER BY l_linenumber, start, stop) AS left_start, CASE WHEN count(*) > 1 THEN last(stop ORDER BY l_linenumber, start, stop) END AS right_stop FROM reads GROUP BY l_orderkey""",
    "c3_zip_join": "SELECT l_orderkey, min(l_quantity) AS a_x, max(l_quantity) AS b_x FROM lineitem GROUP BY l_orderkey",
    "c4_sample_outer": "WITH k AS (SELECT l_orderkey, s AS l_linestatus FROM (SELECT DISTINCT l_orderkey FROM lineitem), (SELECT unnest(['F', 'O']) AS s)) SELECT k.l_orderkey, k.l_linestatus, CAST(count(l.l_orderkey) AS INT) AS n FROM k LEFT JOIN lineitem l ON k.l_orderkey = l.l_orderkey AND k.l_linestatus = l.l_linestatus GROUP BY ALL",
    "c5_group_assembly": f"""WITH {v.ONCE_SQL} SELECT callset_id::VARCHAR || '/' || trim(event, ' ') AS haplotype, count(*) AS n_members, max(call_id) AS last_call, string_agg(call_id::VARCHAR, ',' ORDER BY call_id) AS members FROM once
        WHERE event IS NOT NULL AND trim(event, ' ') NOT IN ('', '.') GROUP BY 1""",
    "c6_broadcast_result": """WITH u AS (SELECT *, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS unit FROM orders), f AS (SELECT unit, arg_min(o_totalprice, o_orderkey) AS p FROM u WHERE unit IS NOT NULL GROUP BY unit)
        SELECT o_orderkey, CASE WHEN unit IS NULL THEN o_totalprice ELSE p END AS o_totalprice FROM u LEFT JOIN f USING (unit)""",
    "c8_fallback_lookup": "SELECT r_name, CASE r_name WHEN 'ASIA' THEN 3 WHEN 'EUROPE' THEN 1 ELSE 2 END AS ploidy FROM region",
    "c9_reference_base": "SELECT doc_id, CAST(doc_id % 400 AS INT) AS pos, CASE WHEN length(text) >= doc_id % 400 + 2 THEN hex(substring(text, CAST(doc_id % 400 + 1 AS BIGINT), 2)) END AS bases FROM documents WHERE text IS NOT NULL",
    "c12_threshold_join": "SELECT CAST(k AS INT) AS k, count(l_orderkey) AS n FROM (SELECT unnest(range(11)) AS k) LEFT JOIN lineitem ON CAST(round(l_discount * 100) AS INT) >= k GROUP BY 1",
    "c13_bias_product": """SELECT * FROM (SELECT unnest(['none', '+', '-']) AS strand), (SELECT unnest(['none', '>', '<']) AS orientation), (SELECT unnest(['none', '^']) AS position), (SELECT unnest(['none', '$']) AS softclip),
        (SELECT unnest(['none', '*']) AS homopolymer), (SELECT unnest(['none', '*']) AS alt_locus) WHERE (strand <> 'none')::INT + (orientation <> 'none')::INT + (position <> 'none')::INT + (softclip <> 'none')::INT + (homopolymer <> 'none')::INT + (alt_locus <> 'none')::INT = 1""",
    "l1_sessionize": """WITH s AS (SELECT *, CASE WHEN epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w > 3600 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM s) SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM r GROUP BY ALL""",
    "l2_neighbours": "SELECT user_id, event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
}
