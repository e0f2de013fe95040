"""Queries of the training-data operators (problems 1, 2 and 7 to 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.llm import components, encoding, leakage, quantiles, reading
from tesseral.session import Scratch, drop_repeats


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.tied_groups(_read(spark, sf_dir, "calls"))


def p1_all_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.all_groups(_read(spark, sf_dir, "calls"))


#: Fixed value: the filler that stands for an unknown template length.
UNKNOWN_TLEN = 2147483647.0


def _usable_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable template lengths per sample and run day, of each chunk once."""
    chunks = _read(spark, sf_dir, "alignment_stats").select("stats_id", "sample_name", F.to_date("run_at").alias("run_day"), "tlens")
    usable = F.filter("tlens", lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < UNKNOWN_TLEN))
    return drop_repeats(Scratch(spark), chunks, ["stats_id"]).select("sample_name", "run_day", usable.alias("tlens"))


def _usable_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable allele frequencies per sample; a null in the key makes a row of its own unless all of it is equal."""
    once = _read(spark, sf_dir, "sample_info").select("call_id", "sample_name", "allelefreq_estimate", "dp", "estimated_at").distinct()
    return once.where("allelefreq_estimate between 0.0 and 1.0").select("sample_name", "allelefreq_estimate")


def _tlen_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.digest_table(_usable_lengths(spark, sf_dir), ["sample_name", "run_day"], "tlens")


def _frequency_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.digest_table(_usable_shares(spark, sf_dir), ["sample_name"], "allelefreq_estimate")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of both columns; run_day is null for allele frequencies, which are per sample."""
    lengths = quantiles.value_percentiles(_usable_lengths(spark, sf_dir), ["sample_name", "run_day"], "tlens")
    shares = quantiles.value_percentiles(_usable_shares(spark, sf_dir), ["sample_name"], "allelefreq_estimate").withColumn("run_day", F.lit(None).cast("date"))
    return lengths.withColumn("field_name", F.lit("tlens")).unionByName(shares.withColumn("field_name", F.lit("allelefreq_estimate")))


def p2_tlen_percentiles_all_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days' digests combined by node addition: percentiles per sample."""
    return quantiles.percentiles(quantiles.merge([_tlen_digest(spark, sf_dir)], ["sample_name"]), ["sample_name"])


def p2_tlen_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tlen_digest(spark, sf_dir)


def p2_rank_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the true rank of each percentile of the allele frequencies is within its bound."""
    values = _usable_shares(spark, sf_dir).withColumnRenamed("allelefreq_estimate", "v")
    found = quantiles.percentiles(_frequency_digest(spark, sf_dir), ["sample_name"])
    asked = found.groupBy("sample_name").agg(F.collect_list(F.struct("share", "value", "n_values", "most_rank_error")).alias("asked"))
    slack = quantiles.VALUE_ERROR
    ranks = values.groupBy("sample_name", "v").agg(F.count("*").alias("n")).join(asked.withColumnRenamed("sample_name", "s"), F.col("sample_name").eqNullSafe(F.col("s")))
    ranks = ranks.select("sample_name", "v", "n", F.explode("asked").alias("a")).groupBy("sample_name", "a.share").agg(
        F.sum(F.when(F.col("v") < F.col("a.value") * (1 - slack), F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("v") <= F.col("a.value") * (1 + slack), F.col("n")).otherwise(0)).alias("upto"),
        F.max(F.col("a.share") * F.col("a.n_values")).alias("wanted"),
        F.max("a.most_rank_error").alias("most"),
    )
    return ranks.select("sample_name", "share", ((F.col("below") - F.col("most") <= F.col("wanted")) & (F.col("wanted") <= F.col("upto") + F.col("most"))).alias("within_bound"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(_read(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text decoded from its ids: equal to the text, empty for a null text."""
    return encoding.decode_corpus(encoding.encode_corpus(_read(spark, sf_dir, "documents")))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without those that leak."""
    docs = _read(spark, sf_dir, "documents")
    return leakage.remove_leaking_documents(docs, Scratch(spark).table(_leaks(spark, sf_dir))).select("doc_id", "lang", "source")


def p8_blanked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaking documents without the leaked passages."""
    docs = _read(spark, sf_dir, "documents")
    return leakage.blank_leaked_spans(docs, Scratch(spark).table(_leaks(spark, sf_dir))).select("doc_id", "clean_text")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "reading_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", "band")


def p9_band_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How demanding the corpus is: documents, words and mean score per band."""
    return _levels(spark, sf_dir).groupBy("band").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.round(F.avg("score"), 4).alias("mean_score"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_all_groups, p2_percentiles, p2_tlen_percentiles_all_days, p2_tlen_digest, p2_rank_bounds, p7_ids, p7_round_trip, p8_found, p8_clean_documents, p8_blanked_spans, p9_found, p9_band_profile)
}

_TIES = """
    WITH RECURSIVE base AS (SELECT DISTINCT call_id, callset_id, regexp_replace(id, '^\\s+|\\s+$', '', 'g') AS n, regexp_replace(event, '^\\s+|\\s+$', '', 'g') AS e, mateid FROM calls),
    ids AS (SELECT call_id, callset_id, n FROM base WHERE n NOT IN ('', '.')),
    mates AS (SELECT call_id, callset_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS n FROM (SELECT call_id, callset_id, unnest(string_split(mateid, ',')) AS x FROM base) WHERE regexp_replace(x, '^\\s+|\\s+$', '', 'g') NOT IN ('', '.')),
    star AS (SELECT callset_id, n, min(call_id) AS v FROM ids GROUP BY callset_id, n),
    events AS (SELECT callset_id, e, min(call_id) AS v FROM base WHERE e NOT IN ('', '.') GROUP BY callset_id, e),
    edges AS (SELECT call_id AS u, v FROM ids JOIN star USING (callset_id, n) UNION SELECT call_id, v FROM mates JOIN star USING (callset_id, n) UNION SELECT call_id, v FROM base JOIN events USING (callset_id, e)),
    two AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
    reach(node, other) AS (SELECT u, u FROM two UNION SELECT reach.node, two.v FROM reach JOIN two ON reach.other = two.u),
    tied AS (SELECT node AS call_id, min(other) AS group_id FROM reach GROUP BY node)
"""
ORACLE = {
    "p1_found": _TIES + "SELECT call_id, group_id FROM tied",
    "p1_all_groups": _TIES + "SELECT DISTINCT c.call_id, coalesce(group_id, c.call_id) AS group_id FROM calls c LEFT JOIN tied t ON c.call_id = t.call_id",
    "p2_rank_bounds": "SELECT sample_name, unnest([0.05::DOUBLE, 0.25, 0.5, 0.75, 0.95, 0.99]) AS share, true AS within_bound FROM (SELECT DISTINCT sample_name FROM sample_info WHERE allelefreq_estimate BETWEEN 0 AND 1)",
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
