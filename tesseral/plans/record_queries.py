"""Queries on heavy keys, intervals, broken rows and packed fields (problems 3 to 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.operators import heavykeys, packed, periods, rejects
from tesseral.session import Scratch, drop_repeats


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chrom = heavykeys.majority_keys(_read(spark, sf_dir, "calls"), "chrom")
    return chrom.unionByName(heavykeys.majority_keys(_read(spark, sf_dir, "work_items"), "rid"))


def p3_chrom_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _read(spark, sf_dir, "calls").withColumn("prob_present", F.col("prob_present").cast("double"))
    got = heavykeys.dense_aggregate(calls, "chrom", sums=["prob_present"], minima=["pos"], maxima=["pos"])
    return got.select(
        F.col("key_value").alias("chrom"),
        "n_rows",
        F.round("sum_prob_present", 2).alias("sum_prob_present"),
        F.col("min_pos").cast("long").alias("min_pos"),
        F.col("max_pos").cast("long").alias("max_pos"),
    )


def p3_rid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = heavykeys.dense_aggregate(_read(spark, sf_dir, "work_items"), "rid", minima=["item_index"], maxima=["item_index"])
    return got.select(F.col("key_value").alias("rid"), "n_rows", F.col("min_item_index").cast("long").alias("min_item"), F.col("max_item_index").cast("long").alias("max_item"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = periods.structural_spans(_read(spark, sf_dir, "calls"))
    return periods.periods_and_gaps(spans, ["callset_id", "chrom"], "pos", "last_pos")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected_rows(rejects.parse_rows(_read(spark, sf_dir, "raw_records"), "raw_id", "line"), "raw_id")


def p5_typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.valid_rows(rejects.parse_rows(_read(spark, sf_dir, "raw_records"), "raw_id", "line"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    packed_rows = _read(spark, sf_dir, "calls").select("call_id", "ann", "aux_values").where("ann is not null or aux_values is not null")
    once = scratch.table(drop_repeats(scratch, packed_rows, ["call_id"]))
    scratch.keep_only(once)
    out = None
    for field, separators in (("ann", ",;\n"), ("aux_values", ",;|\t")):
        part = packed.split_packed(once, "call_id", field, separators).select("call_id", F.lit(field).alias("field_name"), "pos_no", "item_value")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {f.__name__: f for f in (p3_found, p3_chrom_results, p3_rid_results, p4_found, p5_found, p5_typed_rows, p6_found)}

_F = rejects.FIELD
_ROW = "^" + ",".join([f"({_F})"] * 11) + "$"
_NAMES = [n for n, *_ in rejects.VARIANT_ROWS.columns]
_CHECKED = f"""
    WITH r AS (SELECT raw_id, line, regexp_replace(line, '"[^"]*"', '', 'g') AS bare FROM raw_records),
    f AS (SELECT *, regexp_full_match(line, '{rejects.RECORD}') AS well, length(bare) - length(replace(bare, ',', '')) + 1 AS n_fields,
        regexp_extract(line, '{_ROW}', {_NAMES}) AS c FROM r),
    u AS (SELECT raw_id, well, n_fields, {", ".join(f"""nullif(CASE WHEN c['{n}'] LIKE '"%' THEN replace(substr(c['{n}'], 2, length(c['{n}']) - 2), '""', '"') ELSE c['{n}'] END, '') AS "{n}\"""" for n in _NAMES)} FROM f),
    checked AS (SELECT *, CASE WHEN NOT well THEN 'quoting' WHEN n_fields <> 11 THEN 'column_count'
        {" ".join(f"WHEN {p} THEN '{r}'" for r, p in rejects.VARIANT_ROWS.checks)} END AS reason FROM u)
"""

ORACLE = {
    "p5_found": _CHECKED + "SELECT raw_id, reason FROM checked WHERE reason IS NOT NULL",
    "p5_typed_rows": _CHECKED + "SELECT raw_id, " + ", ".join(f'try_cast("{n}" AS {t}) AS "{n}"' for n, t, _ in rejects.VARIANT_ROWS.columns) + " FROM checked WHERE reason IS NULL",
    "p3_found": """
        WITH c AS (SELECT 'chrom' AS field_name, chrom AS k, count(*) AS n, chrom AS s, 0 AS o FROM calls WHERE chrom IS NOT NULL GROUP BY chrom
                   UNION ALL SELECT 'rid', CAST(rid AS VARCHAR), count(*), '', rid FROM work_items WHERE rid IS NOT NULL GROUP BY rid),
        t AS (SELECT 'chrom' AS field_name, count(*) AS total FROM calls UNION ALL SELECT 'rid', count(*) FROM work_items),
        r AS (SELECT field_name, k, n, total, sum(n) OVER (PARTITION BY field_name ORDER BY n DESC, s, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before FROM c JOIN t USING (field_name))
        SELECT field_name, k AS key_value FROM r WHERE before * 2 <= total""",
    "p3_chrom_results": """SELECT chrom, count(*) AS n_rows, round(sum(CASE WHEN NOT isnan(prob_present) THEN CAST(prob_present AS DOUBLE) END), 2) AS sum_prob_present, min(pos) AS min_pos, max(pos) AS max_pos
        FROM calls WHERE chrom IS NOT NULL GROUP BY chrom""",
    "p3_rid_results": "SELECT rid, count(*) AS n_rows, min(item_index) AS min_item, max(item_index) AS max_item FROM work_items WHERE rid IS NOT NULL GROUP BY rid",
    "p4_found": """
        WITH i AS (SELECT DISTINCT callset_id, chrom, pos AS s, coalesce(end_pos, pos + abs(CAST(svlen AS BIGINT))) AS e FROM calls WHERE svtype IN ('DEL', 'DUP', 'INV', 'CNV') AND chrom IS NOT NULL),
        v AS (SELECT * FROM i WHERE e >= s),
        m AS (SELECT *, max(e) OVER (PARTITION BY callset_id, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
        g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY callset_id, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
        p AS (SELECT callset_id, chrom, k, min(s) AS a, max(e) AS z FROM g GROUP BY callset_id, chrom, k),
        q AS (SELECT *, lead(a) OVER (PARTITION BY callset_id, chrom ORDER BY k) AS following FROM p)
        SELECT callset_id, chrom, 'period' AS kind, a AS first_pos, z AS last_pos FROM q
        UNION ALL SELECT callset_id, chrom, 'gap', z + 1, following - 1 FROM q WHERE following IS NOT NULL""",
}
