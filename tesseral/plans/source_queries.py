"""Queries of the sources: variant text, decomposition, call lines, scenarios and properties; and of copy number changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.formula.scenario import Scenario, tumor_normal
from tesseral.functions import genomics as gn
from tesseral.operators import cnv, estimate, ranges
from tesseral.plans import views as v
from tesseral.plans.formula_queries import SCENARIO
from tesseral.session import Scratch
from tesseral.sources import observations as so
from tesseral.sources import variants as sv


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = v.once_calls(spark, sf_dir).where("chrom is not null")
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    clean = lambda c: F.when(~F.coalesce(bare(c), F.lit("")).isin("", "."), bare(c))
    return calls.select("call_id", "chrom", "pos", clean("id").alias("id"), F.col("ref_allele").alias("ref"), F.col("alt_allele").alias("alt"), F.upper("svtype").alias("svtype"), "svlen", F.col("end_pos").alias("end"), clean("event").alias("event"), F.coalesce("imprecise", F.lit(False)).alias("imprecise"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv.to_lines(_calls(spark, sf_dir).withColumn("call", F.col("call_id")), ["call", "svtype", "svlen", "end", "event", "imprecise"])


def a1_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain's calls written as record lines and scanned again."""
    got = sv.parse_lines(_lines(spark, sf_dir), "value")
    return got.select(sv.info("CALL").cast("long").alias("call_id"), "chrom", "pos", "id", "ref", "alt", sv.info("SVLEN").cast("int").alias("svlen"), F.map_contains_key("info", F.lit("IMPRECISE")).alias("imprecise"))


def a4_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed variants of the scanned lines, with the reasons of those left out."""
    records = sv.parse_lines(_lines(spark, sf_dir), "value").withColumn("id", sv.info("CALL"))
    got = sv.decompose(records)
    return got.select(F.col("id").cast("long").alias("call_id"), "allele", "vartype", "length", "skip")


def a4_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv.skip_counts(sv.decompose(sv.parse_lines(_lines(spark, sf_dir), "value").withColumn("id", sv.info("CALL"))))


def a12_call_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as text with their event probabilities."""
    calls = v.once_calls(spark, sf_dir).where("chrom is not null").select("chrom", "pos", F.lit(None).cast("string").alias("id"), F.col("ref_allele").alias("ref"), F.col("alt_allele").alias("alt"), "svtype", F.col("end_pos").alias("end"))
    return sv.to_lines(calls, ["svtype", "end"])


def a13_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = so.load_properties('{"insert_size": {"mean": 312.0, "sd": 11.9}, "max_read_len": 101}')
    return spark.createDataFrame([(p["insert_size"]["mean"], p["max_read_len"], p["max_mapq"], p["gap_params"]["prob_insertion_artifact"])], "mean double, max_read_len int, max_mapq int, insertion double")


def a14_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, resolutions and expressions of two scenarios."""
    rows = []
    for name, s in (("plain", Scenario.from_yaml(SCENARIO)), ("tumor_normal", tumor_normal(0.75))):
        rows += [(name, n, x.resolution, x.contamination, len(s.events), "absent" in s.expressions) for n, x in s.samples.items()]
    return spark.createDataFrame(rows, "scenario string, sample string, resolution double, contamination double, n_events int, has_absent boolean")


def a16_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plot's JSON of the regions, read back as rows."""
    rows = [r.asDict() for r in v.read(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()]  # five rows
    text = so.plot(rows, "bar", "r_regionkey", "r_regionkey", "r_name")
    t = spark.createDataFrame([(text,)], "j string")
    parsed = F.from_json("j", "struct<mark:string,data:struct<values:array<struct<r_regionkey:int,r_name:string>>>>")
    return t.select(parsed.alias("p")).select("p.mark", F.explode("p.data.values").alias("v")).select("mark", "v.r_regionkey", "v.r_name")


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a supplier along the parts as depths of tumor and normal: some stretches are doubled."""
    lines = v.read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("int").alias("q"))
    doubled = F.floor(F.col("l_partkey") / 40) % 3 == 1
    return lines.select("l_suppkey", F.col("l_partkey").alias("pos"), (F.lit(60) + F.col("q") % 3).cast("int").alias("depth_normal"), F.when(doubled, F.lit(120) + F.col("q") % 3).otherwise(F.lit(60) + F.col("q") % 3).cast("int").alias("depth_tumor"), F.when(doubled, F.lit(0.75)).otherwise(F.lit(0.5)).alias("vaf_tumor"), F.lit(0.99).alias("prob_het"))


def a5_fetch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each contig to fetch reads of the domain's calls from: a window of six deviations over the mean insert size at either side, merged."""
    window = round(312 + 6 * 11.9)
    loci = v.once_calls(spark, sf_dir).where("chrom is not null and pos is not null").select("chrom", (F.col("pos") - window).alias("lo"), (F.col("pos") + window).alias("hi"))
    return ranges.coalesce_intervals(loci, ["chrom"], "lo", "hi", 2 * window)


def a7_valid_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = (F.col("l_partkey") % 4096).cast("int")
    return v.read(spark, sf_dir, "lineitem").where(gn.valid_read(flag)).groupBy("l_linenumber").agg(F.count("*").alias("n"))


def a9_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of two samples written with their lineage and read again; a third sample has none."""
    obs = v.observations(spark, sf_dir).select("variant", "sample", "ln_map", "ln_alt", "ln_ref")
    scratch = Scratch(spark)
    scratch.table(spark.range(1))
    paths = {}
    for s in ("F", "O"):
        paths[s] = f"{scratch.root}/{s}"
        so.write_observations(obs.where(F.col("sample") == s), paths[s], {"max_depth": 200, "sample": s})
    return so.read_observations(spark, paths, ["F", "N", "O"]).groupBy("sample").agg(F.count("*").alias("n"), F.countDistinct("variant").alias("n_variants"))


def a10_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    scratch.table(spark.range(1))
    so.write_observations(v.observations(spark, sf_dir).select("variant", "sample").where("variant < 100"), f"{scratch.root}/x", {"max_depth": 200, "window": 64})
    return spark.createDataFrame(sorted(so.read_lineage(spark, f"{scratch.root}/x").items()), "option string, value long")


def a15_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions written as delimited text and read again."""
    scratch = Scratch(spark)
    scratch.table(spark.range(1))
    so.write_delimited(v.read(spark, sf_dir, "region").select("r_regionkey", "r_name"), f"{scratch.root}/d")
    return spark.read.option("header", True).option("sep", "\t").schema("r_regionkey int, r_name string").csv(f"{scratch.root}/d")


def l6_pmfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of depths and of hits."""
    rows = [(k, float(cnv.poisson_ln(k, 7.5)), float(cnv.binomial_ln(k, 20, 0.3))) for k in range(21)]
    return spark.createDataFrame(rows, "k int, p double, b double").select("k", F.round("p", 6).alias("poisson"), F.round("b", 6).alias("binomial"))


def l3_depth_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(estimate.depth_factor(_depths(spark, sf_dir), "depth_tumor", "depth_normal"), 6),)], "factor double")


def l4_cnv_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy number changes in each region of parts of a supplier."""
    return cnv.call_cnvs(_depths(spark, sf_dir), ["l_suppkey"], "pos", 1.0, gap=500)


def l5_region_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cnv.region_likelihoods(_depths(spark, sf_dir), ["l_suppkey"], "pos", 1.0, gap=500)


QUERIES = v.named(a1_scan, a4_decompose, a4_skips, a5_fetch_windows, a7_valid_reads, a9_observations, a10_lineage, a15_delimited, l6_pmfs, a12_call_lines, a13_properties, a14_scenario, a16_plot, l3_depth_factor, l4_cnv_calls, l5_region_likelihood)

_CALLS = f"""{v.ONCE_SQL}, c AS (SELECT call_id, chrom, pos, CASE WHEN coalesce(regexp_replace(id, '^\\s+|\\s+$', '', 'g'), '') NOT IN ('', '.') THEN regexp_replace(id, '^\\s+|\\s+$', '', 'g') END AS id, upper(ref_allele) AS ref, alt_allele AS alt, upper(svtype) AS svtype, svlen, end_pos, CASE WHEN coalesce(regexp_replace(event, '^\\s+|\\s+$', '', 'g'), '') NOT IN ('', '.') THEN regexp_replace(event, '^\\s+|\\s+$', '', 'g') END AS event,
    coalesce(imprecise, false) AS imprecise FROM once WHERE chrom IS NOT NULL)"""
_DECOMPOSED = f"""{_CALLS}, u AS (SELECT call_id, svtype, svlen, end_pos, pos, event, imprecise, ref, n, allele, upper(a) AS a, length(ref) AS rl, length(a) AS al FROM (SELECT *, len(l) AS n, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS allele FROM (SELECT *, string_split(coalesce(alt, ''), ',') AS l FROM c))),
    w AS (SELECT *, CASE WHEN allele = 0 THEN abs(svlen) END AS sl, coalesce(abs(svlen), CASE WHEN svlen IS NULL THEN end_pos - 1 - pos END) AS dl, rl = 1 AND al > 1 AND starts_with(a, ref) AS ai, al = 1 AND rl > 1 AND starts_with(ref, a) AS ad FROM u),
    s AS (SELECT *, CASE WHEN imprecise AND svtype IS NOT NULL AND svtype <> 'BND' THEN 'imprecise' WHEN svtype = 'INV' AND n <> 1 THEN 'inversion_invalid_alt' WHEN svtype = 'INV' AND end_pos IS NULL THEN 'inversion_missing_end' WHEN svtype = 'DUP' AND n <> 1 THEN 'duplication_invalid_alt' WHEN svtype = 'DUP' AND end_pos IS NULL THEN 'duplication_missing_end'
        WHEN svtype = 'BND' AND event IS NULL THEN 'breakend_no_event' WHEN svtype = 'INS' AND n <> 1 THEN 'several_alts' WHEN svtype = 'INS' AND NOT ai THEN 'insertion_without_sequence' WHEN svtype = 'DEL' AND n <> 1 THEN 'several_alts' WHEN svtype = 'DEL' AND coalesce(dl, 0) <= 0 THEN 'deletion_without_length' WHEN svtype = 'DEL' AND a <> '<DEL>' AND NOT ad THEN 'deletion_alleles'
        WHEN svtype IS NOT NULL AND svtype NOT IN ('INV', 'DUP', 'BND', 'INS', 'DEL') THEN 'other_svtype' WHEN svtype IS NULL AND a = '<DEL>' AND sl IS NULL THEN 'deletion_without_length' WHEN svtype IS NULL AND starts_with(a, '<') AND a NOT IN ('<*>', '<DEL>', '<METH>') THEN 'other_symbol' WHEN a = '' THEN 'no_allele' END AS skip FROM w),
    t AS (SELECT *, CASE WHEN skip IS NULL THEN CASE WHEN svtype IN ('INV', 'DUP', 'BND', 'INS', 'DEL') THEN svtype WHEN a = '<*>' THEN 'REF' WHEN a = '<DEL>' THEN 'DEL' WHEN a = '<METH>' THEN 'METH' WHEN rl = 1 AND al = 1 THEN 'SNV' WHEN rl = al THEN 'MNV' WHEN ad THEN 'DEL' WHEN ai THEN 'INS' ELSE 'REP' END END AS vartype FROM s)"""
ORACLE = {
    "a1_scan": f"WITH {_CALLS} SELECT call_id, chrom, pos, id, ref, alt, svlen, imprecise FROM c",
    "a4_decompose": f"""WITH {_DECOMPOSED} SELECT call_id, CAST(allele AS INT) AS allele, vartype, CAST(CASE WHEN vartype IN ('INV', 'DUP') THEN end_pos + 1 - pos WHEN vartype = 'DEL' AND svtype = 'DEL' THEN dl WHEN vartype = 'DEL' AND starts_with(a, '<') THEN sl WHEN vartype = 'DEL' THEN rl - al WHEN vartype = 'INS' THEN al - rl WHEN vartype = 'MNV' THEN al END AS BIGINT) AS length, skip FROM t""",
    "a4_skips": f"WITH {_DECOMPOSED} SELECT skip, count(*) AS n FROM t WHERE skip IS NOT NULL GROUP BY skip",
    "a12_call_lines": f"""WITH {v.ONCE_SQL} SELECT concat_ws(chr(9), chrom, pos::VARCHAR, '.', coalesce(ref_allele, '.'), coalesce(alt_allele, '.'), '.', '.', CASE WHEN svtype IS NULL AND end_pos IS NULL THEN '.' ELSE concat_ws(';', 'SVTYPE=' || svtype, 'END=' || end_pos::VARCHAR) END) AS value FROM once WHERE chrom IS NOT NULL""",
    "a5_fetch_windows": f"""WITH {v.ONCE_SQL}, l AS (SELECT chrom, pos - 383 AS lo, pos + 383 AS hi FROM once WHERE chrom IS NOT NULL AND pos IS NOT NULL), m AS (SELECT *, max(hi) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l),
        h AS (SELECT *, CASE WHEN reach IS NULL OR lo > reach + 766 THEN 1 ELSE 0 END AS new FROM m), g AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY lo, hi, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM h) SELECT chrom, min(lo) AS first_start, max(hi) AS last_end, count(*) AS n FROM g GROUP BY chrom, k""",
    "a7_valid_reads": "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE (CAST(l_partkey % 4096 AS INT) & 1796) = 0 GROUP BY 1",
    "a9_observations": "SELECT l_linestatus AS sample, count(*) AS n, count(DISTINCT l_orderkey) AS n_variants FROM lineitem GROUP BY 1",
    "a10_lineage": "SELECT unnest(['max_depth', 'window']) AS option, CAST(unnest([200, 64]) AS BIGINT) AS value",
    "a15_delimited": "SELECT r_regionkey, r_name FROM region",
    "l6_pmfs": "SELECT CAST(range AS INT) AS k, round(range * ln(7.5::DOUBLE) - 7.5 - lgamma(range + 1), 6) AS poisson, round(lgamma(21) - lgamma(range + 1) - lgamma(21 - range) + range * ln(0.3::DOUBLE) + (20 - range) * ln(0.7::DOUBLE), 6) AS binomial FROM range(21)",
    "a13_properties": "SELECT 312.0::DOUBLE AS mean, 101 AS max_read_len, 60 AS max_mapq, 2.8e-6::DOUBLE AS insertion",
    "a14_scenario": "SELECT unnest(['plain', 'plain', 'tumor_normal', 'tumor_normal']) AS scenario, unnest(['f', 'o', 'normal', 'tumor']) AS sample, unnest([0.1::DOUBLE, 0.01, 0.1, 0.01]) AS resolution, unnest([0.0::DOUBLE, 0.0, 0.0, 0.25]) AS contamination, unnest([1, 1, 4, 4]) AS n_events, true AS has_absent",
    "a16_plot": "SELECT 'bar' AS mark, r_regionkey, r_name FROM region",
    "l3_depth_factor": "WITH q AS (SELECT l_suppkey, l_partkey, CAST(sum(l_quantity) AS INT) % 3 AS k FROM lineitem GROUP BY ALL) SELECT round(avg(CASE WHEN l_partkey // 40 % 3 = 1 THEN 120 + k ELSE 60 + k END) / avg(60 + k), 6) AS factor FROM q",
}
