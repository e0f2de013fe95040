"""Queries of allele support by reads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.functions import genomics as gn
from tesseral.functions import reads as rd
from tesseral.operators import evidence as ev
from tesseral.plans import views as v


def _r(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as reads: clipped by their number, five bases, two deleted, the rest; the locus is up to eleven bases on."""
    n = F.col("l_quantity").cast("int") + 10
    lines = v.read(spark, sf_dir, "lineitem").withColumns({"len": n, "start": F.col("l_partkey"), "pos": F.col("l_partkey") + F.col("l_suppkey") % 12})
    seq = F.substr(F.repeat(F.lit("ACGTN"), F.lit(20)), F.col("l_linenumber") + 1, F.col("len"))
    cigar = F.format_string("%dS5M2D%dM", F.col("l_linenumber"), F.col("len") - F.col("l_linenumber") - 5)
    return lines.withColumns({"seq": seq, "ops": gn.cigar_ops(cigar)})


def _place(shift: int = 0) -> Column:
    return ev.read_position(F.col("ops"), F.col("start"), F.col("pos") + shift)


def k1_snv_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _reads(spark, sf_dir).withColumn("place", _place()).withColumn("base", ev.base_at(F.col("seq"), F.col("place")))
    s = ev.snv_support(F.col("base"), F.lit(20), F.lit("A"), F.lit("G"))
    return reads.where("base is not null").groupBy("place", "base").agg(F.count("*").alias("n"), F.max(_r(s["ln_ref"])).alias("ln_ref"), F.max(_r(s["ln_alt"])).alias("ln_alt"), F.max(s["third"]).alias("third"))


def k2_mnv_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _reads(spark, sf_dir).withColumn("bases", F.array(*(ev.base_at(F.col("seq"), _place(k)) for k in (0, 1)))).where("bases[0] is not null and bases[1] is not null")
    s = ev.mnv_support(F.col("bases"), F.array(F.lit(20), F.lit(30)), F.lit("AC"), F.lit("GT"), F.lit(math.log(0.02)))
    return reads.groupBy(F.array_join("bases", "").alias("bases")).agg(F.count("*").alias("n"), F.max(_r(s["ln_ref"])).alias("ln_ref"), F.max(_r(s["ln_alt"])).alias("ln_alt"), F.max(s["third"]).alias("third"))


def k10_reference_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _reads(spark, sf_dir).withColumn("base", ev.base_at(F.col("seq"), _place())).where("base is not null")
    s = ev.reference_site_support(F.col("base"), F.lit(20), F.lit("A"))
    strand = ev.strand_if_told(s["ln_ref"], s["ln_alt"], F.lit("Forward"))
    return reads.groupBy("base").agg(F.count("*").alias("n"), F.max(_r(s["ln_ref"])).alias("ln_ref"), F.max(_r(s["ln_alt"])).alias("ln_alt"), F.max(strand).alias("strand"))


def k6_k7_breakends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inversions and duplications of the domain as breakends."""
    calls = v.once_calls(spark, sf_dir).where("svtype in ('INV', 'DUP') and chrom is not null and end_pos > pos and ref_allele is not null")
    joints = ev.breakends_of(F.col("svtype"), F.col("chrom"), F.col("pos") - 1, F.col("end_pos") - F.col("pos") + 1, F.substring("ref_allele", 1, 1), F.lit("N"))
    return calls.select("call_id", F.posexplode(joints).alias("k", "b")).select("call_id", "k", "b.pos", "b.spec")


def k8_breakend_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles of small breakend groups, walked from the left."""
    seq = "AACCGGTTAACC"
    groups = {"deletion": [(3, 8, "t["), (8, 3, "]t")], "inversion": [(3, 7, "t]"), (4, 8, "[t")], "none": []}
    rows = [(n, ev.spliced(seq, ev.walk_breakends(g, len(seq)))) for n, g in groups.items()]
    return spark.createDataFrame(rows, "name string, allele string")


def k11_methylation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a read's tags, forward and reversed."""
    lines = v.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 2 == 0).alias("reverse"), F.array(F.col("l_quantity").cast("int"), F.lit(255)).alias("ml"))
    got = rd.methylation_map(F.lit("ACGTCACGTCACGTCACGTC"), F.lit("A+a,1;C+m,0,2;"), F.concat(F.array(F.lit(7)), "ml"), F.col("reverse"))
    return lines.select("l_orderkey", "l_linenumber", F.explode(got).alias("place", "p")).select("l_orderkey", "l_linenumber", "place", _r("p").alias("p"))


def k12_isize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of a deletion of 12 bases by quantities as insert sizes."""
    s = rd.isize_support(F.col("l_quantity"), F.lit(25.0), F.lit(8.0), F.lit(12.0))
    return v.read(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"), F.max(s["ln_ref"]).alias("ln_ref"), F.max(s["ln_alt"]).alias("ln_alt"))


def k13_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _reads(spark, sf_dir).withColumn("place", _place())
    w = ev.candidate_window(F.col("place"), F.col("len"), 8)
    return reads.where(w.isNotNull()).groupBy(w["read_start"].alias("read_start"), w["read_stop"].alias("read_stop"), w["ref_before"].alias("ref_before")).agg(F.count("*").alias("n"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents as reads and alleles: the alternative has one letter changed."""
    docs = v.read(spark, sf_dir, "documents").where("length(text) >= 60 and not contains(text, '~')")
    ref = F.substring("text", 1, 60)
    return docs.select("doc_id", ref.alias("ref"), F.concat(F.substring("text", 1, 29), F.lit("~"), F.substring("text", 31, 30)).alias("alt")).withColumn("read", F.substring("alt", 11, 40))


def k14_realign(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _windows(spark, sf_dir).withColumn("s", ev.realigned_support(F.col("read"), F.lit(None).cast("array<int>"), F.col("ref"), F.col("alt")))
    return got.select("doc_id", (F.col("s.ln_alt") > F.col("s.ln_ref")).alias("alt_wins"), _r(F.exp("s.ln_alt") + F.exp("s.ln_ref")).alias("total"), F.col("s.edits").alias("edits"))


def k15_pairhmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read is likelier under its own allele than under one that differs in a letter."""
    quals = F.lit(None).cast("array<int>")
    got = _windows(spark, sf_dir).select("doc_id", ev.pair_hmm_ln(F.col("read"), quals, F.col("alt")).alias("own"), ev.pair_hmm_ln(F.col("read"), quals, F.col("ref")).alias("other"))
    return got.select("doc_id", (F.col("own") > F.col("other") + 3).alias("own_wins"))


def k16_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _windows(spark, sf_dir)
    return got.select("doc_id", ev.fewest_edits(F.col("read"), F.col("alt")).alias("own"), ev.fewest_edits(F.col("read"), F.col("ref")).alias("other"))


def k17_third_allele(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read with more edits than its errors explain is an allele of its own."""
    rows = [(n, ev.third_allele(r, "AACCGGTTAACC", 0.05)) for n, r in (("same", "CCGGTT"), ("changed", "CCGATT"), ("longer", "CCGGGGTT"))]
    return spark.createDataFrame(rows, "name string, allele string")


def k18_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alternative window of each variant type."""
    rows = [("SNV", "C"), ("MNV", "CCC"), ("DEL", None), ("INS", "CC"), ("REP", "C"), ("INV", None), ("DUP", None), ("REF", None)]
    table = spark.createDataFrame(rows, "vartype string, alt string")
    return table.select("vartype", ev.allele_windows(F.lit("AA"), F.lit("GAT"), F.lit("TT"), F.col("vartype"), F.col("alt"), F.lit(3)).alias("window"))


QUERIES = v.named(k1_snv_support, k2_mnv_support, k6_k7_breakends, k8_breakend_group, k10_reference_site, k11_methylation, k12_isize, k13_window, k14_realign, k15_pairhmm, k16_edit, k17_third_allele, k18_alleles)

_PLACE = "CASE WHEN {o} < 5 THEN l_linenumber + {o} WHEN {o} >= 7 AND l_linenumber + {o} - 2 < CAST(l_quantity AS INT) + 10 THEN l_linenumber + {o} - 2 END"
_SEQ = "substr(repeat('ACGTN', 20), l_linenumber + 1, CAST(l_quantity AS INT) + 10)"
_AT = f"spot AS (SELECT *, {_PLACE.format(o='(l_suppkey % 12)')} AS place, {_PLACE.format(o='(l_suppkey % 12 + 1)')} AS place2, {_SEQ} AS seq, CAST(l_quantity AS INT) + 10 AS len FROM lineitem), b AS (SELECT *, nullif(substr(seq, place + 1, 1), '') AS base, nullif(substr(seq, place2 + 1, 1), '') AS base2 FROM spot)"


def _read_sql(base: str, allele: str, q: float) -> str:
    return f"CASE WHEN {base} = {allele} THEN ln(1 - {q}::DOUBLE) WHEN {base} = 'N' THEN ln(0.25::DOUBLE) ELSE ln({q}::DOUBLE) + ln(0.3333::DOUBLE) END"


_PAIR_REF = f"{_read_sql('base', chr(39) + 'A' + chr(39), 0.01)} + {_read_sql('base2', chr(39) + 'C' + chr(39), 0.001)}"
_PAIR_ALT = f"{_read_sql('base', chr(39) + 'G' + chr(39), 0.01)} + {_read_sql('base2', chr(39) + 'T' + chr(39), 0.001)}"
ORACLE = {
    "k1_snv_support": f"""WITH {_AT} SELECT CAST(place AS BIGINT) AS place, base, count(*) AS n, round(max({_read_sql('base', "CASE WHEN base NOT IN ('N', 'G') THEN base ELSE 'A' END", 0.01)}), 6) + 0.0 AS ln_ref, round(max({_read_sql('base', "'G'", 0.01)}), 6) + 0.0 AS ln_alt,
        max(CASE WHEN base NOT IN ('N', 'G', 'A') THEN 1 END) AS third FROM b WHERE base IS NOT NULL GROUP BY ALL""",
    "k2_mnv_support": f"""WITH {_AT}, s AS (SELECT base || base2 AS bases, {_PAIR_REF} AS lr, {_PAIR_ALT} AS la, CASE WHEN base NOT IN ('N', 'G') THEN 1 ELSE 0 END + CASE WHEN base2 NOT IN ('N', 'T') THEN 1 ELSE 0 END AS e, {_read_sql('base', 'base', 0.01)} + {_read_sql('base2', 'base2', 0.001)} AS own FROM b WHERE base IS NOT NULL AND base2 IS NOT NULL)
        SELECT bases, count(*) AS n, round(max(CASE WHEN la > lr AND e > 0 THEN own ELSE lr END), 6) + 0.0 AS ln_ref, round(max(la), 6) + 0.0 AS ln_alt, max(CASE WHEN la > lr AND e > 0 THEN e END) AS third FROM s GROUP BY bases""",
    "k10_reference_site": f"WITH {_AT} SELECT base, count(*) AS n, round(max(CASE WHEN base = 'A' THEN ln(0.99::DOUBLE) ELSE ln(0.01::DOUBLE) END), 6) + 0.0 AS ln_ref, round(max(CASE WHEN base = 'A' THEN ln(0.01::DOUBLE) ELSE ln(0.99::DOUBLE) END), 6) + 0.0 AS ln_alt, 'Forward' AS strand FROM b WHERE base IS NOT NULL GROUP BY base",
    "k6_k7_breakends": f"""WITH {v.ONCE_SQL}, c AS (SELECT call_id, svtype, chrom AS c, pos - 1 AS s, end_pos - 1 AS e, substr(ref_allele, 1, 1) AS f FROM once WHERE svtype IN ('INV', 'DUP') AND chrom IS NOT NULL AND end_pos > pos AND ref_allele IS NOT NULL)
        SELECT call_id, 0 AS k, s - 1 AS pos, f || ']' || c || ':' || (e + 1) || ']' AS spec FROM c WHERE svtype = 'INV' UNION ALL SELECT call_id, 1, e, 'N]' || c || ':' || s || ']' FROM c WHERE svtype = 'INV' UNION ALL SELECT call_id, 2, s, '[' || c || ':' || (e + 2) || '[' || f FROM c WHERE svtype = 'INV'
        UNION ALL SELECT call_id, 3, e + 1, '[' || c || ':' || (s + 1) || '[N' FROM c WHERE svtype = 'INV' UNION ALL SELECT call_id, 0, e, 'N[' || c || ':' || (s + 1) || '[' FROM c WHERE svtype = 'DUP' UNION ALL SELECT call_id, 1, s, ']' || c || ':' || (e + 1) || ']' || f FROM c WHERE svtype = 'DUP'""",
    "k8_breakend_group": "SELECT unnest(['deletion', 'inversion', 'none']) AS name, unnest(['AACCAACC', 'AACCAACCAACC', 'AACCGGTTAACC']) AS allele",
    "k11_methylation": "SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 17 ELSE 1 END ELSE CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 9 END END AS place, round(CASE WHEN k = 0 THEN (CAST(l_quantity AS INT) + 0.5) / 256 ELSE 255.5 / 256 END, 6)::DOUBLE AS p FROM lineitem, (SELECT unnest([0, 1]) AS k)",
    "k13_window": f"WITH {_AT} SELECT CAST(greatest(place - 8, 0) AS BIGINT) AS read_start, CAST(least(place + 9, len) AS BIGINT) AS read_stop, 12 AS ref_before, count(*) AS n FROM b WHERE place < len GROUP BY ALL",
    "k14_realign": "SELECT doc_id, true AS alt_wins, 1.0::DOUBLE AS total, 0 AS edits FROM documents WHERE length(text) >= 60 AND NOT contains(text, '~')",
    "k15_pairhmm": "SELECT doc_id, true AS own_wins FROM documents WHERE length(text) >= 60 AND NOT contains(text, '~')",
    "k16_edit": "SELECT doc_id, 0 AS own, 1 AS other FROM documents WHERE length(text) >= 60 AND NOT contains(text, '~')",
    "k17_third_allele": "SELECT unnest(['same', 'changed', 'longer']) AS name, unnest([NULL, 'AACCGATTAACC', 'AACCGGGGTTAACC']) AS allele",
    "k18_alleles": "SELECT unnest(['SNV', 'MNV', 'DEL', 'INS', 'REP', 'INV', 'DUP', 'REF']) AS vartype, unnest(['AACTT', 'AACCCTT', 'AATT', 'AAGATCCTT', 'AACTT', 'AAATCTT', 'AAGATGATTT', 'AAGATTT']) AS window",
}
