"""Queries of the scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.functions import genomics as gn
from tesseral.functions import logprob as lp
from tesseral.functions import reads as rd
from tesseral.operators import pileup
from tesseral.plans import views as v


def _r(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def h1_phred_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear probabilities of the events of the domain's calls."""
    calls = v.once_calls(spark, sf_dir)
    return calls.groupBy("callset_id").agg(*(_r(F.sum(lp.phred_to_prob(F.col(c))), 4).alias(c) for c in ("prob_present", "prob_absent", "prob_artifact")))


def h2_log1mexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.read(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n")).select("l_quantity", _r(lp.one_minus(-F.col("l_quantity") / 10)).alias("y"), "n")


def h3_logaddexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _r(lp.add(-F.col("l_quantity") / 10, -F.col("l_linenumber").cast("double"))).alias("y"))


def h4_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.read(spark, sf_dir, "lineitem").groupBy(_r(lp.cap(F.col("l_discount") / 100 - 0.0005), 9).alias("y")).agg(F.count("*").alias("n"))


def h5_kass_raftery(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.col("l_quantity") * F.col("l_linenumber") / 2
    return v.read(spark, sf_dir, "lineitem").groupBy(lp.evidence_level(factor).alias("level"), lp.evidence_letter(factor).alias("letter")).agg(F.count("*").alias("n"))


def h6_bayes_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stronger allele of each observation with the letter of its evidence; an exact tie is E."""
    obs = v.observations(spark, sf_dir).where("abs(a - r) > 1e-9")
    return obs.groupBy("variant").agg(F.count_if(lp.strongest_evidence(F.col("ln_alt"), F.col("ln_ref")) == "RP").alias("n_rp"), F.count_if(lp.strongest_evidence(F.col("ln_alt"), F.col("ln_ref")) == "AB").alias("n_ab"), F.count_if(lp.strongest_evidence(F.col("ln_alt"), F.col("ln_ref")).startswith("A")).alias("n_a"))


def h7_read_base_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line marks as bases: on even lines the mark is read against itself."""
    lines = v.read(spark, sf_dir, "lineitem")
    allele = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise(F.col("l_linestatus"))
    return lines.select("l_orderkey", "l_linenumber", _r(gn.read_base_ln(F.col("l_returnflag"), allele, F.col("l_quantity"))).alias("ln_prob"))


def h8_isize_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of each quantity as an insert size of mean 25 and deviation 8."""
    return v.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rd.isize_pmf_ln(F.col("l_quantity"), F.lit(25.0), F.lit(8.0)).alias("ln_prob"))


def h9_insert_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = F.col("l_partkey"), F.col("l_partkey") + F.col("l_quantity").cast("int")
    size = gn.estimated_insert_size(start, F.col("l_linenumber"), end, F.col("l_linenumber") % 3)
    return v.read(spark, sf_dir, "lineitem").groupBy(size.cast("bigint").alias("insert_size")).agg(F.count("*").alias("n"))


def h10_sample_alt_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    feasible = F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_linenumber") * 4)
    got = gn.sampling_ln(F.lit(30), feasible, F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("int")))
    return v.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _r(got).alias("ln_prob"))


def h11_sample_alt_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance to sample an allele of the quantity's length by fragments of mean 300 and deviation 30 with reads of 100."""
    lengths = v.read(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("len")).agg(F.count("*").alias("n"))
    return lengths.select("len", "n", rd.fragment_sampling_ln(F.col("len"), F.lit(100), F.lit(100), F.lit(80), F.lit(80), F.lit(300.0), F.lit(30.0)).alias("ln_prob"))


def h12_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = v.observations(spark, sf_dir)
    return obs.select("l_orderkey", "l_linenumber", _r(gn.either_ln(F.col("ln_map"), F.col("ln_alt"))).alias("ln_prob"))


def h13_log2fc(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = gn.log2_fold_change(F.col("l_discount"), F.col("l_tax"))
    return v.read(spark, sf_dir, "lineitem").groupBy(F.round(change, 6).alias("l2fc")).agg(F.count("*").alias("n"))


def h13_fold_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts that leave a tax above a quarter of them possible, and the bounds."""
    b = gn.fold_bounds(">", 2.0, F.col("l_discount") * 10)
    return v.read(spark, sf_dir, "lineitem").groupBy(_r(F.col("l_discount")).alias("discount")).agg(F.min(_r(b["hi"])).alias("hi"), F.bool_or(b["hi_open"]).alias("hi_open"))


def h14_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each comparison and its opposite hold."""
    parts = v.read(spark, sf_dir, "part")
    out = {f"n_{n}": F.count_if(gn.compare(F.col("p_size"), op, F.lit(25))) for n, op in _OPS.items()}
    out |= {f"not_{n}": F.count_if(gn.compare(F.col("p_size"), gn.NEGATED[op], F.lit(25))) for n, op in _OPS.items()}
    return parts.groupBy("p_brand").agg(*(x.alias(n) for n, x in out.items()))


_OPS = {"eq": "==", "ne": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}


def h15_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.once_calls(spark, sf_dir).groupBy(gn.change_class(F.col("ref_allele"), F.col("alt_allele")).alias("change")).agg(F.count("*").alias("n"))


def h16_genotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.read(spark, sf_dir, "sample_info").distinct().groupBy("sample_name", gn.genotype(F.col("allelefreq_estimate"), F.col("dp")).alias("gt")).agg(F.count("*").alias("n"))


def h17_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.once_calls(spark, sf_dir).groupBy("chrom", gn.locus_bucket(F.col("pos"), 100).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def _xa():
    hit = lambda sign, n: F.concat(F.col("l_suppkey").cast("string"), F.lit(f",{sign}"), F.col("l_partkey").cast("string"), F.lit(","), F.col("l_linenumber").cast("string"), F.lit(f"M,{n};"))
    return F.concat(hit("+", 1), hit("-", 2))


def h18_alt_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = v.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(gn.alternative_loci(_xa())).alias("x"))
    return lines.select("l_orderkey", "l_linenumber", "x.contig", "x.pos", "x.reverse", "x.cigar", "x.edits")


def h19_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = (F.col("l_orderkey") % 4096).cast("int")
    strand = gn.strand_at(flag, F.when(F.col("l_linenumber") == 1, F.lit("+-*.")), F.col("l_linenumber") - 1)
    return v.read(spark, sf_dir, "lineitem").groupBy(strand.alias("strand"), gn.valid_read(flag).alias("valid")).agg(F.count("*").alias("n"))


def h20_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = gn.read_orientation(F.col("l_partkey"), F.col("l_returnflag") == "R", F.col("l_suppkey") * 20, F.col("l_linestatus") == "O", F.col("l_linenumber") < 5)
    both = gn.evidence_orientation(got, F.when(F.col("l_quantity") > 10, got).when(F.col("l_quantity") > 5, F.lit("F1R2")))
    return v.read(spark, sf_dir, "lineitem").groupBy(got.alias("own"), both.alias("pair")).agg(F.count("*").alias("n"))


def h21_entire_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.read(spark, sf_dir, "lineitem").groupBy(gn.entire_fragment(F.nullif(F.col("l_linenumber") - 1, F.lit(0))).alias("entire")).agg(F.count("*").alias("n"))


def h22_cigar_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("string")
    cigar = F.concat(n, F.lit("S"), F.col("l_quantity").cast("int").cast("string"), F.lit("M"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(n, F.lit("D5M"))).otherwise(F.lit("")))
    ops = gn.cigar_ops(cigar)
    lines = v.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", gn.softclip_length(ops).alias("softclip"), gn.has_indel(ops).alias("indel"), gn.cigar_reference_length(ops).alias("ref_len"), gn.longest_operation(ops, "D").alias("max_del"))
    return lines


def h23_homopolymer_indel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of single homopolymer indels among alleles made of a base repeated."""
    parts = v.read(spark, sf_dir, "part").withColumns({"ref": F.concat(F.lit("C"), F.repeat(F.lit("A"), (F.col("p_size") % 5 + 2).cast("int")), F.lit("G")), "alt": F.concat(F.lit("C"), F.repeat(F.lit("A"), (F.col("p_partkey") % 7 + 2).cast("int")), F.lit("G"))})
    return parts.groupBy(rd.homopolymer_indel_len(F.col("ref"), F.col("alt")).alias("len")).agg(F.count("*").alias("n"))


def h24_homopolymer_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = v.read(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 4).alias("len")).agg(F.count("*").alias("p"))
    return pileup.homopolymer_model(shares, "len", "p").select("len", _r(F.col("ln_prob")).alias("ln_prob"))


def h25_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.read(spark, sf_dir, "lineitem").groupBy(gn.significant(F.col("l_quantity") * F.col("l_quantity") / 7, 3).alias("text"), gn.significant(F.col("l_quantity") / 70000, 2).alias("small")).agg(F.count("*").alias("n"))


def h26_breakends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the domain's breakend alleles, and the allele put together again."""
    p = gn.parse_breakend(F.col("alt_allele"))
    calls = v.once_calls(spark, sf_dir).select("call_id", "alt_allele", p.alias("p")).where("p.mate_pos is not null")
    again = gn.format_breakend(F.col("p.bases"), F.col("p.mate_contig"), F.col("p.mate_pos"), F.col("p.bases_first"), F.col("p.mate_left"))
    return calls.select("call_id", "p.bases", "p.mate_contig", "p.mate_pos", "p.bases_first", "p.mate_left", again.alias("again"))


def h28_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference alleles of the domain's calls as bases of converted reads."""
    base, reverse = F.substring("ref_allele", 1, 1), F.col("pos") % 2 == 0
    alt, ref = gn.converted_read_ln(base, F.lit(30), reverse)
    calls = v.once_calls(spark, sf_dir).where("ref_allele is not null and pos is not null")
    return calls.groupBy(base.alias("base"), reverse.alias("reverse")).agg(F.max(_r(alt)).alias("ln_meth"), F.max(_r(ref)).alias("ln_plain"), F.bool_or(gn.mutated(base, reverse, False)).alias("mutated"), F.bool_or(gn.mutated(base, reverse, True)).alias("mutated_annotated"))


def h29_phred_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Posterior probability for event "), F.col("r_name"), F.when(F.col("r_regionkey") == 0, " (PHRED)").when(F.col("r_regionkey") == 1, " (linear)").otherwise(""))
    return v.read(spark, sf_dir, "region").select("r_name", gn.is_phred_description(text).alias("is_phred"))


def h30_anonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = v.once_calls(spark, sf_dir)
    return calls.select("call_id", gn.anonymise_bases(F.col("ref_allele"), "GTCA").alias("bases"), gn.anonymous_name(F.col("call_id").cast("string"), "s").alias("name"))


def h31_short_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.read(spark, sf_dir, "part").select("p_partkey", gn.short_hash(F.col("p_name")).alias("hash"))


def h32_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = gn.explained_by_errors(F.col("l_linenumber") - 1, F.lit(0), F.lit(0), F.col("l_quantity"), F.lit(math.log(0.05)), F.lit(math.log(1e-6)), F.lit(math.log(1e-6)))
    return v.read(spark, sf_dir, "lineitem").groupBy(ok.alias("explained")).agg(F.count("*").alias("n"))


def h33_allele_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impossible alleles get one half; the mean of both for a mismapped read."""
    from tesseral.model import observations as ob

    obs = v.observations(spark, sf_dir)
    dead = F.col("l_linenumber") == 3
    obs = obs.withColumn("ln_alt", F.when(dead, lp.zero()).otherwise(F.col("ln_alt"))).withColumn("ln_ref", F.when(dead, lp.zero()).otherwise(F.col("ln_ref")))
    got = ob.impossible_to_half(obs)
    return got.select("l_orderkey", "l_linenumber", _r(F.exp("ln_alt")).alias("p_alt"), _r(F.exp(ob.missed_allele(F.col("ln_alt"), F.col("ln_ref")))).alias("p_missed"))


def h34_motif_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.read(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.explode(rd.motif_positions(F.upper("text"), "CG")).alias("pos"))


def h35_ploidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ploidy of each sample on two contigs; a sample without sex has that of all."""
    table = {"all": 2, "chrX": {"male": 1, "female": 2}, "chrY": {"male": 1, "female": 0}}
    samples = v.read(spark, sf_dir, "samples").withColumn("chrom", F.explode(F.array(F.lit("chr1"), F.lit("chrX"), F.lit("chrY"))))
    return samples.select("sample_name", "chrom", gn.ploidy_of(F.col("chrom"), F.col("sex"), table).alias("ploidy"))


QUERIES = v.named(
    h1_phred_decode, h2_log1mexp, h3_logaddexp, h4_cap, h5_kass_raftery, h6_bayes_letter, h7_read_base_prob, h8_isize_pmf, h9_insert_size, h10_sample_alt_read, h11_sample_alt_fragment, h12_either, h13_log2fc, h13_fold_bounds, h14_cmp,
    h15_signature, h16_genotype, h17_bucket, h18_alt_hits, h19_flags, h20_orientation, h21_entire_fragment, h22_cigar_facts, h23_homopolymer_indel, h24_homopolymer_model, h25_significant, h26_breakends, h28_converted, h29_phred_scale, h30_anonymise,
    h31_short_hash, h32_explained, h33_allele_support, h34_motif_positions, h35_ploidy,
)

_OP_SQL = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}
_NOT_SQL = {"eq": "<>", "ne": "=", "gt": "<=", "ge": "<", "lt": ">=", "le": ">"}
_BND = r"^([ACGTNacgtn.]*)([\[\]])([^\[\]]+):([0-9]+)([\[\]])([ACGTNacgtn.]*)$"
ORACLE = {
    "h1_phred_decode": f"WITH {v.ONCE_SQL} SELECT callset_id, " + ", ".join(f"round(sum(pow(10::DOUBLE, -{c}::DOUBLE / 10)), 4) AS {c}" for c in ("prob_present", "prob_absent", "prob_artifact")) + " FROM once GROUP BY callset_id",
    "h2_log1mexp": "SELECT l_quantity, round(ln(1 - exp(-l_quantity / 10)), 6) AS y, count(*) AS n FROM lineitem GROUP BY l_quantity",
    "h3_logaddexp": "SELECT l_orderkey, l_linenumber, round(ln(exp(-l_quantity / 10) + exp(-l_linenumber::DOUBLE)), 6) + 0.0 AS y FROM lineitem",
    "h4_cap": "SELECT round(least(l_discount / 100 - 0.0005::DOUBLE, 0), 9) + 0.0::DOUBLE AS y, count(*) AS n FROM lineitem GROUP BY 1",
    "h5_kass_raftery": """SELECT CASE WHEN f <= 1 THEN 0 WHEN f <= 3 THEN 1 WHEN f <= 20 THEN 2 WHEN f <= 150 THEN 3 ELSE 4 END AS level,
        CASE WHEN f <= 1 THEN 'N' WHEN f <= 3 THEN 'B' WHEN f <= 20 THEN 'P' WHEN f <= 150 THEN 'S' ELSE 'V' END AS letter, count(*) AS n FROM (SELECT l_quantity * l_linenumber / 2 AS f FROM lineitem) GROUP BY ALL""",
    "h6_bayes_letter": f"""WITH {v.LINES_SQL} SELECT l_orderkey AS variant, count(*) FILTER (r > a AND r / a > 3 AND r / a <= 20) AS n_rp, count(*) FILTER (a > r AND a / r <= 3) AS n_ab, count(*) FILTER (a > r) AS n_a
        FROM lines WHERE abs(a - r) > 1e-9 GROUP BY l_orderkey""",
    "h7_read_base_prob": """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = b THEN ln(1 - pow(10::DOUBLE, -l_quantity / 10)) WHEN l_returnflag = 'N' THEN ln(0.25::DOUBLE) ELSE -l_quantity / 10 * ln(10::DOUBLE) + ln(0.3333::DOUBLE) END, 6) AS ln_prob
        FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE l_linestatus END AS b FROM lineitem)""",
    "h9_insert_size": "SELECT CAST(CAST(l_quantity AS BIGINT) + l_linenumber % 3 + l_linenumber AS BIGINT) AS insert_size, count(*) AS n FROM lineitem GROUP BY 1",
    "h10_sample_alt_read": """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber = 7 THEN 0 ELSE ln(least(n, l_linenumber * 4)::DOUBLE) - ln(n::DOUBLE) END, 6) + 0.0::DOUBLE AS ln_prob
        FROM (SELECT *, CASE WHEN l_returnflag <> 'R' THEN least(30, CAST(l_quantity AS INT)) ELSE 30 END AS n FROM lineitem)""",
    "h12_either": f"WITH {v.LINES_SQL} SELECT l_orderkey, l_linenumber, round(ln(1 - (1 - m) * (1 - a)), 6) + 0.0 AS ln_prob FROM lines",
    "h13_log2fc": """SELECT round(CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0.0::DOUBLE WHEN l_tax = 0 THEN CAST('inf' AS DOUBLE) WHEN l_discount = 0 THEN CAST('-inf' AS DOUBLE) ELSE log2(l_discount) - log2(l_tax) END, 6) AS l2fc, count(*) AS n
        FROM lineitem GROUP BY 1""",
    "h13_fold_bounds": "SELECT round(l_discount, 6) + 0.0 AS discount, min(round(CASE WHEN l_discount * 10 / 4 > 1 THEN 1 ELSE l_discount * 10 / 4 END, 6) + 0.0) AS hi, bool_or(l_discount * 10 / 4 <= 1) AS hi_open FROM lineitem GROUP BY 1",
    "h14_cmp": "SELECT p_brand, " + ", ".join([f"count(*) FILTER (p_size {o} 25) AS n_{n}" for n, o in _OP_SQL.items()] + [f"count(*) FILTER (p_size {o} 25) AS not_{n}" for n, o in _NOT_SQL.items()]) + " FROM part GROUP BY p_brand",
    "h15_signature": f"""WITH {v.ONCE_SQL} SELECT CASE WHEN alt_allele IN ('<DEL>', '<INV>', '<DUP>', '<BND>', '<METH>') THEN substr(alt_allele, 2, length(alt_allele) - 2)
        WHEN length(ref_allele) = 1 AND length(alt_allele) = 1 THEN CASE upper(ref_allele) || '>' || upper(alt_allele) WHEN 'C>A' THEN 'C>A' WHEN 'G>T' THEN 'C>A' WHEN 'C>G' THEN 'C>G' WHEN 'G>C' THEN 'C>G' WHEN 'C>T' THEN 'C>T' WHEN 'G>A' THEN 'C>T'
            WHEN 'T>A' THEN 'T>A' WHEN 'A>T' THEN 'T>A' WHEN 'T>C' THEN 'T>C' WHEN 'A>G' THEN 'T>C' WHEN 'T>G' THEN 'T>G' WHEN 'A>C' THEN 'T>G' END
        WHEN length(ref_allele) > 1 AND length(alt_allele) = 1 THEN 'DEL' WHEN length(ref_allele) = 1 AND length(alt_allele) > 1 THEN 'INS' WHEN length(ref_allele) = length(alt_allele) AND length(ref_allele) > 1 THEN 'MNV' ELSE 'Complex' END AS change,
        count(*) AS n FROM once GROUP BY 1""",
    "h16_genotype": """SELECT sample_name, CASE WHEN allelefreq_estimate = 0 THEN '0/0' WHEN allelefreq_estimate = 0.5 THEN '0/1' WHEN allelefreq_estimate = 1 THEN '1/1' WHEN allelefreq_estimate IS NOT NULL AND dp > 0 THEN '0/1' ELSE './.' END AS gt, count(*) AS n
        FROM (SELECT DISTINCT * FROM sample_info) GROUP BY ALL""",
    "h17_bucket": f"WITH {v.ONCE_SQL} SELECT chrom, CAST(floor(pos / 1000) * 1000 AS BIGINT) AS bucket, count(*) AS n FROM once GROUP BY ALL",
    "h18_alt_hits": """SELECT l_orderkey, l_linenumber, l_suppkey::VARCHAR AS contig, l_partkey AS pos, e = 2 AS reverse, l_linenumber::VARCHAR || 'M' AS cigar, e AS edits FROM lineitem, (SELECT unnest([1, 2]) AS e)""",
    "h19_flags": """SELECT CASE WHEN l_linenumber = 1 THEN 'Forward' WHEN (f & 16) <> 0 THEN 'Reverse' ELSE 'Forward' END AS strand, (f & 1796) = 0 AS valid, count(*) AS n FROM (SELECT *, CAST(l_orderkey % 4096 AS INT) AS f FROM lineitem) GROUP BY ALL""",
    "h20_orientation": """SELECT own, CASE WHEN l_quantity > 10 THEN own WHEN l_quantity > 5 THEN CASE WHEN own = 'F1R2' THEN own ELSE 'None' END ELSE own END AS pair, count(*) AS n FROM (SELECT *, CASE WHEN l_linenumber >= 5 OR l_partkey = l_suppkey * 20 THEN 'None'
        WHEN l_partkey < l_suppkey * 20 THEN x || y ELSE y || x END AS own FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'R1' ELSE 'F1' END AS x, CASE WHEN l_linestatus = 'O' THEN 'R2' ELSE 'F2' END AS y FROM lineitem)) GROUP BY ALL""",
    "h21_entire_fragment": "SELECT l_linenumber = 2 AS entire, count(*) AS n FROM lineitem GROUP BY 1",
    "h22_cigar_facts": """SELECT l_orderkey, l_linenumber, l_linenumber AS softclip, l_linenumber % 2 = 0 AS indel, CAST(l_quantity AS INT) + CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber + 5 ELSE 0 END AS ref_len,
        CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS max_del FROM lineitem""",
    "h23_homopolymer_indel": "SELECT CAST(nullif(p_partkey % 7 - p_size % 5, 0) AS INT) AS len, count(*) AS n FROM part GROUP BY 1",
    "h24_homopolymer_model": "WITH s AS (SELECT l_linenumber - 4 AS len, count(*) AS p FROM lineitem WHERE l_linenumber <> 4 GROUP BY 1) SELECT len, round(ln(p / (SELECT sum(p) FROM s)), 6) AS ln_prob FROM s",
    "h25_significant": """SELECT CASE WHEN x >= 100 THEN printf('%.0f', x) WHEN x >= 10 THEN printf('%.1f', x) WHEN x >= 1 THEN printf('%.2f', x) ELSE printf('%.3f', x) END AS text, CASE WHEN y >= 0.0001 THEN printf('%.5f', y) ELSE printf('%.6f', y) END AS small, count(*) AS n
        FROM (SELECT l_quantity * l_quantity / 7 AS x, l_quantity / 70000 AS y FROM lineitem) GROUP BY ALL""",
    "h26_breakends": f"""WITH {v.ONCE_SQL}, p AS (SELECT call_id, alt_allele, regexp_extract(alt_allele, '{_BND}', ['a', 'b', 'c', 'd', 'e', 'f']) AS g FROM once WHERE regexp_full_match(alt_allele, '{_BND}'))
        SELECT call_id, CASE WHEN g['a'] <> '' THEN g['a'] ELSE g['f'] END AS bases, g['c'] AS mate_contig, CAST(g['d'] AS BIGINT) AS mate_pos, g['a'] <> '' AS bases_first, g['b'] = ']' AS mate_left, alt_allele AS again FROM p WHERE g['b'] = g['e']""",
    "h28_converted": f"""WITH {v.ONCE_SQL}, b AS (SELECT substr(ref_allele, 1, 1) AS base, pos % 2 = 0 AS reverse FROM once WHERE ref_allele IS NOT NULL AND pos IS NOT NULL), e AS (SELECT DISTINCT * FROM b)
        SELECT base, reverse, round(CASE WHEN upper(base) = CASE WHEN reverse THEN 'G' ELSE 'C' END THEN ln(0.999::DOUBLE) WHEN upper(base) = 'N' THEN ln(0.25::DOUBLE) ELSE ln(0.001::DOUBLE) + ln(0.3333::DOUBLE) END, 6) AS ln_meth,
        round(CASE WHEN upper(base) = CASE WHEN reverse THEN 'A' ELSE 'T' END THEN ln(0.999::DOUBLE) WHEN upper(base) = 'N' THEN ln(0.25::DOUBLE) ELSE ln(0.001::DOUBLE) + ln(0.3333::DOUBLE) END, 6) AS ln_plain,
        CASE WHEN reverse THEN upper(base) IN ('C', 'T') ELSE upper(base) IN ('A', 'G') END AS mutated, CASE WHEN reverse THEN upper(base) IN ('C', 'A', 'T') ELSE upper(base) IN ('G', 'A', 'T') END AS mutated_annotated FROM e""",
    "h29_phred_scale": "SELECT r_name, r_regionkey <> 1 AS is_phred FROM region",
    "h30_anonymise": f"""WITH {v.ONCE_SQL} SELECT call_id, translate(ref_allele, 'ACGTacgt', 'GTCAgtca') AS bases, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS name
        FROM (SELECT *, sha256('s' || call_id::VARCHAR) AS h FROM once)""",
    "h31_short_hash": "SELECT p_partkey, upper(substr(sha256(p_name), 1, 8)) AS hash FROM part",
    "h32_explained": "SELECT l_linenumber - 1 <= l_quantity * exp(ln(0.05::DOUBLE)) AS explained, count(*) AS n FROM lineitem GROUP BY 1",
    "h33_allele_support": f"WITH {v.LINES_SQL} SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber = 3 THEN 0.5 ELSE a END, 6) + 0.0 AS p_alt, 0.5::DOUBLE AS p_missed FROM lines",
    "h34_motif_positions": """WITH s AS (SELECT doc_id, string_split(upper(text), 'CG') AS p FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS n FROM s)
        SELECT doc_id, CAST(pos AS INT) AS pos FROM (SELECT doc_id, i, n, sum(length(piece) + 2) OVER (PARTITION BY doc_id ORDER BY i) - 2 AS pos FROM u) WHERE i < n""",
    "h35_ploidy": "SELECT sample_name, c AS chrom, CASE WHEN c = 'chr1' THEN 2 WHEN c = 'chrX' THEN CASE sex WHEN 'male' THEN 1 WHEN 'female' THEN 2 END ELSE CASE sex WHEN 'male' THEN 1 WHEN 'female' THEN 0 END END AS ploidy FROM samples, (SELECT unnest(['chr1', 'chrX', 'chrY']) AS c)",
}
