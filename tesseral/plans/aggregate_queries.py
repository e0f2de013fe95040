"""Queries of the aggregations: pileup features, burden, contamination histogram, alignment properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesseral.functions import genomics as gn
from tesseral.functions import logprob as lp
from tesseral.model import bias
from tesseral.model import observations as ob
from tesseral.operators import estimate, filters, pileup
from tesseral.plans import views as v

CODING = 30_000_000


def _r(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def d1_lse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log sum of probabilities as deep as exp(-5000)."""
    lines = v.read(spark, sf_dir, "lineitem").withColumn("x", -F.col("l_quantity") * 100 - F.col("l_linenumber"))
    return lp.sum_exp_by(lines, ["l_orderkey"], F.col("x"), "y").select("l_orderkey", _r("y").alias("y"))


def d2_logprod(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = v.observations(spark, sf_dir, "l_suppkey")
    return pileup.log_product(obs, ["variant"], F.col("ln_alt")).select("variant", _r("ln_likelihood", 4).alias("ln_likelihood"))


def d3_expected_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.expected_depth(v.observations(spark, sf_dir), ["variant", "sample"], "ln_map")


def d4_major_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The major line number of each part among its lines for the alternative allele."""
    obs = v.observations(spark, sf_dir, "l_partkey").where("a > r")
    return pileup.major_feature(obs, ["variant"], "l_linenumber", "major")


def d5_singleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = v.observations(spark, sf_dir)
    got = pileup.adjust_singletons(obs, ["variant"], "ln_alt", "ln_ref")
    return got.groupBy("variant").agg(_r(F.sum(F.exp("ln_alt"))).alias("p_alt"), _r(F.sum(F.exp("ln_ref"))).alias("p_ref"))


def d6_mapq_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = v.observations(spark, sf_dir, "l_partkey")
    return pileup.average_mapping(obs, ["variant"], "m", 0.98).select("variant", _r("prob_map_adj").alias("prob_map_adj"))


def d7_gen_cigar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.generalized_cigar(v.read(spark, sf_dir, "events"), ["user_id"], F.col("event_type"))


def d8_strong_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose uniquely mapped positive alternative lines are at least ten and by two thirds of flag A."""
    obs = v.observations(spark, sf_dir, "l_suppkey").where("m >= 0.95")
    strong = ob.support("ln_alt", "ln_ref") >= lp.KASS_RAFTERY_ORDER["positive"]
    n, k = F.count_if(strong), F.count_if(strong & (F.col("l_returnflag") != "R"))
    got = obs.groupBy("variant").agg(n.alias("n_strong"), k.alias("n_evidence"))
    return got.withColumn("likely", F.when(F.col("n_strong") >= bias.LEAST_STRONG, F.col("n_evidence") / F.col("n_strong") >= bias.STRONG_SHARE))


_SIDE = {"A": "Forward", "N": "Reverse", "R": "Both"}


def _sided(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    """Lines with all marks of an observation; ``scale`` sharpens the alleles so that some support is strong."""
    obs = v.observations(spark, sf_dir, "l_suppkey")
    strand = F.when(F.col("l_returnflag") == "A", "Forward").when(F.col("l_returnflag") == "N", "Reverse").otherwise("Both")
    return obs.withColumns(
        {
            "ln_alt": lp.ln(F.col("a")) * scale,
            "ln_ref": lp.ln(F.col("r")) * scale,
            "strand": strand,
            "read_orientation": F.when(F.col("l_linenumber") % 3 == 0, "F1R2").when(F.col("l_linenumber") % 3 == 1, "F2R1").otherwise("None"),
            "read_position": F.when(F.col("l_linenumber") == 1, "Major").otherwise("Some"),
            "ln_hit_base": lp.ln(F.lit(0.01)),
            "softclipped": F.col("l_linenumber") == 5,
            "alt_locus": F.when(F.col("l_partkey") % 11 == 0, "Major").otherwise("None"),
            "is_max_mapq": F.col("l_tax") > 0.005,
            "homopolymer_len": (F.col("l_linenumber") - 3).cast("int"),
        }
    )


def d9_forward_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bias.learned(ob.standard(_sided(spark, sf_dir, 3.0), "variant", "sample"))
    return got.groupBy("variant").agg(F.max(_r("forward_rate")).alias("forward_rate"), F.bool_or("has_alt_loci").alias("has_alt_loci"))


def d10_major_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bias.pileup_counts(bias.learned(ob.standard(_sided(spark, sf_dir, 3.0))))
    return counts.select("variant", "sample", _r("ref_expected", 4).alias("ref_expected"), _r("ref_major", 4).alias("ref_major"), _r("ref_hit", 4).alias("ref_hit"))


def d11_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bias.pileup_counts(bias.learned(ob.standard(_sided(spark, sf_dir, 3.0))))
    return counts.select("variant", "sample", "n_uncertain", "ref_oriented", "ref_f1r2")


def d12_alt_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bias.pileup_counts(bias.learned(ob.standard(_sided(spark, sf_dir, 3.0))))
    return counts.select("variant", "sample", "n_alt", "alt_low", "n_ref", "ref_low", "n_loci")


def d12_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which artifacts are to be considered for each supplier."""
    return bias.judged(bias.pileup_counts(bias.learned(ob.standard(_sided(spark, sf_dir, 3.0)))))


def _burden_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain's estimates with the class and presence of their call; each repeated row once."""
    calls = v.once_calls(spark, sf_dir).where("prob_present is not null and not isnan(prob_present)")
    info = v.read(spark, sf_dir, "sample_info").distinct().where("allelefreq_estimate between 0 and 1").select("call_id", "sample_name", "allelefreq_estimate")
    rows = calls.select("call_id", gn.change_class(F.col("ref_allele"), F.col("alt_allele")).alias("kind"), lp.phred_to_prob(F.col("prob_present")).alias("p"))
    return rows.where("kind is not null").join(info, "call_id")


def _burden(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    got = estimate.burden(_burden_rows(spark, sf_dir), mode, F.col("p"), "allelefreq_estimate", "kind", CODING, "sample_name")
    return got.select(*(_r(c).alias(c) if c in ("mb", "min_vaf", "vaf") else F.col(c) for c in got.columns))


def d13_burden_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _burden(spark, sf_dir, "curve")


def d13_burden_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _burden(spark, sf_dir, "table")


def d13_burden_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _burden(spark, sf_dir, "hist")


def d13_burden_multibar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _burden(spark, sf_dir, "multibar")


def d14_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = v.read(spark, sf_dir, "sample_info").distinct().where("allelefreq_estimate between 0 and 1")
    got = estimate.vaf_histogram(info, "allelefreq_estimate")
    return got.select(_r("vaf", 2).alias("vaf"), "n")


_CIGAR = "concat(l_linenumber, 'S', cast(l_quantity as int), 'M', case when l_linenumber % 2 = 0 then concat(l_linenumber, 'D5M') else concat(l_linenumber, 'I7M') end)"


def d15_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = v.read(spark, sf_dir, "lineitem").withColumns({"cigar": F.expr(_CIGAR), "mapq": (F.col("l_partkey") % 61).cast("int"), "len": F.col("l_quantity").cast("int") + 10})
    got = estimate.alignment_maxima(lines, "cigar", "mapq", "len", ["l_suppkey"])
    return got.withColumn("frac_max_softclip", _r("frac_max_softclip"))


def d16_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = estimate.trimmed_mean_sd(v.read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")
    return got.select("l_suppkey", _r("mean").alias("mean"), _r("sd").alias("sd"), "n")


def d17_cigar_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.cigar_counts(v.read(spark, sf_dir, "lineitem").withColumn("cigar", F.expr(_CIGAR)), "cigar")


_STATES = ("MatchA", "MatchC", "GapX", "GapY", "HopAX", "MatchG", "Other")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(*(F.lit(s) for s in _STATES)), (F.col("event_id") * 7 % 11 % 7 + 1).cast("int"))
    return v.read(spark, sf_dir, "events").withColumn("state", state)


def d18_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.transitions(_states(spark, sf_dir), ["user_id"], ["event_id"], "state")


def d19_gap_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _squared(spark, sf_dir)
    got = estimate.gap_rates(counts)
    return got.select("estimated", *(_r(c).alias(c) for c in ("insertion", "deletion", "insertion_extend", "deletion_extend")))


def _squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of pairs of states, from lines: the state of the number to that of the flag."""
    at = lambda c: F.element_at(F.array(*(F.lit(s) for s in _STATES)), (c % 7 + 1).cast("int"))
    return v.read(spark, sf_dir, "lineitem").groupBy(at(F.col("l_partkey")).alias("source"), at(F.col("l_suppkey")).alias("target")).agg(F.count("*").alias("n"))


def d20_hop_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = estimate.hop_rates(_squared(spark, sf_dir))
    return got.select("base", "side", _r("rate").alias("rate"))


def d21_error_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = v.read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("ref_len"), (F.col("l_partkey") % 9).alias("read_len")).agg(F.count("*").alias("n"))
    got = estimate.error_model(counts, "ref_len", "read_len", "n")
    return got.select("diff", _r("prob").alias("prob"))


def d22_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why lines would be skipped, and how many of each."""
    reason = F.when(F.col("l_quantity") < 5, "too_small").when(F.col("l_discount") > 0.08, "discounted").when(F.col("l_returnflag") == "R", "returned").otherwise("kept")
    return v.read(spark, sf_dir, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint log scores of five events per order."""
    lines = v.read(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey", F.concat(F.lit("e"), (F.col("l_linenumber") % 5).cast("string")).alias("event")).agg((-F.sum("l_quantity") * 10).alias("score"))


def d23_map_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.mark_most(_scores(spark, sf_dir), ["l_orderkey"], "event", "score")


def d25_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pileup.normalise(_scores(spark, sf_dir), ["l_orderkey"], "score")
    return got.select("l_orderkey", "event", _r("posterior").alias("posterior"))


def d26_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of even number rolled up to one artifact."""
    got = pileup.normalise(_scores(spark, sf_dir), ["l_orderkey"], "score").withColumn("what", F.when(F.col("event").isin("e0", "e2", "e4"), "artifact").otherwise(F.col("event")))
    return lp.sum_exp_by(got, ["l_orderkey", "what"], F.col("posterior"), "ln_prob").select("l_orderkey", "what", _r("ln_prob").alias("ln_prob"))


def d27_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second line of an order as mates."""
    obs = _sided(spark, sf_dir).withColumn("third", F.when(F.col("l_partkey") % 5 == 0, F.lit(1))).withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    obs = obs.withColumn("place", F.col("l_linenumber"))
    fields = ("ln_alt", "ln_ref", "strand", "homopolymer_len", "third", "place")
    pair = obs.where("rank <= 2").groupBy("l_orderkey").agg(*(F.max(F.when(F.col("rank") == k, F.struct(*fields))).alias(f"m{k}") for k in (1, 2)))
    side = lambda k: {f if f != "place" else "read_position": F.col(f"m{k}.{f}") for f in fields}
    got = pileup.merge_mates(side(1), side(2))
    return pair.select("l_orderkey", *((_r(x) if n.startswith("ln_") else x).alias(n) for n, x in got.items()))


def d28_haplotype_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of an order as a haplotype of its lines: the chance of any reference allele against none."""
    obs = v.observations(spark, sf_dir).groupBy("variant").agg(F.collect_list(F.struct("ln_alt", "ln_ref")).alias("s"))  # an order's lines
    got = pileup.haplotype_support(F.col("s"))
    return obs.select("variant", _r(got["ln_alt"]).alias("ln_alt"), _r(got["ln_ref"]).alias("ln_ref"))


def j24_saobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.simple_observations(_sided(spark, sf_dir).where("abs(a - r) > 1e-9"), ["variant"], True)


def j24_srobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.simple_observations(_sided(spark, sf_dir).where("abs(a - r) > 1e-9"), ["variant"], False)


def j24_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine symbols of the lines of each supplier, counted."""
    obs = _sided(spark, sf_dir).where("abs(a - r) > 1e-9").withColumns({"third_allele_evidence": F.when(F.col("l_linenumber") == 2, F.lit(1)), "paired": F.col("l_quantity") > 25})
    return pileup.generalized_cigar(obs, ["variant"], pileup.observation_code(), F.when(F.col("__i").startswith("N"), 2).when(F.col("__i").startswith("E"), 1).otherwise(0), "obs")


def j24_oobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filtered_out(_sided(spark, sf_dir), ["variant", "sample"])


QUERIES = v.named(
    d1_lse, d2_logprod, d3_expected_depth, d4_major_feature, d5_singleton, d6_mapq_avg, d7_gen_cigar, d8_strong_ratio, d9_forward_rate, d10_major_rate, d11_orientation, d12_alt_locus, d12_judged, d13_burden_curve, d13_burden_table, d13_burden_hist,
    d13_burden_multibar, d14_hist, d15_properties, d16_trimmed, d17_cigar_stats, d18_transitions, d19_gap_mle, d20_hop_mle, d21_error_model, d22_counts, d23_map_event, d25_posterior, d26_artifact, d27_mates, d28_haplotype_dp, j24_saobs,
    j24_srobs, j24_obs, j24_oobs,
)

_LSE = "max(x) + ln(sum(exp(x - mx)))"
SIDED_SQL = f"""{v.LINES_SQL},
    sided AS (SELECT *, l_suppkey AS variant, l_linestatus AS sample, ln(a) * 3 AS la, ln(r) * 3 AS lr, exp(ln(a) * 3 - ln(r) * 3) >= 20 + 1e-9 AND exp(ln(a) * 3 - ln(r) * 3) > 20 AS s_alt, exp(ln(r) * 3 - ln(a) * 3) > 20 AS s_ref, exp(ln(r) * 3 - ln(a) * 3) > 3 AS p_ref,
        CASE l_returnflag WHEN 'A' THEN 'Forward' WHEN 'N' THEN 'Reverse' ELSE 'Both' END AS strand, CASE l_linenumber % 3 WHEN 0 THEN 'F1R2' WHEN 1 THEN 'F2R1' ELSE 'None' END AS orientation, l_linenumber = 1 AS major, l_linenumber = 5 AS clipped,
        l_partkey % 11 = 0 AS locus, l_tax > 0.005 AS is_max, l_linenumber - 3 AS hlen FROM lines),
    learned AS (SELECT variant, sum(CASE WHEN s_ref AND strand <> 'Both' THEN m ELSE 0 END) AS ra, sum(CASE WHEN s_ref AND strand = 'Forward' THEN m ELSE 0 END) AS rf, bool_or(locus) AS has_alt_loci FROM sided GROUP BY variant),
    rates AS (SELECT *, CASE WHEN ra > 100 AND rf / ra > 0 AND rf / ra < 1 THEN rf / ra WHEN ra > 2 AND rf / ra BETWEEN 0.4 AND 0.6 THEN 0.5 END AS rate FROM learned)"""
_BURDEN = f"""{v.ONCE_SQL}, k AS (SELECT call_id, pow(10::DOUBLE, -prob_present::DOUBLE / 10) AS p, CASE WHEN alt_allele IN ('<DEL>', '<INV>', '<DUP>', '<BND>', '<METH>') THEN substr(alt_allele, 2, length(alt_allele) - 2)
        WHEN length(ref_allele) = 1 AND length(alt_allele) = 1 THEN CASE upper(ref_allele) || '>' || upper(alt_allele) WHEN 'C>A' THEN 'C>A' WHEN 'G>T' THEN 'C>A' WHEN 'C>G' THEN 'C>G' WHEN 'G>C' THEN 'C>G' WHEN 'C>T' THEN 'C>T' WHEN 'G>A' THEN 'C>T'
            WHEN 'T>A' THEN 'T>A' WHEN 'A>T' THEN 'T>A' WHEN 'T>C' THEN 'T>C' WHEN 'A>G' THEN 'T>C' WHEN 'T>G' THEN 'T>G' WHEN 'A>C' THEN 'T>G' END
        WHEN length(ref_allele) > 1 AND length(alt_allele) = 1 THEN 'DEL' WHEN length(ref_allele) = 1 AND length(alt_allele) > 1 THEN 'INS' WHEN length(ref_allele) = length(alt_allele) AND length(ref_allele) > 1 THEN 'MNV' ELSE 'Complex' END AS vartype
        FROM once WHERE prob_present IS NOT NULL AND NOT isnan(prob_present)),
    b AS (SELECT k.*, sample_name AS sample, allelefreq_estimate AS v FROM k JOIN (SELECT DISTINCT * FROM sample_info WHERE allelefreq_estimate BETWEEN 0 AND 1) USING (call_id) WHERE vartype IS NOT NULL)"""
_MB = f"round(sum(p) * 1e6 / {CODING}, 6) + 0.0 AS mb"
_CURVE = f"WITH {_BURDEN}, t AS (SELECT range / 99.0::DOUBLE AS t FROM range(100)) SELECT vartype, round(t, 6) + 0.0 AS min_vaf, {_MB} FROM b JOIN t ON v >= t GROUP BY vartype, t"
_AT = "(['MatchA', 'MatchC', 'GapX', 'GapY', 'HopAX', 'MatchG', 'Other'])"
_SQUARED = f"sq AS (SELECT {_AT}[l_partkey % 7 + 1] AS source, {_AT}[l_suppkey % 7 + 1] AS target, count(*) AS n FROM lineitem GROUP BY ALL)"
_SCORES = "sc AS (SELECT l_orderkey, 'e' || (l_linenumber % 5)::VARCHAR AS event, -sum(l_quantity) * 10 AS score FROM lineitem GROUP BY ALL), mx AS (SELECT *, max(score) OVER (PARTITION BY l_orderkey) AS top FROM sc), po AS (SELECT l_orderkey, event, score - top - ln(sum(exp(score - top)) OVER (PARTITION BY l_orderkey)) AS posterior FROM mx)"
_LETTER = "CASE WHEN f > 150 THEN 'V' WHEN f > 20 THEN 'S' WHEN f > 3 THEN 'P' WHEN f > 1 THEN 'B' ELSE 'N' END"


def _simple(f: str, keep: str, name: str) -> str:
    return f"""WITH {v.LINES_SQL}, l AS (SELECT l_suppkey AS variant, {f} AS f, l_tax > 0.005 AS mx FROM lines WHERE abs(a - r) > 1e-9 AND {keep}), i AS (SELECT variant, CASE WHEN mx THEN {_LETTER} ELSE lower({_LETTER}) END AS i FROM l),
        c AS (SELECT variant, i, count(*) AS n FROM i GROUP BY ALL) SELECT variant, string_agg(n::VARCHAR || i, '' ORDER BY n DESC, i) AS {name} FROM c GROUP BY variant"""


ORACLE = {
    "d1_lse": "WITH l AS (SELECT l_orderkey, -l_quantity * 100 - l_linenumber AS x FROM lineitem), m AS (SELECT *, max(x) OVER (PARTITION BY l_orderkey) AS t FROM l) SELECT l_orderkey, round(max(t) + ln(sum(exp(x - t))), 6) + 0.0 AS y FROM m GROUP BY l_orderkey",
    "d2_logprod": f"WITH {v.LINES_SQL} SELECT l_suppkey AS variant, round(sum(ln(a)), 4) + 0.0 AS ln_likelihood FROM lines GROUP BY 1",
    "d3_expected_depth": f"WITH {v.LINES_SQL} SELECT l_orderkey AS variant, l_linestatus AS sample, CAST(round(round(sum(m), 9)) AS INT) AS dp FROM lines GROUP BY ALL",
    "d4_major_feature": f"""WITH {v.LINES_SQL}, c AS (SELECT l_partkey AS variant, l_linenumber AS f, count(*) AS n FROM lines WHERE a > r GROUP BY ALL), k AS (SELECT *, max(n) OVER (PARTITION BY variant) AS best FROM c)
        SELECT variant, CASE WHEN count(*) = 1 AND max(n) > 1 THEN max(f) END AS major FROM k WHERE n = best GROUP BY variant""",
    "d5_singleton": f"""WITH {v.LINES_SQL}, c AS (SELECT *, count(*) FILTER (a > r) OVER (PARTITION BY l_orderkey) AS n FROM lines)
        SELECT l_orderkey AS variant, round(sum(CASE WHEN n = 1 AND a > r THEN 0.5 ELSE a END), 6) + 0.0 AS p_alt, round(sum(CASE WHEN n = 1 AND a > r THEN 0.5 ELSE r END), 6) + 0.0 AS p_ref FROM c GROUP BY 1""",
    "d6_mapq_avg": f"""WITH {v.LINES_SQL}, s AS (SELECT l_partkey AS variant, sum(CASE WHEN abs(m - 0.98) <= 1e-12 THEN m ELSE 0.5 END) AS s, count(*) AS n FROM lines GROUP BY 1)
        SELECT variant, round(CASE WHEN n < 20 THEN (s + 0.5) / (n + 1) ELSE s / n END, 6) + 0.0 AS prob_map_adj FROM s""",
    "d7_gen_cigar": "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL) SELECT user_id, string_agg(n::VARCHAR || event_type, '' ORDER BY n DESC, event_type) AS cigar FROM c GROUP BY user_id",
    "d8_strong_ratio": f"""WITH {v.LINES_SQL}, c AS (SELECT l_suppkey AS variant, count(*) FILTER (a / r > 3) AS n_strong, count(*) FILTER (a / r > 3 AND l_returnflag <> 'R') AS n_evidence FROM lines WHERE m >= 0.95 GROUP BY 1)
        SELECT *, CASE WHEN n_strong >= 10 THEN n_evidence / n_strong >= 0.66666 END AS likely FROM c""",
    "d9_forward_rate": f"WITH {SIDED_SQL} SELECT variant, round(coalesce(rate, 0.5), 6) + 0.0 AS forward_rate, has_alt_loci FROM rates",
    "d10_major_rate": f"WITH {SIDED_SQL} SELECT variant, sample, round(sum(CASE WHEN s_ref THEN m ELSE 0 END), 4) + 0.0 AS ref_expected, round(sum(CASE WHEN s_ref AND major THEN m ELSE 0 END), 4) + 0.0 AS ref_major, round(sum(CASE WHEN s_ref THEN m * 0.01 ELSE 0 END), 4) + 0.0 AS ref_hit FROM sided GROUP BY ALL",
    "d11_orientation": f"WITH {SIDED_SQL} SELECT variant, sample, count(*) FILTER (orientation = 'None') AS n_uncertain, count(*) FILTER (s_ref AND orientation <> 'None') AS ref_oriented, count(*) FILTER (s_ref AND orientation = 'F1R2') AS ref_f1r2 FROM sided GROUP BY ALL",
    "d12_alt_locus": f"WITH {SIDED_SQL} SELECT variant, sample, count(*) FILTER (s_alt) AS n_alt, count(*) FILTER (s_alt AND NOT is_max) AS alt_low, count(*) FILTER (s_ref) AS n_ref, count(*) FILTER (s_ref AND NOT is_max) AS ref_low, count(*) FILTER (locus) AS n_loci FROM sided GROUP BY ALL",
    "d12_judged": f"""WITH {SIDED_SQL}, o AS (SELECT sided.*, has_alt_loci, m >= 0.95 AND s_alt AS u FROM sided JOIN rates USING (variant)),
        c AS (SELECT variant, sample, count(*) AS n, count(*) FILTER (u) AS st, bool_and(lr > la) AS all_ref,
            count(*) FILTER (u AND strand = 'Forward') AS f, bool_or(strand = 'Forward') AS f_any, count(*) FILTER (u AND strand = 'Reverse') AS rv, bool_or(strand = 'Reverse') AS rv_any,
            count(*) FILTER (u AND orientation <> 'F2R1') AS o1, bool_or(orientation <> 'F2R1') AS o1_any, count(*) FILTER (u AND orientation <> 'F1R2') AS o2, bool_or(orientation <> 'F1R2') AS o2_any, count(*) FILTER (u AND major) AS p, bool_or(major) AS p_any,
            count(*) FILTER (u AND clipped) AS c, bool_or(clipped) AS c_any, count(*) FILTER (u AND CASE WHEN has_alt_loci THEN locus ELSE NOT is_max END) AS al, bool_or(CASE WHEN has_alt_loci THEN locus ELSE NOT is_max END) AS al_any,
            count(*) FILTER (orientation = 'None') AS n_unc, count(*) FILTER (s_ref AND orientation <> 'None') AS ro, count(*) FILTER (s_ref AND orientation = 'F1R2') AS r1,
            sum(CASE WHEN s_ref THEN m ELSE 0 END) AS re, sum(CASE WHEN s_ref AND major THEN m ELSE 0 END) AS rm, sum(CASE WHEN s_ref THEN m * 0.01 ELSE 0 END) AS rh, count(*) FILTER (clipped) AS n_c, count(*) FILTER (s_alt) AS na, count(*) FILTER (s_alt AND NOT is_max) AS nal,
            count(*) FILTER (s_ref) AS nr, count(*) FILTER (s_ref AND NOT is_max) AS nrl, count(*) FILTER (hlen > 0) AS lg, count(*) FILTER (hlen < 0) AS sh, count(*) FILTER (locus) AS nl FROM o GROUP BY ALL),
        g AS (SELECT variant, {", ".join(f"bool_or(CASE WHEN st >= 10 THEN {x} / st >= 0.66666 ELSE NOT all_ref END) AND bool_or({x}_any) AS seen_{x}" for x in ("f", "rv", "o1", "o2", "p", "c", "al"))}, sum(n) AS n, sum(n_unc) AS n_unc, sum(ro) AS ro, sum(r1) AS r1, bool_or(re > 10 AND rm > 0 AND abs(rm / re - rh) < 0.05) AS fits, sum(n_c) AS n_c, sum(na) AS na, sum(nal) AS nal, sum(nr) AS nr, sum(nrl) AS nrl, sum(nl) AS nl,
            bool_and(na = 0 OR (lg > 0 AND sh > 0)) AS both_ways FROM c GROUP BY variant)
        SELECT variant, coalesce(seen_f AND rate IS NOT NULL, false) AS ok_forward, coalesce(seen_rv AND rate IS NOT NULL, false) AS ok_reverse, coalesce(seen_o1 AND n_unc < n / 2 AND ro > 2 AND r1 / ro BETWEEN 0.3 AND 0.7, false) AS ok_f1r2,
            coalesce(seen_o2 AND n_unc < n / 2 AND ro > 2 AND r1 / ro BETWEEN 0.3 AND 0.7, false) AS ok_f2r1, coalesce(seen_p AND fits, false) AS ok_position, coalesce(seen_c AND n_c > 0, false) AS ok_softclip,
            coalesce(seen_al AND na > 0 AND nal > na * 0.1 AND na - nal < 10 AND (nl > 0 OR (nr > 0 AND nrl < nr * 0.9)), false) AS ok_alt_locus, coalesce(both_ways, false) AS ok_homopolymer FROM g JOIN rates USING (variant)""",
    "d13_burden_curve": _CURVE,
    "d13_burden_table": _CURVE,
    "d13_burden_hist": f"WITH {_BURDEN}, t AS (SELECT 0.05::DOUBLE + 0.05::DOUBLE * range AS c FROM range(19)) SELECT vartype, round(c, 6) + 0.0 AS vaf, {_MB} FROM b JOIN t ON v >= c - 0.05 AND v < c + 0.05 GROUP BY vartype, c",
    "d13_burden_multibar": f"WITH {_BURDEN} SELECT vartype, sample, {_MB}, 0.2::DOUBLE AS vaf FROM b WHERE v >= 0.2 AND v < 1 GROUP BY vartype, sample",
    "d14_hist": "SELECT round(floor(allelefreq_estimate * 100) / 100, 2) + 0.0 AS vaf, count(*) AS n FROM (SELECT DISTINCT * FROM sample_info WHERE allelefreq_estimate BETWEEN 0 AND 1) GROUP BY 1",
    "d15_properties": """SELECT l_suppkey, max(CAST(l_partkey % 61 AS INT)) AS max_mapq, max(CAST(l_quantity AS INT) + 10) AS max_read_len, max(CASE WHEN l_linenumber % 2 <> 0 THEN l_linenumber END) AS max_ins, max(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END) AS max_del,
        round(max(l_linenumber / (CAST(l_quantity AS INT) + 10)), 6) + 0.0 AS frac_max_softclip, count(*) AS n_softclips, count(*) AS n_not_regular, count(*) AS n FROM lineitem GROUP BY l_suppkey""",
    "d16_trimmed": """WITH p AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.05) AS lo, quantile_cont(l_quantity, 0.95) AS hi FROM lineitem GROUP BY 1)
        SELECT l_suppkey, round(avg(l_quantity), 6) + 0.0 AS mean, round(stddev_samp(l_quantity), 6) + 0.0 AS sd, count(*) AS n FROM lineitem JOIN p USING (l_suppkey) WHERE l_quantity BETWEEN lo AND hi GROUP BY l_suppkey""",
    "d17_cigar_stats": """WITH u AS (SELECT 'match' AS kind, CAST(l_quantity AS INT) AS length FROM lineitem UNION ALL SELECT 'match', CASE WHEN l_linenumber % 2 = 0 THEN 5 ELSE 7 END FROM lineitem UNION ALL SELECT 'gap', CASE WHEN l_linenumber % 2 = 0 THEN -l_linenumber ELSE l_linenumber END FROM lineitem)
        SELECT kind, length, count(*) AS n FROM u GROUP BY ALL""",
    "d18_transitions": f"WITH s AS (SELECT user_id, event_id, {_AT}[event_id * 7 % 11 % 7 + 1] AS state FROM events), l AS (SELECT lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS source, state AS target FROM s) SELECT source, target, count(*) AS n FROM l WHERE source IS NOT NULL GROUP BY ALL",
    "d19_gap_mle": f"""WITH {_SQUARED}, s AS (SELECT sum(n) FILTER (source LIKE 'Match%' AND target = 'GapX') AS ih, sum(n) FILTER (source LIKE 'Match%' AND target <> 'Other') AS al, sum(n) FILTER (source LIKE 'Match%' AND target = 'GapY') AS dh, sum(n) FILTER (source = 'GapX' AND target = 'GapX') AS ix,
            sum(n) FILTER (source = 'GapX' AND target <> 'Other') AS ixa, sum(n) FILTER (source = 'GapY' AND target = 'GapY') AS dx, sum(n) FILTER (source = 'GapY' AND target <> 'Other') AS dxa FROM sq), e AS (SELECT *, ih >= 100 AND dh >= 100 AND ix >= 100 AND dx >= 100 AS ok FROM s)
        SELECT ok AS estimated, round(CASE WHEN ok THEN ih / al ELSE 2.8e-6 END, 6) + 0.0 AS insertion, round(CASE WHEN ok THEN dh / al ELSE 5.1e-6 END, 6) + 0.0 AS deletion, round(CASE WHEN ok THEN ix / ixa ELSE 0 END, 6) + 0.0 AS insertion_extend, round(CASE WHEN ok THEN dx / dxa ELSE 0 END, 6) + 0.0 AS deletion_extend FROM e""",
    "d20_hop_mle": f"""WITH {_SQUARED}, b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS base), t AS (SELECT base, side FROM b, (SELECT unnest(['X', 'Y']) AS side))
        SELECT base, side, round(CASE WHEN coalesce(sum(n) FILTER (target = 'Hop' || base || side AND source IN ('Match' || base, 'Hop' || base || side)), 0) >= 100 THEN sum(n) FILTER (target = 'Hop' || base || side AND source IN ('Match' || base, 'Hop' || base || side)) / sum(n) FILTER (source = 'Match' || base AND target <> 'Other') END, 6) + 0.0 AS rate FROM t, sq GROUP BY ALL""",
    "d21_error_model": """WITH c AS (SELECT l_linenumber AS a, l_partkey % 9 AS b, count(*) AS n FROM lineitem GROUP BY ALL) SELECT CAST(a - b AS BIGINT) AS diff, round(sum(n) / (SELECT sum(n) FROM c WHERE n >= 10), 6) + 0.0 AS prob FROM c GROUP BY 1""",
    "d22_counts": "SELECT CASE WHEN l_quantity < 5 THEN 'too_small' WHEN l_discount > 0.08 THEN 'discounted' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS reason, count(*) AS n FROM lineitem GROUP BY 1",
    "d23_map_event": f"WITH {_SCORES} SELECT l_orderkey, first(event ORDER BY score DESC, event) AS best_event, max(score) AS best_score FROM sc GROUP BY l_orderkey",
    "d25_posterior": f"WITH {_SCORES} SELECT l_orderkey, event, round(posterior, 6) + 0.0 AS posterior FROM po",
    "d26_artifact": f"""WITH {_SCORES}, w AS (SELECT l_orderkey, CASE WHEN event IN ('e0', 'e2', 'e4') THEN 'artifact' ELSE event END AS what, posterior FROM po), q AS (SELECT *, max(posterior) OVER (PARTITION BY l_orderkey, what) AS t FROM w)
        SELECT l_orderkey, what, round(max(t) + ln(sum(exp(posterior - t))), 6) + 0.0 AS ln_prob FROM q GROUP BY ALL""",
    "d27_mates": f"""WITH {v.LINES_SQL}, o AS (SELECT *, ln(a) AS la, ln(r) AS lr, CASE l_returnflag WHEN 'A' THEN 'Forward' WHEN 'N' THEN 'Reverse' ELSE 'Both' END AS strand, l_linenumber - 3 AS hl, CASE WHEN l_partkey % 5 = 0 THEN 1 END AS th,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lines), p AS (SELECT x.l_orderkey, x.la, x.lr, x.strand AS s1, x.hl AS h1, x.th AS t1, x.l_linenumber AS p1, y.la AS yla, y.lr AS ylr, y.strand AS s2, y.hl AS h2, y.th AS t2, y.l_linenumber AS p2 FROM o x LEFT JOIN o y ON x.l_orderkey = y.l_orderkey AND y.k = 2 WHERE x.k = 1)
        SELECT l_orderkey, round(la + coalesce(yla, 0), 6) + 0.0 AS ln_alt, round(lr + coalesce(ylr, 0), 6) + 0.0 AS ln_ref, CASE WHEN s2 IS NULL OR s1 = s2 THEN s1 ELSE 'Both' END AS strand,
            CASE WHEN s2 IS NULL THEN p1 WHEN la > lr AND yla > ylr THEN CASE WHEN p1 = p2 THEN p1 END WHEN NOT la > lr AND yla > ylr THEN p2 ELSE p1 END AS read_position, h1 AS homopolymer_len, CASE WHEN t1 IS NOT NULL AND t2 IS NOT NULL THEN t1 + t2 ELSE coalesce(t1, t2) END AS third FROM p""",
    "d28_haplotype_dp": f"WITH {v.LINES_SQL} SELECT l_orderkey AS variant, round(sum(ln(a)), 6) + 0.0 AS ln_alt, round(ln(1 - exp(sum(ln(a)))), 6) + 0.0 AS ln_ref FROM lines GROUP BY 1",
    "j24_saobs": _simple("a / r", "a > r", "saobs"),
    "j24_srobs": _simple("r / a", "a <= r", "srobs"),
    "j24_obs": f"""WITH {v.LINES_SQL}, l AS (SELECT *, greatest(a / r, r / a) AS f FROM lines WHERE abs(a - r) > 1e-9), i AS (SELECT l_suppkey AS variant, CASE WHEN l_tax > 0.005 THEN s ELSE lower(s) END || CASE WHEN l_linenumber = 2 THEN '1' ELSE '.' END || CASE WHEN l_quantity > 25 THEN 'p' ELSE 's' END
            || CASE WHEN l_partkey % 11 = 0 THEN '#' ELSE '.' END || CASE l_returnflag WHEN 'A' THEN '+' WHEN 'N' THEN '-' ELSE '*' END || CASE l_linenumber % 3 WHEN 0 THEN '>' WHEN 1 THEN '<' ELSE '*' END || CASE WHEN l_linenumber = 1 THEN '^' ELSE '*' END
            || CASE WHEN l_linenumber = 5 THEN '$' ELSE '.' END || CASE WHEN l_linenumber <> 3 THEN '*' ELSE '.' END AS i FROM (SELECT *, CASE WHEN a > r THEN 'A' ELSE 'R' END || {_LETTER} AS s FROM l)), c AS (SELECT variant, i, count(*) AS n FROM i GROUP BY ALL)
        SELECT variant, string_agg(n::VARCHAR || i, '' ORDER BY n DESC, i) AS obs FROM c GROUP BY variant""",
    "j24_oobs": f"WITH {SIDED_SQL} SELECT variant, sample, CAST(0 AS BIGINT) AS n_filtered_out FROM sided GROUP BY ALL",
}
