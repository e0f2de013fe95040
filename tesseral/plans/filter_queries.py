"""Queries of the filters, the false discovery rate, ranking, sampling and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.functions import genomics as gn
from tesseral.functions import logprob as lp
from tesseral.model import observations as ob
from tesseral.operators import estimate, filters, pileup, ranges
from tesseral.plans import views as v

ALPHA = 0.3
UNIT, ORDER = "o_custkey", ("o_orderkey",)


def _r(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def _errors(calls: DataFrame) -> DataFrame:
    """Error probability of each order as a whole number of millionths, so that equal ones are equal on both sides."""
    return calls.withColumn("error", F.round(1 - F.exp(filters.event_probability(["PROB_HIGH", "PROB_LOW"])), 6))


def b1_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = v.order_calls(spark, sf_dir)
    dels = filters.by_type(calls, "del", "vartype", "svlen", 5, 25)
    return dels.unionByName(filters.by_type(calls, "SNV")).select("o_orderkey", "vartype", "svlen")


def b2_fdr_local_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.fdr_local(v.order_calls(spark, sf_dir), ["high", "low"], ALPHA).select("o_orderkey")


def b2_fdr_local_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.fdr_local(v.order_calls(spark, sf_dir), ["high"], ALPHA, smart=True).select("o_orderkey")


def b2_fdr_local_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smart, with artifacts wanted, of one variant type."""
    return filters.fdr_local(v.order_calls(spark, sf_dir), ["high"], ALPHA, smart=True, retain_artifacts=True, vartype="SNV").select("o_orderkey")


def b3_allele_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as alleles of their order: those of high price stay, orders without any go."""
    lines = v.read(spark, sf_dir, "lineitem")
    got = filters.trimmed_alleles(lines, ["l_orderkey"], F.col("l_quantity") > 25, ["l_partkey"], "l_linenumber")
    return got.select("l_orderkey", F.array_join(F.transform("l_partkey", lambda x: x.cast("string")), ",").alias("alleles"))


def b4_event_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = v.order_calls(spark, sf_dir).withColumn("unit", F.when(F.col("o_orderkey") % 3 != 0, F.col(UNIT)))
    return filters.once_per_event(calls, F.col("o_totalprice") > 150000, "unit", ORDER).select("o_orderkey")


def b5_posterior_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with less than strong evidence for absence or artifact against presence."""
    return filters.posterior_odds(v.order_calls(spark, sf_dir), ["high", "low"], ["absent", "artifact"], "strong").select("o_orderkey")


def b6_known_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown events are skipped: only the known one counts."""
    calls = v.order_calls(spark, sf_dir)
    p = filters.event_probability(filters.known_events(calls, ["HIGH", "no_such_event"]))
    return calls.select("o_orderkey", _r(F.exp(p)).alias("p"))


_ORIENT = ("F1R2", "F2R1", "R1F2", "F1F2", "None")


def _with_orientation(df: DataFrame) -> DataFrame:
    return df.withColumn("read_orientation", F.element_at(F.array(*(F.lit(x) for x in _ORIENT)), (F.col("l_partkey") % 5 + 1).cast("int")))


def b7_nonstandard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filtered_out(_with_orientation(v.read(spark, sf_dir, "lineitem")), ["l_orderkey"])


def b8_plug_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two filters of the user, one after the other."""
    got = filters.custom(v.read(spark, sf_dir, "part"), lambda d: d.where("p_size > 10"), lambda d: d.where("p_retailprice < 1500"))
    return got.select("p_partkey")


def b9_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates of contamination: status O is the contaminant."""
    obs = v.observations(spark, sf_dir)
    support = F.col("a") > F.col("r")
    got = filters.contamination_candidates(obs, ["l_suppkey"], F.col("l_linestatus") == "O", support & (F.col("l_linestatus") == "F"), ob.support("ln_alt", "ln_ref") >= lp.KASS_RAFTERY_ORDER["positive"])
    return got.select("l_suppkey", "n_contaminant", "n_sample")


def b10_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.coding_only(v.once_calls(spark, sf_dir).where("ann is not null and not contains(ann, '\"')")).select("call_id")


def b11_iupac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.substitution_only(v.once_calls(spark, sf_dir), "R", "Y", "ref_allele", "alt_allele").select("call_id")


def b12_mapq_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = v.read(spark, sf_dir, "lineitem").withColumn("left", (F.col("l_partkey") % 4).cast("int")).withColumn("right", F.when(F.col("l_linenumber") > 1, (F.col("l_suppkey") % 4).cast("int")))
    return filters.pair_quality(lines, "left", "right").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def b13_informative(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = v.read(spark, sf_dir, "lineitem").withColumn("strand", F.when(F.col("l_linenumber") % 2 == 0, "None").otherwise("Forward")).withColumn("imprecise", F.col("l_returnflag") == "R")
    return filters.informative(lines, "strand", "imprecise").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def b14_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.propagate(v.read(spark, sf_dir, "part"), ["p_brand", "p_partkey", "no_such", "p_brand"], ["p_partkey"])


def b15_drop_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = v.read(spark, sf_dir, "part").select("p_partkey", F.lit(1.0).alias("prob_alt"), F.lit("x").alias("strand"), "p_size")
    return filters.without_observations(calls)


def b16_methylation_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = v.read(spark, sf_dir, "lineitem").withColumn("flag", (F.col("l_partkey") % 200).cast("int"))
    return filters.methylation_reads(reads, "flag").groupBy("flag").agg(F.count("*").alias("n"))


def b17_mutation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions of the domain whose new base can't come from a methylation site."""
    calls = v.once_calls(spark, sf_dir).where("length(alt_allele) = 1 and pos is not null")
    return calls.where(~gn.mutated(F.col("alt_allele"), F.col("pos") % 2 == 0, False)).groupBy("alt_allele").agg(F.count("*").alias("n"))


def e1_fdr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = filters.fdr_curve(_errors(v.order_calls(spark, sf_dir)), "error", UNIT, ORDER)
    return got.select("error", "n_calls", _r("fdr").alias("fdr"))


def e2_fdr_global_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.fdr_global(_errors(v.order_calls(spark, sf_dir)), F.col("error"), ALPHA, UNIT, ORDER).select("o_orderkey")


def e2_fdr_global_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without units: presence decides, and the event must be more likely than not."""
    calls = v.order_calls(spark, sf_dir)
    error = F.round(F.exp(filters.event_probability(["PROB_ABSENT", "PROB_ARTIFACT"])), 12)
    return filters.fdr_global(calls, error, 0.2507, also=F.exp(filters.event_probability(["PROB_HIGH"])) > 0.5 + 1e-12).select("o_orderkey")


def e3_local_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.read(spark, sf_dir, "region").select("r_regionkey", _r(lp.one_minus(lp.ln(F.lit(ALPHA) * (F.col("r_regionkey") + 1) / 2))).alias("ln_threshold"))


def e4_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = v.order_calls(spark, sf_dir)
    long = calls.select("o_orderkey", F.explode(F.array(*(F.struct(F.lit(e).alias("e"), (-F.col(f"PROB_{e.upper()}")).alias("s")) for e in ("high", "low", "absent", "artifact")))).alias("x"))
    return pileup.ranked_events(long.select("o_orderkey", "x.e", F.round("x.s", 6).alias("s")), ["o_orderkey"], "e", "s")


def e5_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = estimate.reciprocal_regression(v.read(spark, sf_dir, "sample_info").distinct().where("allelefreq_estimate > 0.1 and allelefreq_estimate <= 1"), "allelefreq_estimate")
    return got.select(F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"))


def e6_dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.dense_ids(v.read(spark, sf_dir, "events"), ["event_type"], "user_id", "event_id")


def e7_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.run_lengths(v.read(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type")


def e8_density_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities of the domain's estimates, in order of frequency and written anew."""
    info = v.read(spark, sf_dir, "sample_info").distinct().where("vaf_dist is not null")
    d = gn.vaf_density(F.col("vaf_dist"))
    return info.select("call_id", "sample_name", F.size(d).alias("n"), _r(F.array_min(F.transform(d, lambda x: x["vaf"])), 3).alias("lowest"), _r(F.array_max(F.transform(d, lambda x: x["phred"])), 2).alias("worst"))


def e9_record_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.record_index(v.read(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "record_index")


def f1_sorted_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution of error probabilities in order, with each value's rank from 0."""
    from tesseral.session import Scratch, running

    calls = _errors(v.order_calls(spark, sf_dir)).groupBy("error").agg(F.count("*").alias("n"))
    return running(Scratch(spark), calls, ["error"], {"upto": F.col("n")}).select("error", "n", (F.col("upto") - F.col("n")).alias("rank"))


def f2_first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 records in the order of their keys: the number is what is asked for."""
    return v.read(spark, sf_dir, "lineitem").orderBy("l_orderkey", "l_linenumber").limit(25).select("l_orderkey", "l_linenumber")


def f3_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments needed for each region's precision, without a limit and with as many as there are lines."""
    n = v.read(spark, sf_dir, "lineitem").count()
    rows = [(r, estimate.alignments_needed(0.001 * (r + 1), 0.1), estimate.alignments_needed(0.001 * (r + 1), 0.1, n)) for r in range(5)]
    return spark.createDataFrame(rows, "r_regionkey int, needed long, needed_of_available long")


def f4_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.subsample(v.read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey", 50).select("l_suppkey", "l_orderkey", "l_linenumber")


def f5_best_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the smallest discount of their part."""
    return ranges.best_with_ties(v.read(spark, sf_dir, "lineitem"), ["l_partkey"], "l_discount").select("l_partkey", "l_orderkey", "l_linenumber", "l_discount")


def f6_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = v.read(spark, sf_dir, "sample_info").distinct().where("allelefreq_estimate <= 1")
    return estimate.largest_with_ties(info, "allelefreq_estimate").select("call_id", "sample_name", "allelefreq_estimate")


def g1_interval_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which hundredths lie in the intersection, union, difference and complement of two regions."""
    from tesseral.formula.regions import FULL
    from tesseral.formula.syntax import parse_universe

    a, b = parse_universe("[0.0,0.3[ | 0.5 | ]0.6,0.9]"), parse_universe("{0.1, 0.5} | ]0.2,0.7[ | 1.0")
    rows = [(k, (a & b).holds(k / 100), (a | b).holds(k / 100), (a - b).holds(k / 100), (FULL - a).holds(k / 100)) for k in range(101)]
    return spark.createDataFrame(rows, "hundredth int, both boolean, either boolean, only_a boolean, not_a boolean")


def g2_overlap6(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = F.col("p_size") % 20, F.col("p_size") % 20 + F.col("p_partkey") % 7 + 1
    a_open, b_open = (F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 == 0), (F.lit(False), F.lit(True))
    got = ranges.range_relation(lo, hi, F.lit(8), F.lit(13), a_open, b_open)
    return v.read(spark, sf_dir, "part").groupBy(got.alias("relation")).agg(F.count("*").alias("n"))


def g3_locus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other variants at each locus of the domain's calls."""
    calls = v.once_calls(spark, sf_dir).where("chrom is not null").select("call_id", "callset_id", "chrom", "pos", "alt_allele")
    got = ranges.with_neighbours_at_locus(calls, ["callset_id", "chrom", "pos"], "alt_allele", "call_id")
    return got.select("call_id", F.array_join(F.transform("others", lambda x: F.coalesce(x, F.lit("null"))), ";").alias("others"))


def g4_event_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested events that the calls have."""
    have = filters.known_events(v.order_calls(spark, sf_dir), ["high", "germline", "artifact", "low"])
    return spark.createDataFrame([(h,) for h in have], "event string")


QUERIES = v.named(
    b1_type_filter, b2_fdr_local_strict, b2_fdr_local_smart, b2_fdr_local_retain, b3_allele_filter, b4_event_consistent, b5_posterior_odds, b6_known_events, b7_nonstandard, b8_plug_in, b9_having, b10_coding, b11_iupac, b12_mapq_pairs,
    b13_informative, b14_propagate, b15_drop_observations, b16_methylation_reads, b17_mutation_guard, e1_fdr_curve, e2_fdr_global_strict, e2_fdr_global_smart, e3_local_threshold, e4_rank, e5_regression, e6_dense_ids, e7_rle, e8_density_fmt,
    e9_record_index, f1_sorted_probs, f2_first_records, f3_sample_size, f4_subsample, f5_best_ties, f6_max, g1_interval_algebra, g2_overlap6, g3_locus_union, g4_event_difference,
)

_ERRORS = f"{v.CALLS_SQL}, err AS (SELECT *, round(1 - (high + low), 6) AS error FROM calls_view)"
_UNITS = f"{_ERRORS}, unit AS (SELECT arg_min(error, o_orderkey) AS error FROM err GROUP BY o_custkey)"
_CURVE = """p AS (SELECT error, count(*) AS n FROM {src} GROUP BY error),
    c AS (SELECT error, n, sum(n) OVER w AS n_calls, sum(n * error) OVER w AS s FROM p WINDOW w AS (ORDER BY error ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT max(error) AS t FROM c WHERE (s - n * error + error) / (n_calls - n + 1) <= {alpha}::DOUBLE * (1 + 1e-12))"""
_KIND = v.KIND_SQL
ORACLE = {
    "b1_type_filter": f"SELECT * FROM (SELECT o_orderkey, {_KIND} AS vartype, CAST(o_orderkey % 50 AS INT) AS svlen FROM orders) WHERE vartype = 'SNV' OR (vartype = 'DEL' AND svlen >= 5 AND svlen < 25)",
    "b2_fdr_local_strict": f"WITH {v.CALLS_SQL} SELECT o_orderkey FROM calls_view WHERE high + low >= 0.7 - 1e-12",
    "b2_fdr_local_smart": f"WITH {v.CALLS_SQL} SELECT o_orderkey FROM calls_view WHERE 1 - absent - artifact >= 0.7 - 1e-12 AND high > 0.5 + 1e-12",
    "b2_fdr_local_retain": f"WITH {v.CALLS_SQL} SELECT o_orderkey FROM calls_view WHERE 1 - absent >= 0.7 - 1e-12 AND high + artifact > 0.5 + 1e-12 AND {_KIND} = 'SNV'",
    "b3_allele_filter": "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS alleles FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey",
    "b4_event_consistent": """WITH u AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS unit FROM orders), f AS (SELECT unit, arg_min(o_totalprice > 150000, o_orderkey) AS keep FROM u WHERE unit IS NOT NULL GROUP BY unit)
        SELECT o_orderkey FROM u LEFT JOIN f USING (unit) WHERE CASE WHEN unit IS NULL THEN o_totalprice > 150000 ELSE keep END""",
    "b5_posterior_odds": f"WITH {v.CALLS_SQL} SELECT o_orderkey FROM calls_view WHERE (absent + artifact) / (high + low) <= 20",
    "b6_known_events": f"WITH {v.CALLS_SQL} SELECT o_orderkey, round(high, 6) + 0.0 AS p FROM calls_view",
    "b7_nonstandard": "SELECT l_orderkey, count(*) FILTER (l_partkey % 5 IN (2, 3)) AS n_filtered_out FROM lineitem GROUP BY l_orderkey",
    "b8_plug_in": "SELECT p_partkey FROM part WHERE p_size > 10 AND p_retailprice < 1500",
    "b9_having": f"""WITH {v.LINES_SQL} SELECT l_suppkey, count(*) FILTER (l_linestatus = 'O') AS n_contaminant, count(*) FILTER (l_linestatus <> 'O') AS n_sample FROM lines GROUP BY l_suppkey
        HAVING count(*) FILTER (l_linestatus = 'O') >= 10 AND count(*) FILTER (l_linestatus <> 'O') >= 10 AND count(*) FILTER (l_linestatus <> 'O' AND a / r > 3) > 0""",
    "b10_coding": f"""WITH {v.ONCE_SQL}, u AS (SELECT call_id, string_split(unnest(regexp_split_to_array(ann, '[,;\\n]')), '|') AS f FROM once WHERE ann IS NOT NULL AND NOT contains(ann, '"'))
        SELECT DISTINCT call_id FROM u WHERE f[8] = 'protein_coding' AND coalesce(f[14], '') <> ''""",
    "b11_iupac": f"WITH {v.ONCE_SQL} SELECT call_id FROM once WHERE upper(ref_allele) IN ('A', 'G') AND upper(alt_allele) IN ('C', 'T')",
    "b12_mapq_pairs": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey % 4 <> 0 AND (l_linenumber <= 1 OR l_suppkey % 4 <> 0) GROUP BY l_orderkey",
    "b13_informative": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber % 2 <> 0 OR l_returnflag = 'R' GROUP BY l_orderkey",
    "b14_propagate": "SELECT p_partkey, p_brand FROM part",
    "b15_drop_observations": "SELECT p_partkey, p_size FROM part",
    "b16_methylation_reads": "SELECT CAST(l_partkey % 200 AS INT) AS flag, count(*) AS n FROM lineitem WHERE l_partkey % 200 IN (0, 16, 83, 99, 147, 163) GROUP BY 1",
    "b17_mutation_guard": f"WITH {v.ONCE_SQL} SELECT alt_allele, count(*) AS n FROM once WHERE length(alt_allele) = 1 AND pos IS NOT NULL AND NOT CASE WHEN pos % 2 = 0 THEN upper(alt_allele) IN ('C', 'T') ELSE upper(alt_allele) IN ('A', 'G') END GROUP BY 1",
    "e1_fdr_curve": f"WITH {_UNITS}, {_CURVE.format(src='unit', alpha=ALPHA)} SELECT error, CAST(n_calls AS BIGINT) AS n_calls, round(s / n_calls, 6) + 0.0 AS fdr FROM c",
    "e2_fdr_global_strict": f"WITH {_UNITS}, {_CURVE.format(src='unit', alpha=ALPHA)}, f AS (SELECT o_custkey, arg_min(error, o_orderkey) AS first FROM err GROUP BY o_custkey) SELECT o_orderkey FROM err JOIN f USING (o_custkey), t WHERE first <= t",
    "e2_fdr_global_smart": f"""WITH {v.CALLS_SQL}, err AS (SELECT *, round(absent + artifact, 12) AS error FROM calls_view), {_CURVE.format(src='err', alpha=0.2507)} SELECT o_orderkey FROM err, t WHERE error <= t AND high > 0.5 + 1e-12""",
    "e3_local_threshold": f"SELECT r_regionkey, round(ln(1 - {ALPHA}::DOUBLE * (r_regionkey + 1) / 2), 6) + 0.0 AS ln_threshold FROM region",
    "e4_rank": f"""WITH {v.CALLS_SQL}, l AS (SELECT o_orderkey, unnest([{{'e': 'high', 's': high}}, {{'e': 'low', 's': low}}, {{'e': 'absent', 's': absent}}, {{'e': 'artifact', 's': artifact}}]) AS x FROM calls_view)
        SELECT o_orderkey, string_agg(x.e, ',' ORDER BY round(10 * log10(x.s), 6) DESC, x.e) AS events FROM l GROUP BY o_orderkey""",
    "e5_regression": """WITH p AS (SELECT 1 / allelefreq_estimate AS x, count(*) AS n FROM (SELECT DISTINCT * FROM sample_info) WHERE allelefreq_estimate > 0.1 AND allelefreq_estimate <= 1 GROUP BY 1), c AS (SELECT x, sum(n) OVER (ORDER BY x) AS y FROM p)
        SELECT round(regr_slope(y, x), 3) AS slope, round(regr_intercept(y, x), 3) AS intercept FROM c""",
    "e6_dense_ids": "WITH f AS (SELECT event_type, user_id, min(event_id) AS e FROM events GROUP BY ALL) SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY e, user_id) - 1 AS dense_id FROM f",
    "e7_rle": """WITH m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run_no FROM m) SELECT user_id, CAST(run_no AS BIGINT) AS run_no, any_value(event_type) AS item, count(*) AS run_length FROM r GROUP BY user_id, run_no""",
    "e8_density_fmt": """WITH d AS (SELECT DISTINCT * FROM sample_info), u AS (SELECT call_id, sample_name, list_transform(string_split(vaf_dist, ','), lambda x: {'v': try_cast(string_split(x, '=')[1] AS DOUBLE), 'p': try_cast(string_split(x, '=')[2] AS DOUBLE)}) AS l FROM d WHERE vaf_dist IS NOT NULL),
        k AS (SELECT call_id, sample_name, list_filter(l, lambda x: x.v IS NOT NULL AND x.p IS NOT NULL) AS l FROM u)
        SELECT call_id, sample_name, CAST(len(l) AS INT) AS n, round(list_min(list_transform(l, lambda x: x.v)), 3) + 0.0 AS lowest, round(list_max(list_transform(l, lambda x: x.p)), 2) + 0.0 AS worst FROM k""",
    "e9_record_index": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS record_index FROM lineitem",
    "f1_sorted_probs": f"WITH {_ERRORS}, p AS (SELECT error, count(*) AS n FROM err GROUP BY error) SELECT error, n, CAST(sum(n) OVER (ORDER BY error) - n AS BIGINT) AS rank FROM p",
    "f2_first_records": "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 25",
    "f5_best_ties": "SELECT l_partkey, l_orderkey, l_linenumber, l_discount FROM (SELECT *, min(l_discount) OVER (PARTITION BY l_partkey) AS best FROM lineitem) WHERE l_discount = best",
    "f6_max": "WITH d AS (SELECT DISTINCT * FROM sample_info WHERE allelefreq_estimate <= 1) SELECT call_id, sample_name, allelefreq_estimate FROM d WHERE allelefreq_estimate = (SELECT max(allelefreq_estimate) FROM d)",
    "g1_interval_algebra": """WITH h AS (SELECT CAST(range AS INT) AS k FROM range(101)), s AS (SELECT k, k < 30 OR k = 50 OR (k > 60 AND k <= 90) AS a, k IN (10, 50, 100) OR (k > 20 AND k < 70) AS b FROM h)
        SELECT k AS hundredth, a AND b AS both, a OR b AS either, a AND NOT b AS only_a, NOT a AS not_a FROM s""",
    "g2_overlap6": """WITH s AS (SELECT p_size % 20 AS lo, p_size % 20 + p_partkey % 7 + 1 AS hi, p_partkey % 2 = 0 AS al, p_partkey % 3 = 0 AS ar FROM part)
        SELECT CASE WHEN lo = 8 AND hi = 13 AND NOT al AND ar THEN 'Equal' WHEN hi < 8 OR lo > 13 OR (hi = 8 AND ar) OR lo = 13 THEN 'None'
            ELSE CASE WHEN (lo > 8 OR (lo = 8 AND al)) AND hi < 13 THEN 'Contained' WHEN lo > 8 OR (lo = 8 AND al) THEN 'Start' WHEN hi < 13 THEN 'End' ELSE 'Contains' END END AS relation, count(*) AS n FROM s GROUP BY 1""",
    "g3_locus_union": f"""WITH {v.ONCE_SQL}, c AS (SELECT * FROM once WHERE chrom IS NOT NULL)
        SELECT a.call_id, coalesce(string_agg(coalesce(b.alt_allele, 'null'), ';' ORDER BY b.call_id) FILTER (b.call_id IS NOT NULL), '') AS others FROM c a LEFT JOIN c b ON a.callset_id = b.callset_id AND a.chrom = b.chrom AND a.pos = b.pos AND a.call_id <> b.call_id GROUP BY a.call_id""",
    "g4_event_difference": "SELECT unnest(['PROB_HIGH', 'PROB_ARTIFACT', 'PROB_LOW']) AS event",
}
