"""Queries of the model: likelihoods, artifacts, priors, posteriors and contamination."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.formula.scenario import Scenario, ScenarioError, Species, tumor_normal
from tesseral.functions import logprob as lp
from tesseral.model import adaptive, bias, likelihood, posterior, priors
from tesseral.model import observations as ob
from tesseral.operators import estimate
from tesseral.plans import views as v
from tesseral.plans.aggregate_queries import _sided


def _r(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def _standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.standard(v.observations(spark, sf_dir))


def j1_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log likelihood at frequency 0.25 where alternative fragments are sampled at a rate of 0.8."""
    obs = _standard(spark, sf_dir).withColumn("ln_sample_alt", F.lit(math.log(0.8)))
    return obs.groupBy("variant").agg(_r(F.sum(likelihood.observation(F.lit(0.25)))).alias("ll"))


def j2_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency 0.5 in a sample of which a quarter comes from one without the allele."""
    return _standard(spark, sf_dir).groupBy("variant").agg(_r(F.sum(likelihood.contaminated(F.lit(0.5), F.lit(0.0), 0.25))).alias("ll"))


def j3_effective_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance to sample the allele at a hundred frequencies; at one the sampling bias has no effect."""
    grid = spark.range(0, 101).select(F.col("id").cast("int").alias("hundredth"))
    return grid.select("hundredth", _r(likelihood.effective_alt(F.col("hundredth") / 100, F.lit(math.log(0.8)))).alias("p"))


def j4_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint log likelihood of frequency 0.5 in sample F and 1.0 in sample O; nothing seen has likelihood one."""
    at = F.when(F.col("sample") == "F", F.lit(0.5)).otherwise(F.lit(1.0))
    return _standard(spark, sf_dir).groupBy("variant").agg(_r(F.sum(likelihood.observation(at))).alias("ll"))


TWO = """
samples:
  F: {universe: "0.0 | 0.5 | 1.0"}
  O: {universe: "0.0 | 0.5 | 1.0"}
events:
  het_both: "F:0.5 & O:0.5"
  f_only: "F:{0.5, 1.0} & O:0.0"
  o_hom: "O:1.0"
"""


def j8_two_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events over two samples of an order, by status."""
    got = posterior.posteriors(v.observations(spark, sf_dir), Scenario.from_yaml(TWO))
    return got.select("variant", *(_r(f"prob_{e}", 5).alias(f"prob_{e}") for e in ("absent", "het_both", "f_only", "o_hom")), "dp_F", "dp_O")


ONE = 'samples: {s: {universe: "[0.0,1.0]", resolution: 0.1}}\nevents: {present: "s:]0.0,1.0]"}'


def _one_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.observations(spark, sf_dir).withColumn("sample", F.lit("s"))


def j6_simpson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence at any frequency against absence, by Simpson's rule at a resolution of 0.1."""
    got = posterior.posteriors(_one_sample(spark, sf_dir), Scenario.from_yaml(ONE))
    return got.select("variant", _r("prob_absent", 5).alias("prob_absent"), _r("prob_present", 5).alias("prob_present"), "dp_s")


def d24_vaf_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities of the frequencies of each variant, with the most likely one."""
    got = posterior.posteriors(_one_sample(spark, sf_dir), Scenario.from_yaml(ONE))
    return got.select("variant", F.explode("afd_s").alias("d")).select("variant", _r("d.vaf", 2).alias("vaf"), _r("d.density", 5).alias("density"))


def j7_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integral of the likelihood over all frequencies of each supplier, with a grid that follows its density."""
    return adaptive.adaptive_integral(v.observations(spark, sf_dir, "l_suppkey"), 0.0, 1.0, 0.01)


def j8_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of presence with artifacts considered, per supplier: all probabilities sum to one."""
    obs = _sided(spark, sf_dir, 3.0).withColumn("sample", F.lit("s"))
    got = posterior.posteriors(obs, Scenario.from_yaml(ONE), biases=bias.Applicable())
    total = lp.phred_to_prob(F.col("prob_absent")) + lp.phred_to_prob(F.col("prob_present")) + lp.phred_to_prob(F.col("prob_artifact"))
    return got.select("variant", _r(total).alias("total"))


def _bias(spark: SparkSession, sf_dir: str, artifact: str, part: int, by: list[str]) -> DataFrame:
    """Log probabilities of a feature under an artifact and without, per kind of observation."""
    obs = bias.learned(ob.standard(_sided(spark, sf_dir, 3.0))).withColumn("forward_rate", F.lit(0.5)).withColumn("has_alt_loci", F.lit(True))
    value = lambda c: F.max(F.when(c == lp.NEG_INF, F.lit(-999.0)).otherwise(_r(c)))
    cols = {"alt_biased": bias.alt_parts(artifact)[part], "alt_plain": bias.alt_parts("none")[part], "ref_biased": bias.ref_parts(artifact)[part], "mismapped": bias.any_parts()[part]}
    return obs.groupBy(*by).agg(*(value(c).alias(n) for n, c in cols.items()))


def j9_bias_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bias(spark, sf_dir, "forward", 0, ["strand"])


def j9_bias_orient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bias(spark, sf_dir, "f1r2", 1, ["read_orientation"])


def j9_bias_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bias(spark, sf_dir, "position", 2, ["read_position"])


def j9_bias_softclip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bias(spark, sf_dir, "softclip", 3, ["softclipped"])


def j9_bias_homopolymer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bias(spark, sf_dir, "homopolymer", 4, ["homopolymer_len"])


def j9_bias_altlocus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bias(spark, sf_dir, "alt_locus", 5, ["alt_locus"])


def j10_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which biases the domain's calls can have, by their alleles and precision."""
    calls = v.once_calls(spark, sf_dir)
    small = F.coalesce((F.length("ref_allele") == F.length("alt_allele")) & ~F.col("alt_allele").startswith("<") & F.col("svtype").isNull(), F.lit(False))
    got = bias.applicable(small, F.coalesce(~F.col("imprecise"), F.lit(True)), F.coalesce(F.size("hints") > 0, F.lit(False)))
    return calls.select(got.alias("b")).groupBy("b.orientation", "b.strand", "b.homopolymer").agg(F.count("*").alias("n"))


def j11_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absence, and each event with and without artifacts."""
    s = tumor_normal(0.75)
    rows = [("absent", False)] + [(e, a) for e in s.events for a in (False, True)]
    return spark.createDataFrame(rows, "event string, artifact boolean")


PEDIGREE = """
species: {{heterozygosity: 0.001, germline-mutation-rate: 1e-3, ploidy: 2}}
samples:
  child: {{inheritance: {{mendelian: {{from: [father, mother]}}}}}}
  father: {{}}
  mother: {{}}
events: {{e: "child:0.5"}}
"""


def j13_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of each number of copies among two diploid samples."""
    return spark.createDataFrame([(m, math.exp(priors.population(m, 4, math.log(0.001)))) for m in range(5)], "n_alt int, p double").select("n_alt", _r("p", 9).alias("p"))


def j14_mendelian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of a child's copies given those of its parents."""
    rows = [(a, b, c, math.exp(priors.mendelian((2, 2), 2, (a, b), c, 1e-3))) for a, b, c in product(range(3), repeat=3)]
    return spark.createDataFrame(rows, "father int, mother int, child int, p double").select("father", "mother", "child", _r("p", 9).alias("p"))


def j12_pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior of a family: population of the parents times inheritance of the child."""
    s = Scenario.from_yaml(PEDIGREE.format())
    rows = [(*(round(2 * x) for x in vafs), p) for vafs, p in priors.prior_table(s)]
    return spark.createDataFrame(rows, "child int, father int, mother int, p double").select("child", "father", "mother", _r("p", 12).alias("p"))


CLONAL = """
species: {heterozygosity: 0.001, ploidy: 2}
samples:
  normal: {somatic-effective-mutation-rate: 1e-10}
  tumor: {somatic-effective-mutation-rate: 1e-6, inheritance: {clonal: {from: normal, somatic: false}}}
  relapse: {somatic-effective-mutation-rate: 1e-6, inheritance: {subclonal: {from: tumor}}}
events: {e: "tumor:0.5"}
"""


def j15_clonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior of frequencies in a normal, a tumor and its relapse, normalised logs."""
    prior = priors.Prior(Scenario.from_yaml(CLONAL))
    rows = [(n, r, t, prior((n / 4, r / 4, t / 4))) for n, r, t in product(range(0, 5, 2), range(5), range(5))]
    return spark.createDataFrame(rows, "normal int, relapse int, tumor int, ln_p double").select("normal", "relapse", "tumor", _r("ln_p", 4).alias("ln_p"))


def j16_somatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, math.exp(priors.somatic(math.log(1e-3), k / 10))) for k in range(11)], "tenth int, p double").select("tenth", _r("p", 9).alias("p"))


def j17_absent_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is possible shares the complement of absence."""
    prior = priors.Prior(Scenario.from_yaml(PEDIGREE.format()), absent_only=True)
    rows = [(c, f, m, math.exp(prior((c / 2, f / 2, m / 2)))) for c, f, m in product(range(3), repeat=3)]
    return spark.createDataFrame(rows, "child int, father int, mother int, p double").select("child", "father", "mother", _r("p", 9).alias("p"))


def j18_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = ("SNV", "MNV", "INS", "DEL", "REP", "INV", "DUP", "BND", "METH")
    return spark.createDataFrame([(t, Species().type_fraction(t)) for t in types], "vartype string, fraction double")


def j19_prior_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which scenarios lack what their inheritance needs."""
    bad = {
        "no_rate": 'species: {heterozygosity: 0.001, ploidy: 2}\nsamples: {c: {inheritance: {mendelian: {from: [a, b]}}}, a: {}, b: {}}\nevents: {e: "c:0.5"}',
        "no_ploidy": 'samples: {c: {universe: "0.5", inheritance: {clonal: {from: a, somatic: false}}}, a: {universe: "0.5"}}\nevents: {e: "c:0.5"}',
        "fine": PEDIGREE.format(),
    }
    rows = []
    for name, text in bad.items():
        try:
            priors.Prior(Scenario.from_yaml(text)).check()
            rows.append((name, True))
        except ScenarioError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "name string, valid boolean")


def j20_prior_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a prior's plot: five steps per range; uniform within the universe."""
    s = Scenario.from_yaml('samples: {s: {universe: "0.0 | ]0.5,1.0]"}}\nevents: {e: "s:0.0"}')
    return spark.createDataFrame([(x[0], p) for x, p in priors.prior_table(s)], "vaf double, p double")


def _denovo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as de novo variants: their density is least at their own frequency."""
    lines = v.read(spark, sf_dir, "lineitem")
    x = F.round(F.col("l_discount") * 10, 1)
    dist = F.array(*(F.struct(F.lit(k / 4).alias("vaf"), F.ln(0.1 + F.abs(k / 4 - x)).alias("density")) for k in range(5)))
    return lines.select(x.alias("v"), dist.alias("d"), (F.lit(0.95) + F.round(F.col("l_tax"), 2) / 2).alias("p"))


def j21_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = estimate.contamination(_denovo(spark, sf_dir), "v", "d", "p")
    return got.select(_r("contamination", 2).alias("contamination"), "max_somatic", _r("ln_density", 3).alias("ln_density"))


def j22_tumor_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as variants of the built-in scenario, status O as tumor: all probabilities sum to one."""
    obs = v.observations(spark, sf_dir).withColumn("sample", F.when(F.col("l_linestatus") == "O", "tumor").otherwise("normal"))
    s = tumor_normal(0.75)
    got = posterior.posteriors(obs, s, densities=False)
    total = F.lit(0.0)
    for e in ("absent", *s.events):
        total = total + lp.phred_to_prob(F.col(f"prob_{e}"))
    return got.select("variant", _r(total).alias("total"), "dp_tumor", "dp_normal")


def j23_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of the sample with the first name against two others, of calls that have both."""
    info = v.read(spark, sf_dir, "sample_info").distinct().where("allelefreq_estimate between 0 and 1").groupBy("call_id", "sample_name").agg(F.max("allelefreq_estimate").alias("vaf"))
    names = [r[0] for r in v.read(spark, sf_dir, "samples").select("sample_name").distinct().orderBy("sample_name").limit(3).collect()]
    return estimate.scatter_pairs(info, ["call_id"], "sample_name", "vaf", names[0], names[1:])


QUERIES = v.named(
    j1_sampled, j2_contaminated, j3_effective_alt, j4_joint, j6_simpson, d24_vaf_slice, j7_adaptive, j8_two_samples, j8_artifacts, j9_bias_strand, j9_bias_orient, j9_bias_pos, j9_bias_softclip, j9_bias_homopolymer, j9_bias_altlocus, j10_applicable,
    j11_universe, j12_pedigree, j13_population, j14_mendelian, j15_clonal, j16_somatic, j17_absent_only, j18_fractions, j19_prior_check, j20_prior_plot, j21_contamination, j22_tumor_normal, j23_scatter,
)

_L = "ln(m * ({f} * a + (1 - {f}) * r) + (1 - m) * (a + r) / 2)"
_NODES = "nodes AS (SELECT range / 10.0::DOUBLE AS f, ln((CASE WHEN range IN (0, 10) THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END) * 0.1::DOUBLE / 3) AS w FROM range(11))"
_SINGLE = f"""{v.LINES_SQL}, {_NODES},
    ll AS (SELECT l_orderkey AS variant, f, w, sum({_L.format(f='f')}) AS l, CAST(round(round(sum(m), 9)) AS INT) AS dp, count(*) > 10 AND bool_and(r > 3 * a) AS clear FROM lines, nodes GROUP BY ALL),
    jo AS (SELECT variant, dp, f, 'absent' AS e, l AS j FROM ll WHERE f = 0 UNION ALL SELECT variant, dp, f, 'present', l + w FROM ll),
    tp AS (SELECT variant, max(j) AS t FROM jo GROUP BY variant), su AS (SELECT variant, any_value(t) + ln(sum(exp(j - t))) AS z FROM jo JOIN tp USING (variant) GROUP BY variant)"""
_BIASED = {
    "j9_bias_strand": ("strand", "CASE strand WHEN 'Forward' THEN 0 ELSE -999 END", "CASE strand WHEN 'Both' THEN 0 ELSE ln(0.5) END", "ln(0.5)", "ln(0.5)"),
    "j9_bias_orient": ("orientation", "CASE orientation WHEN 'F1R2' THEN 0 WHEN 'F2R1' THEN -999 ELSE ln(0.5) END", "ln(0.5)", "ln(0.5)", "ln(0.5)"),
    "j9_bias_pos": ("CASE WHEN major THEN 'Major' ELSE 'Some' END", "CASE WHEN major THEN 0 ELSE -999 END", "CASE WHEN major THEN ln(0.01) ELSE ln(0.99) END", "CASE WHEN major THEN ln(0.01) ELSE ln(0.99) END", "CASE WHEN major THEN ln(0.01) ELSE ln(0.99) END"),
    "j9_bias_softclip": ("clipped", "CASE WHEN clipped THEN 0 ELSE -999 END", "0", "0", "0"),
    "j9_bias_homopolymer": ("hlen", "0", "0", "0", "0"),
    "j9_bias_altlocus": ("CASE WHEN locus THEN 'Major' ELSE 'None' END", "CASE WHEN locus THEN 0 ELSE -999 END", "ln(0.5)", "CASE WHEN locus THEN -999 ELSE 0 END", "ln(0.5)"),
}
_NAME = {"j9_bias_strand": "strand", "j9_bias_orient": "read_orientation", "j9_bias_pos": "read_position", "j9_bias_softclip": "softclipped", "j9_bias_homopolymer": "homopolymer_len", "j9_bias_altlocus": "alt_locus"}


def _bias_sql(name: str) -> str:
    from tesseral.plans.aggregate_queries import SIDED_SQL

    key, *values = _BIASED[name]
    return f"WITH {SIDED_SQL} SELECT {key} AS {_NAME[name]}, " + ", ".join(f"max(round(({x})::DOUBLE, 6) + 0.0::DOUBLE) AS {n}" for n, x in zip(("alt_biased", "alt_plain", "ref_biased", "mismapped"), values)) + " FROM sided GROUP BY 1"


_THREE = "SELECT CAST(a.range AS INT) AS child, CAST(b.range AS INT) AS father, CAST(c.range AS INT) AS mother FROM range(3) a, range(3) b, range(3) c"
_INHERIT = """t AS (SELECT k.*, i.x AS fi, j.x AS mi, CASE WHEN i.x = 1 THEN father / 2 ELSE 1 - father / 2 END AS pf, CASE WHEN j.x = 1 THEN mother / 2 ELSE 1 - mother / 2 END AS pm FROM k, (SELECT unnest([0, 1]) AS x) i, (SELECT unnest([0, 1]) AS x) j),
    q AS (SELECT child, father, mother, sum(CASE WHEN child - fi - mi >= 0 THEN pf * pm * pow(0.001::DOUBLE, child - fi - mi) ELSE 0 END) AS p FROM t GROUP BY ALL)"""
_POP = "CASE WHEN father + mother > 0 THEN 0.001::DOUBLE / (father + mother) ELSE 1 - 0.001::DOUBLE * (1 + 1 / 2 + 1 / 3 + 1 / 4) END"
ORACLE = {n: _bias_sql(n) for n in _BIASED} | {
    "j1_sampled": f"WITH {v.LINES_SQL} SELECT l_orderkey AS variant, round(sum({_L.format(f='0.2::DOUBLE')}), 6) + 0.0 AS ll FROM lines GROUP BY 1",
    "j2_contaminated": f"WITH {v.LINES_SQL} SELECT l_orderkey AS variant, round(sum(ln(m * (0.75 * (0.5 * a + 0.5 * r) + 0.25 * r) + (1 - m) * (a + r) / 2)), 6) + 0.0 AS ll FROM lines GROUP BY 1",
    "j3_effective_alt": "SELECT CAST(range AS INT) AS hundredth, round(CASE WHEN range = 100 THEN 1 ELSE range / 100.0::DOUBLE * 0.8 END, 6) + 0.0::DOUBLE AS p FROM range(101)",
    "j4_joint": f"WITH {v.LINES_SQL} SELECT l_orderkey AS variant, round(sum(CASE WHEN l_linestatus = 'F' THEN {_L.format(f='0.5::DOUBLE')} ELSE {_L.format(f='1.0::DOUBLE')} END), 6) + 0.0 AS ll FROM lines GROUP BY 1",
    "j6_simpson": f"""WITH {_SINGLE} SELECT variant, greatest(round(-10 * ln(sum(exp(j - z)) FILTER (e = 'absent')) / ln(10), 5), 0) + 0.0 AS prob_absent, greatest(round(-10 * ln(sum(exp(j - z)) FILTER (e = 'present')) / ln(10), 5), 0) + 0.0 AS prob_present, any_value(dp) AS dp_s FROM jo JOIN su USING (variant) GROUP BY variant""",
    "d24_vaf_slice": f"""WITH {_SINGLE} SELECT variant, round(f, 2) + 0.0 AS vaf, round(l + w - z, 5) + 0.0 AS density FROM ll JOIN su USING (variant)""",
    "j8_two_samples": f"""WITH {v.LINES_SQL}, ff AS (SELECT unnest([0.0::DOUBLE, 0.5, 1.0]) AS f),
        va AS (SELECT DISTINCT l_orderkey AS variant FROM lines), st AS (SELECT l_orderkey AS variant, l_linestatus AS s, count(*) > 10 AND bool_and(r > 3 * a) AS clear, CAST(round(round(sum(m), 9)) AS INT) AS dp FROM lines GROUP BY ALL),
        ll AS (SELECT l_orderkey AS variant, l_linestatus AS s, f, sum({_L.format(f='f')}) AS l FROM lines, ff GROUP BY ALL),
        g AS (SELECT va.variant, x.f AS vf, y.f AS vo, coalesce(a.l, 0) + coalesce(b.l, 0) AS j, coalesce(sf.clear, false) AS cf, coalesce(so.clear, false) AS co, coalesce(sf.dp, 0) AS dpf, coalesce(so.dp, 0) AS dpo FROM va, ff x, ff y LEFT JOIN ll a ON a.variant = va.variant AND a.s = 'F' AND a.f = x.f
            LEFT JOIN ll b ON b.variant = va.variant AND b.s = 'O' AND b.f = y.f LEFT JOIN st sf ON sf.variant = va.variant AND sf.s = 'F' LEFT JOIN st so ON so.variant = va.variant AND so.s = 'O'),
        e AS (SELECT *, CASE WHEN vf = 0 AND vo = 0 THEN 'absent' WHEN vf = 0.5 AND vo = 0.5 AND NOT cf AND NOT co THEN 'het_both' WHEN vf > 0 AND vo = 0 AND NOT cf THEN 'f_only' WHEN vo = 1 AND NOT co THEN 'o_hom' END AS e FROM g),
        t AS (SELECT *, max(j) OVER (PARTITION BY variant) AS t FROM e WHERE e IS NOT NULL), z AS (SELECT *, t + ln(sum(exp(j - t)) OVER (PARTITION BY variant)) AS z FROM t)
        SELECT variant, {", ".join(f"greatest(round(-10 * ln(coalesce(sum(exp(j - z)) FILTER (e = '{e}'), 0)) / ln(10), 5), 0) + 0.0 AS prob_{e}" for e in ("absent", "het_both", "f_only", "o_hom"))}, any_value(dpf) AS "dp_F", any_value(dpo) AS "dp_O" FROM z GROUP BY variant""",
    "j8_artifacts": "SELECT DISTINCT l_suppkey AS variant, 1.0::DOUBLE AS total FROM lineitem",
    "j10_applicable": f"""WITH {v.ONCE_SQL}, s AS (SELECT *, coalesce(length(ref_allele) = length(alt_allele) AND NOT starts_with(alt_allele, '<') AND svtype IS NULL, false) AS small, coalesce(NOT imprecise, true) AS precise FROM once)
        SELECT small AND precise AS orientation, precise AS strand, coalesce(len(hints) > 0, false) AS homopolymer, count(*) AS n FROM s GROUP BY ALL""",
    "j11_universe": "SELECT 'absent' AS event, false AS artifact UNION ALL SELECT e, a FROM (SELECT unnest(['somatic_tumor', 'somatic_normal', 'germline_het', 'germline_hom']) AS e), (SELECT unnest([true, false]) AS a)",
    "j12_pedigree": f"WITH k AS ({_THREE}), {_INHERIT} SELECT child, father, mother, round(p * {_POP}, 12) + 0.0 AS p FROM q",
    "j13_population": "SELECT CAST(range AS INT) AS n_alt, round(CASE WHEN range > 0 THEN 0.001::DOUBLE / range ELSE 1 - 0.001::DOUBLE * (1 + 1 / 2 + 1 / 3 + 1 / 4) END, 9) + 0.0 AS p FROM range(5)",
    "j14_mendelian": f"WITH k AS ({_THREE}), {_INHERIT} SELECT father, mother, child, round(p, 9) + 0.0 AS p FROM q",
    "j16_somatic": "SELECT CAST(range AS INT) AS tenth, CASE WHEN range = 0 THEN 0.999::DOUBLE ELSE 0.001 END AS p FROM range(11)",
    "j17_absent_only": f"WITH k AS ({_THREE}), {_INHERIT}, z AS (SELECT *, p * {_POP} AS whole FROM q) SELECT child, father, mother, round(CASE WHEN child + father + mother = 0 THEN whole WHEN whole = 0 THEN 0 ELSE 1 - (SELECT whole FROM z WHERE child + father + mother = 0) END, 9) + 0.0 AS p FROM z",
    "j18_fractions": "SELECT unnest(['SNV', 'MNV', 'INS', 'DEL', 'REP', 'INV', 'DUP', 'BND', 'METH']) AS vartype, unnest([1.0::DOUBLE, 0.001, 0.0125, 0.0125, 0.0125, 0.01, 0.01, 0.01, 1.0]) AS fraction",
    "j19_prior_check": "SELECT unnest(['no_rate', 'no_ploidy', 'fine']) AS name, unnest([false, false, true]) AS valid",
    "j20_prior_plot": "SELECT unnest([0.0::DOUBLE, 0.5, 0.625, 0.75, 0.875, 1.0]) AS vaf, unnest([1.0::DOUBLE, 0.0, 1.0, 1.0, 1.0, 1.0]) AS p",
    "j21_contamination": """WITH d AS (SELECT round(l_discount * 10, 1) AS v, 0.95::DOUBLE + round(l_tax, 2) / 2 AS p FROM lineitem), c AS (SELECT v, p, count(*) AS n FROM d WHERE p >= 0.95 GROUP BY ALL),
        g AS (SELECT x.range / 100.0::DOUBLE AS c, y.m AS m, x.range AS i FROM range(101) x, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75, 1.0]) AS m) y), s AS (SELECT g.*, v, p, n, m * (1 - c) * v / (SELECT max(v) FROM c) AS x FROM g, c),
        k AS (SELECT *, least(floor(x * 4), 3) / 4 AS lo FROM s), l AS (SELECT c, m, i, n, CASE WHEN c = 1 THEN ln(1 - p) ELSE ln((0.1 + abs(lo - v)) * (1 - (x - lo) * 4) + (0.1 + abs(lo + 0.25 - v)) * (x - lo) * 4) END AS l FROM k),
        j AS (SELECT c, m, i, sum(l * n) AS j FROM l GROUP BY ALL), w AS (SELECT *, j + ln((CASE WHEN i IN (0, 100) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) / 300.0::DOUBLE) AS jw FROM j), t AS (SELECT max(jw) AS t FROM w), z AS (SELECT t + ln(sum(exp(jw - t))) AS z FROM w, t GROUP BY t)
        SELECT round(c, 2) + 0.0 AS contamination, m AS max_somatic, round(j - z, 3) + 0.0 AS ln_density FROM w, z""",
    "j22_tumor_normal": f"""WITH {v.LINES_SQL} SELECT l_orderkey AS variant, 1.0::DOUBLE AS total, CAST(round(round(coalesce(sum(m) FILTER (l_linestatus = 'O'), 0), 9)) AS INT) AS dp_tumor, CAST(round(round(coalesce(sum(m) FILTER (l_linestatus <> 'O'), 0), 9)) AS INT) AS dp_normal FROM lines GROUP BY 1""",
    "j23_scatter": """WITH i AS (SELECT call_id, sample_name, max(allelefreq_estimate) AS vaf FROM sample_info WHERE allelefreq_estimate BETWEEN 0 AND 1 GROUP BY ALL), n AS (SELECT sample_name, row_number() OVER (ORDER BY sample_name) AS k FROM (SELECT DISTINCT sample_name FROM samples))
        SELECT a.call_id, a.vaf AS x, b.vaf AS y, b.sample_name AS y_sample FROM i a JOIN i b USING (call_id) JOIN n na ON na.sample_name = a.sample_name AND na.k = 1 JOIN n nb ON nb.sample_name = b.sample_name AND nb.k IN (2, 3)""",
}
