"""The flagship query: posteriors of a discrete scenario on lines as observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.operators import posterior


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as observations; all lines of an order belong to the one sample of the scenario."""
    p_alt = 0.05 + F.lit(9.0) * F.col("l_discount")
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("variant"), (0.90 + F.col("l_tax")).alias("p_map"), p_alt.alias("p_alt"), (1 - p_alt).alias("p_ref"))


def j8_posterior_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Universe 0.0 | 0.5 | 1.0 with the events het, hom and absent."""
    got = posterior.discrete_posteriors(_obs(spark, sf_dir), "variant", {"het": (0.5,), "hom": (1.0,)})
    return got.select("variant", *(F.round(c, 6).alias(c) for c in ("prob_absent", "prob_het", "prob_hom")), "af", "dp")


def j1_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log likelihood of each variant's observations at frequency 0.5."""
    return _obs(spark, sf_dir).groupBy("variant").agg(F.round(F.sum(posterior.observation_likelihood(0.5, F.col("p_map"), F.col("p_alt"), F.col("p_ref"))), 6).alias("ln_likelihood"))


QUERIES = {f.__name__: f for f in (j8_posterior_discrete, j1_likelihood)}

_OBS = "obs AS (SELECT l_orderkey AS variant, 0.90::DOUBLE + l_tax AS m, 0.05::DOUBLE + 9 * l_discount AS a, 1 - (0.05::DOUBLE + 9 * l_discount) AS r FROM lineitem)"
_LN = "ln(m * ({v} * a + (1 - {v}) * r) + (1 - m) * (a + r) / 2)"

ORACLE = {
    "j8_posterior_discrete": f"""
        WITH {_OBS},
        l AS (SELECT variant, count(*) AS dp, bool_and(r > 3 * a) AS for_ref, sum({_LN.format(v="0.0::DOUBLE")}) AS l0, sum({_LN.format(v="0.5::DOUBLE")}) AS l5, sum({_LN.format(v="1.0::DOUBLE")}) AS l1 FROM obs GROUP BY variant),
        x AS (SELECT variant, dp, l0, CASE WHEN dp > 10 AND for_ref THEN CAST('-inf' AS DOUBLE) ELSE l5 END AS l5, CASE WHEN dp > 10 AND for_ref THEN CAST('-inf' AS DOUBLE) ELSE l1 END AS l1 FROM l),
        s AS (SELECT *, greatest(l0, l5, l1) + ln(exp(l0 - greatest(l0, l5, l1)) + exp(l5 - greatest(l0, l5, l1)) + exp(l1 - greatest(l0, l5, l1))) AS total FROM x)
        SELECT variant, round(greatest(-10 * (l0 - total) / ln(10), 0), 6) AS prob_absent, round(greatest(-10 * (l5 - total) / ln(10), 0), 6) AS prob_het, round(greatest(-10 * (l1 - total) / ln(10), 0), 6) AS prob_hom,
            CASE WHEN l0 >= l5 AND l0 >= l1 THEN 0.0::DOUBLE WHEN l5 >= l1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS af, dp FROM s""",
    "j1_likelihood": f"WITH {_OBS} SELECT variant, round(sum({_LN.format(v='0.5::DOUBLE')}), 6) AS ln_likelihood FROM obs GROUP BY variant",
}
