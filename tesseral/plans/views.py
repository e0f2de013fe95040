"""Adapter views: the plain tables in the shapes of observations, calls, reads and loci, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.functions import logprob as lp


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Parts of an observation's row, the same arithmetic on both sides.
P_MAP, P_ALT = "0.90 + l_tax", "0.05 + 9 * l_discount"
LINES_SQL = f"""lines AS (SELECT *, 0.90::DOUBLE + l_tax AS m, 0.05::DOUBLE + 9 * l_discount AS a, 1 - (0.05::DOUBLE + 9 * l_discount) AS r FROM lineitem)"""


def observations(spark: SparkSession, sf_dir: str, variant: str = "l_orderkey") -> DataFrame:
    """Lines as observations in log space, their status as sample; the columns of the line stay."""
    m, a = F.lit(0.90) + F.col("l_tax"), F.lit(0.05) + F.lit(9.0) * F.col("l_discount")
    out = read(spark, sf_dir, "lineitem").withColumns({"m": m, "a": a, "r": 1 - a, "variant": F.col(variant), "sample": F.col("l_linestatus")})
    return out.withColumns({"ln_map": lp.ln(F.col("m")), "ln_alt": lp.ln(F.col("a")), "ln_ref": lp.ln(F.col("r"))})


CALLS_SQL = """calls_view AS (SELECT *, u * h AS high, u * (1 - h) AS low, (1 - u) * s AS absent, (1 - u) * (1 - s) AS artifact
    FROM (SELECT *, (o_orderkey % 97 + 1) / 98.0::DOUBLE AS u, (o_orderkey % 7 + 1) / 8.0::DOUBLE AS h, (o_orderkey % 13 + 1) / 15.0::DOUBLE AS s FROM orders))"""


def order_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls with PHRED scores of the events high, low, absent and artifact, the customer as event."""
    k = F.col("o_orderkey")
    u, h, s = (k % 97 + 1) / F.lit(98.0), (k % 7 + 1) / F.lit(8.0), (k % 13 + 1) / F.lit(15.0)
    scores = {"PROB_HIGH": u * h, "PROB_LOW": u * (1 - h), "PROB_ABSENT": (1 - u) * s, "PROB_ARTIFACT": (1 - u) * (1 - s)}
    kind = F.element_at(F.array(*(F.lit(x) for x in ("SNV", "DEL", "INS", "MNV", "BND"))), (k % 5 + 1).cast("int"))
    return read(spark, sf_dir, "orders").withColumns({c: lp.prob_to_phred(p) for c, p in scores.items()}).withColumns({"vartype": kind, "svlen": (k % 50).cast("int")})


KIND_SQL = "(['SNV', 'DEL', 'INS', 'MNV', 'BND'])[o_orderkey % 5 + 1]"


def once_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the domain, each delivered record once: repeats differ in the load time only."""
    calls = read(spark, sf_dir, "calls")
    return calls.drop("loaded_at").distinct()


ONCE_SQL = "once AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM calls)"


def named(*functions) -> dict:
    return {f.__name__: f for f in functions}
