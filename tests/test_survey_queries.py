import math

import __spark_entry__ as entry
from tesseral.operators import posterior


def test_entry_gives_a_posterior_for_every_order(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey").distinct().count()
    rows = entry.entry(spark).collect()
    assert len(rows) == orders > 0
    for r in rows:
        assert abs(sum(10 ** (-r[c] / 10) for c in ("prob_absent", "prob_het", "prob_hom")) - 1) < 1e-4


def test_posterior_by_hand(spark):
    obs = spark.createDataFrame([(1, 0.9, 0.8, 0.2)] + [(2, 0.9, 0.1, 0.9)] * 11 + [(3, 0.9, 0.1, 0.9)] * 10, "variant long, p_map double, p_alt double, p_ref double")
    got = {r["variant"]: r for r in posterior.discrete_posteriors(obs, "variant", {"het": (0.5,), "hom": (1.0,)}).collect()}
    weights = [0.9 * (v * 0.8 + (1 - v) * 0.2) + 0.1 * 0.5 for v in (0.0, 0.5, 1.0)]
    assert abs(got[1]["prob_hom"] + 10 * math.log10(weights[2] / sum(weights))) < 1e-9
    assert (got[1]["af"], got[1]["dp"]) == (1.0, 1)
    assert (got[2]["prob_absent"], got[2]["prob_het"], got[2]["af"]) == (0.0, math.inf, 0.0)  # clearly the reference
    assert got[3]["prob_het"] < math.inf
