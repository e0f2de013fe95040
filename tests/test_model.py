import math
import random
from itertools import product

import numpy as np
import pandas as pd
import pytest

from tesseral.formula.scenario import Scenario
from tesseral.functions import logprob as lp
from tesseral.model import adaptive, bias, posterior, priors
from tesseral.operators import cnv, estimate, filters, pileup
from tesseral.functions import reads as rd


def rows_of(spark, n, p_alt, p_ref, sample="s", variant=1, **more):
    rows = [{"variant": variant, "sample": sample, "ln_map": math.log(0.95), "ln_alt": math.log(p_alt), "ln_ref": math.log(p_ref), **more} for _ in range(n)]
    return rows


def chance(p):
    return 10 ** (-p / 10)


def test_posterior_against_brute_force(spark):
    s = Scenario.from_yaml('samples: {a: {universe: "0.0 | 0.5 | 1.0", contamination: {by: b, fraction: 0.2}}, b: {universe: "0.0 | 0.5 | 1.0"}}\nevents: {one: "a:0.5 & b:0.0", two: "a:{0.5,1.0} & b:0.5", fold: "l2fc(a, b) > 0.5 & b:0.5"}')
    with pytest.raises(ValueError):
        posterior.compile_grid(Scenario.from_yaml('samples: {a: {universe: "[0.0,1.0]"}}\nevents: {x: "a:[0.0,0.5]", y: "a:]0.4,1.0]"}'))
    s.events.pop("fold")
    reads = rows_of(spark, 3, 0.9, 0.1, "a") + rows_of(spark, 2, 0.2, 0.8, "a") + rows_of(spark, 2, 0.3, 0.7, "b")
    got = posterior.posteriors(spark.createDataFrame(reads), s).collect()[0]

    def ll(va, vb):
        out = 0.0
        for r in reads:
            a, ref, m = math.exp(r["ln_alt"]), math.exp(r["ln_ref"]), 0.95
            own = lambda v: v * a + (1 - v) * ref
            right = 0.8 * own(va) + 0.2 * own(vb) if r["sample"] == "a" else own(vb)
            out += math.log(m * right + (1 - m) * (a + ref) / 2)
        return math.exp(out)

    parts = {"absent": ll(0, 0), "one": ll(0.5, 0), "two": ll(0.5, 0.5) + ll(1, 0.5)}
    total = sum(parts.values())
    for e, x in parts.items():
        assert math.isclose(chance(got[f"prob_{e}"]), x / total, rel_tol=1e-9)
    within = {"absent": [(0, 0)], "one": [(0.5, 0)], "two": [(0.5, 0.5), (1, 0.5)]}[max(parts, key=parts.get)]
    assert got["best_event"] == max(parts, key=parts.get)
    assert (got["af_a"], got["af_b"]) == max(within, key=lambda v: ll(*v)) and got["dp_a"] == 5


def test_posteriors_stream_by_without_rows_per_frequency(spark, monkeypatch):
    monkeypatch.setattr(posterior, "frequency_likelihoods", lambda *_: pytest.fail("a row is made for each observation and frequency"))
    s = Scenario.from_yaml('samples: {t: {resolution: 0.1, contamination: {by: n, fraction: 0.25}, universe: "[0.0,1.0]"}, n: {universe: "0.0 | 0.5 | 1.0"}}\nevents: {some: "t:]0.0,1.0] & n:0.0", het: "t:]0.0,1.0] & n:0.5", hom: "t:]0.0,1.0] & n:1.0"}')
    rnd = random.Random(5)
    pileups = {"deep": 90, "sampled": 7, "sure": 3, "tiny": 40, "normal only": 0}
    reads = []
    for v, n in pileups.items():
        for sample, k in (("t", n), ("n", n // 2 or 2)):
            for _ in range(k):
                a, r = {"sure": (1.0, 0.0), "tiny": (1e-140, 1e-150)}.get(v, (rnd.uniform(0.1, 0.9), rnd.uniform(0.1, 0.9)))
                reads.append({"variant": v, "sample": sample, "ln_map": 0.0 if v in ("sure", "tiny") else math.log(rnd.uniform(0.8, 1.0)), "ln_alt": math.log(a), "ln_ref": math.log(r) if r else -math.inf, "ln_sample_alt": math.log(rnd.uniform(0.5, 1.0)) if v == "sampled" else 0.0})
    rnd.shuffle(reads)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a pileup goes on over many batches
    try:
        df = spark.createDataFrame(reads, "variant string, sample string, ln_map double, ln_alt double, ln_ref double, ln_sample_alt double")
        got = {r["variant"]: r for r in posterior.posteriors(df, s).collect()}
        assert "afd_t" not in posterior.posteriors(df, s, densities=False).columns
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(got) == set(pileups)

    def ll(v, t, n):
        out = 0.0
        for r in reads:
            if r["variant"] == v:
                a, ref, m = math.exp(r["ln_alt"]), math.exp(r["ln_ref"]), math.exp(r["ln_map"])
                own = lambda x: (e := 1.0 if x == 1 else x * math.exp(r["ln_sample_alt"])) * a + (1 - e) * ref
                p = m * (0.75 * own(t) + 0.25 * own(n) if r["sample"] == "t" else own(n)) + (1 - m) * (a + ref) / 2
                out += math.log(p) if p > 0 else -math.inf
        return out

    nodes = [(k / 10, math.log(0.1 / 3 * (1 if k in (0, 10) else 4 if k % 2 else 2))) for k in range(11)]
    for v in pileups:
        joint = {"absent": [ll(v, 0.0, 0.0)]} | {e: [w + ll(v, t, n) for t, w in nodes] for e, n in (("some", 0.0), ("het", 0.5), ("hom", 1.0))}
        total = priors.log_sum([x for xs in joint.values() for x in xs])
        for e, xs in joint.items():
            want = -10 / math.log(10) * (priors.log_sum(xs) - total)
            assert math.isclose(got[v][f"prob_{e}"], max(want, 0), rel_tol=1e-9, abs_tol=1e-9), (v, e)
        assert got[v]["dp_t"] == int(sum(math.exp(r["ln_map"]) for r in reads if r["variant"] == v and r["sample"] == "t") + 0.5)
    one = got["sure"]
    assert (one["best_event"], one["af_n"]) == ("hom", 1.0) and [x["vaf"] for x in one["afd_n"]] == [0.5, 1.0]


def test_substitutions_and_missing_samples(spark):
    s = Scenario.from_yaml('samples: {a: {universe: "0.0 | 0.5"}, b: {universe: "0.0 | 0.5"}}\nevents: {cg: "C>G & a:0.5", other: "!C>G & a:0.5"}')
    obs = spark.createDataFrame(rows_of(spark, 4, 0.9, 0.1, "a", 1) + rows_of(spark, 4, 0.9, 0.1, "a", 2))
    alleles = spark.createDataFrame([(1, "C", "G"), (2, "C", "T")], "variant long, ref_allele string, alt_allele string")
    got = {r["variant"]: r for r in posterior.posteriors(obs, s, alleles).collect()}
    assert got[1]["prob_other"] == math.inf and got[2]["prob_cg"] == math.inf and got[1]["prob_cg"] < 1
    assert got[1]["dp_b"] == 0


def test_strand_artifact_beats_the_variant(spark):
    s = Scenario.from_yaml('samples: {s: {universe: "0.0 | 0.5 | 1.0"}}\nevents: {het: "s:0.5", hom: "s:1.0"}')
    refs = [r for k in range(10) for r in rows_of(spark, 1, 0.001, 0.999, strand="Forward" if k % 2 else "Reverse")]
    alts = rows_of(spark, 12, 0.999, 0.001, strand="Forward")
    got = posterior.posteriors(spark.createDataFrame(refs + alts), s, biases=bias.Applicable(orientation=False, position=False, softclip=False, homopolymer=False, alt_locus=False)).collect()[0]
    assert got["artifact"] == "+....." and got["af_s"] == 0.0
    assert math.isclose(sum(chance(got[f"prob_{e}"]) for e in ("absent", "het", "hom", "artifact")), 1, rel_tol=1e-9)
    both = rows_of(spark, 6, 0.999, 0.001, strand="Forward") + rows_of(spark, 6, 0.999, 0.001, strand="Reverse")
    got = posterior.posteriors(spark.createDataFrame(refs + both), s, biases=bias.Applicable(orientation=False, position=False, softclip=False, homopolymer=False, alt_locus=False)).collect()[0]
    assert got["artifact"] == "......" and got["af_s"] == 0.5


def test_adaptive_integral(spark):
    obs = spark.createDataFrame(rows_of(spark, 6, 0.99, 0.01) + rows_of(spark, 6, 0.01, 0.99))
    got = adaptive.adaptive_integral(obs, 0.0, 1.0, 0.01).collect()[0]
    x = np.linspace(0, 1, 20001)
    one = lambda a, r: 0.95 * (x * a + (1 - x) * r) + 0.05 * 0.5
    y = one(0.99, 0.01) ** 6 * one(0.01, 0.99) ** 6
    assert math.isclose(got["ln_integral"], math.log(np.trapezoid(y, x)), abs_tol=0.1)
    assert abs(got["best"] - 0.5) < 0.02


def test_priors_sum_to_one():
    for a, b in product(range(3), repeat=2):
        total = sum(math.exp(priors.mendelian((2, 2), 2, (a, b), c, 0.0)) for c in range(3))
        assert math.isclose(total, 1)
    s = Scenario.from_yaml("species: {heterozygosity: 0.001, ploidy: 2}\nsamples: {a: {}, b: {}}\nevents: {}")
    p = priors.Prior(s)
    assert math.isclose(math.exp(p((0.5, 0.0))), 0.001) and math.isclose(math.exp(p((0.5, 1.0))), 0.001 / 3) and p((0.3, 0.0)) == -math.inf


def test_deep_log_sums_and_smart_fdr(spark):
    df = spark.createDataFrame([(1, -5000.0), (1, -5000.0), (2, -math.inf), (2, None), (3, -1.0)], "k int, x double")
    from pyspark.sql import functions as F

    got = {r["k"]: r["y"] for r in lp.sum_exp_by(df, ["k"], F.col("x"), "y").collect()}
    assert math.isclose(got[1], -5000 + math.log(2)) and got[2] == -math.inf and got[3] == -1.0
    calls = spark.createDataFrame([(i, -10 * math.log10(1 - e), -10 * math.log10(max(e, 1e-9)), 100.0) for i, e in enumerate((0.0, 0.1, 0.1, 0.1))], "id int, PROB_X double, PROB_ABSENT double, PROB_ARTIFACT double")
    kept = filters.fdr_global(calls, F.round(1 - F.pow(F.lit(10.0), -F.col("PROB_X") / 10), 9), 0.06)
    assert kept.count() == 4  # the first of the equal errors is within the rate
    assert filters.fdr_global_smart(calls, ["x"], 0.06).count() >= 1


def test_major_feature_and_haplotype(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, None)], "k int, f string")
    assert {r["k"]: r["major"] for r in pileup.major_feature(df, ["k"], "f").collect()} == {1: "a", 2: None, 3: None, 4: None}
    one = spark.createDataFrame([([(-0.1, -2.0), (-0.5, -1.0)],)], "s array<struct<ln_alt:double,ln_ref:double>>").select(pileup.haplotype_support(F.col("s")).alias("h")).first()["h"]
    assert math.isclose(one["ln_alt"], -0.6)
    a, r = np.exp([-0.1, -0.5]), np.exp([-2.0, -1.0])
    assert math.isclose(math.exp(one["ln_ref"]), r[0] * a[1] + a[0] * r[1] + r[0] * r[1])


def test_copy_numbers_against_brute_force():
    rng = np.random.default_rng(1)
    emit = rng.normal(size=(4, 3)) * 3
    keep, change = cnv.transitions(3, 20.0)
    scores = {p: emit[0, p[0]] - math.log(3) + sum(emit[i, p[i]] + (keep if p[i] == p[i - 1] else change) for i in range(1, 4)) for p in product(range(3), repeat=4)}
    assert tuple(cnv.viterbi(emit, 20.0)) == max(scores, key=scores.get)
    assert math.isclose(cnv.forward(emit, 20.0), math.log(sum(math.exp(x) for x in scores.values())))


@pytest.fixture
def calls(spark, monkeypatch):
    """Calls of keys with doubled stretches and steps over 100, in small batches and buffers; the same by key and region, with emissions and the path found step by step."""
    rnd, rows = random.Random(2), []
    for key, n, far in ((1, 400, 37), (2, 90, 1000), (None, 60, 20), (3, 1, 1), (4, 5, 1), (5, 130, 64)):
        pos = 0
        for i in range(n):
            pos += 150 if i and i % far == 0 else rnd.randint(0, 9)
            d, more = rnd.randint(40, 80), 0.3 < i / n < 0.6
            rows.append((key, pos, d * (2 if more else 1) + rnd.randint(-3, 3), d, rnd.choice((0.5, 0.75)) if more else rnd.choice((0.45, 0.5)), rnd.choice((0.0, 0.5, 0.99, 1.0))))
    regions = {}
    for key in {r[0] for r in rows}:
        number, before = 0, None
        for r in sorted(r for r in rows if r[0] == key):
            number += before is not None and r[1] - before > 100
            before = r[1]
            regions.setdefault((key, number), []).append(r)
    keep, change = cnv.transitions(len(cnv.states(1.0)), 100.0)
    for k, x in regions.items():
        emit = cnv.emissions(pd.DataFrame(x, columns=["chrom", "pos", *cnv.VALUES]), cnv.states(1.0), 1.0)
        score, back = emit[0], []
        for row in emit[1:]:
            top = int(score.argmax())
            back.append(np.where(score + keep >= score[top] + change, np.arange(len(row)), top))
            score = np.maximum(score + keep, score[top] + change) + row
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        regions[k] = ([r[1] for r in x], emit, path[::-1])
    rnd.shuffle(rows)
    for name, value in (("BUFFER", 50), ("SIDE_BY_SIDE", 3), ("BLOCK", 16)):
        monkeypatch.setattr(cnv, name, value)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    yield spark.createDataFrame(rows, "chrom long, pos long, depth_tumor int, depth_normal int, vaf_tumor double, prob_het double"), regions
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_copy_numbers_of_streamed_regions(calls):
    df, regions = calls
    table, want = cnv.states(1.0), set()
    for (key, number), (pos, emit, path) in regions.items():
        a = 0
        for z in range(1, len(path) + 1):
            if z == len(path) or path[z] != path[a]:
                if z - a > 1 and table["gain"][path[a]] != 0:
                    want.add((key, number, pos[a], pos[z - 1], int(table["gain"][path[a]]), float(table["frequency"][path[a]]), z - a, round(float(emit[a:z, 0].sum()), 6)))
                a = z
    got = cnv.call_cnvs(df, ["chrom"], "pos", 1.0, gap=100)
    assert got.columns == ["chrom", "region", "first_pos", "last_pos", "gain", "frequency", "n_calls", "ln_no_change"]
    assert len(want) > 3 and sorted(((*r[:7], round(r[7], 6)) for r in got.collect()), key=str) == sorted(want, key=str)
    assert cnv.call_cnvs(df.where("false"), ["chrom"], "pos", 1.0, gap=100).count() == 0
    # regions side by side, in blocks, find what each finds alone
    every = list(regions.values())
    emit, lens = np.concatenate([x[1] for x in every]), np.array([len(x[2]) for x in every])
    first, end, state = cnv.stretches(emit.__getitem__, emit.shape[1], np.arange(len(emit)), np.cumsum(lens) - lens, lens, 100.0)
    assert np.repeat(state, end - first).tolist() == [s for x in every for s in x[2]]


def test_likelihoods_of_streamed_regions(calls):
    df, regions = calls
    keep, change = cnv.transitions(len(cnv.states(1.0)), 100.0)
    want = {}
    for k, (_, emit, _) in regions.items():
        f = emit[0] - math.log(emit.shape[1])
        for row in emit[1:]:
            f = row + np.logaddexp(f.max() + math.log(np.exp(f - f.max()).sum()) + change, f + math.log(math.exp(keep) - math.exp(change)))
        want[k] = f.max() + math.log(np.exp(f - f.max()).sum())
    got = {(r["chrom"], r["region"]): r["ln_likelihood"] for r in cnv.region_likelihoods(df, ["chrom"], "pos", 1.0, gap=100).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    # far emissions don't underflow, and what no state allows is impossible
    far = np.array([[0.0, -5000.0], [-5000.0, 0.0], [-np.inf, -9000.0]])
    assert math.isclose(cnv.forward(far, 20.0), math.log(0.5) + cnv.transitions(2, 20.0)[1] + cnv.transitions(2, 20.0)[0] - 9000.0, rel_tol=1e-9)
    assert cnv.forward(np.array([[0.0, 0.0], [-np.inf, -np.inf], [0.0, 0.0]]), 20.0) == -math.inf


def test_estimates():
    assert estimate.alignments_needed(0.01, 0.1) > estimate.alignments_needed(0.1, 0.1) >= 1
    assert math.isclose(sum(rd.isize_pmf(np.arange(0, 600, dtype=float), 300.0, 12.0)), 1)
    assert rd.fragment_sampling(1, 100, 100, 80, 80, 300.0, 30.0) <= 0
    assert rd.homopolymer_indel("CAAAG", "CAAAAG") == 1 and rd.homopolymer_indel("CAAAG", "CAAG") == -1 and rd.homopolymer_indel("CAG", "CATG") is None
    assert rd.methylation_calls("ACCG", "C+m,1;", [10], False) == {2: 10.5 / 256} and rd.methylation_calls("ACCG", "C+m,5;", [10], False) is None
    assert rd.motif_sequences("CHG") == ["CAG", "CCG", "CTG"]
