"""Operators of problems 3 to 6 on nulls, ties, repeats, empty tables and clashing names."""

import os

import pytest
from pyspark.sql import functions as F

from tesseral.operators import evidence, heavykeys, packed, periods, rejects
from tesseral.session import Scratch, clean_up, drop_repeats, lookup, running, scratch_root


def test_lookup_with_hot_keys(spark):
    folder = scratch_root(spark).removeprefix("file://")
    clean_up()
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    left = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(100)] + [(200, None), (201, 555)], "i long, k long")
    table = spark.createDataFrame([(7, "seven")] + [(i, str(i)) for i in range(0, 100, 3)], "key long, v string")
    got = {r["i"]: r["out"] for r in lookup(Scratch(spark), left, "k", table, "key", "v", "out", hot_rows=10).collect()}
    assert len(got) == 102 and got[1] == "seven" and got[3] == "3" and got[200] is None and got[201] is None
    assert set(os.listdir(folder)) - before
    clean_up()
    assert not set(os.listdir(folder)) - before


def test_drop_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "x"), (None, "x"), (None, "y")], "k long, v string")
    for most in (0, 100):
        assert sorted(drop_repeats(Scratch(spark), df, ["k"], most).collect(), key=str) == sorted([(1, "a"), (2, "b"), (None, "x"), (None, "y")], key=str)
    assert drop_repeats(Scratch(spark), df.limit(0), ["k"]).count() == 0


def test_running_sums(spark):
    df = spark.range(1000).withColumn("x", F.lit(2))
    got = running(Scratch(spark), df, ["id"], {"s": F.col("x")}).collect()
    assert all(r["s"] == 2 * (r["id"] + 1) for r in got) and len(got) == 1000


def test_dense_aggregate_whole_numbers_nulls_and_empty(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([("a", big, 1.5), ("a", -big, None), (None, 3, 2.0), ("b", None, float("nan"))], "k string, n long, x double")
    got = {r["key_value"]: r for r in heavykeys.dense_aggregate(df, "k", sums=["n", "x"], minima=["n"], maxima=["n"], null_key=True).collect()}
    assert got["a"]["min_n"] == -big and got["a"]["max_n"] == big and got["a"]["sum_n"] == 0 and got["a"]["sum_x"] == 1.5
    assert got["b"]["sum_n"] is None and got["b"]["n_x"] == 0 and got[None]["n_rows"] == 1
    assert heavykeys.dense_aggregate(df.where("false"), "k").count() == 0


def test_majority_keys(spark, monkeypatch):
    df = spark.createDataFrame([(x,) for x in "aaabbbccd"] + [(None,)] * 3, "k string")
    assert [r["key_value"] for r in heavykeys.majority_keys(df, "k").orderBy("key_value").collect()] == ["a", "b", "c"]
    assert heavykeys.majority_keys(df.where("false"), "k").count() == 0
    assert heavykeys.majority_keys(df.where("k is null"), "k").count() == 0
    monkeypatch.setattr(heavykeys, "TIES_IN_ONE_TASK", 0)
    even = spark.createDataFrame([(x,) for x in "fedcba"], "k string")
    assert sorted(r["key_value"] for r in heavykeys.majority_keys(even, "k").collect()) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("tile", [2, 5, 1 << 20])
def test_periods_against_brute_force(spark, tile):
    rows = [("x", 1, 3), ("x", 4, 4), ("x", 10, 12), ("x", 11, 20), ("x", 11, 20), ("x", 30, 29), ("x", None, 5), (None, 5, 6), (None, 9, 9), ("y", -7, -3)]
    df = spark.createDataFrame(rows, "chrom string, kind long, e long").withColumnRenamed("kind", "start")
    got = {(r["chrom"], r["kind"], r["first_pos"], r["last_pos"]) for r in periods.periods_and_gaps(df, ["chrom"], "start", "e", tile).collect()}
    assert got == {("x", "period", 1, 4), ("x", "gap", 5, 9), ("x", "period", 10, 20), (None, "period", 5, 6), (None, "gap", 7, 8), (None, "period", 9, 9), ("y", "period", -7, -3)}
    assert periods.periods_and_gaps(df.where("false"), ["chrom"], "start", "e").count() == 0


def test_rejects(spark):
    good = "chr1,5,.,A,T,.,PASS,.,,,DP=1"
    lines = {
        1: (good, None),
        2: (good + ",x", "column_count"),
        3: ("", "column_count"),
        4: (None, "column_count"),
        5: (good.replace("DP=1", '"a\nb"'), None),
        6: (good.replace("PASS", '"PASS'), "quoting"),
        7: (good.replace("PASS", 'PA"S"S'), "quoting"),
        8: (good.replace("PASS", ' "PASS"'), "quoting"),
        9: (good.replace(",5,", ",-5,"), "bad_pos"),
        10: (good.replace(",5,", ",2147483648,"), "bad_pos"),
        11: (good.replace(",T,", ',"T,,A",'), "bad_alt"),
        12: (good.replace("PASS,.", "PASS,XXX"), "bad_svtype"),
        13: (good.replace("PASS", "PA\nSS"), None),
        14: (good.replace("DP=1", "x" * 300_000), None),
        15: (good.replace("DP=1", '"say ""hi"" twice"'), None),
        16: ('"' + good, "quoting"),
    }
    df = spark.createDataFrame([(k, v) for k, (v, _) in lines.items()] + [(1, good)], "id long, line string")
    rows = rejects.parse_rows(df, "id", "line").collect()
    assert len(rows) == 17 and {r["id"]: r["reason"] for r in rows} == {k: r for k, (_, r) in lines.items()}
    at = {r["id"]: r for r in rows}
    assert at[5]["info"] == "a\nb" and at[15]["info"] == 'say "hi" twice' and at[13]["filter"] == "PA\nSS" and at[1]["pos"] == 5 and at[1]["id_field"] == "."
    assert rejects.parse_rows(df.where("false"), "id", "line").count() == 0


FIELDS = [(1, 'a, "b,c" ;d'), (2, '"x""y";;.; z'), (3, '"open,e'), (4, ""), (5, None), (6, "o'a,b"), (7, '"q" tail,w'), (8, 'a"b,c"d')] + [(10 + i, 'k1,k2;"k,3"') for i in range(30)]
VALUES = {1: [(1, "a"), (2, "b,c"), (3, "d")], 2: [(1, 'x"y'), (4, "z")], 3: [(1, '"open'), (2, "e")], 6: [(1, "o'a"), (2, "b")], 7: [(1, "q tail"), (2, "w")], 8: [(1, 'a"b'), (2, 'c"d')]}


def values(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], []).append((r["pos_no"], r["item_value"]))
    return {k: sorted(v) for k, v in out.items()}


def test_packed_fields_come_from_the_lattice(spark):
    df = spark.createDataFrame(FIELDS, "id long, item_value string")
    got = values(packed.split_packed(df, "id", "item_value", ",;"))
    assert {k: v for k, v in got.items() if k < 10} == VALUES and got[10] == [(1, "k1"), (2, "k2"), (3, "k,3")]
    # the exact check changes nothing that the model decided, and without what it learned the rows differ
    assert values(packed.split_packed(df, "id", "item_value", ",;", exact_check=False)) == got
    assert values(packed.split_packed(df, "id", "item_value", ",;", learned=packed.uninformed(",;"), exact_check=False)) != got
    assert packed.split_packed(df.where("false"), "id", "item_value", ",;").count() == 0


def test_packed_fields_with_one_reading_need_no_model(spark, monkeypatch):
    rows = [(i, '"a,x') for i in range(40)] + [(100 + i, 'y,b"') for i in range(40)] + [(200, '"a,b"'), (201, '"a,b" ;"c;d"""')]
    df = spark.createDataFrame(rows, "id long, x string")
    # a model of this column cuts the one span that is closed
    assert values(packed.split_packed(df, "id", "x", ",;", exact_check=False))[200] == [(1, '"a'), (2, 'b"')]
    monkeypatch.setattr(packed, "learn_values", lambda *_: pytest.fail("a model was fitted that no row depends on"))
    got = values(packed.split_packed(df, "id", "x", ",;"))
    assert got[0] == [(1, '"a'), (2, "x")] and got[100] == [(1, "y"), (2, 'b"')]
    assert got[200] == [(1, "a,b")] and got[201] == [(1, "a,b"), (2, 'c;d"')]
    with pytest.raises(ValueError, match="exact_check"):
        packed.split_packed(df, "id", "x", ",;", learned=packed.uninformed(",;"))


def test_separators_that_belong_to_values(spark):
    names = ["Smith, J, Jr", "Doe, A", "Roe, B"]
    rows = [(i, ";".join([names[i % 3], f"v{i}", names[(i + 1) % 3]])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x string")
    got = values(packed.split_packed(df, "id", "x", ",;", separators_always_part=False))
    assert got[0] == [(1, "Smith, J, Jr"), (2, "v0"), (3, "Doe, A")]
    assert got[7] == [(1, "Doe, A"), (2, "v7"), (3, "Roe, B")]


def test_edit_distance_and_pair_hmm_against_brute_force():
    import random

    rnd = random.Random(3)

    def plain(a, w):
        row = [0] * (len(w) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(w, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    for _ in range(60):
        a, w = ("".join(rnd.choice("ACGT") for _ in range(rnd.randint(1, 12))) for _ in range(2))
        d, s, e = evidence.edit_distance(a, w)
        assert d == plain(a, w) and 0 <= s <= e <= len(w)
    own, other = (evidence.pair_hmm("ACGTAC", [30] * 6, w) for w in ("GGACGTACGG", "GGACGAACGG"))
    assert own > other + 3 > -200
