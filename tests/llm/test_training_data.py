"""Operators of problems 1, 2, 7 and 9 on planted cases, nulls, ties and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.llm import components, encoding, quantiles, reading, spoken
from tesseral.session import clean_up


def leaves(df):
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


def test_components_of_a_long_path(spark, monkeypatch):
    n, rnd = 3000, random.Random(5)
    names = list(range(n))
    rnd.shuffle(names)
    edges = spark.createDataFrame([(names[i], names[i + 1]) for i in range(n - 1)] + [(n + 1, n + 1), (None, 3), (names[0], names[1])], "u long, v long")
    sizes, write = [], components.Scratch.table
    monkeypatch.setattr(components.Scratch, "table", lambda self, df: sizes.append(leaves(df)) or write(self, df))
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {n + 1: n + 1}
    assert len(sizes) > 30 and max(sizes) <= 6  # no plan grows with the rounds
    clean_up()


def test_components_against_union_find_with_hot_keys(spark):
    rnd = random.Random(1)
    pairs = [(0, rnd.randint(1, 60)) for _ in range(80)] + [(rnd.randint(61, 160), rnd.randint(61, 160)) for _ in range(70)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long"), hot_rows=5).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_tied_groups(spark):
    rows = [(1, 1, "a", None, "b ,c"), (2, 1, " b", ".", None), (3, 1, "c", "", None), (4, 2, "a", "E", None), (5, 2, "z", " E ", None), (6, 1, None, None, "nowhere"), (7, None, "a", None, None), (4, 2, "a", "E", None)]
    df = spark.createDataFrame(rows, "call_id long, callset_id long, id string, event string, mateid string").withColumn("key", F.lit(1))
    assert {tuple(r) for r in components.tied_groups(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


@pytest.mark.parametrize("nodes", [quantiles.NODES_PER_TASK, 3000])
def test_percentiles_within_their_bound_after_merging(spark, monkeypatch, nodes):
    monkeypatch.setattr(quantiles, "NODES_PER_TASK", nodes)
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.lognormal(3, 1, 40_000), np.full(10_000, 7.0)])
    days = [spark.createDataFrame([("s", float(v)) for v in values[i::4]] + [("s", None), ("s", float("nan")), (None, 1.0)], "k string, v double") for i in range(4)]
    tables = [quantiles.digest_table(d, ["k"], "v") for d in days]
    merged = quantiles.merge(tables, ["k"])
    rows = merged.where("k = 's'").collect()
    assert sum(r["count"] for r in rows) == len(values) and len(rows) <= 3 * quantiles.budget_of(quantiles.RANK_ERROR)
    for r in quantiles.percentiles(merged, ["k"]).where("k = 's'").collect():
        lo = (values < r["value"] * (1 - quantiles.VALUE_ERROR)).sum() - r["most_rank_error"]
        hi = (values <= r["value"] * (1 + quantiles.VALUE_ERROR)).sum() + r["most_rank_error"]
        assert lo <= r["share"] * len(values) <= hi
    assert quantiles.percentiles(merged, ["k"]).where("k is null").count() == len(quantiles.DEFAULT_PERCENTILES)
    assert quantiles.value_percentiles(days[0].where("false"), ["k"], "v").count() == 0


@pytest.mark.parametrize("leaf", [8, 64])
def test_tree_encoding_equals_encoding_at_once(spark, leaf):
    tree = encoding.Encoder(leaf=leaf)
    rnd = random.Random(4)
    texts = ["", " ", "don't we'll 123  \n\n x", "a" * 500, "日本語 текст naïve 🎬🎬", "\n \t" * 40] + ["".join(rnd.choice("ab' \n1.é漢") for _ in range(200)) for _ in range(100)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").collect()]
    for t in texts:
        ids = tree.encode(t)
        assert list(ids) == tree.core.encode_ordinary(t) and tree.decode(ids) == t
    assert list(tree.encode(None)) == []


def test_encode_corpus_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, None), (2, "")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = encoding.encode_corpus(df).collect()
    assert len(got) == 4 and sorted(len(r["ids"]) for r in got) == [0, 0, 2, 2]


def cue(i, text):
    return f"{i}\n00:00:{i:02d},000 --> 00:00:{i + 1:02d},000\n{text}\n\n"


def test_adverts_are_learned_and_dialogue_stays(spark):
    rows = []
    for d in range(60):
        lines = [f"Line {chr(97 + (d * 7 + k) % 26)} of talk number {d} {k}" for k in range(6)] + ["I am free for dinner tonight"]
        if d % 3 == 0:
            lines = ["Rate this file and support us"] + lines
        rows.append((d, "".join(cue(i, x) for i, x in enumerate(lines))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    adverts = spoken.learn_adverts(df)
    assert "rate this file and support us" in adverts.keys
    said = spoken.words("".join(cue(i, x) for i, x in enumerate(["Hello there", "<i>Rate this file</i> and support us", "Bye"])), adverts)
    assert said == ["hello", "there", "bye"]
    assert spoken.learn_adverts(df.limit(0)).keys == frozenset()


def test_masked_text_keeps_places():
    text = cue(1, "<i>Hel</i>lo [door] JOHN SMITH: there") + cue(2, "- Bye (" + "x" * 400 + ") now")
    plain, masked = spoken.masked_text(text)
    assert len(plain) == len(masked) and spoken.words(text) == ["hello", "john", "smith", "there", "bye", "now"]
    assert len(spoken.word_spans(masked)) == 6 and spoken.spoken_text(None) == ""


def test_reading_levels(spark):
    easy, hard = "The cat sat. The dog ran. We go home now. It is a big day. ", "Notwithstanding considerable institutional resistance, the committee subsequently acknowledged that fundamental restructuring, although expensive, remained unavoidable. "
    rows = [(i, (easy if i % 2 else hard) * (4 + i % 3), "en") for i in range(60)] + [(100, None, "en"), (101, "", "en"), (102, easy * 9, "de"), (103, "too short", "en"), (1, easy * 5, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, r, 1 if i % 2 else 4) for i in range(0, 30) for r in ("x", "y")] + [(5, "z", None), (9999, "x", 2)], "doc_id long, rater string, band int")
    got = {r["doc_id"]: r["band"] for r in reading.reading_levels(docs, labels).collect()}
    assert got == {i: 1 if i % 2 else 4 for i in range(60)}
    with pytest.raises(ValueError):
        reading.reading_levels(docs, labels.where("false")).count()


def test_rater_error():
    assert abs(reading.rater_error(980, 1000, 4) - 0.0106) < 2e-3
    assert 0 < reading.rater_error(0, 0, 4) < 0.75
