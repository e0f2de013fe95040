"""Reading level of documents by a regularised ordinal regression.

Features of the spoken words (length, lexical diversity, rarity in the corpus,
connectives, clause depth) feed a proportional-odds model that is calibrated to
graded documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.llm import spoken
from tesseral.session import Scratch, drop_repeats

#: English words that join clauses or mark how they hang together.
CONNECTIVES = frozenset(
    """after although and as because before but consequently either even except for furthermore hence however if
    inasmuch insofar instead irrespective likewise moreover neither nevertheless nor notwithstanding once or otherwise
    provided rather since so still than that then therefore though thus unless until when whenever where whereas
    wherever whether which while who whom whose yet""".split()
)
#: Words that open a dependent clause.
SUBORDINATORS = frozenset("after although as because before if inasmuch insofar notwithstanding once since that though unless until when whereas whether which while who whom whose why".split())
#: Buckets of the corpus-wide word counts: the table that is broadcast (4 bytes each) has this size whatever the corpus.
BUCKETS = 1 << 20
_SENTENCE_END = re.compile(r"[.?!…]+(?=\s|$|[\"'”’)])")
_CLAUSE_MARK = re.compile(r"[,;:]")
FEATURES = ("word_length", "long_words", "very_long_words", "log_sentence_length", "diversity", "hapax_share", "connectives", "subordinators", "clause_marks", "length_spread", "log_words", "rarity", "rare_share")


class _Facts(dict):
    """Token to (length, bucket, connective, subordinator), or None where it is no word."""

    def __missing__(self, token: str):
        w = spoken.fold(token)
        got = (len(w), xxhash.xxh32_intdigest(w) % BUCKETS, w in CONNECTIVES, w in SUBORDINATORS, w) if w else None
        if len(self) > 500_000:
            self.clear()
        self[token] = got
        return got


def describe(text: str | None, facts: dict | None = None, adverts: spoken.Adverts = spoken.NO_ADVERTS) -> tuple[int, list[float], list[int]]:
    """Number of spoken words, the features without rarity, and the bucket of each word."""
    facts = _Facts() if facts is None else facts
    said = spoken.spoken_text(text, adverts)
    got = [g for g in map(facts.__getitem__, spoken.parts(said)) if g is not None]
    n = len(got)
    if not n:
        return 0, [0.0] * (len(FEATURES) - 2), []
    size = np.array([g[0] for g in got], dtype=np.float64)
    kinds: dict[str, int] = {}
    for g in got:
        kinds[g[4]] = kinds.get(g[4], 0) + 1
    sentences = max(1, len(_SENTENCE_END.findall(said)))
    values = [
        size.mean(),
        np.count_nonzero(size >= 7) / n,
        np.count_nonzero(size >= 11) / n,
        np.log(n / sentences),
        len(kinds) / n**0.5,
        sum(1 for v in kinds.values() if v == 1) / n,
        sum(g[2] for g in got) / n,
        sum(g[3] for g in got) / sentences if sentences > 1 else sum(g[3] for g in got) / max(1.0, n / 12),
        len(_CLAUSE_MARK.findall(said)) / n,
        size.std(),
        np.log(n),
    ]
    return n, [float(v) for v in values], [g[1] for g in got]


@dataclass
class OrdinalModel:
    """P(level <= k) = logistic(cut_k - weights . standardised features)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    levels: np.ndarray
    rater_error: float

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        score = ((x - self.mean) / self.scale) @ self.weights
        upto = _logistic(self.cuts[None, :] - score[:, None])
        full = np.concatenate([np.zeros((len(x), 1)), upto, np.ones((len(x), 1))], axis=1)
        return np.log(np.maximum(np.diff(full, axis=1), 1e-12))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_ordinal(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 200) -> OrdinalModel:
    """Fit by damped Newton steps on the penalised likelihood.

    ``penalty`` is the weight of the squared coefficients.  Levels are the distinct
    values of ``y``; at least two are needed.
    """
    levels = np.unique(y)
    if len(levels) < 2:
        raise ValueError("at least two levels must be labelled")
    at = np.searchsorted(levels, y)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    p, k = z.shape[1], len(levels) - 1
    share = np.clip(np.cumsum(np.bincount(at, minlength=k + 1))[:-1] / len(y), 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    # the cuts stay in order: the first, then logarithms of the distances
    q = np.concatenate([np.zeros(p), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])

    def cuts_of(q: np.ndarray) -> np.ndarray:
        return q[p] + np.concatenate([[0.0], np.cumsum(np.exp(q[p + 1 :]))])

    def loss_and_slope(q: np.ndarray) -> tuple[float, np.ndarray]:
        cuts = cuts_of(q)
        score = z @ q[:p]
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = _logistic(edge[at + 1] - score), _logistic(edge[at] - score)
        mass = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        by_cut = np.zeros(k)
        np.add.at(by_cut, at[at < k], dhi[at < k])
        np.add.at(by_cut, at[at > 0] - 1, -dlo[at > 0])
        slope = np.empty(len(q))
        slope[:p] = z.T @ (dhi - dlo) + penalty * q[:p]
        tail = np.cumsum(by_cut[::-1])[::-1]
        slope[p] = -tail[0]
        slope[p + 1 :] = -tail[1:] * np.exp(q[p + 1 :])
        return float(-np.log(mass).sum() + 0.5 * penalty * (q[:p] ** 2).sum()), slope

    loss, slope = loss_and_slope(q)
    damp = 1e-3
    for _ in range(steps):
        curve = np.empty((len(q), len(q)))
        for i in range(len(q)):
            e = np.zeros(len(q))
            e[i] = 1e-5
            curve[i] = (loss_and_slope(q + e)[1] - loss_and_slope(q - e)[1]) / 2e-5
        curve = (curve + curve.T) / 2
        while damp < 1e9:
            step = np.linalg.lstsq(curve + damp * np.eye(len(q)) * max(1.0, np.abs(np.diag(curve)).max()), slope, rcond=None)[0]
            new_loss, new_slope = loss_and_slope(q - step)
            if new_loss <= loss:
                break
            damp *= 10
        gain = loss - new_loss
        if not gain >= 0:
            break
        q, loss, slope, damp = q - step, new_loss, new_slope, max(damp / 10, 1e-9)
        if gain < 1e-8 * (1 + abs(loss)):
            break
    return OrdinalModel(mean, scale, q[:p], cuts_of(q), levels, 0.0)


def rater_error(same: int, pairs: int, levels: int) -> float:
    """Chance that a rater errs, from how many pairs of ratings of one document agree.

    With error rate e spread over the other levels, two raters agree with the chance
    (1 - e)^2 + e^2 / (levels - 1).  One pair of each kind is added, so that it is never
    zero; without pairs it is that of a coin's toss between agreeing and not.
    """
    agree = (same + 1) / (pairs + 2)
    m = max(1, levels - 1)
    a, b, c = 1 + 1 / m, -2.0, 1 - agree
    root = max(0.0, b * b - 4 * a * c) ** 0.5
    return min(max((-b - root) / (2 * a), 1e-6), m / (m + 1) - 1e-6)


def reading_levels(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", language: str = "en", label_id: str = "doc_id", rater: str = "rater", band: str = "band", least_words: int = 40, most_labels: int = 20_000, penalty: float = 1.0
) -> DataFrame:
    """Reading band of each document of one language with enough spoken words.

    Result: doc_id, band (int), score (the expected band, double), n_words, one row per
    document whose ``lang`` equals ``language`` exactly and that has at least ``least_words``
    spoken words.  Null and empty texts have none and don't appear; a null ``lang`` is no
    match.  Of rows with the same id one counts; rows without an id count once per text.  Labels that are null or belong to no
    document are left out; repeated labels of a rater count once.

    The model is fitted on at most ``most_labels`` labels (those with the smallest hash of
    the document id), whose features alone come to the driver; the word counts behind rarity
    cover all documents of the language.  Raters err: a labelled document gets the band that
    model and labels together make most likely, with the error rate of raters that documents
    with two raters show.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    kind = dict(documents.dtypes)[doc_id]
    mine = documents.where(F.col(lang) == language).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    mine = drop_repeats(scratch, mine, ["doc_id"])
    known = spark.sparkContext.broadcast(spoken.learn_adverts(mine))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        facts = _Facts()
        for b in batches:
            n, values, buckets = zip(*(describe(t, facts, known.value) for t in b["text"])) if len(b) else ((), (), ())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": list(n), "features": list(values), "buckets": list(buckets)})

    measured = scratch.table(mine.mapInPandas(measure, f"doc_id {kind}, n_words int, features array<double>, buckets array<int>").where(F.col("n_words") > 0))

    def tally_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for x in b["buckets"]:
                np.add.at(seen, np.asarray(x, dtype=np.int64), 1)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"b": at, "n": seen[at]})

    tallied = measured.select("buckets").mapInPandas(tally_words, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    counts = np.zeros(BUCKETS, dtype=np.float64)
    counts[tallied["b"].to_numpy(np.int64)] = tallied["n"]
    vocabulary = max(1, len(tallied))
    rarity = -np.log((counts + 1) / (counts.sum() + vocabulary))
    shared = spark.sparkContext.broadcast(rarity.astype(np.float32))

    def complete(b: pd.DataFrame) -> np.ndarray:
        rare = shared.value
        size = b["buckets"].map(len).to_numpy()
        each = rare[np.concatenate([np.asarray(x, dtype=np.int64) for x in b["buckets"]])]
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        mean = np.add.reduceat(each, start) / size
        share = np.add.reduceat((each > np.log(20_000)).astype(np.float64), start) / size
        return np.column_stack([np.array(b["features"].tolist()), mean, share])

    def with_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"band": b["band"], "x": list(complete(b))})

    enough = measured.where(F.col("n_words") >= least_words)
    graded = labels.select(F.col(label_id).alias("doc_id"), F.col(rater).alias("rater"), F.col(band).cast("int").alias("band")).dropna(subset=["doc_id", "band"]).distinct()
    sample = graded.orderBy(F.xxhash64("doc_id"), "doc_id", "rater", "band").limit(most_labels)
    train = enough.join(F.broadcast(sample), "doc_id").select("features", "buckets", "band").mapInPandas(with_features, "band int, x array<double>").toPandas()  # at most most_labels rows of features
    if not len(train):
        raise ValueError("no labelled document has enough words")
    model = fit_ordinal(np.array(train["x"].tolist()), train["band"].to_numpy(), penalty)
    rated = graded.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("band").alias("lo"), F.max("band").alias("hi")).where("n = 2")
    pairs = rated.agg(F.count("*").alias("n"), F.count_if(F.col("lo") == F.col("hi")).alias("same")).first()
    model.rater_error = rater_error(pairs["same"], pairs["n"], len(model.levels))
    fitted = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = fitted.value
        for b in batches:
            if len(b):
                yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": b["n_words"], "logs": model.log_probabilities(complete(b)).tolist()})

    scratch.keep_only(measured)
    scored = enough.mapInPandas(predict, f"doc_id {kind}, n_words int, logs array<double>")
    # per document the number of labels of each level
    tally = graded.groupBy("doc_id").agg(*(F.count_if(F.col("band") == int(v)).alias(f"__l{i}") for i, v in enumerate(model.levels)))
    agree = float(np.log(1 - model.rater_error) - np.log(model.rater_error / max(1, len(model.levels) - 1)))
    joint = scored.join(tally, "doc_id", "left")
    logs = [F.col("logs")[i] + F.coalesce(F.col(f"__l{i}"), F.lit(0)) * agree for i in range(len(model.levels))]
    most = F.greatest(*logs)
    weights = [F.exp(x - most) for x in logs]
    choice = F.lit(int(model.levels[-1]))
    for i in range(len(model.levels) - 2, -1, -1):
        choice = F.when(logs[i] == most, int(model.levels[i])).otherwise(choice)
    total, first = weights[0], weights[0] * float(model.levels[0])
    for v, w in zip(model.levels[1:], weights[1:]):
        total, first = total + w, first + w * float(v)
    return joint.select("doc_id", choice.cast("int").alias("band"), (first / total).alias("score"), "n_words")
