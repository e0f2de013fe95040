"""Evaluation passages that leak into a corpus.

A broadcast set of the normalised n-grams of all test items is held against every
token window of every document; the hits are verified word by word along their
diagonal (document position minus item position).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.llm import spoken

#: Word n-grams of the seeds.  Of 15 words with 2 damaged, at least 12 - 2 * 4 = 4 windows stay whole.
SEED_WORDS = 4
#: Characters of item texts that one broadcast index is made from; more are searched in blocks of about this size.
CHARS_PER_BLOCK = 16_000_000
_PRIMES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


def edit_distance_at_most(a: str, b: str, most: int) -> bool:
    """Whether two words differ by at most ``most`` edits."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def is_damaged_form(a: str, b: str) -> bool:
    """Whether two different folded words may be one word with damaged characters.

    Words of 3 characters may have one changed; in shorter ones that mostly makes another
    word (if, of), so that only their skeletons count.
    """
    if spoken.skeleton(a) == spoken.skeleton(b):
        return True
    shorter = min(len(a), len(b))
    if shorter == 3 and len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return shorter >= 4 and edit_distance_at_most(a, b, max(1, shorter // 4))


def passage_spans(state: np.ndarray, least: int, damaged_of: int) -> list[tuple[int, int]]:
    """First and last place of each stretch whose words all belong to a passage.

    ``state`` is 0 where two words agree, 1 where one is a damaged form of the other
    and 2 where they differ; a passage has no 2, at least ``least`` words and at most
    one damaged word in ``damaged_of``.  Passages that overlap come out as one stretch.
    """
    out: list[tuple[int, int]] = []
    start = 0
    for stop in np.append(np.flatnonzero(state == 2), len(state)):
        n = int(stop - start)
        if n >= least:
            # words a to b - 1 have few enough damaged ones where excess[b] <= excess[a]
            excess = damaged_of * np.concatenate(([0], np.cumsum(state[start:stop]))) - np.arange(n + 1)
            lowest = np.minimum.accumulate(excess[::-1])[::-1]
            ends = np.searchsorted(lowest, excess[:-1], side="right") - 1  # the longest passage from each place
            for a in np.flatnonzero(ends - np.arange(n) >= least):
                first, last = int(start + a), int(start + ends[a] - 1)
                if out and first <= out[-1][1]:
                    out[-1] = (out[-1][0], max(last, out[-1][1]))
                else:
                    out.append((first, last))
        start = int(stop) + 1
    return out


@dataclass
class SeedIndex:
    """Normalised n-grams of the items of one block, ready to be broadcast."""

    item_ids: list[int]
    words: list[list[str]]
    least: int
    damaged_of: int
    skeleton_ids: dict[str, int] = field(default_factory=dict)
    exact_ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        keys, items, places = [], [], []
        self.exact: list[np.ndarray] = []
        self.bones: list[np.ndarray] = []
        for k, ws in enumerate(self.words):
            bones = np.array([self.skeleton_ids.setdefault(spoken.skeleton(w), len(self.skeleton_ids)) for w in ws], dtype=np.int64)
            self.exact.append(np.array([self.exact_ids.setdefault(w, len(self.exact_ids)) for w in ws], dtype=np.int64))
            self.bones.append(bones)
            grams = ngram_keys(bones)
            keys.append(grams)
            items.append(np.full(len(grams), k, dtype=np.int64))
            places.append(np.arange(len(grams), dtype=np.int64))
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.item = np.concatenate(items)[order] if items else np.zeros(0, np.int64)
        self.place = np.concatenate(places)[order] if places else np.zeros(0, np.int64)
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)


def ngram_keys(ids: np.ndarray) -> np.ndarray:
    """64-bit keys of all windows of SEED_WORDS ids; verified later, so a collision costs time only."""
    n = len(ids) - SEED_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k, p in enumerate(_PRIMES):
        out ^= (x[k : k + n] * p) * np.uint64(0xFF51AFD7ED558CCD) + (out << np.uint64(5))
    return out


class _Tokens(dict):
    """Token to (skeleton id, exact id), -1 where no item has it; None for no word."""

    def __init__(self, index: SeedIndex):
        super().__init__()
        self.index = index

    def __missing__(self, token: str):
        w = spoken.fold(token)
        got = (self.index.skeleton_ids.get(spoken.skeleton(w), -1), self.index.exact_ids.get(w, -1), w) if w else None
        if len(self) > 500_000:
            self.clear()
        self[token] = got
        return got


def find_leaks(texts: list[str | None], index: SeedIndex, tokens: dict | None = None, adverts: spoken.Adverts = spoken.NO_ADVERTS) -> list[tuple[int, int, int, int]]:
    """(place of the text, place of the item, first word, last word) of every leaked stretch in a batch.

    Word places count the spoken words of the text from 0.  A pair has as many rows as its
    text holds stretches of the item.
    """
    tokens = _Tokens(index) if tokens is None else tokens
    docs, bones, exact_of, bounds = [], [], [], [0]
    for text in texts:
        got = [g for g in map(tokens.__getitem__, spoken.parts(spoken.spoken_text(text, adverts))) if g is not None]
        docs.append(got)
        bones.extend(g[0] for g in got)
        exact_of.extend(g[1] for g in got)
        bones.extend([-1] * SEED_WORDS)  # no window reaches over two documents
        exact_of.extend([-1] * SEED_WORDS)
        bounds.append(len(bones))
    exact_of = np.array(exact_of, dtype=np.int64)
    ids = np.array(bones, dtype=np.int64)
    bounds = np.array(bounds)
    if not len(index.key) or len(ids) < SEED_WORDS:
        return []
    ok = np.ones(len(ids) - SEED_WORDS + 1, bool)
    for k in range(SEED_WORDS):
        ok &= ids[k : k + len(ok)] >= 0
    at = np.flatnonzero(ok)
    keys = ngram_keys(ids)[at]
    slot = np.minimum(np.searchsorted(index.key, keys), len(index.key) - 1)
    hit = index.key[slot] == keys
    at, slot = at[hit], slot[hit]
    if not len(at):
        return []
    n = index.count[slot]
    where = np.repeat(index.first[slot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    at = np.repeat(at, n)
    doc = np.searchsorted(bounds, at, side="right") - 1
    item = index.item[where]
    diagonal = at - bounds[doc] - index.place[where]
    pairs, seeds = np.unique(np.stack([doc, item, diagonal]), axis=1, return_counts=True)
    # the fewest whole windows that a passage can have, and the most damaged words in its best stretch of least words
    sizes = np.arange(index.least, 2 * index.least + index.damaged_of)
    need = max(1, int(np.min(sizes - SEED_WORDS + 1 - SEED_WORDS * (sizes // index.damaged_of))))
    spared = index.least - int(np.max(sizes[: index.least] // index.damaged_of))
    out: set[tuple[int, int, int, int]] = set()
    for d, k, diag in pairs[:, seeds >= need].T:
        ws = index.words[k]
        lo, hi = max(0, diag), min(len(docs[d]), diag + len(ws))
        if hi - lo < index.least:
            continue
        mine = slice(bounds[d] + lo, bounds[d] + hi)
        alike = ids[mine] == index.bones[k][lo - diag : hi - diag]
        total = np.concatenate(([0], np.cumsum(alike)))
        if (total[index.least :] - total[: -index.least]).max() < spared:
            continue
        same = exact_of[mine] == index.exact[k][lo - diag : hi - diag]
        state = np.where(same, 0, np.where(alike, 1, 2))
        for x in np.flatnonzero(state == 2):
            if is_damaged_form(docs[d][lo + x][2], ws[lo + x - diag]):
                state[x] = 1
        out.update((int(d), int(k), int(lo + a), int(lo + z)) for a, z in passage_spans(state, index.least, index.damaged_of))
    return sorted(out)


def leaked_passages(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", least_words: int = 15, damaged_of: int = 6, chars_per_block: int = CHARS_PER_BLOCK) -> DataFrame:
    """Documents that hold a passage of an evaluation item.

    A passage is at least ``least_words`` consecutive words of an item's text that stand
    as consecutive spoken words in the document, with at most one word in ``damaged_of``
    damaged.  Result: doc_id, item_id, first_word, last_word (in spoken words from 0), one
    row per stretch of passages: a pair has several rows where the document holds the item
    more than once or in parts.

    Null, empty and short texts, on either side, leak nothing; items that share a text are
    all reported; rows of repeated documents and items come once.  Other columns are ignored.

    The index of the items is broadcast.  Its size is bound by ``chars_per_block``: longer
    item texts are searched in blocks, one pass over the documents for each.  Adverts are
    learned from the documents (``spoken.learn_adverts``).
    """
    spark = documents.sparkSession
    ids = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).where(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).distinct()
    blocks = max(1, -(-int(ids.agg(F.sum(F.length("item_text"))).first()[0] or 0) // chars_per_block))
    adverts = spoken.learn_adverts(documents, text)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    out = None
    for k in range(blocks):
        mine = ids.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else ids
        rows = mine.collect()  # about chars_per_block characters
        words = [[w for t in spoken.parts(r.item_text) if (w := spoken.fold(t))] for r in rows]
        keep = [i for i, w in enumerate(words) if len(w) >= least_words]
        shared = spark.sparkContext.broadcast((SeedIndex([rows[i].item_id for i in keep], [words[i] for i in keep], least_words, damaged_of), adverts))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index, adverts = shared.value
            tokens = _Tokens(index)
            for b in batches:
                for lo in range(0, len(b), 500):
                    part = b.iloc[lo : lo + 500]
                    doc_ids = part["doc_id"].to_numpy()
                    found = find_leaks(part["text"].tolist(), index, tokens, adverts)
                    yield pd.DataFrame({"doc_id": [doc_ids[d] for d, *_ in found], "item_id": [index.item_ids[k] for _, k, *_ in found], "first_word": [a for *_, a, _ in found], "last_word": [z for *_, z in found]})

        types = dict(documents.select(F.col(doc_id).alias("d")).dtypes) | dict(ids.dtypes)
        found = docs.mapInPandas(scan, f"doc_id {types['d']}, item_id {types['item_id']}, first_word int, last_word int")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def remove_leaking_documents(documents: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents without those that leak; rows without an id stay."""
    return documents.join(leaks.select(F.col("doc_id").alias("__d")).distinct(), F.col(doc_id) == F.col("__d"), "left_anti")


def blank_leaked_spans(documents: DataFrame, leaks: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "clean_text") -> DataFrame:
    """Leaking documents with their text, without the leaked passages, in ``out``.

    Only the passages go, from their first to their last word; cue numbers, times and all
    other text stay as they are, but for encodings and line ends, which are mended.  Only
    documents with a leak are returned: all others need no change.
    """
    spans = leaks.groupBy(F.col("doc_id").alias("__d")).agg(F.collect_set(F.struct("first_word", "last_word")).alias("__spans"))
    kind = dict(documents.dtypes)[text]
    shared = documents.sparkSession.sparkContext.broadcast(spoken.learn_adverts(documents, text))

    @F.pandas_udf(kind)
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        done = []
        for t, s in zip(texts, spans):
            plain, masked = spoken.masked_text(t, shared.value)
            at = spoken.word_spans(masked)
            # a passage over several lines goes line by line, so that what stands between them stays
            gone: list[tuple[int, int]] = []
            for k in sorted({k for x in s for k in range(x["first_word"], x["last_word"] + 1)}):
                if gone and not plain[gone[-1][1] : at[k][0]].strip(" \t"):
                    gone[-1] = (gone[-1][0], at[k][1])
                else:
                    gone.append(at[k])
            kept, end = [], 0
            for first, last in gone:
                if first == 0 or plain[first - 1] == "\n":
                    while plain[last : last + 1] in (" ", "\t"):
                        last += 1
                else:
                    while first > end and plain[first - 1] in " \t":
                        first -= 1
                kept.append(plain[end:first])
                end = last
            done.append("".join(kept) + plain[end:])
        return pd.Series(done)

    return documents.join(spans, F.col(doc_id) == F.col("__d")).withColumn(out, cut(F.col(text), F.col("__spans"))).drop("__d", "__spans")
