"""Encoding of a corpus with a public byte-level BPE vocabulary.

The encoding of a text is built by a monoid of encoded pieces: leaves are encoded
alone, neighbours are joined by encoding anew a window round their boundary, which
grows until the tokens outside can't change any more.  Long texts are cut in halves
until a piece has at most ``leaf`` characters, so no call of the tokenizer sees more.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter everywhere.
VOCABULARY_FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
#: Fixed value: the public pattern that parts a text before byte pairs are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECE = regex.compile(PATTERN)
LEAF = 4096


@dataclass
class Encoded:
    """The encoding of the stretch [start, end) of a text, as if it stood alone."""

    start: int
    end: int
    ids: np.ndarray


class Encoder:
    """Encoder of one vocabulary; ``encode`` equals encoding the whole text at once."""

    def __init__(self, folder: str = VOCABULARY_FOLDER, vocabulary: str = "byte_bpe_50k", leaf: int = LEAF):
        import tiktoken

        with open(os.path.join(folder, vocabulary + ".tiktoken"), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.leaf = max(8, leaf)
        self._bytes: dict[int, bytes] | None = None

    def _pieces(self, pieces: list[str]) -> list[int]:
        return [i for p in pieces for i in self.core.encode_ordinary(p)]

    def _leaf(self, text: str, start: int, end: int) -> Encoded:
        return Encoded(start, end, np.asarray(self.core.encode_ordinary(text[start:end]), dtype=np.int32))

    def _last_pieces(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """The last three pieces, or more, of the stretch encoded alone: found from a safe place before its end."""
        back = 32
        while True:
            lo = max(start, end - back)
            at = lo
            if lo > start:
                m = _SAFE.search(text, lo, end)
                at = m.end() - 1 if m else -1
            if at >= 0:
                found = [(m.start(), m.end()) for m in _PIECE.finditer(text, at, end)]
                if len(found) > 3 or at == start:
                    return found[1:] if at > start else found
            back *= 4

    def join(self, text: str, a: Encoded, b: Encoded) -> Encoded:
        """Join two neighbours into the encoding of the whole stretch.

        All pieces of ``a`` but its last two end before its end for good: only the last
        can go on over the boundary, and an apostrophe piece before it can become a
        contraction.  From the place before those two the pieces are found anew on the
        joined text, until one ends where a piece of ``b`` ends as well; from there on
        both partings read the same characters and agree.
        """
        if a.start == a.end or b.start == b.end:
            return Encoded(a.start, b.end, np.concatenate([a.ids, b.ids]))
        last = self._last_pieces(text, a.start, a.end)[-2:]
        begin = last[0][0]
        drop_left = len(self._pieces([text[x:y] for x, y in last]))
        own = _PIECE.finditer(text, b.start, b.end)
        own_pieces: list[str] = []
        own_end = b.start
        fresh: list[str] = []
        for m in _PIECE.finditer(text, begin, b.end):
            fresh.append(m.group())
            while own_end < m.end():
                o = next(own)
                own_pieces.append(o.group())
                own_end = o.end()
            if own_end == m.end() and m.end() > b.start:
                break
        drop_right = len(self._pieces(own_pieces))
        return Encoded(a.start, b.end, np.concatenate([a.ids[: len(a.ids) - drop_left], np.asarray(self._pieces(fresh), dtype=np.int32), b.ids[drop_right:]]))

    def _tree(self, text: str, start: int, end: int) -> Encoded:
        if end - start <= self.leaf:
            return self._leaf(text, start, end)
        middle = (start + end) // 2
        return self.join(text, self._tree(text, start, middle), self._tree(text, middle, end))

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a text, without special tokens; none for null and empty texts."""
        if not text:
            return np.zeros(0, np.int32)
        return self._tree(text, 0, len(text)).ids

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids, put together up the same kind of tree."""
        if self._bytes is None:
            self._bytes = {v: k for k, v in self.ranks.items()}
        parts = [self._bytes[int(i)] for i in ids]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0].decode() if parts else ""


#: Where a piece begins in every parting: at what follows a line feed or tab, and at the blank after a letter or number.
_SAFE = regex.compile(r"[\n\t\r]\S|[\p{L}\p{N}] ")
_ENCODERS: dict[tuple, Encoder] = {}


def encoder(folder: str, vocabulary: str, leaf: int) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = (folder, vocabulary, leaf)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(folder, vocabulary, leaf)
    return _ENCODERS[key]


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = VOCABULARY_FOLDER, vocabulary: str = "byte_bpe_50k", leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (array<int>) of every row, by a public vocabulary, without special tokens.

    Null and empty texts give an empty list; every row of the input is in the result,
    also rows with a null or repeated id.  Other columns are ignored.  No shuffle: texts
    are encoded where they are read.
    """
    kind = dict(documents.dtypes)[doc_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, vocabulary, leaf)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [enc.encode(t) for t in b["text"]]})

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, f"doc_id {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", folder: str = VOCABULARY_FOLDER, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """doc_id and text of every row of token ids; a null list gives a null text."""
    kind = dict(encoded.dtypes)[doc_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, vocabulary, LEAF)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [None if x is None else enc.decode(x) for x in b["ids"]]})

    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInPandas(run, f"doc_id {kind}, text string")
