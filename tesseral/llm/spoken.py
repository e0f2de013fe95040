"""Spoken words of subtitle texts.

A subtitle text is a list of cues: a number, a line with start and end time, and
lines of text.  ``spoken_text`` keeps what is said and drops the rest: headers,
cue numbers, times (with damaged arrows too), cue settings, sound descriptions,
markup, adverts, speaker names and leading dashes; it also undoes text that was
decoded with the wrong encoding once or twice.  Adverts are learned from the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CLOCK = r"\d{1,2}:\d\d(?::\d\d)?[.,]\d{3}"
_CUE = re.compile(rf"\n[ \t\ufeff]*(?:\d{{1,7}}[ \t]*\r?\n[ \t]*)?\ufeff?{_CLOCK}[^\n\d]{{1,8}}{_CLOCK}[^\n]*")
_TAG = re.compile(r"</?[A-Za-z][^<>\n\x1e]*>")
_SOUND = re.compile(r"(?=[\[({♪\n（【])(?:\[[^\[\]\x1e]*\]|\([^()\x1e]*\)|\{[^{}\x1e]*\}|♪[^♪\x1e]*♪|\n[ \t]*\*[^*\n\x1e]+\*|♪|（[^（）\x1e]*）|【[^【】\x1e]*】)")
#: A speaker's name in capitals, of at most four words.
_SPEAKER = re.compile(r"\n[ \t\-–—]*[A-Z](?=[A-Z0-9l .'])[A-Z0-9l.']*(?: [A-Z0-9l.']+){0,3}:[ \t]+")
_MOJIBAKE = re.compile(r"[ÂÃâÐÑãåäæçèéï][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]")
#: Code points that the Windows Latin code page puts on bytes 128 to 159.
_CP1252 = {ord(bytes([b]).decode("cp1252", "ignore") or chr(b)): b for b in range(128, 160)}
_TO_BYTES = {**{c: c for c in range(256)}, **_CP1252}
_SPAN = re.compile(r"[\u0080-\u00ff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{2,}")


def _redecode(m: re.Match) -> str:
    s = m.group()
    try:
        return bytes(_TO_BYTES[ord(c)] for c in s).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return s


def mend_encoding(text: str) -> str:
    """Undo UTF-8 read as a one-byte code page, in the spans where that is what happened."""
    for _ in range(3):
        if not _MOJIBAKE.search(text):
            break
        mended = _SPAN.sub(_redecode, text)
        if mended == text:
            break
        text = mended
    return text


def mend(text: str) -> str:
    """A text with its encoding mended and line ends of one kind."""
    if not text.isascii():
        text = mend_encoding(text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text


class Adverts:
    """Learned cue texts that are no speech, with a scan that tells at once when a text has none."""

    def __init__(self, keys: frozenset[str] = frozenset()):
        self.keys = keys
        self._scan = None
        if keys:
            self._scan = ahocorasick.Automaton()
            for k in keys:
                self._scan.add_word(max(k.split(), key=len), True)
            self._scan.make_automaton()

    def __getstate__(self):
        return self.keys

    def __setstate__(self, keys):
        self.__init__(keys)

    def may_hold(self, text: str) -> bool:
        return self._scan is not None and next(self._scan.iter(text.casefold()), None) is not None


NO_ADVERTS = Adverts()
#: A cue text is an advert if it opens or closes at least one in so many documents, ...
ADVERT_DOCUMENTS = 200
#: ... at least so many, and stands there in at least this share of its places.
LEAST_DOCUMENTS, EDGE_SHARE = 8, 0.5
LEAST_WORDS = 3


def cue_key(cue: str) -> str:
    """Folded words of a cue without markup."""
    return " ".join(w for t in parts(_TAG.sub("", cue)) if (w := fold(t)))


def cues_of(text: str) -> list[str]:
    """Cue texts of a mended text, without a header before the first."""
    cues = _CUE.split("\n" + text)
    return cues[1:] if len(cues) > 1 else cues


def learn_adverts(documents: DataFrame, text: str = "text") -> Adverts:
    """Cue texts of at least three words that open or close many documents and seldom stand elsewhere.

    One pass counts the first and last cues of all documents.  A text that stands there in
    one of ``ADVERT_DOCUMENTS`` documents is a candidate, so that there are at most twice
    ``ADVERT_DOCUMENTS`` of them; a second pass counts all places of the candidates.  In a
    corpus too small for ``LEAST_DOCUMENTS`` nothing is learned.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(text).alias("x")).where("x is not null")

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        n = 0
        for b in batches:
            for t in b["x"]:
                n += 1
                cues = cues_of(mend(t))
                for k in {cue_key(cues[0]), cue_key(cues[-1])} if len(cues) > 1 else ():
                    if k.count(" ") >= LEAST_WORDS - 1:
                        seen[k] = seen.get(k, 0) + 1
        yield pd.DataFrame({"k": pd.Series([None, *seen], dtype=object), "n": [n, *seen.values()]})

    counted = texts.mapInPandas(edges, "k string, n bigint").groupBy("k").agg(F.sum("n").alias("n")).cache()
    total = counted.where("k is null").agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_DOCUMENTS, -(-total // ADVERT_DOCUMENTS))
    at_edge = {r["k"]: r["n"] for r in counted.where((F.col("n") >= least) & F.col("k").isNotNull()).collect()}  # at most 2 * ADVERT_DOCUMENTS rows
    counted.unpersist()
    if not at_edge:
        return NO_ADVERTS
    shared = spark.sparkContext.broadcast(Adverts(frozenset(at_edge)))

    def everywhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adverts = shared.value
        seen: dict[str, int] = {}
        for b in batches:
            for t in b["x"]:
                if adverts.may_hold(t):
                    for c in cues_of(mend(t)):
                        if adverts.may_hold(c) and (k := cue_key(c)) in adverts.keys:
                            seen[k] = seen.get(k, 0) + 1
        yield pd.DataFrame({"k": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})

    places = texts.mapInPandas(everywhere, "k string, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()  # at most as many
    return Adverts(frozenset(r["k"] for r in places if at_edge[r["k"]] >= EDGE_SHARE * r["n"]))


def _blank(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def masked_text(text: str | None, adverts: Adverts = NO_ADVERTS) -> tuple[str, str]:
    """A mended text, and the same with all that is not said blanked, character for character.

    Markup becomes DEL characters, which part no word; all else becomes white space.
    """
    if not text:
        return "", ""
    plain = mend(text)
    heads = list(_CUE.finditer("\n" + plain))
    if heads:
        out, at = [], 0
        look = adverts.may_hold(plain)
        for i, m in enumerate(heads):
            start, end = max(m.start() - 1, 0), m.end() - 1
            out.append(" " * (start - at) if i == 0 else _said(plain[at:start], adverts, look))
            out.append("\x1e" + " " * (end - start - 1))
            at = end
        out.append(_said(plain[at:], adverts, look))
        said = "".join(out)
    else:
        said = _said(plain, adverts, adverts.may_hold(plain))
    said = "\n" + said
    if "<" in said:
        said = _TAG.sub(lambda m: "\x7f" * (m.end() - m.start()), said)
    if "(" in said or "[" in said or "♪" in said or "*" in said or "{" in said or "（" in said or "【" in said:
        said = _SOUND.sub(_blank, said)
    if ": " in said:
        said = _SPEAKER.sub(lambda m: "\n" + " " * (m.end() - m.start() - 1), said)
    return plain, said[1:].replace("\x1e", "\n")


def _said(cue: str, adverts: Adverts, look: bool) -> str:
    return " " * len(cue) if look and adverts.may_hold(cue) and cue_key(cue) in adverts.keys else cue


def spoken_text(text: str | None, adverts: Adverts = NO_ADVERTS) -> str:
    """What is said in a subtitle text; cues are parted by line feeds.

    Null, empty and blank texts give a blank string.  A text without any line of times is
    taken as spoken throughout.
    """
    said = masked_text(text, adverts)[1]
    return said.replace("\x7f", "") if "\x7f" in said else said


_KEEP = re.compile(r"[\W_]+")
_PARTS = re.compile(r"[\s\-‐‑‒–—―]+")


def fold(token: str) -> str:
    """A token without case and punctuation; accents stay."""
    return _KEEP.sub("", token.casefold())


#: Characters that optical recognition takes for one another.
_LIKE = {"0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "9": "g", "q": "g", "5": "s", "8": "b", "f": "t", "3": "e", "c": "e", "6": "b", "7": "t", "4": "a", "2": "z", "$": "s", "@": "a", "ß": "b"}
#: Character pairs that are read as one character, and back.
_PAIRS = (("rn", "m"), ("el", "d"), ("vv", "w"), ("ll", "h"))  # as the table above leaves them: "el" is "cl"
_LIKE_TABLE = str.maketrans(_LIKE)
_MARKS = re.compile(r"[\u0300-\u036f]")


def skeleton(token: str) -> str:
    """A token with all characters that are mistaken for one another made equal."""
    s = unicodedata.normalize("NFD", token.casefold())
    s = _MARKS.sub("", s).translate(_LIKE_TABLE)
    s = _KEEP.sub("", s)
    for pair, one in _PAIRS:
        s = s.replace(one, pair)
    return s


_RUN = re.compile(r"[^\s\-‐‑‒–—―]+")


def word_spans(masked: str) -> list[tuple[int, int]]:
    """Start and end of each spoken word in a masked text, in the order and number of ``words``."""
    return [m.span() for m in _RUN.finditer(masked) if fold(m.group())]


def parts(text: str) -> list[str]:
    """Tokens of a text, parted at white space and dashes."""
    return _PARTS.split(text)


def words(text: str | None, adverts: Adverts = NO_ADVERTS) -> list[str]:
    """Folded spoken words of a subtitle text."""
    return [w for t in parts(spoken_text(text, adverts)) if (w := fold(t))]
