"""Parser of the formula and universe languages; formulas are trees of frozen dataclasses."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tesseral.formula.regions import Interval, Region


@dataclass(frozen=True)
class Atom:
    """The frequency of a sample lies in a region."""

    sample: str
    region: Region


@dataclass(frozen=True)
class Change:
    """The variant is (or, not ``positive``, isn't) a substitution that matches two ambiguity codes."""

    ref: str
    alt: str
    positive: bool = True


@dataclass(frozen=True)
class Fold:
    """Comparison of the log2 fold change of two samples' frequencies with a number."""

    a: str
    b: str
    op: str
    value: float


@dataclass(frozen=True)
class Name:
    """A named expression."""

    name: str


@dataclass(frozen=True)
class Constant:
    value: bool


@dataclass(frozen=True)
class Not:
    operand: object


@dataclass(frozen=True)
class And:
    operands: tuple


@dataclass(frozen=True)
class Or:
    operands: tuple


class FormulaError(ValueError):
    """A formula that can't be parsed or resolved."""


#: The tokens of the language.
_TOKENS = re.compile(
    r"""\s*(?:(?P<comment>/\*.*?\*/)
    |(?P<fold>l2fc\s*\()
    |(?P<op><=|>=|==|!=|<|>)
    |(?P<word>[A-Za-z0-9_.\-]+)
    |(?P<mark>[&|!()$:,{}\[\]]))""",
    re.X | re.S,
)
_VAF = re.compile(r"0\.\d+|1\.0")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d*)?(?:[eE][+-]?\d+)?")
IUPAC_CODES = frozenset("ACGTRYSWKMBDHVN")


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text.rstrip()):
            m = _TOKENS.match(text, at)
            if not m:
                raise FormulaError(f"unexpected {text[at:].strip()[:10]!r} in {text!r}")
            if m.lastgroup != "comment":
                self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        i = self.at + ahead
        return self.tokens[i][1] if i < len(self.tokens) else None

    def kind(self, ahead: int = 0) -> str | None:
        i = self.at + ahead
        return self.tokens[i][0] if i < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> str:
        got = self.peek()
        if got is None or (wanted is not None and got != wanted):
            raise FormulaError(f"expected {wanted or 'more'} instead of {got or 'the end'} in {self.text!r}")
        self.at += 1
        return got

    def vaf(self) -> float:
        got = self.take()
        if not _VAF.fullmatch(got):
            raise FormulaError(f"{got!r} is no allele frequency (0.x or 1.0) in {self.text!r}")
        return float(got)

    def region(self) -> Region:
        if self.peek() == "{":
            self.take()
            points = [self.vaf()]
            while self.peek() == ",":
                self.take()
                points.append(self.vaf())
            self.take("}")
            if len(points) < 2:
                raise FormulaError(f"a set needs two frequencies in {self.text!r}")
            return Region.of(points)
        if self.peek() in ("[", "]"):
            left = self.take()
            lo = self.vaf()
            self.take(",")
            hi = self.vaf()
            right = self.take()
            if right not in ("[", "]"):
                raise FormulaError(f"expected a bracket instead of {right!r} in {self.text!r}")
            return Region.of((), [Interval(lo, hi, left == "]", right == "[")])
        return Region.point(self.vaf())

    def done(self) -> None:
        if self.peek() is not None:
            raise FormulaError(f"unexpected {self.peek()!r} in {self.text!r}")

    def formula(self, top: bool):
        """Operands under one operator; & and | don't mix without parentheses."""
        first = self.operand()
        sign = self.peek()
        if sign not in ("&", "|"):
            return first
        operands = [first]
        while self.peek() == sign:
            self.take()
            operands.append(self.operand())
        if self.peek() in ("&", "|"):
            raise FormulaError(f"& and | need parentheses in {self.text!r}")
        return And(tuple(operands)) if sign == "&" else Or(tuple(operands))

    def operand(self):
        got = self.peek()
        if got == "(":
            self.take()
            inner = self.formula(False)
            self.take(")")
            return inner
        if got == "!":
            self.take()
            return Not(self.operand())
        if got == "$":
            self.take()
            return Name(self.take())
        if self.kind() == "fold":
            self.take()
            a = self.take()
            self.take(",")
            b = self.take()
            self.take(")")
            op, value = self.take(), self.take()
            if not _NUMBER.fullmatch(value):
                raise FormulaError(f"{value!r} is no number in {self.text!r}")
            return Fold(a, b, op, float(value))
        if self.kind() != "word":
            raise FormulaError(f"unexpected {got!r} in {self.text!r}")
        word = self.take()
        if self.peek() == ":":
            self.take()
            return Atom(word, self.region())
        if self.kind() == "op":
            op, other = self.take(), self.take()
            if op == ">" and word in IUPAC_CODES and other in IUPAC_CODES:
                return Change(word, other)
            return Fold(word, other, op, 0.0)
        if word in ("true", "false"):
            return Constant(word == "true")
        raise FormulaError(f"unexpected {word!r} in {self.text!r}")


def parse_formula(text: str):
    """The tree of a formula."""
    r = _Reader(str(text))
    out = r.formula(True)
    r.done()
    return out


def parse_universe(text: str) -> Region:
    """The region of a universe: frequencies, ranges and sets parted by ``|``."""
    r = _Reader(str(text))
    out = r.region()
    while r.peek() == "|":
        r.take()
        out = out | r.region()
    r.done()
    return out
