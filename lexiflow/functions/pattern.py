"""Word patterns as Column builders: ``glob("*ing") & ~glob("th*").at(-1)``.

A pattern is built from terms with ``&``, ``|`` and ``~``. A term is a spelling
(``*`` any run, ``?`` one letter), the place of the word that it tests (``at``,
counted along the line) and where that word stands (``where``). A word that is
missing matches no term.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiflow.sources.corpus import reached

LONGEST = 160
#: Where a word stands: name and test of (line columns, words, position).
PLACES = {
    "li": ("line initial", lambda ws, i: i == 0),
    "lf": ("line final", lambda ws, i: i == F.size(ws) - 1),
    "pi": ("first line of a paragraph", lambda ws, i: F.col("first")),
    "pgi": ("first line of a page", lambda ws, i: F.col("page_first")),
    "lpi": ("first line of a later paragraph", lambda ws, i: F.col("first") & ~F.col("page_first")),
    "npi": ("line within a paragraph", lambda ws, i: ~F.col("first")),
}


class Node:
    def __and__(self, other: Node) -> Node:
        return Both(self, other, "AND")

    def __or__(self, other: Node) -> Node:
        return Both(self, other, "OR")

    def __invert__(self) -> Node:
        return Not(self)


def like(word: Column, spelling: str) -> Column:
    """Whole-word glob; null words do not match."""
    escaped = "".join("%" if c == "*" else "_" if c == "?" else "\\" + c if c in "%_\\" else c for c in spelling)
    return F.coalesce(word.like(escaped), F.lit(False))


@dataclass(frozen=True)
class Term(Node):
    spelling: str = "*"
    offset: int = 0
    places: tuple[str, ...] = ()

    def at(self, offset: int) -> Term:
        return replace(self, offset=offset)

    def where(self, *places: str) -> Term:
        unknown = [p for p in places if p.removeprefix("!") not in PLACES]
        if unknown:
            raise ValueError(f"unknown place {unknown}")
        return replace(self, places=(*self.places, *places))

    def test(self, words: Column, i: Column) -> Column:
        out = like(reached(words, i, self.offset), self.spelling)
        for p in self.places:
            stands = PLACES[p.removeprefix("!")][1](words, i + self.offset)
            out = out & (~stands if p.startswith("!") else stands)
        return out

    def terms(self):
        return [self]

    def base(self) -> Node | None:
        return replace(self, spelling="*") if self.places else None

    def __str__(self) -> str:
        return f"{self.offset}:" * bool(self.offset) + "".join(f"[{p}]" for p in self.places) + self.spelling


@dataclass(frozen=True)
class Not(Node):
    a: Node

    def test(self, words, i):
        return ~self.a.test(words, i)

    def terms(self):
        return self.a.terms()

    def base(self):
        return self if all(t.places and t.spelling == "*" for t in self.terms()) else None

    def __str__(self):
        return f"NOT ({self.a})"


@dataclass(frozen=True)
class Both(Node):
    a: Node
    b: Node
    op: str

    def test(self, words, i):
        a, b = self.a.test(words, i), self.b.test(words, i)
        return a & b if self.op == "AND" else a | b

    def terms(self):
        return self.a.terms() + self.b.terms()

    def base(self):
        """Places only: both sides' for AND (or the one there is), both or none for OR."""
        a, b = self.a.base(), self.b.base()
        if self.op == "AND":
            return Both(a, b, "AND") if a and b else a or b
        return Both(a, b, "OR") if a and b else None

    def __str__(self):
        inner = lambda n: f"({n})" if isinstance(n, Both) and n.op != self.op else str(n)
        return f"{inner(self.a)} {self.op} {inner(self.b)}"


def glob(spelling: str) -> Term:
    if len(spelling) > LONGEST:
        raise ValueError(f"patterns have at most {LONGEST} characters")
    return Term(spelling)


def literal_word(node: Node) -> str:
    """The one spelling that a pattern names, or an empty string."""
    one = isinstance(node, Term) and not node.offset and not node.places and not set("*?") & set(node.spelling)
    return node.spelling if one else ""


def places_used(node: Node) -> list[str]:
    return list(dict.fromkeys(p for t in node.terms() for p in t.places))


def matcher(node: Node):
    """A function of (words, position) for ``tokens(rows, name=matcher(node))``."""
    return lambda words, i: node.test(words, i)


def rate_base(node: Node | None):
    """Matcher of the words that a pattern's places allow; all words where it names none."""
    base = node.base() if node is not None else None
    return (lambda words, i: F.lit(True)) if base is None else matcher(base)
