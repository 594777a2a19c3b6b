"""Expressions on single words and numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gallows, plain ones first, in the order in which labels list them.
GALLOWS = ("t", "k", "p", "f", "cth", "ckh", "cph", "cfh")
#: Confidence tiers, strongest first.
TIERS = ("supported", "provisional", "experimental")


def merged(word: Column) -> Column:
    """Without one initial q."""
    return F.when(word.startswith("q"), F.substring(word, 2, 1 << 30)).otherwise(word)


def stripped(word: Column) -> Column:
    """Without one initial q, but the bare word q stays."""
    return F.when((F.length(word) > 1) & word.startswith("q"), F.substring(word, 2, 1 << 20)).otherwise(word)


def spellings(word: Column) -> Column:
    """The spellings that a merged word stands for."""
    return F.array(word, F.concat(F.lit("q"), word))


def within_edits(word: Column, query: str, most: int = 2) -> Column:
    return F.levenshtein(word, F.lit(query), most) >= 0


def edit(word: Column, kind: str, old: str, new: str) -> Column:
    """The edited word, or null where the rule does not apply."""
    n = len(old)
    if kind == "exact":
        return F.when(word == old, F.lit(new))
    if kind == "prefix":
        return F.when(word.startswith(old), F.concat(F.lit(new), F.substring(word, n + 1, 1 << 20)))
    if kind == "suffix":
        return F.when(word.endswith(old), F.concat(F.substring(word, F.lit(1), F.length(word) - n), F.lit(new)))
    if kind == "contains":
        at = F.instr(word, old)
        return F.when(at > 0, F.concat(F.substring(word, F.lit(1), at - 1), F.lit(new), F.substring(word, at + n, F.lit(1 << 20))))
    raise ValueError(f"unknown kind {kind}")


def prev_class(word: Column) -> Column:
    """Ending class of the word before."""
    out = F.when(word.isNull(), "boundary / unreadable")
    for end, label in (("ol", "-ol"), ("or", "-or"), ("l", "-l (other)"), ("r", "-r (other)"), ("y", "-y")):
        out = out.when(word.endswith(end), label)
    return out.otherwise("other")


def next_class(word: Column) -> Column:
    """Beginning class of the word after."""
    return F.when(word.isNull(), "boundary / unreadable").otherwise(F.concat(F.regexp_extract(word, "^(ckh|cth|cph|cfh|ch|sh|.)", 1), F.lit("-")))


def gallows_class(word: Column) -> Column:
    """Kinds of gallows in a word in a fixed order, joined by plus signs."""
    found = F.array_distinct(F.regexp_extract_all(word, F.lit("(cth|ckh|cph|cfh|[tkpf])"), F.lit(1)))
    labels = [F.when(F.array_contains(found, g), F.lit(g.upper() if len(g) == 1 else g[0] + g[1].upper() + g[2])) for g in GALLOWS]
    return F.when(word.isNull(), "boundary / unreadable").otherwise(F.coalesce(F.nullif(F.concat_ws(" + ", *labels), F.lit("")), F.lit("none")))


def swapped(word: Column, a: str = "k", b: str = "t") -> Column:
    """Plain a and b exchanged; letters within compound gallows stay. Its own inverse."""
    held = F.regexp_replace(word, f"c{a}h", "\u0001")
    held = F.regexp_replace(held, f"c{b}h", "\u0002")
    out = F.translate(held, a + b, b + a)
    return F.regexp_replace(F.regexp_replace(out, "\u0001", f"c{a}h"), "\u0002", f"c{b}h")


def count_class(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 4, "2-4").when(n <= 9, "5-9").otherwise("10+")


def event_class(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 9, "2-9").otherwise("10+")


def tie_weight(cell: Column) -> Column:
    """1 and a thousandth of the first six hex digits of the SHA-256."""
    return 1 + 1e-3 * F.conv(F.substring(F.sha2(cell, 256), 1, 6), 16, 10).cast("double") / float(16**6)


def balance(source: Column, target: Column) -> Column:
    """log2 of target over source: infinite where one side has nothing, null where neither has."""
    return (
        F.when((source == 0) & (target == 0), F.lit(None).cast("double"))
        .when(source == 0, F.lit(float("inf")))
        .when(target == 0, F.lit(float("-inf")))
        .otherwise(F.log2(target / source))
    )


def intensity(rate: Column, most: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.log1p(rate), F.log1p(most)), F.lit(0.0))))


def bounded_residual(actual: Column, expected: Column) -> Column:
    return F.when(actual + expected > 0, (actual - expected) / (actual + expected))


def nice_step(raw: Column) -> Column:
    """The least of 1, 2, 2.5, 5, 10 times a power of ten that is not below ``raw``."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    steps = [F.when(raw <= s * scale * (1 + 1e-9), s * scale) for s in (1.0, 2.0, 2.5, 5.0)]
    return F.coalesce(*steps, 10.0 * scale)


def tier_rank(confidence: Column) -> Column:
    out = F.lit(len(TIERS))
    for i, t in reversed(list(enumerate(TIERS))):
        out = F.when(confidence == t, i).otherwise(out)
    return out


def evidence_label(units: Column, concentration: Column, margin: Column) -> Column:
    return F.when(units < 3, "short form").when(concentration < 0.25, "diffuse").when(margin < 0.05, "near tie").otherwise("clear")


def folio(name: Column) -> list[Column]:
    """leaf, side and panel of a name such as f12r3."""
    take = lambda i: F.regexp_extract(name, r"^f(\d+)([rv])(\d*)$", i)
    return [F.nullif(take(1), F.lit("")).cast("int"), take(2), take(3)]


def evaluation_key(key: Column) -> list[Column]:
    """split, fit and test half of a key such as A|fit1_eval2|merged."""
    take = lambda i: F.regexp_extract(key, r"^([^|]*)\|fit(\d)_eval(\d)", i)
    split = F.when(take(1) == "A", "1").when(take(1) == "B", "2").otherwise(take(1))
    return [split, take(2), take(3)]
