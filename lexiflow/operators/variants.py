"""Spelling variants: site variables, their columns, page relatives and physical neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.operators.ranks import numbered

# Site variables: key -> (pattern over the spaced units of a word, variants that count as new).
# Groups of a pattern: what stays before, the variant, what stays after.
# Units and variants.
_G = "(?:k|t|p|f|ckh|cth|cph|cfh)"
_E = "e{1,4}"
VARIABLES = {
    "DY": (r"^(.*(?:^| )(?:e|ee|eee|ch|sh|o|a)) (d y|y)()$", ("d y",)),
    "GEY": (rf"^(.*(?:^| ){_G}) ((?:{_E} )?y)()$", ("e y", "ee y", "eee y", "eeee y")),
    "GEO": (rf"^((?:(?!{_G}(?: |$))\S+ )*{_G}) ((?:{_E} )?o)( .*)?$", ("e o", "ee o", "eee o", "eeee o")),
    "CHEO": (rf"^((?:(?!(?:ch|sh)(?: |$))\S+ )*(?:ch|sh)) ((?:{_E} )?o)( .*)?$", ("e o", "ee o", "eee o", "eeee o")),
    "KT": (rf"^((?:(?!{_G}(?: |$))\S+ )*)([kt])((?: (?!{_G}(?: |$))\S+)*)$", ("k",)),
    "OA": (r"^((?:.* )?)([oa])( [lr])$", ("a",)),
    "BENCHLIQ": (rf"^()((?:ch |sh )?)((?:{_E} )?o [lr])$", ("",)),
    "D0": (r"^()((?:d )?)(a(?: .*)?)$", ("",)),
    "S3CH": (r"^(.*(?:^| )[kt]) (ch e|ch|ee|e) (y)$", ("e", "ee")),
    "GEDYA": (rf"^(.*(?:^| ){_G}) (e d y|a [lr])()$", ("e d y",)),
    "AIIN": (r"^((?:.* )?a) (i|ii|iii) (n)$", ("i",)),
}


def site_variant(units: Column, key: str) -> dict[str, Column]:
    """variant, family (the rest around the site) and new of a word's spaced units; nulls where the site is absent."""
    pattern, new = VARIABLES[key]
    has = units.rlike(pattern)
    take = lambda i: F.coalesce(F.regexp_extract(units, pattern, i), F.lit(""))
    variant = F.when(has, F.trim(take(2)))
    return {"variant": variant, "family": F.when(has, F.concat(F.trim(take(1)), F.lit(" _ "), F.trim(take(3)))), "new": F.when(has, variant.isin(*new))}


def innovative_share(rows: DataFrame, *by: str) -> DataFrame:
    """eligible and new tokens by count class and in all: rows (by, cls, new, n)."""
    each = rows.select(*by, F.explode(F.array(F.col("cls"), F.lit("all"))).alias("cls"), "new", "n")
    return each.groupBy(*by, "cls").agg(F.sum("n").alias("eligible"), F.sum(F.when(F.col("new"), F.col("n")).otherwise(0)).alias("innovative"))


def _halves(word: str) -> list[tuple]:
    """Keys of which words one edit apart share one: an edit leaves the first or the second half of the shorter word as it is."""
    n = len(word)
    return [(size, first, word[: size // 2] if first else word[n - (size - size // 2) :]) for size in (n, n - 1) for first in (True, False)]


def _one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    at = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return len(b) - len(a) == 1 and a[at:] == b[at + 1 :]


def _nearest(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (kind, locus, idx, words) of a page, focus tokens (kind 0) first: each focus token with its nearest relative."""
    focus, keys, known = [], {}, {}
    for kind, locus, idx, text in rows:
        if kind == 0:
            for key in _halves(text):
                keys.setdefault(key, []).append(len(focus))
            focus.append([locus, idx, text, None])
        elif focus:
            for i, word in enumerate(text.split(" ")):
                near = known.get(word)
                if near is None:
                    some = {n for key in _halves(word) for n in keys.get(key, ())} if word else ()
                    near = known[word] = [focus[n] for n in some if _one_edit(word, focus[n][2])]
                for f in near:
                    found = (abs(locus - f[0]), abs(i - f[1]), word, locus)
                    if f[3] is None or found < f[3]:
                        f[3] = found
    for locus, idx, word, best in focus:
        if best is not None:
            yield locus, idx, word, best[2], best[0], (best[3] > locus) - (best[3] < locus)


def nearest_relative(lines: DataFrame, focus: DataFrame) -> DataFrame:
    """(page, locus, idx, word, relative, distance, side): the nearest other token of the page one edit away, for focus tokens (page, locus, idx, word) of ``lines`` (page, locus, words).

    Lines and focus tokens of a page are brought together once; tokens are
    looked up there by the halves of their words, so neither tokens nor keys
    are shuffled.
    """
    none = F.lit(None).cast("int")
    rows = lines.select("page", F.lit(1).alias("kind"), "locus", none.alias("idx"), F.array_join("words", " ", "").alias("words")).unionByName(focus.select("page", F.lit(0).alias("kind"), "locus", "idx", F.col("word").alias("words")))
    names = ["page", "locus", "idx", "word", "relative", "distance", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
        out = []
        for page, own in groupby(every, key=lambda r: r[0]):
            out += [(page, *found) for found in _nearest(r[1:] for r in own)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    # dealt by a hash: a union's parts may count as dealt by the page already, and then meet in different tasks
    dealt = rows.filter("page is not null").withColumn("dealt", F.xxhash64("page")).repartition("dealt").sortWithinPartitions("page", "kind", "locus", "idx")
    return dealt.drop("dealt").mapInArrow(run, "page long, locus int, idx int, word string, relative string, distance int, side int")


def page_pairs(pages: DataFrame) -> DataFrame:
    """(kind, a, b) of pages (page, leaf, side, sheet): same leaf, facing, next leaf on the same side, same sheet face.

    Each kind is one join on a key that both pages have.
    """
    def pair(kind, left, right):
        a = pages.select(F.col("page").alias("a"), left.alias("k"), "side")
        b = pages.select(F.col("page").alias("b"), right.alias("k"), F.col("side").alias("side_b"))
        return a.join(b, "k").filter("a <> b").select(F.lit(kind).alias("kind"), "a", "b", "side", "side_b")

    leaf, side = F.col("leaf"), F.col("side")
    same_leaf = pair("same leaf", leaf, leaf).filter("a < b")
    facing = pair("facing", leaf, leaf - 1).filter("side = 1 and side_b = 0")
    following = pair("next leaf", leaf, leaf - 1).filter("side = side_b")
    face = pair("same face", F.struct("sheet", side), F.struct("sheet", side)).filter("a < b")
    return same_leaf.unionByName(facing).unionByName(following).unionByName(face).select("kind", "a", "b")


def neighbour_test(pairs: DataFrame, shares: DataFrame, shuffles: int, seed: int = 3) -> DataFrame:
    """(kind, observed, shuffled, pairs): mean absolute difference of shares, and the mean over shuffles of pages within groups.

    shares (page, grp, share). A shuffle deals the shares of a group to its
    pages by the order of a hash.
    """
    each = shares.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(shuffles))))
    mixed = F.when(F.col("draw") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(seed), "draw", "page"))
    ranked = numbered(numbered(each, [F.col("page").asc()], "draw", "grp", name="i"), [mixed.asc(), F.col("page").asc()], "draw", "grp", name="j")
    dealt = ranked.select("draw", "grp", "page", "i").join(ranked.select("draw", "grp", F.col("j").alias("i"), "share"), ["draw", "grp", "i"])
    s = dealt.select("draw", "page", "share")
    a, b = s.select("draw", F.col("page").alias("a"), F.col("share").alias("sa")), s.select("draw", F.col("page").alias("b"), F.col("share").alias("sb"))
    diff = pairs.join(a, "a").join(b, ["draw", "b"]).groupBy("kind", "draw").agg(F.avg(F.abs(F.col("sa") - F.col("sb"))).alias("d"), F.count("*").alias("pairs"))
    return diff.groupBy("kind").agg(F.max(F.when(F.col("draw") == 0, F.col("d"))).alias("observed"), F.avg(F.when(F.col("draw") > 0, F.col("d"))).alias("shuffled"), F.max("pairs").alias("pairs"))
