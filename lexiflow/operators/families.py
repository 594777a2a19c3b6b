"""Word families that differ in one site letter: shares, outcomes and checks.

A family is the words with one prefix and tail around a site letter; k and t
name the two site letters' counts, whatever the letters are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions.words import bounded_residual
from lexiflow.operators.rates import PER

EPS = 1e-9


def site_words(words: DataFrame, k: str = "a", t: str = "o") -> DataFrame:
    """With prefix, site and tail of words that hold exactly one of the site letters."""
    pattern = f"^([^{k}{t}]*)([{k}{t}])([^{k}{t}]*)$"
    take = lambda i: F.regexp_extract("word", pattern, i)
    return words.filter(F.col("word").rlike(pattern)).select("*", take(1).alias("prefix"), take(2).alias("site"), take(3).alias("tail"))


def shares(rows: DataFrame, by: list[str], k: str = "a", populations: tuple[str, str] = ("A", "B")) -> DataFrame:
    """Counts k and t of each population (columns site, pop, n): k_A, t_A, k_B, t_B."""
    one = lambda site, p: F.coalesce(F.sum(F.when((F.col("site") == k if site else F.col("site") != k) & (F.col("pop") == p), F.col("n"))), F.lit(0))
    return rows.groupBy(*by).agg(*[one(s, p).alias(f"{'k' if s else 't'}_{q}") for p, q in zip(populations, ("A", "B"), strict=True) for s in (True, False)])


def share(p: str) -> Column:
    return F.try_divide(F.col(f"k_{p}") * 1.0, F.col(f"k_{p}") + F.col(f"t_{p}"))


def pattern_class(minimum: int, closeness: float, advantage: float, balance: float) -> Column:
    """stable, inverted, reversal, shift, balanced or insufficient, of two populations' k shares."""
    a, b = share("A"), share("B")
    same, mirror = F.abs(b - a), F.abs(b - (1 - a))
    enough = (F.col("k_A") + F.col("t_A") >= minimum) & (F.col("k_B") + F.col("t_B") >= minimum) & a.isNotNull() & b.isNotNull()
    crosses = ((a < 0.5) & (b > 0.5)) | ((a > 0.5) & (b < 0.5))
    return (
        F.when(~enough, "insufficient")
        .when(F.abs(2 * a - 1) < balance - EPS, "balanced")
        .when((mirror <= closeness + EPS) & (same - mirror >= advantage - EPS), "inverted")
        .when((same <= closeness + EPS) & (mirror - same >= advantage - EPS), "stable")
        .when(crosses, "reversal")
        .otherwise("shift")
    )


def outcomes(rows: DataFrame, n_a: Column, n_b: Column, growth: Column, minimum: int = 10, flat: float = 0.10, swap: float = 0.15) -> DataFrame:
    """Adds outcome, swap_error, retention_error and growth_ratio to rows with k_A, t_A, k_B, t_B.

    Rates are per PER; ``growth`` is how much all families grew, by which the
    second population's rates are divided before they are compared.
    """
    rate = lambda c, n: F.col(c) * PER / n
    ka, ta, kb, tb = rate("k_A", n_a), rate("t_A", n_a), rate("k_B", n_b), rate("t_B", n_b)
    c, d = kb / growth, tb / growth
    total = ka + ta + c + d
    swap_error = F.try_divide(F.abs(c - ta) + F.abs(d - ka), total)
    keep_error = F.try_divide(F.abs(c - ka) + F.abs(d - ta), total)
    crossing = (F.col("k_A") - F.col("t_A")) * (F.col("k_B") - F.col("t_B")) < 0
    mean = (ka + ta + kb + tb) / 2
    gap_change = F.try_divide(F.abs(kb - tb) - F.abs(ka - ta), mean)
    quality = (F.least(F.col("k_A") + F.col("t_A"), F.col("k_B") + F.col("t_B")) >= F.greatest(F.lit(10), F.lit(minimum))) & (F.abs(share("A") - 0.5) >= 0.05 - EPS)
    plus = crossing & quality & (swap_error <= swap + EPS) & (swap_error < keep_error - EPS)
    outcome = (
        F.when(plus, "inversion+")
        .when(crossing, "inversion")
        .when(gap_change.isNull() | (F.abs(gap_change) <= flat + EPS), "flat")
        .when(gap_change > 0, "diverge")
        .otherwise("converge")
    )
    return rows.select("*", outcome.alias("outcome"), swap_error.alias("swap_error"), keep_error.alias("retention_error"), F.try_divide(kb + tb, growth * (ka + ta)).alias("growth_ratio"), bounded_residual(c, ta).alias("reciprocal"))


# Checks: each returns the offending rows with a reason, none if all is well.


def family_faults(words: DataFrame, sections: DataFrame, routes: DataFrame) -> DataFrame:
    """words (family, word, section, n, site), sections (section, N), routes (family, source, target, exchange, steps)."""
    why = lambda df, what, detail: df.select(F.lit(what).alias("reason"), detail.alias("detail"))
    owner = words.select("family", "word").distinct()
    twice = owner.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = sections.filter("N is null or N <= 0 or isnan(N)")
    need = owner.crossJoin(F.broadcast(sections.select("section")))  # a handful of sections
    missing = need.join(words.filter("n is not null and n >= 0"), ["family", "word", "section"], "left_anti")
    ends = routes.select("family", F.explode(F.array("source", "target")).alias("word"))
    outside = ends.join(owner, ["family", "word"], "left_anti")
    links = F.zip_with(F.slice("steps", F.lit(1), F.greatest(F.size("steps") - 1, F.lit(0))), F.slice("steps", F.lit(2), F.greatest(F.size("steps") - 1, F.lit(0))), lambda a, b: a["target"] == b["source"])
    whole = F.forall(links, lambda x: x) & (F.element_at("steps", 1)["source"] == F.col("source")) & (F.element_at("steps", -1)["target"] == F.col("target"))
    broken = routes.filter((F.size("steps") > 0) & ~whole)
    site = words.select("family", "word", "site").distinct()
    sided = routes.filter("exchange").join(site.select("family", F.col("word").alias("source"), F.col("site").alias("s")), ["family", "source"]).join(site.select("family", F.col("word").alias("target"), F.col("site").alias("t")), ["family", "target"])
    wrong = sided.filter("not (s = 't' and t = 'k')")
    parts = [
        why(twice, "word in two families", F.col("word")),
        why(sizes, "section without a size", F.col("section")),
        why(missing, "count missing", F.concat_ws("/", "word", "section")),
        why(outside, "route outside its family", F.col("word")),
        why(broken, "broken trace", F.concat_ws(">", "source", "target")),
        why(wrong, "exchange direction", F.concat_ws(">", "source", "target")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def partition_faults(members: DataFrame, words: DataFrame) -> DataFrame:
    """Words that no group or several groups hold: members (grp, word), words (word)."""
    n = members.distinct().groupBy("word").agg(F.count("*").alias("groups"))
    return words.select("word").distinct().join(n, "word", "left").fillna(0, ["groups"]).filter("groups <> 1")


def totals(gains: DataFrame, *by: str) -> DataFrame:
    """gain, positive families, and gain without the largest one and five: rows (by, family, gain)."""
    top = F.slice(F.sort_array(F.collect_list("gain"), asc=False), F.lit(1), F.lit(5))
    part = gains.groupBy(*by, F.pmod(F.xxhash64("family"), F.lit(64)).alias("part")).agg(F.sum("gain").alias("gain"), F.count_if(F.col("gain") > 1e-7).alias("positive"), top.alias("top"))
    best = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), F.lit(1), F.lit(5))
    out = part.groupBy(*by).agg(F.sum("gain").alias("gain"), F.sum("positive").alias("positive"), best.alias("top"))
    five = F.aggregate("top", F.lit(0.0), lambda s, x: s + x)
    return out.select(*by, "gain", "positive", (F.col("gain") - F.get("top", F.lit(0))).alias("without_largest"), (F.col("gain") - five).alias("without_five"))
