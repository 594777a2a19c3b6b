"""Queries: staged accounts of three populations, exchanges, residuals and unexplained families."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.functions import words as W
from lexiflow.operators import graph, stages
from lexiflow.operators import rates as rate_ops
from lexiflow.plans.base import query, r6
from lexiflow.plans.rules import MENU, edges
from lexiflow.plans.search import bag

#: The exchange of the queries: each a for o and each o for a.
SWAP = ("ao", "oa")


def swap(c):
    return F.translate(c, *SWAP)


def counts(spark, d, sheets=False):
    """(word, a, m, b): merged words of the English sources of number 0, 1 and 2 modulo 3, with rates; with ``sheets`` also sheets_a and sheets_b, distinct sheets."""
    part = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int") % 3
    t = bag(spark, d, keep=(), lang="en", part=part).withColumn("word", W.merged(F.col("word"))).filter("word <> '' and part is not null")
    per = rate_ops.word_counts(t, "part")
    if sheets:
        per = t.groupBy("part", "word", "sheet").agg(F.count("*").alias("n")).groupBy("part", "word").agg(F.sum("n").alias("n"), F.count("*").alias("sheets"))
    r = rate_ops.rates(graph.settled(per), "part")
    at = lambda i, c, zero: F.coalesce(F.max(F.when(F.col("part") == i, F.col(c))), F.lit(zero))
    more = [at(0, "sheets", 0).alias("sheets_a"), at(2, "sheets", 0).alias("sheets_b")] if sheets else []
    return graph.settled(r.groupBy("word").agg(*[at(i, "rate", 0.0).alias(n) for i, n in enumerate("amb")], *more))


def routes(spark, d):
    """The rule edges, both ways."""
    e = edges(spark, d).select("src", "dst")
    return graph.settled(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())


def rounded(df, *keys):
    return df.select(*keys, *[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


PARTS = MENU + """, pt AS (SELECT CAST(source[4:] AS INT) % 3 AS part, regexp_replace(word, '^q', '') AS word, page // 4 AS sheet FROM tokens WHERE lang = 'en' AND word <> 'q'),
pc AS (SELECT part, word, count(*) AS n, count(DISTINCT sheet) AS sheets FROM pt GROUP BY ALL), pq AS (SELECT *, n * 10000.0 / sum(n) OVER (PARTITION BY part) AS rate FROM pc),
amb AS (SELECT word, coalesce(max(rate) FILTER (part = 0), 0) AS a, coalesce(max(rate) FILTER (part = 1), 0) AS m, coalesce(max(rate) FILTER (part = 2), 0) AS b, coalesce(max(sheets) FILTER (part = 0), 0) AS sheets_a, coalesce(max(sheets) FILTER (part = 2), 0) AS sheets_b FROM pq GROUP BY word)"""


@query("c33_staged_totals")
def c33(spark, d):
    """Totals of the account by mode: mass may go directly, through the middle, or both. Tested against a brute-force maximum."""
    ledger, _ = stages.account(counts(spark, d), routes(spark, d))
    return rounded(stages.account_totals(ledger, "mode"), "mode")


@query("c33_word_ledgers")
def c33b(spark, d):
    """The account's ledger per word, by mode."""
    ledger, _ = stages.account(counts(spark, d), routes(spark, d))
    return rounded(ledger.drop("timing"), "mode", "component", "word")


SAME = " SELECT timing, mode, round(sum(CASE WHEN mode = 'staged' THEN least(x.a, coalesce(t.b, 0), coalesce(u.m, 0)) ELSE least(x.a, coalesce(t.b, 0)) END), 6) AS same, round(sum(least(x.a, x.b)), 6) AS baseline FROM amb x CROSS JOIN (VALUES ('none', 0, 0), ('first', 1, 0), ('second', 0, 1), ('both', 1, 1)) z(timing, f, s) CROSS JOIN (VALUES ('direct'), ('staged'), ('both')) y(mode) LEFT JOIN amb t ON t.word = CASE WHEN f <> s THEN translate(x.word, 'ao', 'oa') ELSE x.word END LEFT JOIN amb u ON u.word = CASE WHEN f = 1 THEN translate(x.word, 'ao', 'oa') ELSE x.word END GROUP BY ALL"


@query("c34_timed_same", PARTS + SAME)
def c34(spark, d):
    """Credit of same spellings, by mode and by the leg on which the exchange takes place."""
    none = routes(spark, d).limit(0)
    ledger, _ = stages.account(counts(spark, d), none, timings=tuple(stages.TIMINGS), swap=swap)
    return rounded(ledger.groupBy("timing", "mode").agg(F.sum("same").alias("same"), F.sum("baseline").alias("baseline")), "timing", "mode")


@query("c34_timed_totals")
def c34b(spark, d):
    """Totals of the account by mode and timing of the exchange, all in one job."""
    ledger, _ = stages.account(counts(spark, d), routes(spark, d), timings=tuple(stages.TIMINGS), swap=swap)
    return rounded(stages.account_totals(ledger, "timing", "mode"), "timing", "mode")


def vowels(word):
    """k, t or kt: the words with an a only, an o only, and both (the letters that the exchange exchanges)."""
    a, o = word.contains("a"), word.contains("o")
    return F.when(a & o, "kt").when(a, "k").when(o, "t")


@query("a43_exchange_by_class")
def a43(spark, d):
    """What an exchange on the first leg gains within each class of words (by their first letter's kind), and into which words credit moves."""
    first = F.substring("word", 1, 1)
    cls = F.when(first.isin("a", "e", "i", "o", "u"), "vowel").when(first.isin("t", "k", "p", "f"), "gallows").otherwise("other")
    rows = counts(spark, d).withColumn("class", cls)
    e = routes(spark, d)
    kind = rows.select("word", "class")
    within = e.join(kind.withColumnsRenamed({"word": "src", "class": "c"}), "src").join(kind.withColumnsRenamed({"word": "dst", "class": "d"}), "dst").filter("c = d").select("src", "dst")
    ledger, _ = stages.account(rows, graph.settled(within), "class", timings=("none", "first"), swap=swap)
    return rounded(stages.exchange_effect(ledger, vowels(F.col("word")), "class", "mode"), "class", "mode", "words")


@query("t3_unexplained_families")
def t3(spark, d):
    """The twelve families of words with most mass missing and left."""
    ledger, _ = stages.account(counts(spark, d), routes(spark, d), modes=("both",))
    return rounded(stages.unexplained(ledger, 12), "component", "lead", "size")


@query("c31_word_residuals")
def c31(spark, d):
    """Words with mass left or missing in a direct account, with their sheets on both sides and whether a route leads out or in."""
    rows, e = counts(spark, d, sheets=True), routes(spark, d)
    ledger, flows = stages.account(rows, e, modes=("direct",))
    out, into = (flows.select(F.col(c).alias("word")).distinct().withColumn(n, F.lit(True)) for c, n in (("src", "route_out"), ("dst", "route_in")))
    left = ledger.filter("left > 1e-8 or missing > 1e-8").select("word", "left", "missing").join(rows.select("word", "sheets_a", "sheets_b"), "word")
    left = left.join(out, "word", "left").join(into, "word", "left").fillna(False, ["route_out", "route_in"])
    return rounded(left, "word")


@query("c31_open_routes", PARTS + ", rt AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge) SELECT x.word, x.sheets_a, x.sheets_b, EXISTS (SELECT 1 FROM rt JOIN amb y ON y.word = rt.dst AND y.b - least(y.a, y.b) > 1e-9 WHERE rt.src = x.word AND x.a - least(x.a, x.b) > 1e-9) AS route_out, EXISTS (SELECT 1 FROM rt JOIN amb y ON y.word = rt.src AND y.a - least(y.a, y.b) > 1e-9 WHERE rt.dst = x.word AND x.b - least(x.a, x.b) > 1e-9) AS route_in FROM amb x WHERE abs(x.a - x.b) > 1e-9")
def c31b(spark, d):
    """Words that lose or gain, with their sheets and whether any route is open to them."""
    rows, e = counts(spark, d, sheets=True), routes(spark, d)
    lose = rows.filter("a - b > 1e-9").select(F.col("word").alias("src"))
    gain = rows.filter("b - a > 1e-9").select(F.col("word").alias("dst"))
    live = e.join(lose, "src", "left_semi").join(gain, "dst", "left_semi")
    out, into = (live.select(F.col(c).alias("word")).distinct().withColumn(n, F.lit(True)) for c, n in (("src", "route_out"), ("dst", "route_in")))
    words = rows.filter("abs(a - b) > 1e-9").select("word", "sheets_a", "sheets_b")
    return words.join(out, "word", "left").join(into, "word", "left").fillna(False, ["route_out", "route_in"])


@query("c16_policy_credits")
def c16(spark, d):
    """Credit of the families that rules and the exchange of o for a make, under policies for exchanges and on both bases, against no exchange."""
    from lexiflow.operators import families, policies

    part = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int") % 2
    t = bag(spark, d, keep=(), lang="en", part=part).withColumn("word", W.merged(F.col("word"))).filter("word <> '' and part is not null")
    r = rate_ops.rates(rate_ops.word_counts(t, "part"), "part")
    at = lambda i, c, zero: F.coalesce(F.max(F.when(F.col("part") == i, F.col(c))), F.lit(zero))
    wide = graph.settled(r.groupBy("word").agg(at(0, "rate", 0.0).alias("a"), at(1, "rate", 0.0).alias("b"), at(0, "n", 0).alias("n_a"), at(1, "n", 0).alias("n_b")))
    rules = routes(spark, d).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(False).alias("exchange"), F.lit(False).alias("after_o"))
    swapped = F.regexp_replace("word", "o", "a")
    pairs = wide.filter("word like '%o%'").select(F.col("word").alias("source"), swapped.alias("target"), F.lit(True).alias("exchange"), F.col("word").rlike("[aeiou]o").alias("after_o"))
    pairs = pairs.join(wide.select(F.col("word").alias("target")), "target", "left_semi")
    every = graph.settled(rules.unionByName(pairs.select(rules.columns)))
    of = graph.settled(graph.components(every.select(F.col("source").alias("src"), F.col("target").alias("dst"))))
    words = graph.settled(wide.join(of, "word").withColumnRenamed("component", "family"))
    owned = graph.settled(every.join(of.select(F.col("word").alias("source"), F.col("component").alias("family")), "source"))
    found = policies.against_none(*policies.solve(words, owned))
    sums = found.groupBy("policy", "basis").agg(*[F.sum(c).alias(c) for c in ("before", "after", "gross_gain", "loss")])
    gains = families.totals(found.select("policy", "basis", "family", "gain"), "policy", "basis")
    return rounded(sums.join(gains, ["policy", "basis"]), "policy", "basis", "positive")
