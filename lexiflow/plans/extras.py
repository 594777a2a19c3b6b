"""Queries: odds contrasts of two strata, labels and residual tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.functions import words as W
from lexiflow.operators import exact
from lexiflow.plans.base import query, r6
from lexiflow.plans.search import first_lines, pair, toks
from lexiflow.sources import corpus as C


ODDS = """, t AS (SELECT lang, word, count(*) FILTER (first) AS h1, count(*) AS h FROM tokens WHERE lang IN ('en','fr') GROUP BY ALL), m AS (SELECT lang, sum(h1)::BIGINT AS n1, sum(h)::BIGINT AS n FROM t GROUP BY lang),
s AS (SELECT * FROM t JOIN m USING (lang)),
v AS (SELECT word, a.h1, a.h, a.n1, a.n, coalesce(b.h, 0) AS g, coalesce(b.n1, 0) AS m1, coalesce(b.n, 0) AS m, a.h1 + coalesce(b.h1, 0) AS tot FROM (SELECT * FROM s WHERE lang = 'en') a LEFT JOIN (SELECT * FROM s WHERE lang = 'fr') b USING (word)
  UNION ALL SELECT word, h1, h, n1, n, 0, 0, 0, h1 FROM s WHERE lang = 'fr' AND word NOT IN (SELECT word FROM s WHERE lang = 'en')),
r AS (SELECT *, greatest(0, h - (n - n1), tot - least(g, m1)) AS lo, least(h, n1, tot - greatest(0, g - (m - m1))) AS hi FROM v),
x AS (SELECT *, unnest(range(lo, hi + 1)) AS k FROM r),
lw AS (SELECT word, h1, k, coalesce(sum(ln((n1 - k + 1)::DOUBLE * (h - k + 1) / (k::DOUBLE * (n - n1 - h + k)) * ((tot - k + 1)::DOUBLE * (m - m1 - g + tot - k + 1)) / ((m1 - tot + k)::DOUBLE * (g - tot + k)))) FILTER (k > lo) OVER (PARTITION BY word ORDER BY k), 0) AS l FROM x),
pk AS (SELECT word, max(l) AS top, max(l) FILTER (k = h1) AS own FROM lw GROUP BY word)"""


@query("c7_equal_odds", ODDS + " SELECT word, round(least(1, sum(exp(l - top)) FILTER (l <= own + 1e-9) / sum(exp(l - top))), 6) AS p FROM lw JOIN pk USING (word) GROUP BY word")
def c7(spark, d):
    """Exact test of all words of two strata (en, fr): equal odds of standing in first lines."""
    rows = first_lines(spark, d).filter("lang in ('en','fr')").withColumnRenamed("lang", "stratum")
    return exact.equal_odds(rows, "word").select("word", r6("p").alias("p"))


@query("f6_evaluation_keys", "SELECT lang, CASE WHEN lang IN ('en','fr') THEN '1' ELSE '2' END AS split, '1' AS fit, '2' AS test FROM (SELECT DISTINCT lang FROM documents)", base=False)
def f6(spark, d):
    key = F.concat(F.when(F.col("lang").isin("en", "fr"), "A").otherwise("B"), F.lit("|fit1_eval2|merged"))
    split, fit, test = W.evaluation_key(key)
    return C.table(spark, d, "documents").select("lang").distinct().select("lang", split.alias("split"), fit.alias("fit"), test.alias("test"))


@query("f10_evidence_labels", "SELECT word, CASE WHEN length(word) < 3 THEN 'short form' WHEN n * 1.0 / t < 0.25 THEN 'diffuse' WHEN n * 2.0 / t - 1 < 0.05 THEN 'near tie' ELSE 'clear' END AS label FROM (SELECT word, max(n) AS n, sum(n) AS t FROM wc GROUP BY word) WHERE t >= 5")
def f10(spark, d):
    c = toks(spark, d).groupBy("lang", "word").agg(F.count("*").alias("n")).groupBy("word").agg(F.max("n").alias("n"), F.sum("n").alias("t")).filter("t >= 5")
    return c.select("word", W.evidence_label(F.length("word"), F.col("n") / F.col("t"), F.col("n") * 2.0 / F.col("t") - 1).alias("label"))


PAIR = ", ab AS (SELECT coalesce(x.word, y.word) AS word, coalesce(x.rate, 0) AS a, coalesce(y.rate, 0) AS b FROM (SELECT * FROM wr WHERE lang = 'en') x FULL JOIN (SELECT * FROM wr WHERE lang = 'fr') y ON x.word = y.word)"


@query("f13_log_domain", PAIR + " SELECT round(log10(min(least(a, b))), 6) AS low, round(log10(max(greatest(a, b))), 6) AS high FROM ab WHERE a > 0 AND b > 0")
def f13(spark, d):
    both = pair(spark, d).filter("a > 0 and b > 0")
    return both.agg(r6(F.log10(F.min(F.least("a", "b")))).alias("low"), r6(F.log10(F.max(F.greatest("a", "b")))).alias("high"))


@query("s8_t3_t4_residual_export", PAIR + " SELECT word, round(a, 6) AS a, round(b, 6) AS b, round(greatest(b - a, 0) + greatest(a - b, 0), 6) AS residual FROM ab ORDER BY round(abs(a - b), 6) DESC, word LIMIT 60")
def s8(spark, d):
    rows = pair(spark, d).select("word", r6("a").alias("a"), r6("b").alias("b"), r6(F.abs(F.col("a") - F.col("b"))).alias("residual"))
    return rows.orderBy(F.desc("residual"), "word").limit(60)
