"""Queries: families of words around a site letter."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.operators import families as fam
from lexiflow.plans.base import query, r6
from lexiflow.plans.search import bag

FAM = """, fw AS (SELECT word, CASE WHEN CAST(source[4:] AS INT) % 2 = 0 THEN 'A' ELSE 'B' END AS pop, count(*) AS n,
  regexp_extract(word, '^([^ao]*)([ao])([^ao]*)$', 1) AS prefix, regexp_extract(word, '^([^ao]*)([ao])([^ao]*)$', 2) AS site, regexp_extract(word, '^([^ao]*)([ao])([^ao]*)$', 3) AS tail
  FROM tokens WHERE lang = 'en' AND regexp_matches(word, '^([^ao]*)([ao])([^ao]*)$') GROUP BY ALL),
pr AS (SELECT prefix, tail, coalesce(sum(n) FILTER (site='a' AND pop='A'), 0) AS k_A, coalesce(sum(n) FILTER (site='o' AND pop='A'), 0) AS t_A, coalesce(sum(n) FILTER (site='a' AND pop='B'), 0) AS k_B, coalesce(sum(n) FILTER (site='o' AND pop='B'), 0) AS t_B FROM fw GROUP BY prefix, tail),
sz AS (SELECT count(*) FILTER (CAST(source[4:] AS INT) % 2 = 0) AS n_a, count(*) FILTER (CAST(source[4:] AS INT) % 2 = 1) AS n_b FROM tokens WHERE lang='en'),
gr AS (SELECT n_a, n_b, (SELECT sum(k_B + t_B) FROM pr) * 10000.0 / n_b / ((SELECT sum(k_A + t_A) FROM pr) * 10000.0 / n_a) AS growth FROM sz),
cl AS (SELECT *, CASE WHEN k_A + t_A < 10 OR k_B + t_B < 10 THEN 'insufficient' WHEN abs(2 * sa - 1) < 0.1 - 1e-9 THEN 'balanced' WHEN abs(sb - 1 + sa) <= 0.1 + 1e-9 AND abs(sb - sa) - abs(sb - 1 + sa) >= 0.1 - 1e-9 THEN 'inverted' WHEN abs(sb - sa) <= 0.1 + 1e-9 AND abs(sb - 1 + sa) - abs(sb - sa) >= 0.1 - 1e-9 THEN 'stable' WHEN (sa - 0.5) * (sb - 0.5) < 0 THEN 'reversal' ELSE 'shift' END AS class
  FROM (SELECT *, k_A * 1.0 / nullif(k_A + t_A, 0) AS sa, k_B * 1.0 / nullif(k_B + t_B, 0) AS sb FROM pr)),
oc0 AS (SELECT prefix, tail, k_A, t_A, k_B, t_B, k_A*10000.0/n_a AS ka, t_A*10000.0/n_a AS ta, k_B*10000.0/n_b AS kb, t_B*10000.0/n_b AS tb, growth FROM pr, gr),
oc1 AS (SELECT *, (abs(kb/growth-ta)+abs(tb/growth-ka))/(ka+ta+kb/growth+tb/growth) AS swap_error, (abs(kb/growth-ka)+abs(tb/growth-ta))/(ka+ta+kb/growth+tb/growth) AS retention_error, (k_A-t_A)*(k_B-t_B) < 0 AS crossing, (abs(kb-tb)-abs(ka-ta))/((ka+ta+kb+tb)/2) AS gc FROM oc0),
oc AS (SELECT *, CASE WHEN crossing AND least(k_A+t_A, k_B+t_B) >= 10 AND abs(k_A*1.0/(k_A+t_A)-0.5) >= 0.05-1e-9 AND swap_error <= 0.15+1e-9 AND swap_error < retention_error-1e-9 THEN 'inversion+' WHEN crossing THEN 'inversion' WHEN abs(gc) <= 0.10+1e-9 THEN 'flat' WHEN gc > 0 THEN 'diverge' ELSE 'converge' END AS outcome FROM oc1)"""


def words(spark, d):
    even = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 0
    return bag(spark, d, keep=("lang", "source"), lang="en", pop=F.when(even, "A").otherwise("B"))


def site(spark, d):
    return fam.site_words(words(spark, d).groupBy("word", "pop").agg(F.count("*").alias("n")))


def pairs(spark, d):
    return fam.shares(site(spark, d), ["prefix", "tail"])


def sizes(spark, d, p):
    total = p.agg(F.sum(F.col("k_A") + F.col("t_A")).alias("fa"), F.sum(F.col("k_B") + F.col("t_B")).alias("fb"))
    n = words(spark, d).agg(F.count_if(F.col("pop") == "A").alias("n_a"), F.count_if(F.col("pop") == "B").alias("n_b"))
    return n.crossJoin(F.broadcast(total)).withColumn("growth", (F.col("fb") * 1e4 / F.col("n_b")) / (F.col("fa") * 1e4 / F.col("n_a")))


def outcome_rows(spark, d):
    p = pairs(spark, d)
    rows = p.crossJoin(F.broadcast(sizes(spark, d, p)))  # one row of totals
    return fam.outcomes(rows, F.col("n_a"), F.col("n_b"), F.col("growth"))


CLASS = fam.pattern_class


@query("a22_c18_family_shares", FAM + " SELECT prefix, tail, k_A AS k_a, t_A AS t_a, k_B AS k_b, t_B AS t_b, round(k_A * 1.0 / nullif(k_A + t_A, 0), 6) AS share_a, round(k_A * 1.0 / nullif(t_A, 0), 6) AS ratio_a FROM pr")
def a22(spark, d):
    return pairs(spark, d).select("prefix", "tail", F.col("k_A").alias("k_a"), F.col("t_A").alias("t_a"), F.col("k_B").alias("k_b"), F.col("t_B").alias("t_b"), r6(fam.share("A")).alias("share_a"), r6(F.try_divide(F.col("k_A") * 1.0, F.col("t_A"))).alias("ratio_a"))


@query("a23_inventory", FAM + " SELECT n_a, n_b, round(growth, 6) AS growth FROM gr")
def a23(spark, d):
    return sizes(spark, d, pairs(spark, d)).select("n_a", "n_b", r6("growth").alias("growth"))


@query("c17_pattern_classes", FAM + " SELECT prefix, tail, class FROM cl WHERE class <> 'insufficient'")
def c17(spark, d):
    return pairs(spark, d).select("prefix", "tail", CLASS(10, 0.1, 0.1, 0.1).alias("class")).filter("class <> 'insufficient'")


@query("a24_class_fractions", FAM + " SELECT class, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS fraction FROM cl GROUP BY class")
def a24(spark, d):
    rows = pairs(spark, d).select(CLASS(10, 0.1, 0.1, 0.1).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("t"))
    return rows.crossJoin(F.broadcast(total)).select("class", "n", r6(F.col("n") / F.col("t")).alias("fraction"))


@query("c19_eligible_groups", FAM + ", e AS (SELECT prefix, bool_or(class <> 'insufficient') AS eligible, count(*) AS groups FROM cl GROUP BY prefix) SELECT prefix, groups FROM e WHERE eligible")
def c19(spark, d):
    rows = pairs(spark, d).select("prefix", (CLASS(10, 0.1, 0.1, 0.1) != "insufficient").alias("e"))
    return rows.groupBy("prefix").agg(F.bool_or("e").alias("eligible"), F.count("*").alias("groups")).filter("eligible").select("prefix", "groups")


@query("c20_f11_outcomes", FAM + " SELECT prefix, tail, outcome, round(swap_error, 6) AS swap_error, round(retention_error, 6) AS retention_error FROM oc")
def c20(spark, d):
    return outcome_rows(spark, d).select("prefix", "tail", "outcome", r6("swap_error").alias("swap_error"), r6("retention_error").alias("retention_error"))


@query("a25_outcome_coverage", FAM + " SELECT coalesce(outcome, 'all') AS outcome, count(*) AS groups, sum(k_A + t_A) AS early, sum(k_B + t_B) AS later FROM oc GROUP BY GROUPING SETS ((outcome), ())")
def a25(spark, d):
    rows = outcome_rows(spark, d).rollup("outcome").agg(F.count("*").alias("groups"), F.sum(F.col("k_A") + F.col("t_A")).alias("early"), F.sum(F.col("k_B") + F.col("t_B")).alias("later"))
    return rows.withColumn("outcome", F.coalesce("outcome", F.lit("all")))


@query("c46_t5_outcome_browser", FAM + " SELECT prefix, tail, outcome, k_A + t_A + k_B + t_B AS volume FROM oc WHERE outcome IN ('inversion', 'diverge') AND k_A + t_A + k_B + t_B >= 20 ORDER BY volume DESC, swap_error NULLS LAST, prefix, tail LIMIT 60")
def c46(spark, d):
    volume = F.col("k_A") + F.col("t_A") + F.col("k_B") + F.col("t_B")
    rows = outcome_rows(spark, d).withColumn("volume", volume).filter("outcome in ('inversion', 'diverge') and volume >= 20")
    return rows.orderBy(F.desc("volume"), F.asc_nulls_last("swap_error"), "prefix", "tail").limit(60).select("prefix", "tail", "outcome", "volume")


@query("c21_family_tree", FAM + " SELECT prefix, tail, site, sum(n) AS n, count(DISTINCT word) AS words FROM fw GROUP BY GROUPING SETS ((), (prefix), (prefix, tail), (prefix, tail, site)) HAVING sum(n) >= 5")
def c21(spark, d):
    rows = site(spark, d).groupBy("prefix", "tail", "site", "word").agg(F.sum("n").alias("n"))
    return rows.rollup("prefix", "tail", "site").agg(F.sum("n").alias("n"), F.count("*").alias("words")).filter("n >= 5")


@query("c48_f14_stem_branches", FAM + ", b AS (SELECT prefix, CASE WHEN tail LIKE '%ing' THEN 'ing' WHEN tail LIKE '%n' THEN 'n' WHEN tail = '' THEN 'bare' ELSE 'other' END AS ending, word FROM fw) SELECT prefix, ending, count(DISTINCT word) AS words FROM b GROUP BY ALL")
def c48(spark, d):
    ending = F.when(F.col("tail").endswith("ing"), "ing").when(F.col("tail").endswith("n"), "n").when(F.col("tail") == "", "bare").otherwise("other")
    return site(spark, d).select("prefix", ending.alias("ending"), "word").distinct().groupBy("prefix", "ending").agg(F.count("*").alias("words"))


@query("u4_absent_counterparts", FAM + ", w AS (SELECT DISTINCT prefix, site, tail FROM fw) SELECT prefix, CASE WHEN site='a' THEN 'o' ELSE 'a' END AS site, tail FROM w EXCEPT SELECT prefix, site, tail FROM w")
def u4(spark, d):
    w = site(spark, d).select("prefix", "site", "tail").distinct()
    return w.withColumn("site", F.when(F.col("site") == "a", "o").otherwise("a")).join(w, ["prefix", "site", "tail"], "left_anti")


@query("s12_partition_check", FAM + " SELECT count(*) AS faults FROM (SELECT word FROM (SELECT DISTINCT word, prefix, tail FROM fw) GROUP BY word HAVING count(*) <> 1)")
def s12(spark, d):
    w = site(spark, d)
    return fam.partition_faults(w.select(F.concat_ws("|", "prefix", "tail").alias("grp"), "word"), w).agg(F.count("*").alias("faults"))


@query("s11_family_gate", FAM + """, w AS (SELECT DISTINCT word, site, prefix || '|' || tail AS family FROM fw), rt AS (SELECT s.word AS source, t.word AS target, s.site AS s, t.site AS t, s.family AS f, t.family AS g FROM w s JOIN w t ON s.family = t.family AND s.site = 'o' AND t.site = 'a'),
ct AS (SELECT w.word, p.pop, coalesce(sum(fw.n), 0) AS n FROM w CROSS JOIN (VALUES ('A'), ('B')) p(pop) LEFT JOIN fw ON fw.word = w.word AND fw.pop = p.pop GROUP BY ALL)
SELECT CAST((SELECT count(*) FROM (SELECT word FROM w GROUP BY word HAVING count(DISTINCT family) > 1)) + (SELECT count(*) FROM ct WHERE n IS NULL OR n < 0) + (SELECT count(*) FILTER (n_a IS NULL OR n_a <= 0) + count(*) FILTER (n_b IS NULL OR n_b <= 0) FROM sz) + (SELECT count(*) FROM rt WHERE f <> g OR s <> 'o' OR t <> 'a' OR source NOT IN (SELECT word FROM w) OR target NOT IN (SELECT word FROM w)) AS INT) AS faults""")
def s11(spark, d):
    """The gate over families with a route from each t word to its k word; every count of either population is given."""
    w = site(spark, d).withColumn("family", F.concat_ws("|", "prefix", "tail")).withColumn("site", F.when(F.col("site") == "a", "k").otherwise("t"))
    full = w.select("family", "word", "site").distinct().withColumn("section", F.explode(F.array(F.lit("A"), F.lit("B"))))
    full = full.join(w.select("word", F.col("pop").alias("section"), "n"), ["word", "section"], "left").fillna(0, ["n"])
    sections = words(spark, d).groupBy(F.col("pop").alias("section")).agg(F.count("*").cast("double").alias("N"))
    s, t = full.filter("site='t'").select("family", F.col("word").alias("source")).distinct(), full.filter("site='k'").select("family", F.col("word").alias("target")).distinct()
    routes = s.join(t, "family").withColumn("exchange", F.lit(True)).withColumn("steps", F.array(F.struct(F.lit("KT").alias("rule"), "source", "target")))
    return fam.family_faults(full, sections, routes).agg(F.count("*").cast("int").alias("faults"))


@query("a26_family_totals", FAM + ", g AS (SELECT prefix || '|' || tail AS family, least(k_A + t_A, k_B + t_B) - least(k_A, k_B) - least(t_A, t_B) AS gain FROM pr), r AS (SELECT gain, row_number() OVER (ORDER BY gain DESC) AS k FROM g) SELECT round(sum(gain), 6) AS gain, count(*) FILTER (gain > 1e-7) AS positive, round(sum(gain) FILTER (k > 1), 6) AS without_largest, round(sum(gain) FILTER (k > 5), 6) AS without_five FROM r")
def a26(spark, d):
    gain = F.least(F.col("k_A") + F.col("t_A"), F.col("k_B") + F.col("t_B")) - F.least("k_A", "k_B") - F.least("t_A", "t_B")
    t = fam.totals(pairs(spark, d).select(F.concat_ws("|", "prefix", "tail").alias("family"), gain.cast("double").alias("gain")))
    return t.select(r6("gain").alias("gain"), "positive", r6("without_largest").alias("without_largest"), r6("without_five").alias("without_five"))


@query("c22_cut_provenance", FAM + ", w AS (SELECT DISTINCT prefix, tail, site, word FROM fw), x AS (SELECT a.prefix, a.word LIKE 'th%' AS s, b.word LIKE 'th%' AS t FROM w a JOIN w b ON a.prefix = b.prefix AND a.tail = b.tail AND a.site = 'o' AND b.site = 'a') SELECT prefix, count(*) FILTER (s AND t) AS internal, count(*) FILTER (s <> t) AS boundary, count(*) AS routes FROM x GROUP BY prefix")
def c22(spark, d):
    """Routes of each family inside a cut (words that begin with th), and over its boundary."""
    w = site(spark, d).select("prefix", "tail", "site", "word").distinct()
    s = w.filter("site='o'").select("prefix", "tail", F.col("word").startswith("th").alias("s"))
    t = w.filter("site='a'").select("prefix", "tail", F.col("word").startswith("th").alias("t"))
    rows = s.join(t, ["prefix", "tail"])
    return rows.groupBy("prefix").agg(F.count_if(F.col("s") & F.col("t")).alias("internal"), F.count_if(F.col("s") != F.col("t")).alias("boundary"), F.count("*").alias("routes"))


@query("a27_flow_rollup", FAM + ", x AS (SELECT CASE WHEN tail LIKE '%ing' THEN 'ing' WHEN tail = '' THEN 'bare' ELSE 'other' END AS level, least(k_A, k_B) + least(t_A, t_B) AS kept, greatest(least(k_A + t_A, k_B + t_B) - least(k_A, k_B) - least(t_A, t_B), 0) AS swap FROM pr) SELECT level, kind, sum(v) AS mass FROM (SELECT level, 'kept' AS kind, kept AS v FROM x UNION ALL SELECT level, 'swap', swap FROM x) GROUP BY level, kind")
def a27(spark, d):
    """Kept and exchanged mass rolled up from families to endings."""
    level = F.when(F.col("tail").endswith("ing"), "ing").when(F.col("tail") == "", "bare").otherwise("other")
    kept = F.least("k_A", "k_B") + F.least("t_A", "t_B")
    swap = F.greatest(F.least(F.col("k_A") + F.col("t_A"), F.col("k_B") + F.col("t_B")) - kept, F.lit(0))
    each = F.explode(F.array(F.struct(F.lit("kept").alias("kind"), kept.alias("v")), F.struct(F.lit("swap").alias("kind"), swap.alias("v")))).alias("e")
    return pairs(spark, d).select(level.alias("level"), each).groupBy("level", "e.kind").agg(F.sum("e.v").alias("mass"))
