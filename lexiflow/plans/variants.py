"""Queries: fits, stages, site variants, physical neighbours and copying."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.functions import words as W
from lexiflow.operators import chain, copying, fit, graph, rates, stages, variants
from lexiflow.plans.base import query, r6
from lexiflow.plans.rules import MENU, english, menu
from lexiflow.plans.search import bag, toks
from lexiflow.sources import corpus as C

# Fit: half of the sheets fits, the other half evaluates; populations are even and odd sources of the English text.

HALF = """, cw AS (SELECT (page // 4) % 2 AS half, CASE WHEN CAST(source[4:] AS INT) % 2 = 0 THEN 'A' ELSE 'B' END AS pop, CASE WHEN first THEN 'first' ELSE 'body' END AS cls, word, count(*) AS n FROM tokens WHERE lang='en' GROUP BY ALL),
crr AS (SELECT *, n * 10000.0 / sum(n) OVER (PARTITION BY half, pop, cls) AS rate FROM cw),
hit AS (SELECT src AS word, code AS rule, CASE WHEN src LIKE 'th%' THEN 'th' WHEN src LIKE 'an%' THEN 'an' ELSE 'other' END AS front, dst FROM menu WHERE dst IN (SELECT word FROM ew) AND dst <> src)"""


def class_counts(spark, d):
    even = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 0
    docs = C.table(spark, d, "documents").filter("lang='en'").withColumns({"half": F.floor(F.col("doc_id") / 4) % 2, "pop": F.when(even, "A").otherwise("B")})  # once a document, not a word
    return graph.settled(fit.class_counts(C.tokens(C.lines(docs, "half", "pop")), "half", "pop"))


def hits(spark, d):
    words = english(spark, d)
    m = menu(spark, d).join(words.select(F.col("word").alias("dst")), "dst", "left_semi")
    front = F.when(F.col("src").startswith("th"), "th").when(F.col("src").startswith("an"), "an").otherwise("other")
    return m.select(F.col("src").alias("word"), F.col("code").alias("rule"), front.alias("front"), "dst")


@query("a10_a11_class_rates", MENU + HALF + " SELECT half, pop, cls, word, n, round(rate, 6) AS rate FROM crr WHERE n >= 3")
def a10(spark, d):
    return fit.class_rates(class_counts(spark, d), "half", "pop").filter("n >= 3").select("half", "pop", "cls", "word", "n", r6("rate").alias("rate"))


@query("j16_hits", MENU + HALF + " SELECT word, rule, front, dst FROM hit")
def j16(spark, d):
    return hits(spark, d)


@query("c30_supported_cells", MENU + HALF + ", r AS (SELECT DISTINCT word, rule, front FROM hit), s AS (SELECT rule, front, sum(n) AS support FROM cw JOIN r USING (word) WHERE half=0 AND pop='A' GROUP BY ALL) SELECT rule, front, support, support >= 5 AND front <> 'other' AS own FROM s")
def c30a(spark, d):
    a = class_counts(spark, d).filter("half = 0 and pop = 'A'")
    c = fit.cells(a, hits(spark, d))
    return c.groupBy("rule", "front").agg(F.sum("n").alias("support"), F.first(F.col("cell") == F.concat_ws("|", "rule", "front")).alias("own")).withColumn("own", F.coalesce("own", F.lit(False)) & (F.col("front") != "other"))


THETA = "SELECT rule, front, CASE rule WHEN 'ED_ING' THEN 0.3 WHEN 'ER_ING' THEN 0.2 WHEN 'RE_ER' THEN 0.5 WHEN 'EN_ER' THEN 0.0 ELSE 0.25 END AS theta FROM (SELECT DISTINCT rule, front FROM hit)"
EVAL = f""", th AS ({THETA}), p0 AS (SELECT h.word, h.rule, h.front, h.dst, theta / count(*) OVER (PARTITION BY h.word, h.rule, h.front) AS part FROM hit h JOIN th USING (rule, front) WHERE theta > 0),
p AS (SELECT word, dst, part / greatest(1.0, sum(part) OVER (PARTITION BY word)) AS part FROM p0),
ra AS (SELECT cls, word, rate FROM crr WHERE half=1 AND pop='A'), rb AS (SELECT cls, word, rate AS b FROM crr WHERE half=1 AND pop='B'),
fl AS (SELECT cls, ra.word, dst, rate * part AS m FROM ra JOIN p ON p.word = ra.word), dd AS (SELECT cls, word, sum(d) AS d FROM (SELECT cls, word, -m AS d FROM fl UNION ALL SELECT cls, dst, m FROM fl) GROUP BY ALL),
ev AS (SELECT cls, word, coalesce(rate, 0) AS before, coalesce(rate, 0) + coalesce(d, 0) AS after, coalesce(b, 0) AS b FROM ra FULL JOIN dd USING (cls, word) FULL JOIN rb USING (cls, word))"""


def theta(spark, d):
    value = F.when(F.col("rule") == "ED_ING", 0.3).when(F.col("rule") == "ER_ING", 0.2).when(F.col("rule") == "RE_ER", 0.5).when(F.col("rule") == "EN_ER", 0.0).otherwise(0.25)
    return hits(spark, d).select("rule", "front").distinct().withColumn("theta", value)


def halves(spark, d, half):
    r = fit.class_rates(class_counts(spark, d), "half", "pop").filter(F.col("half") == half)
    return r.filter("pop = 'A'").select("cls", "word", "rate"), r.filter("pop = 'B'").select("cls", "word", "rate")


@query("c30_evaluation", MENU + HALF + EVAL + " SELECT cls, round(sum(least(before, b)), 6) AS before, round(sum(least(after, b)), 6) AS after, round(sum(least(after, b)) - sum(least(before, b)), 6) AS net FROM ev GROUP BY cls")
def c30(spark, d):
    a, b = halves(spark, d, 1)
    out = fit.evaluate(a, b, hits(spark, d), theta(spark, d))
    return out.select("cls", r6("before").alias("before"), r6("after").alias("after"), r6("net").alias("net"))


@query("c30_c32_fit")
def c32(spark, d):
    """Fractions fitted on one half of the sheets, evaluated on the other beside none. The objective is checked in the tests."""
    h = hits(spark, d)
    t = fit.fit_theta(*halves(spark, d, 0), h, steps=4)
    rows = fit.evaluate(*halves(spark, d, 1), h, t)
    return rows.select("cls", r6("before").alias("before"), r6("after").alias("after"), r6("net").alias("net"), (F.col("net") > 0).alias("higher"))


@query("p30_j15_residuals", MENU + HALF + EVAL + ", w AS (SELECT word, sum(before) AS x, sum(after) AS y, sum(b) AS t FROM ev GROUP BY word) SELECT word, round(greatest(y - t, 0), 6) AS surplus, round(greatest(t - y, 0), 6) AS shortfall, word IN (SELECT word FROM hit) AS route FROM w WHERE abs(y - t) >= 10")
def p30(spark, d):
    a, b = halves(spark, d, 1)
    h = hits(spark, d)
    rows = fit.moved(a, h, theta(spark, d)).join(b.withColumnRenamed("rate", "b"), ["cls", "word"], "full_outer").fillna(0.0)
    w = rows.groupBy("word").agg(F.sum("after").alias("y"), F.sum("b").alias("t")).filter("abs(y - t) >= 10")
    w = w.join(h.select("word").distinct().withColumn("route", F.lit(True)), "word", "left")
    return w.select("word", r6(F.greatest(F.col("y") - F.col("t"), F.lit(0.0))).alias("surplus"), r6(F.greatest(F.col("t") - F.col("y"), F.lit(0.0))).alias("shortfall"), F.coalesce("route", F.lit(False)).alias("route"))


# Stages: en through fr to es.

TRIPLE = ", tr AS (SELECT word, coalesce(max(rate) FILTER (lang='en'),0) AS a, coalesce(max(rate) FILTER (lang='fr'),0) AS m, coalesce(max(rate) FILTER (lang='es'),0) AS b FROM wr WHERE lang IN ('en','fr','es') GROUP BY word)"


def triple(spark, d):
    r = rates.rates(rates.word_counts(toks(spark, d), "lang"), "lang")
    at = lambda lang, n: F.coalesce(F.max(F.when(F.col("lang") == lang, F.col("rate"))), F.lit(0.0)).alias(n)
    return r.filter("lang in ('en','fr','es')").groupBy("word").agg(at("en", "a"), at("fr", "m"), at("es", "b"))


@query("c33_c35_same_spelling", TRIPLE + " SELECT round(sum(least(a,b)),6) AS direct, round(sum(least(a,m,b)),6) AS staged, round(sum(least(a,m)),6) AS arrived, round(sum(least(a,m)-least(a,m,b)),6) AS stops FROM tr")
def c33(spark, d):
    s = stages.same_spelling(triple(spark, d))
    return s.agg(*[r6(F.sum(c)).alias(c) for c in ("direct", "staged", "arrived", "stops")])


@query("c33_routed", MENU + TRIPLE + ", l AS (SELECT word, a - least(a,m) AS x FROM tr WHERE a > m), r AS (SELECT word, m - least(a,m) AS x FROM tr WHERE m > a), o AS (SELECT e.dst, r.x AS room, l.x * 1.0 / count(*) OVER (PARTITION BY e.src) AS part FROM (SELECT DISTINCT src, dst FROM menu WHERE dst <> src) e JOIN l ON l.word = e.src JOIN r ON r.word = e.dst) SELECT dst AS word, round(least(max(room), sum(part)), 6) AS routed FROM o GROUP BY dst")
def c33b(spark, d):
    routes = menu(spark, d).select("src", "dst").distinct()
    return stages.routed(triple(spark, d), routes).select("word", r6("routed").alias("routed"))


@query("c34_exchange_timing", "SELECT word, translate(word, 'ao', 'oa') AS at_middle, translate(word, 'ao', 'oa') AS at_target FROM (SELECT DISTINCT word FROM wc WHERE lang = 'es')")
def c34(spark, d):
    words = toks(spark, d).filter("lang='es'").select("word").distinct()
    return stages.timed(words, True, False, lambda c: F.translate(c, "ao", "oa"))


@query("a43_exchange_effect", MENU + ", x AS (SELECT word, n, CASE WHEN word LIKE '%k%' AND word LIKE '%t%' THEN 'both' WHEN word LIKE '%k%' THEN 'k' WHEN word LIKE '%t%' THEN 't' ELSE 'none' END AS class FROM ew) SELECT class, count(*) AS words, sum(n) AS tokens FROM x GROUP BY class")
def a43(spark, d):
    k, t = F.col("word").contains("k"), F.col("word").contains("t")
    cls = F.when(k & t, "both").when(k, "k").when(t, "t").otherwise("none")
    return english(spark, d).groupBy(cls.alias("class")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))


# Site variants

VOWELS = ", sv AS (SELECT page, sheet, locus, source, word, count(*) OVER (PARTITION BY word) AS total, regexp_extract(word, '^(.*)([ao])([lr])$', 1) || ' _ ' || regexp_extract(word, '^(.*)([ao])([lr])$', 3) AS fam, regexp_extract(word, '^(.*)([ao])([lr])$', 2) = 'a' AS new, idx FROM tokens WHERE lang = 'es' AND regexp_matches(word, '^(.*)([ao])([lr])$'))"


def annotated(spark, d, lang="es"):
    t = toks(spark, d, keep=("lang", "source")).filter(F.col("lang") == lang)
    words = rates.word_counts(t).withColumnRenamed("n", "total")
    v = variants.site_variant(F.array_join(chain.units_of(F.col("word")), " "), "OA")
    known = words.select("word", "total", *[c.alias(n) for n, c in v.items()]).filter("variant is not null")  # once per different word
    return t.join(known, "word")


@query("f3_site_variables", ", u AS (SELECT DISTINCT word, array_to_string(regexp_extract_all(word, '(ckh|cth|cph|cfh|ch|sh|e{1,4}|i{1,4}|.)'), ' ') AS u FROM tokens), v AS (SELECT word, CASE WHEN regexp_matches(u, '^(.*(?:^| )(?:e|ee|eee|ch|sh|o|a)) (d y|y)()$') THEN regexp_extract(u, '^(.*(?:^| )(?:e|ee|eee|ch|sh|o|a)) (d y|y)()$', 2) END AS dy, CASE WHEN regexp_matches(u, '^((?:.* )?)([oa])( [lr])$') THEN regexp_extract(u, '^((?:.* )?)([oa])( [lr])$', 2) END AS oa, CASE WHEN regexp_matches(u, '^()((?:d )?)(a(?: .*)?)$') THEN trim(regexp_extract(u, '^()((?:d )?)(a(?: .*)?)$', 2)) END AS d0, CASE WHEN regexp_matches(u, '^((?:.* )?a) (i|ii|iii) (n)$') THEN regexp_extract(u, '^((?:.* )?a) (i|ii|iii) (n)$', 2) END AS aiin FROM u) SELECT * FROM v WHERE coalesce(dy, oa, d0, aiin) IS NOT NULL")
def f3(spark, d):
    u = bag(spark, d, keep=()).select("word").distinct().select("word", F.array_join(chain.units_of(F.col("word")), " ").alias("u"))
    v = {k.lower(): variants.site_variant(F.col("u"), k)["variant"] for k in ("DY", "OA", "D0", "AIIN")}
    # one pattern tells most words off before any other is tried
    return u.filter(F.col("u").rlike("y$|[lrn]$|^(?:d )?a")).select("word", *[c.alias(n) for n, c in v.items()]).filter("coalesce(dy, oa, d0, aiin) is not null")


@query("f3_all_variables")
def f3b(spark, d):
    """Words, tokens and new variants of all eleven site variables. Checked in the tests by examples."""
    c = rates.word_counts(toks(spark, d)).select("word", "n", F.array_join(chain.units_of(F.col("word")), " ").alias("u"))
    each = F.array(*[F.struct(F.lit(k).alias("variable"), *[v.alias(n) for n, v in variants.site_variant(F.col("u"), k).items()]) for k in variants.VARIABLES])
    rows = c.select("n", F.explode(each).alias("s")).select("n", "s.*").filter("variant is not null")
    return rows.groupBy("variable", "variant").agg(F.count("*").alias("words"), F.sum("n").alias("tokens"), F.max("new").alias("new"))


@query("a36_c36_innovative_share", VOWELS + ", c AS (SELECT source, unnest([CASE WHEN total<=1 THEN '1' WHEN total<=4 THEN '2-4' WHEN total<=9 THEN '5-9' ELSE '10+' END, 'all']) AS cls, new FROM sv) SELECT source, cls, count(*) AS eligible, count(*) FILTER (new) AS innovative FROM c GROUP BY ALL")
def a36(spark, d):
    rows = annotated(spark, d).select("source", W.count_class(F.col("total")).alias("cls"), "new", F.lit(1).alias("n"))
    return variants.innovative_share(rows, "source")


@query("a37_line_shares", VOWELS + " SELECT page, locus, count(*) AS eligible, count(*) FILTER (new) AS innovative FROM sv GROUP BY ALL")
def a37(spark, d):
    return annotated(spark, d).groupBy("page", "locus").agg(F.count("*").alias("eligible"), F.count_if("new").alias("innovative"))


@query("a38_c38_sheet_share", VOWELS + " SELECT sheet, CASE WHEN page % 4 IN (0, 3) THEN 'outer' ELSE 'inner' END AS face, count(*) AS eligible, round(count(*) FILTER (new) * 1.0 / count(*), 6) AS share FROM sv GROUP BY ALL HAVING count(*) >= 3")
def a38(spark, d):
    face = F.when((F.col("page") % 4).isin(0, 3), "outer").otherwise("inner")
    rows = annotated(spark, d).groupBy("sheet", face.alias("face")).agg(F.count("*").alias("eligible"), F.count_if("new").alias("k")).filter("eligible >= 3")
    return rows.select("sheet", "face", "eligible", r6(F.col("k") / F.col("eligible")).alias("share"))


@query("a39_j11_f4_relatives", ", dw AS (SELECT DISTINCT page, word FROM tokens), hx AS (SELECT word FROM tokens GROUP BY word HAVING count(*) = 1), fc AS (SELECT page, locus, idx, word FROM tokens WHERE word IN (SELECT word FROM hx)), rl AS (SELECT a.page, a.word, b.word AS relative FROM fc a JOIN dw b ON a.page = b.page AND a.word <> b.word AND abs(length(a.word) - length(b.word)) <= 1 AND levenshtein(a.word, b.word) = 1), m AS (SELECT f.page, f.locus, f.idx, f.word, min(abs(t.locus - f.locus)) AS distance FROM fc f JOIN rl ON rl.page = f.page AND rl.word = f.word JOIN tokens t ON t.page = f.page AND t.word = rl.relative GROUP BY ALL) SELECT page, locus, idx, word, distance FROM m")
def a39(spark, d):
    """Words that occur once in the whole corpus, in any language, and their nearest relatives."""
    # a word that occurs once is its own first token: no join finds it
    words = toks(spark, d).groupBy("word").agg(F.count("*").alias("total"), F.min(F.struct("page", "locus", "idx")).alias("at"))
    once = words.filter("total = 1").select("at.*", "word")
    return variants.nearest_relative(C.corpus(spark, d), once).select("page", "locus", "idx", "word", "distance")


PAIRS = ", pg AS (SELECT doc_id AS page, doc_id // 2 AS leaf, doc_id % 2 AS side, doc_id // 4 AS sheet FROM documents), pp AS (SELECT 'same leaf' AS kind, a.page AS a, b.page AS b FROM pg a JOIN pg b ON a.leaf = b.leaf AND a.page < b.page UNION ALL SELECT 'facing', a.page, b.page FROM pg a JOIN pg b ON b.leaf - 1 = a.leaf AND a.side = 1 AND b.side = 0 UNION ALL SELECT 'next leaf', a.page, b.page FROM pg a JOIN pg b ON b.leaf - 1 = a.leaf AND a.side = b.side UNION ALL SELECT 'same face', a.page, b.page FROM pg a JOIN pg b ON a.sheet = b.sheet AND a.side = b.side AND a.page < b.page)"


def pages(spark, d):
    p = F.col("page")
    return C.table(spark, d, "documents").select(F.col("doc_id").alias("page")).select("page", F.floor(p / 2).alias("leaf"), (p % 2).alias("side"), F.floor(p / 4).alias("sheet"))


@query("j12_f5_page_pairs", PAIRS + " SELECT kind, a, b FROM pp")
def j12(spark, d):
    return variants.page_pairs(pages(spark, d))


@query("c37_w8_neighbour_test")
def c37(spark, d):
    """Mean difference of a share between physical neighbours, observed and over shuffles."""
    s = toks(spark, d).groupBy("page", F.col("lang").alias("grp")).agg(F.count("*").alias("n"), (F.count_if(F.col("word").endswith("n")) / F.count("*")).alias("share")).filter("n >= 15")
    return variants.neighbour_test(variants.page_pairs(pages(spark, d)), s.select("page", "grp", "share"), 20).select("kind", r6("observed").alias("observed"), r6("shuffled").alias("shuffled"), "pairs")


# Copying

EV = VOWELS + ", e AS (SELECT page, locus AS line, idx, word, fam, new FROM sv), dn AS (SELECT t.page, t.line, t.idx, t.word, t.new, (SELECT count(*) FROM e s WHERE s.page=t.page AND s.fam=t.fam AND s.new<>t.new AND s.line<t.line) AS page_donors, (SELECT count(*) FROM e s WHERE s.page=t.page AND s.fam=t.fam AND s.new<>t.new AND s.line<t.line AND t.line-s.line<=3) AS local3, (SELECT count(*) FROM e s WHERE s.page=t.page AND s.fam=t.fam AND s.new<>t.new AND s.line<t.line AND t.line-s.line<=10) AS local10, (SELECT count(*) FROM e s WHERE s.page=t.page AND s.fam=t.fam AND s.new<>t.new AND s.line<t.line AND CASE WHEN t.line>=3 THEN s.line>=2 ELSE s.line=t.line-1 END) AS usual, (SELECT count(*) FROM e s WHERE s.page=t.page AND s.word=t.word AND (s.line>t.line OR s.line=t.line AND s.idx>t.idx)) AS later FROM e t)"


def events(spark, d):
    return annotated(spark, d).select("page", "family", "word", "new", F.col("locus").cast("long").alias("line"), "idx")


@query("j9_j10_w5_c39_donors", EV + " SELECT page, line, idx, word, page_donors, local3, local10, usual, later FROM dn")
def j9(spark, d):
    return copying.donor_flags(events(spark, d)).select("page", "line", "idx", "word", "page_donors", "local3", "local10", "usual", "later")


@query("a40_copy_stats", EV + " SELECT new, count(*) AS targets, count(*) FILTER (page_donors > 0) AS with_donor, count(*) FILTER (later > 0) AS with_later, sum(page_donors) AS candidate_pairs, sum(later) AS later_pairs FROM dn GROUP BY new")
def a40(spark, d):
    s = copying.copy_stats(copying.donor_flags(events(spark, d)), "new")
    return s.select("new", "targets", F.col("with_page_donors").alias("with_donor"), "with_later", "candidate_pairs", "later_pairs")


@query("a41_a42_stage_shares", VOWELS + ", c AS (SELECT CAST(source[4:] AS INT) // 5 AS stage, unnest([CASE WHEN total<=1 THEN '1' WHEN total<=9 THEN '2-9' ELSE '10+' END, 'all']) AS cls, new FROM sv) SELECT stage, cls, count(*) AS eligible, count(*) FILTER (new) AS innovative FROM c GROUP BY ALL")
def a41(spark, d):
    stage = F.floor(F.regexp_extract("source", r"(\d+)$", 1).cast("int") / 5)
    rows = annotated(spark, d).select(stage.alias("stage"), W.event_class(F.col("total")).alias("cls"), "new", F.lit(1).alias("n"))
    return variants.innovative_share(rows, "stage")


@query("a47_replicates", EV + " SELECT page % 3 AS seed, count(*) AS n, count(*) FILTER (new) AS k, round(count(*) FILTER (new) * 1.0 / count(*), 6) AS share FROM dn GROUP BY seed")
def a47(spark, d):
    rows = events(spark, d).groupBy((F.col("page") % 3).alias("seed")).agg(F.count("*").alias("n"), F.count_if("new").alias("k"))
    return rows.withColumn("share", r6(F.col("k") / F.col("n")))


RUNS = 40
CONTROL = VOWELS + f""", r AS (SELECT unnest(range(0, {RUNS + 1})) AS run), l AS (SELECT DISTINCT page, locus AS line FROM sv),
o AS (SELECT run, page, line, row_number() OVER (PARTITION BY run, page ORDER BY line) AS i, row_number() OVER (PARTITION BY run, page ORDER BY CASE WHEN run > 0 THEN md5(run || ':' || page || ':' || line) ELSE '' END, line) AS j FROM l, r),
mv AS (SELECT a.run, a.page, a.line, b.line AS dest FROM o a JOIN o b ON a.run = b.run AND a.page = b.page AND b.i = a.j),
e AS (SELECT mv.run, mv.page, dest AS line, fam, new, TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) // 5 AS stage FROM sv JOIN mv ON sv.page = mv.page AND sv.locus = mv.line),
dd AS (SELECT run, stage, line > CASE WHEN new THEN min(line) FILTER (NOT new) OVER f ELSE min(line) FILTER (new) OVER f END AS page_donors,
  CASE WHEN new THEN count(*) FILTER (NOT new) OVER f3 ELSE count(*) FILTER (new) OVER f3 END > 0 AS local3, CASE WHEN new THEN count(*) FILTER (NOT new) OVER f10 ELSE count(*) FILTER (new) OVER f10 END > 0 AS local10 FROM e
  WINDOW f AS (PARTITION BY run, page, fam), f3 AS (PARTITION BY run, page, fam ORDER BY line RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), f10 AS (PARTITION BY run, page, fam ORDER BY line RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING)),
c AS (SELECT run, stage, 'page_donors' AS scope, count(*) AS targets, count(*) FILTER (page_donors) AS v FROM dd GROUP BY ALL UNION ALL SELECT run, stage, 'local3', count(*), count(*) FILTER (local3) FROM dd GROUP BY ALL UNION ALL SELECT run, stage, 'local10', count(*), count(*) FILTER (local10) FROM dd GROUP BY ALL),
a AS (SELECT stage, scope, max(targets) AS targets, max(v) FILTER (run = 0) AS observed, avg(v) FILTER (run > 0) AS mean, list_sort(list(v) FILTER (run > 0)) AS vs FROM c GROUP BY ALL)"""


def stage_of(source):
    return F.floor(F.regexp_extract(source, r"(\d+)$", 1).try_cast("int") / 5)


@query("c40_line_order_control", CONTROL + f" SELECT stage, scope, targets, observed, round(mean, 6) AS mean, vs[2] AS low, vs[{RUNS - 1}] AS high, round((1 + len(list_filter(vs, lambda x: x >= observed))) / {RUNS + 1}.0, 6) AS p FROM a")
def c40(spark, d):
    """Targets with an earlier donor per stage and scope, against ``RUNS`` shuffled line orders."""
    e = annotated(spark, d).select("page", "family", "word", "new", F.col("locus").cast("long").alias("line"), "idx", stage_of("source").alias("stage"))
    s = copying.order_control(e, RUNS, "stage")
    return s.select("stage", "scope", "targets", "observed", r6("mean").alias("mean"), "low", "high", r6("p").alias("p"))


SEEDS = 8
DEALT = VOWELS + f""", pg AS (SELECT page, TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) // 5 AS stage, count(*) AS n, count(*) FILTER (new) AS k FROM sv GROUP BY ALL),
sl AS (SELECT stage, row_number() OVER (ORDER BY stage NULLS FIRST, page) AS place FROM pg), r AS (SELECT unnest(range(0, {SEEDS + 1})) AS run),
dl AS (SELECT run, n, k, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN run = 0 THEN stage END NULLS FIRST, CASE WHEN run > 0 THEN md5(run || ':' || page) END, page) AS place FROM pg, r),
tr AS (SELECT run, stage, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, sum(k) * 1.0 / sum(n) AS share FROM dl JOIN sl USING (place) GROUP BY run, stage)"""


def dealt(spark, d):
    pages = annotated(spark, d).groupBy("page", stage_of("source").alias("stage")).agg(F.count("*").alias("n"), F.count_if("new").alias("k"))
    return copying.replicates(pages, SEEDS).withColumn("share", F.col("k") / F.col("n"))


@query("a47_replicate_trajectories", DEALT + " SELECT run, stage, n, k, round(share, 6) AS share FROM tr")
def a47b(spark, d):
    """k of n per seed and stage, seed 0 as observed; the others deal the pages to stages of the same sizes."""
    return dealt(spark, d).select("run", "stage", "n", "k", r6("share").alias("share"))


@query("a47_replicate_spread", DEALT + f", a AS (SELECT stage, max(share) FILTER (run = 0) AS observed, avg(share) FILTER (run > 0) AS mean, list_sort(list(share) FILTER (run > 0)) AS vs FROM tr GROUP BY stage) SELECT stage, round(observed, 6) AS observed, round(mean, 6) AS mean, round(vs[1], 6) AS low, round(vs[{SEEDS}], 6) AS high, round((1 + len(list_filter(vs, lambda x: x >= observed))) / {SEEDS + 1}.0, 6) AS p FROM a")
def a47c(spark, d):
    """The observed share of each stage against the seeds."""
    s = copying.spread(dealt(spark, d), "share", "stage")
    return s.select("stage", *[r6(c).alias(c) for c in ("observed", "mean", "low", "high", "p")])


@query("c41_persistence", EV + ", n AS (SELECT page, fam, line, min(line) OVER (PARTITION BY page, fam) AS s FROM e WHERE new) SELECT page, fam AS family_name, count(*) FILTER (line > s AND line <= s + 3) AS again FROM n GROUP BY page, fam")
def c41(spark, d):
    flat = F.regexp_replace("family", " (?!_)(?<!_ )", "")
    return copying.persistence(events(spark, d)).select("page", flat.alias("family_name"), "again")


LINKS = "SELECT c.conv_id * 1000 + c.turn AS child, p.conv_id * 1000 + p.turn AS parent, c.turn - p.turn AS lag FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1"


@query("j14_c42_parent_links", LINKS, base=False)
def j14(spark, d):
    rows = C.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", F.array(F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parents"))
    links = copying.parent_links(rows, "id", "parents", "turn")
    return links.select("child", "parent", (F.col("child_turn") - F.col("parent_turn")).alias("lag"))


@query("s13_reconciliation", ", e AS (SELECT page, locus, idx, CASE WHEN idx % 7 = 0 THEN 'changed' ELSE word END AS word FROM tokens ), j AS (SELECT CASE WHEN t.word IS NOT DISTINCT FROM e.word THEN 'none' ELSE 'word differs' END AS reason FROM e JOIN tokens t USING (page, locus, idx)) SELECT reason, count(*) AS n FROM j GROUP BY reason")
def s13(spark, d):
    t = toks(spark, d)
    e = t.select("page", "locus", "idx", F.when(F.col("idx") % 7 == 0, "changed").otherwise(F.col("word")).alias("word"))
    return copying.reconcile(e, t).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query("a46_mean_transition", "SELECT lang, round(avg(CASE WHEN prev IS NOT NULL THEN length(word) * 1.0 / length(prev) END), 6) AS mean FROM tokens GROUP BY lang")
def a46(spark, d):
    ratio = F.length("word") / F.length("prev")
    return toks(spark, d, "prev").groupBy("lang").agg(r6(F.avg(F.when(~F.isnan(ratio), ratio))).alias("mean"))


#: Splits of the sheets into a fitted and a held-out half.
SPLITS = ("even", "odd", "early", "late")


def split_counts(spark, d):
    """(split, half, pop, cls, word, n): half 0 is fitted, 1 held out; populations are even and odd English sources."""
    even = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int") % 2 == 0
    docs = C.table(spark, d, "documents").filter("lang='en'").withColumn("pop", F.when(even, "A").otherwise("B"))  # once a document, not a word
    # sheets count only by the four halves that they fall into
    t = C.tokens(C.lines(docs, "pop")).withColumn("sheet", F.col("sheet") % 4)
    t = t.groupBy("sheet", "pop", F.when(F.col("first"), "first").otherwise("body").alias("cls"), "word").agg(F.count("*").alias("n"))
    parity, run = F.col("sheet") % 2, F.floor(F.col("sheet") / 2) % 2
    halves = F.array(*[F.struct(F.lit(s).alias("split"), h.alias("half")) for s, h in zip(SPLITS, (parity, 1 - parity, run, 1 - run), strict=True)])
    rows = t.select("pop", "cls", "word", "n", F.explode(halves).alias("s"))
    return rows.groupBy("s.split", "s.half", "pop", "cls", "word").agg(F.sum("n").alias("n"))


def rule_sets(spark, d):
    """(rules, word, rule, front, dst): hits of all rules, and of the supported ones."""
    from lexiflow.plans.rules import CATALOG

    supported = [c for c, confidence, _, _ in CATALOG if confidence == "supported"]
    names = F.when(F.col("rule").isin(*supported), F.array(F.lit("all"), F.lit("supported"))).otherwise(F.array(F.lit("all")))
    return hits(spark, d).select(F.explode(names).alias("rules"), "word", "rule", "front", "dst")


def fitted(spark, d):
    from lexiflow.operators.graph import settled

    rows, h = settled(fit.blocks(split_counts(spark, d))), settled(rule_sets(spark, d))
    part = lambda half, pop: rows.filter((F.col("half") == half) & (F.col("pop") == pop)).drop("half", "pop")
    theta, values = fit.fit_many(part(0, "A"), part(0, "B"), h)
    return theta, values, fit.evaluate_many(part(1, "A"), part(1, "B"), h, theta)


@query("c32_rule_sets")
def c32b(spark, d):
    """All rules against the supported ones over four splits, fitted in one job and scored on the held-out halves, with the mean and the number of splits higher or lower."""
    out = fit.compare_rules(fitted(spark, d)[2], "all", "supported")
    return out.select("split", *[r6(c).alias(c) for c in ("before", "compared", "active", "difference")], "higher", "lower")


@query("c30_fractions")
def c30b(spark, d):
    """The fitted fraction of each cell, by split and rule set."""
    return fitted(spark, d)[0].select("split", "rules", "cell", r6("theta").alias("theta"))


@query("c30_cells_of_splits", MENU + HALF + """, sp AS (SELECT s.split, word, count(*) AS n FROM tokens, LATERAL (VALUES ('even', (page // 4) % 2), ('odd', 1 - (page // 4) % 2), ('early', (page // 4 // 2) % 2), ('late', 1 - (page // 4 // 2) % 2)) s(split, half) WHERE lang = 'en' AND s.half = 0 AND CAST(source[4:] AS INT) % 2 = 0 GROUP BY ALL),
rs AS (SELECT DISTINCT r.rules, word, rule, front FROM hit, LATERAL (VALUES ('all'), ('supported')) r(rules) WHERE r.rules = 'all' OR rule IN ('ED_ING', 'RE_ER')),
su AS (SELECT split, rules, rule, front, sum(n) AS support FROM sp JOIN rs USING (word) GROUP BY ALL), ow AS (SELECT *, support >= 5 AND front <> 'other' AS own FROM su),
re AS (SELECT split, rules, rule, sum(support) AS rest FROM ow WHERE NOT own GROUP BY ALL)
SELECT split, rules, rule, front, CASE WHEN own THEN rule || '|' || front ELSE rule || '|other' END AS cell FROM ow LEFT JOIN re USING (split, rules, rule) WHERE own OR rest >= 5""")
def c30c(spark, d):
    """Which cell each rule's front is fitted in, by split and rule set."""
    counts = split_counts(spark, d).filter("half = 0 and pop = 'A'").groupBy("split", "word").agg(F.sum("n").alias("n"))
    return fit.environments(counts, rule_sets(spark, d))
