"""Queries: sources, rates, patterns, searches and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.functions import words as W
from lexiflow.functions.pattern import glob, matcher, rate_base
from lexiflow.operators import contexts, exact, rates
from lexiflow.plans.base import query, r6
from lexiflow.sources import corpus as C


def toks(spark, d, *wanted, keep=("lang",), **more):
    return C.tokens(C.corpus(spark, d, *keep), *wanted, **more)


def bag(spark, d, keep=("lang",), lang=None, **more):
    """Words without their places, of one language or of all; ``more`` adds columns by expressions of a document, computed before its words are told apart."""
    docs = C.table(spark, d, "documents")
    if lang is not None:
        docs = docs.filter(F.col("lang") == lang)
    return C.bag(docs.withColumns(more) if more else docs, *keep, *more)


def lang_rates(spark, d):
    return rates.rates(rates.word_counts(toks(spark, d), "lang"), "lang")


def pair(spark, d, a="en", b="fr"):
    r = lang_rates(spark, d)
    return rates.side_by_side(r.filter(F.col("lang") == a), r.filter(F.col("lang") == b))


# Sources and sinks


@query("s2_scope_lines", "SELECT role, count(*) AS lines, CAST(sum(len(str_split(coalesce(text,''), chr(10)))) AS BIGINT) AS parts FROM conversations WHERE role IN ('user','assistant') GROUP BY role", base=False)
def s2(spark, d):
    rows = C.in_scope(C.table(spark, d, "conversations"), "running")
    return rows.groupBy("role").agg(F.count("*").alias("lines"), F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).cast("long").alias("parts"))


@query("s1_s3_populations", ", two AS (SELECT [lang, source] AS sections FROM documents UNION ALL SELECT ['role:' || role] FROM conversations) SELECT s AS section, count(*) AS n FROM (SELECT unnest(sections) AS s FROM two) WHERE s IN ('en','src0','role:user') GROUP BY s")
def s1(spark, d):
    docs = C.table(spark, d, "documents").select(F.array("lang", "source").alias("sections"), F.col("doc_id"))
    talk = C.table(spark, d, "conversations").select(F.array(F.concat(F.lit("role:"), "role")).alias("sections"), "turn")
    both = docs.unionByName(talk, allowMissingColumns=True)
    parts = [C.in_population(both, s).select(F.lit(s).alias("section")) for s in ("en", "src0", "role:user")]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("section").agg(F.count("*").alias("n"))


@query("s4_w1_tokens_neighbours", "SELECT page, locus, idx, word, prev2, prev, next FROM tokens")
def s4(spark, d):
    return toks(spark, d, "prev2", "prev", "next").select("page", "locus", "idx", "word", "prev2", "prev", "next")


@query("s5_occurrence_export", "SELECT page, locus, idx, word, CASE WHEN idx = 0 THEN '(line boundary)' ELSE coalesce(words[idx], '(unreadable)') END AS prev_label, CASE WHEN idx + 1 = size THEN '(line boundary)' ELSE coalesce(words[idx + 2], '(unreadable)') END AS next_label FROM tokens WHERE word LIKE 'thr%ing'")
def s5(spark, d):
    return toks(spark, d, "prev_label", "next_label").filter(W.F.col("word").like("thr%ing")).select("page", "locus", "idx", "word", "prev_label", "next_label")


@query("s6_unit_export", "SELECT sheet, array_to_string(list_sort(list_distinct(list(lang))), '; ') AS langs, array_to_string(list_sort(list_distinct(list(source))), '; ') AS sources, count(*) AS tokens FROM tokens GROUP BY sheet")
def s6(spark, d):
    names = lambda c: F.concat_ws("; ", F.array_sort(F.collect_set(c)))
    return toks(spark, d, keep=("lang", "source")).groupBy("sheet").agg(names("lang").alias("langs"), names("source").alias("sources"), F.count("*").alias("tokens"))


@query("s9_tsv_safe", "SELECT doc_id, regexp_replace(text, '[\\t\\r\\n]', ' ', 'g') AS text FROM documents", base=False)
def s9(spark, d):
    return C.tsv_safe(C.table(spark, d, "documents").select("doc_id", "text"))


@query("s10_json_rows", "SELECT word, '{\"lang\":\"' || lang || '\",\"n\":' || n || '}' AS json FROM wc WHERE n >= 20")
def s10(spark, d):
    return rates.word_counts(toks(spark, d), "lang").filter("n >= 20").select("word", F.to_json(F.struct("lang", "n")).alias("json"))


# Counts and rates


@query("a1_word_counts", "SELECT lang, word, n FROM wc")
def a1(spark, d):
    return rates.word_counts(toks(spark, d), "lang")


@query("a2_collapsed_counts", "SELECT lang, word, count(*) AS n FROM tokens WHERE prev IS DISTINCT FROM word GROUP BY ALL")
def a2(spark, d):
    return rates.word_counts(rates.collapsed(toks(spark, d, "prev")), "lang")


@query("a3_rates", "SELECT lang, word, n, round(rate, 6) AS rate FROM wr")
def a3(spark, d):
    return lang_rates(spark, d).select("lang", "word", "n", r6("rate").alias("rate"))


@query("a4_rate_comparison", ", f AS (SELECT word, count(*) FILTER (first) AS k, count(*) AS n FROM tokens WHERE lang='en' GROUP BY word), t AS (SELECT sum(k) AS kk, sum(n) AS nn FROM f) SELECT word, round(k / kk, 6) AS selected, round(n / nn, 6) AS baseline, round((k / kk) / (n / nn), 6) AS lift, round(k * 10000.0 / nn, 6) AS per10k FROM f, t WHERE n >= 10")
def a4(spark, d):
    rows = toks(spark, d).filter("lang = 'en'").groupBy("word").agg(F.count_if("first").alias("k"), F.count("*").alias("n"))
    totals = rows.agg(F.sum("k").alias("kk"), F.sum("n").alias("nn"))
    r = rates.rate_comparison(F.col("k"), F.col("kk"), F.col("n"), F.col("nn"))
    return rows.filter("n >= 10").crossJoin(F.broadcast(totals)).select("word", *[r6(c).alias(n) for n, c in r.items()])


PAIR = ", ab AS (SELECT coalesce(x.word, y.word) AS word, coalesce(x.rate, 0) AS a, coalesce(y.rate, 0) AS b FROM (SELECT * FROM wr WHERE lang = 'en') x FULL JOIN (SELECT * FROM wr WHERE lang = 'fr') y ON x.word = y.word)"
OVERLAP = " SELECT round(sum(least(a,b)),6) AS overlap, round(sum(greatest(a-b,0)),6) AS surplus, round(sum(greatest(b-a,0)),6) AS shortfall, count(*) AS words FROM ab"


@query("a5_j1_overlap", PAIR + OVERLAP)
def a5(spark, d):
    return rates.overlap(pair(spark, d)).select(r6("overlap").alias("overlap"), r6("surplus").alias("surplus"), r6("shortfall").alias("shortfall"), "words")


@query("t8_most_changed", PAIR + " SELECT word, round(a,6) AS a, round(b,6) AS b, round(abs(a-b),6) AS change FROM ab ORDER BY round(abs(a-b),6) DESC, word LIMIT 40")
def t8(spark, d):
    rows = pair(spark, d).select("word", r6("a").alias("a"), r6("b").alias("b"), r6(F.abs(F.col("a") - F.col("b"))).alias("change"))
    return rows.orderBy(F.desc("change"), "word").limit(40)


@query("p22_frequency_filter", PAIR + " SELECT word, greatest(a,b) >= 5 AS either, least(a,b) >= 5 AS both, a >= 5 AS source, b >= 5 AS target FROM ab WHERE greatest(a,b) >= 5")
def p22(spark, d):
    e, b = F.greatest("a", "b") >= 5, F.least("a", "b") >= 5
    return pair(spark, d).filter(e).select("word", e.alias("either"), b.alias("both"), (F.col("a") >= 5).alias("source"), (F.col("b") >= 5).alias("target"))


@query("u1_u2_u3_word_sets", ", s AS (SELECT word, bool_or(lang='en') AS e, bool_or(lang='fr') AS f FROM wc GROUP BY word) SELECT count(*) FILTER (e OR f) AS either, count(*) FILTER (e AND f) AS both, count(*) FILTER (e AND NOT f) AS only_first FROM s")
def u1(spark, d):
    words = toks(spark, d).select("lang", "word").distinct()
    e, f = words.filter("lang='en'").select("word"), words.filter("lang='fr'").select("word")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(e.union(f).distinct(), "either").crossJoin(n(e.join(f, "word", "left_semi"), "both")).crossJoin(n(e.join(f, "word", "left_anti"), "only_first"))


@query("u7_p7_q_variants", ", m AS (SELECT DISTINCT regexp_replace(word, '^q', '') AS core FROM wc WHERE lang = 'fr'), v AS (SELECT core, unnest([core, 'q' || core]) AS word FROM m) SELECT v.core, v.word, coalesce(wc.n, 0) AS n FROM v LEFT JOIN wc ON wc.word = v.word AND wc.lang = 'fr'")
def u7(spark, d):
    counts = rates.word_counts(toks(spark, d).filter("lang = 'fr'"))
    cores = counts.select(W.merged(F.col("word")).alias("core")).distinct()
    v = cores.select("core", F.explode(W.spellings(F.col("core"))).alias("word"))
    return v.join(counts, "word", "left").select("core", "word", F.coalesce("n", F.lit(0)).alias("n"))


@query("p8_stripped", "SELECT word, CASE WHEN length(word) > 1 AND word LIKE 'q%' THEN word[2:] ELSE word END AS core FROM (SELECT DISTINCT word FROM tokens)")
def p8(spark, d):
    return toks(spark, d).select("word").distinct().select("word", W.stripped(F.col("word")).alias("core"))


@query("a8_forms_table", "SELECT word, count(*) FILTER (lang='en') AS n_a, count(*) FILTER (lang='fr') AS n_b, count(DISTINCT sheet) FILTER (lang='en') AS sheets_a, count(DISTINCT sheet) FILTER (lang='fr') AS sheets_b FROM tokens WHERE lang IN ('en','fr') GROUP BY word")
def a8(spark, d):
    # sheets are counted over (word, lang, sheet) rows: combined before the shuffle, no set per word
    per = toks(spark, d).filter("lang in ('en','fr')").groupBy("word", "lang", "sheet").agg(F.count("*").alias("n"))
    of = lambda lang, c: F.coalesce(F.sum(F.when(F.col("lang") == lang, c)), F.lit(0))
    return per.groupBy("word").agg(of("en", F.col("n")).alias("n_a"), of("fr", F.col("n")).alias("n_b"), of("en", F.lit(1)).cast("long").alias("sheets_a"), of("fr", F.lit(1)).cast("long").alias("sheets_b"))


@query("a12_population_card", "SELECT lang, count(*) AS tokens, count(DISTINCT word) AS words, count(DISTINCT page) AS pages, count(DISTINCT sheet) AS sheets FROM tokens GROUP BY lang")
def a12(spark, d):
    t = toks(spark, d)
    n = t.groupBy("lang", "page", "sheet").agg(F.count("*").alias("n"))
    pages = n.groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("pages"), F.countDistinct("sheet").alias("sheets"))
    return pages.join(t.select("lang", "word").distinct().groupBy("lang").agg(F.count("*").alias("words")), "lang").select("lang", "tokens", "words", "pages", "sheets")


# Patterns


def where(spark, d, node, keep=("lang",)):
    return toks(spark, d, keep=keep, hit=matcher(node)).filter("hit")


@query("p1_glob", "SELECT lang, word, count(*) AS n FROM tokens WHERE word LIKE 'th%_ing' GROUP BY ALL")
def p1(spark, d):
    return rates.word_counts(where(spark, d, glob("th*?ing")), "lang")


@query("p2_and_or_not", "SELECT lang, word, count(*) AS n FROM tokens WHERE (word LIKE 'an%' OR word LIKE '%ing') AND NOT coalesce(prev LIKE 'th%', false) GROUP BY ALL")
def p2(spark, d):
    return rates.word_counts(where(spark, d, (glob("an*") | glob("*ing")) & ~glob("th*").at(-1)), "lang")


@query("p3_w2_offset_terms", "SELECT lang, word, count(*) AS n FROM tokens WHERE word LIKE 'th%' AND CASE WHEN idx >= 2 AND prev IS NOT NULL THEN coalesce(prev2 LIKE 'a%', false) ELSE false END AND next IS NOT NULL AND coalesce(words[idx + 3] LIKE '%e%', false) GROUP BY ALL")
def p3(spark, d):
    return rates.word_counts(where(spark, d, glob("th*") & glob("a*").at(-2) & glob("*e*").at(2)), "lang")


@query("p4_places", "SELECT lang, word, count(*) AS n FROM tokens WHERE (word LIKE 't%' AND idx = 0 AND first AND NOT page_first) OR (word LIKE '%n' AND idx = size - 1 AND NOT first) OR (coalesce(next LIKE 'a%', false) AND idx + 1 = size - 1) GROUP BY ALL")
def p4(spark, d):
    return rates.word_counts(where(spark, d, glob("t*").where("li", "lpi") | glob("*n").where("lf", "npi") | glob("a*").at(1).where("lf")), "lang")


@query("p5_p6_line_classes", "SELECT page, count(*) FILTER (first) AS first, count(*) FILTER (page_first) AS page_first, count(*) FILTER (first AND NOT page_first) AS later, count(*) FILTER (NOT first) AS body FROM lines GROUP BY page")
def p5(spark, d):
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return C.corpus(spark, d).groupBy("page").agg(n("first", "first"), n("page_first", "page_first"), n("first and not page_first", "later"), n("not first", "body"))


@query("p9_p10_p11_context_filters", "SELECT word, count(*) AS n FROM tokens WHERE lang='fr' AND coalesce(prev LIKE '%e', false) AND next IS NOT NULL AND next NOT LIKE 'q%' AND word LIKE 'q%' AND idx > 0 AND idx < size - 1 GROUP BY word")
def p9(spark, d):
    t = toks(spark, d, "prev", "next", "size").filter("lang='fr' and idx > 0 and idx < size - 1")
    return rates.word_counts(t.filter(F.coalesce(F.col("prev").endswith("e"), F.lit(False)) & F.col("next").isNotNull() & ~F.col("next").startswith("q") & F.col("word").startswith("q")))


@query("p12_related_words", "SELECT word, count(*) AS n, levenshtein(word, 'thering') AS distance FROM tokens WHERE levenshtein(word, 'thering') <= 2 GROUP BY ALL")
def p12(spark, d):
    rows = rates.word_counts(toks(spark, d)).filter(W.within_edits(F.col("word"), "thering"))
    return rows.select("word", "n", F.levenshtein("word", F.lit("thering")).alias("distance"))


@query("p13_search", "SELECT page, locus, idx, word FROM tokens WHERE word LIKE '%tion%' AND word NOT IN ('tion') AND idx < size - 1 AND coalesce(next LIKE 'th%', false)")
def p13(spark, d):
    t = toks(spark, d, "next", "size", hit=matcher(glob("*tion*"))).filter("hit and word not in ('tion') and idx < size - 1")
    return t.filter(F.coalesce(F.col("next").startswith("th"), F.lit(False))).select("page", "locus", "idx", "word")


LABELLED = ", lab AS (SELECT *, CASE WHEN idx = 0 THEN '(line boundary)' ELSE coalesce(words[idx], '(unreadable)') END AS pl FROM tokens)"


@query("p14_p16_neighbour_labels", LABELLED + " SELECT word, pl AS prev_label, count(*) AS n FROM lab WHERE word LIKE 'th%' AND pl NOT IN ('the', '(line boundary)') GROUP BY ALL")
def p14(spark, d):
    t = toks(spark, d, "prev_label").filter("word like 'th%'")
    return contexts.without_neighbours(t, "prev_label", ["the", "(line boundary)"]).groupBy("word", "prev_label").agg(F.count("*").alias("n"))


PREV = "CASE WHEN prev IS NULL THEN 'boundary / unreadable' WHEN prev LIKE '%ol' THEN '-ol' WHEN prev LIKE '%or' THEN '-or' WHEN prev LIKE '%l' THEN '-l (other)' WHEN prev LIKE '%r' THEN '-r (other)' WHEN prev LIKE '%y' THEN '-y' ELSE 'other' END"
NEXT = "CASE WHEN next IS NULL THEN 'boundary / unreadable' ELSE regexp_extract(next, '^(ckh|cth|cph|cfh|ch|sh|.)', 1) || '-' END"


@query("p15_group_filters", f", g AS (SELECT *, {PREV} AS pc, {NEXT} AS nc FROM tokens WHERE lang='en') SELECT word, count(*) AS n FROM g WHERE pc IN ('-or', '-y') AND nc NOT IN ('t-', 'boundary / unreadable') GROUP BY word")
def p15(spark, d):
    t = toks(spark, d, "prev", "next").filter("lang='en'").withColumn("pc", W.prev_class(F.col("prev"))).withColumn("nc", W.next_class(F.col("next")))
    return rates.word_counts(contexts.group_filters(t, only={"pc": ["-or", "-y"]}, exclude={"nc": ["t-", "boundary / unreadable"]}))


@query("p17_a7_neighbour_summary", f", g AS (SELECT word, coalesce(prev, '-') AS prev, {PREV} AS class FROM tokens WHERE word LIKE '%ing') SELECT class, prev, count(*) AS n FROM g GROUP BY ROLLUP (class, prev)")
def p17(spark, d):
    t = toks(spark, d, "prev").filter("word like '%ing'").select(W.prev_class(F.col("prev")).alias("class"), F.coalesce("prev", F.lit("-")).alias("prev"))
    return t.rollup("class", "prev").agg(F.count("*").alias("n"))


@query("p18_neighbour_gallows", ", w AS (SELECT DISTINCT word FROM tokens), g AS (SELECT word, list_distinct(regexp_extract_all(word, 'cth|ckh|cph|cfh|[tkpf]')) AS f FROM w) SELECT word, coalesce(nullif(array_to_string(list_filter(list_transform(['t','k','p','f','cth','ckh','cph','cfh'], lambda x: CASE WHEN list_contains(f, x) THEN (CASE WHEN length(x) = 1 THEN upper(x) ELSE x[1] || upper(x[2]) || x[3] END) END), lambda y: y IS NOT NULL), ' + '), ''), 'none') AS class FROM g")
def p18(spark, d):
    return toks(spark, d).select("word").distinct().select("word", W.gallows_class(F.col("word")).alias("class"))


@query("p19_rate_base", "SELECT count(*) FILTER (word LIKE 'p%' AND first AND idx = 0) AS matches, count(*) FILTER (first AND idx = 0) AS base, round(count(*) FILTER (word LIKE 'p%' AND first AND idx = 0) * 1.0 / count(*) FILTER (first AND idx = 0), 6) AS rate FROM tokens")
def p19(spark, d):
    node = glob("p*").where("pi") & glob("*").where("li")
    t = toks(spark, d, hit=matcher(node), base=rate_base(node))
    return t.agg(F.count_if("hit").alias("matches"), F.count_if("base").alias("base")).withColumn("rate", r6(F.col("matches") / F.col("base")))


@query("p27_p28_count_classes", "SELECT lang, CASE WHEN n<=1 THEN '1' WHEN n<=9 THEN '2-9' ELSE '10+' END AS event_class, CASE WHEN n<=1 THEN '1' WHEN n<=4 THEN '2-4' WHEN n<=9 THEN '5-9' ELSE '10+' END AS count_class, count(*) AS words FROM wc GROUP BY ALL")
def p27(spark, d):
    c = rates.word_counts(toks(spark, d), "lang")
    return c.groupBy("lang", W.event_class(F.col("n")).alias("event_class"), W.count_class(F.col("n")).alias("count_class")).agg(F.count("*").alias("words"))


@query("f7_tie_weight", "SELECT word, round(1 + 1e-3 * CAST('0x' || substr(sha256(word), 1, 6) AS BIGINT) / 16777216.0, 9) AS weight FROM (SELECT DISTINCT word FROM wc)")
def f7(spark, d):
    return toks(spark, d).select("word").distinct().select("word", F.round(W.tie_weight(F.col("word")), 9).alias("weight"))


@query("f8_f9_balance", PAIR + " SELECT word, CASE WHEN a=0 THEN 'inf' WHEN b=0 THEN '-inf' ELSE CAST(round(log2(b/a), 4) AS VARCHAR) END IS NULL AS missing, CASE WHEN a>0 AND b>0 THEN round(log2(b/a),6) END AS balance, round(ln(1+a)/ln(1+1000),6) AS intensity, round((a-b)/(a+b),6) AS residual FROM ab WHERE a < 1000")
def f8(spark, d):
    b = W.balance(F.col("a"), F.col("b"))
    return pair(spark, d).filter("a < 1000").select("word", b.isNull().alias("missing"), F.when((F.col("a") > 0) & (F.col("b") > 0), r6(b)).alias("balance"), r6(W.intensity(F.col("a"), F.lit(1000.0))).alias("intensity"), r6(W.bounded_residual(F.col("a"), F.col("b"))).alias("residual"))


@query("f2_swap", "SELECT word, replace(replace(translate(replace(replace(word, 'ckh', chr(1)), 'cth', chr(2)), 'kt', 'tk'), chr(1), 'ckh'), chr(2), 'cth') AS swapped FROM (SELECT DISTINCT word FROM wc)")
def f2(spark, d):
    return toks(spark, d).select("word").distinct().select("word", W.swapped(F.col("word")).alias("swapped"))


# Contexts


CELLS = f", g AS (SELECT sheet, {PREV} AS class, first AS focus FROM tokens WHERE lang='en')"


@query("a9_sheet_cells", CELLS + " SELECT sheet, class, count(*) AS n, count(*) FILTER (focus) AS hits FROM g GROUP BY ALL")
def a9(spark, d):
    t = toks(spark, d, "prev").filter("lang='en'").withColumn("class", W.prev_class(F.col("prev")))
    return contexts.cells(t, "sheet", "class", F.col("first"))


CONTRAST = CELLS + """, cell AS (SELECT sheet, class, focus, count(*) AS n FROM g GROUP BY ALL), tot AS (SELECT sheet, focus, sum(n) AS n FROM cell GROUP BY ALL),
classes AS (SELECT DISTINCT class FROM cell), x AS (SELECT c.class, t.sheet, t.focus, t.n, coalesce(k.n, 0) AS h FROM classes c, tot t LEFT JOIN cell k ON k.class = c.class AND k.sheet = t.sheet AND k.focus = t.focus),
p AS (SELECT class, sum(n) FILTER (focus) AS n1, sum(n) FILTER (NOT focus) AS n0, sum(h) FILTER (focus) AS h1, sum(h) FILTER (NOT focus) AS h0, count(DISTINCT sheet) AS sheets FROM x GROUP BY class),
s AS (SELECT p.class, x.sheet, sum(CASE WHEN focus THEN (h - n * h1 / n1) / n1 ELSE -(h - n * h0 / n0) / n0 END) AS score FROM p JOIN x USING (class) GROUP BY p.class, x.sheet),
v AS (SELECT class, sum(score * score) AS ss, count(*) AS g FROM s GROUP BY class)"""


@query("c3_c4_c5_contrast", CONTRAST + " SELECT class, round(h1 / n1 - h0 / n0, 6) AS effect, round(sqrt(ss * g / (g - 1) * (n1 + n0 - 1) / (n1 + n0 - 2)), 6) AS se, g - 1 AS df, sheets >= 6 AND h1 + h0 >= 5 AND n1 + n0 - h1 - h0 >= 5 AS supported, abs(h1 / n1 - h0 / n0) >= 0.01 AND (h1 / n1 >= 2 * h0 / n0 OR h0 / n0 >= 2 * h1 / n1) OR abs(h1 / n1 - h0 / n0) >= 0.05 AS review FROM p JOIN v USING (class)")
def c5(spark, d):
    t = toks(spark, d, "prev").filter("lang='en'").select("sheet", W.prev_class(F.col("prev")).alias("class"), F.col("first").alias("focus"))
    out = contexts.contrast(t)
    return out.select("class", r6("effect").alias("effect"), r6("se").alias("se"), "df", "supported", "review")


def weighted(rows, weights):
    """SQL of a weighted contrast; ``rows`` selects sheet, class and part."""
    values = ", ".join(f"({i}, {w})" for i, w in enumerate(weights))
    return f""", g AS ({rows}), cell AS (SELECT sheet, class, part, count(*) AS h FROM g GROUP BY ALL), m AS (SELECT sheet, part, sum(h) AS m FROM cell GROUP BY ALL), n AS (SELECT part, sum(m)::DOUBLE AS n, count(*) AS g FROM m GROUP BY part),
t AS (SELECT class, part, sum(h) AS t FROM cell GROUP BY ALL), w AS (SELECT * FROM (VALUES {values}) v(part, w)),
p AS (SELECT c.class, n.part, w, n, g, coalesce(t, 0)::DOUBLE AS t FROM (SELECT DISTINCT class FROM cell) c CROSS JOIN n JOIN w USING (part) LEFT JOIN t ON t.class = c.class AND t.part = n.part),
s AS (SELECT p.class, m.sheet, sum(p.w * (coalesce(c.h, 0) - p.t / p.n * m.m) / p.n) AS score FROM p JOIN m USING (part) LEFT JOIN cell c ON c.class = p.class AND c.part = p.part AND c.sheet = m.sheet GROUP BY ALL),
v AS (SELECT class, sum(score * score) AS ss, count(*) AS gg FROM s GROUP BY class),
o AS (SELECT class, sum(w * t / n) AS effect, sum(n) AS n, count(*) AS k, min(g) - 1 AS df, bool_and(g >= 6 AND t >= 5 AND n - t >= 5) AS supported FROM p GROUP BY class)
SELECT class, round(effect, 6) + 0.0 AS effect, round(sqrt(ss * gg / (gg - 1) * (n - 1) / (n - k)), 6) AS se, df, supported FROM o JOIN v USING (class)"""


def two_populations(spark, d, label):
    """sheet, class and part (0, 1: first lines and others of en; 2, 3: of fr)."""
    t = toks(spark, d, "prev").filter("lang in ('en','fr')")
    return t.select("sheet", label.alias("class"), (F.when(F.col("lang") == "fr", 2).otherwise(0) + F.when(F.col("first"), 0).otherwise(1)).alias("part"))


PART = "CASE WHEN lang = 'fr' THEN 2 ELSE 0 END + CASE WHEN first THEN 0 ELSE 1 END"
BEFORE = "coalesce(prev, '(none)')"


@query("c3_section_contrast", weighted(f"SELECT sheet, {PREV} AS class, ({PART}) // 2 AS part FROM tokens WHERE lang IN ('en','fr')", (-1, 1)))
def c3a(spark, d):
    """Neighbour classes of two populations, with errors by sheet."""
    rows = two_populations(spark, d, W.prev_class(F.col("prev"))).withColumn("part", F.floor(F.col("part") / 2))
    return contexts.weighted_contrast(rows, (-1, 1)).withColumns({"effect": r6("effect"), "se": r6("se")})


@query("c3_selection_contrast", weighted(f"SELECT sheet, {PREV} AS class, {PART} AS part FROM tokens WHERE lang IN ('en','fr')", (-1, 1, 1, -1)))
def c3b(spark, d):
    """How first lines change neighbour classes in one population against the other."""
    return contexts.weighted_contrast(two_populations(spark, d, W.prev_class(F.col("prev"))), (-1, 1, 1, -1)).withColumns({"effect": r6("effect"), "se": r6("se")})


@query("c9_word_contrast", weighted(f"SELECT sheet, {BEFORE} AS class, {PART} AS part FROM tokens WHERE lang IN ('en','fr')", (-1, 1, 1, -1)))
def c9b(spark, d):
    """The same for each word before."""
    return contexts.weighted_contrast(two_populations(spark, d, F.coalesce("prev", F.lit("(none)"))), (-1, 1, 1, -1)).withColumns({"effect": r6("effect"), "se": r6("se")})


REVIEW = f""", g AS (SELECT {BEFORE} AS class, {PART} AS part FROM tokens WHERE lang IN ('en','fr')), h AS (SELECT class, count(*) FILTER (part = 0)::DOUBLE AS h0, count(*) FILTER (part = 1)::DOUBLE AS h1, count(*) FILTER (part = 2)::DOUBLE AS h2, count(*) FILTER (part = 3)::DOUBLE AS h3 FROM g GROUP BY class),
n AS (SELECT sum(h0) AS n0, sum(h1) AS n1, sum(h2) AS n2, sum(h3) AS n3 FROM h), r AS (SELECT class, (h0 + h1) / (n0 + n1) AS a, (h2 + h3) / (n2 + n3) AS b, h0 / n0 AS fa, h2 / n2 AS fb FROM h, n),
l AS (SELECT *, fa - a AS ea, fb - b AS eb, CASE WHEN fa = a THEN 1 WHEN a = 0 THEN 'inf'::DOUBLE ELSE fa / a END AS la, CASE WHEN fb = b THEN 1 WHEN b = 0 THEN 'inf'::DOUBLE ELSE fb / b END AS lb FROM r),
k AS (SELECT class, 'section' AS kind, b - a AS effect, CASE WHEN b = a THEN 1 WHEN a = 0 THEN 'inf'::DOUBLE ELSE b / a END AS lift, true AS up FROM l
  UNION ALL SELECT class, 'selection', eb - ea, CASE WHEN lb = la THEN 1 WHEN la = 0 THEN 'inf'::DOUBLE ELSE lb / la END, true FROM l
  UNION ALL SELECT class, 'shared', least(ea, eb), least(la, lb), ea > 0 AND eb > 0 AND (ea >= 0.05 OR ea >= 0.01 AND (la >= 2 OR la <= 0.5)) AND (eb >= 0.05 OR eb >= 0.01 AND (lb >= 2 OR lb <= 0.5)) FROM l)
SELECT class, kind, round(effect, 6) + 0.0 AS effect, CASE WHEN lift < 'inf'::DOUBLE THEN round(lift, 6) END AS lift, up AND (kind = 'shared' OR abs(effect) + 1e-12 >= 0.05 OR abs(effect) + 1e-12 >= 0.01 AND (lift >= 2 OR lift <= 0.5)) AS flagged FROM k"""


@query("c3_c4_review", REVIEW)
def c4b(spark, d):
    """Review flags of the words before: between populations, of the selections, and shared; an infinite lift is null."""
    out = contexts.review(two_populations(spark, d, F.coalesce("prev", F.lit("(none)"))))
    return out.select("class", "kind", r6("effect").alias("effect"), F.when(F.col("lift") < float("inf"), r6("lift")).alias("lift"), "flagged")


@query("c9_drill_down", f", g AS (SELECT prev, first AS focus, {PREV} AS class FROM tokens WHERE lang='en') SELECT prev, count(*) FILTER (focus) AS selected, count(*) AS n FROM g WHERE class = '-y' GROUP BY prev")
def c9(spark, d):
    t = toks(spark, d, "prev").filter("lang='en'").filter(W.prev_class(F.col("prev")) == "-y")
    return t.groupBy("prev").agg(F.count_if("first").alias("selected"), F.count("*").alias("n"))


@query("c8_shared_enrichment", ", r AS (SELECT lang, word, count(*) FILTER (first) * 1.0 / sum(count(*) FILTER (first)) OVER (PARTITION BY lang) - count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY lang) AS gap FROM tokens WHERE lang IN ('en','fr') GROUP BY lang, word) SELECT word, round(min(gap), 6) AS effect, min(gap) > 0.000000001 AS shared FROM r GROUP BY word HAVING count(*) = 2")
def c8(spark, d):
    n = toks(spark, d).filter("lang in ('en','fr')").groupBy("lang", "word").agg(F.count_if("first").alias("k"), F.count("*").alias("n"))
    totals = n.groupBy("lang").agg(F.sum("k").alias("kk"), F.sum("n").alias("nn"))
    gap = F.col("k") / F.col("kk") - F.col("n") / F.col("nn")
    rows = n.join(F.broadcast(totals), "lang").groupBy("word").agg(F.min(gap).alias("effect"), F.count("*").alias("sides")).filter("sides = 2")
    return rows.select("word", r6("effect").alias("effect"), (F.col("effect") > 1e-9).alias("shared"))


#: Weights of all tables with the margins of each word, from running sums of their ratios' logarithms.
EXACT = """, t AS (SELECT lang, word, count(*) FILTER (first) AS h1, count(*) AS h FROM tokens GROUP BY ALL), m AS (SELECT lang, sum(h1)::BIGINT AS n1, sum(h)::BIGINT AS n FROM t GROUP BY lang),
g AS (SELECT DISTINCT lang, h, n1, n FROM t JOIN m USING (lang)), x AS (SELECT *, unnest(range(greatest(0, h - (n - n1)), least(h, n1) + 1)) AS k FROM g),
lw AS (SELECT *, coalesce(sum(ln((n1 - k + 1)::DOUBLE * (h - k + 1) / (k::DOUBLE * (n - n1 - h + k)))) FILTER (k > greatest(0, h - (n - n1))) OVER (PARTITION BY lang, h ORDER BY k), 0) AS l FROM x),
pk AS (SELECT lang, h, max(l) AS top FROM lw GROUP BY ALL), w AS (SELECT lang, h, k, l, exp(l - top) AS w FROM lw JOIN pk USING (lang, h)),
hh AS (SELECT DISTINCT lang, h, h1 FROM t), own AS (SELECT hh.*, w.l AS own FROM hh JOIN w ON w.lang = hh.lang AND w.h = hh.h AND w.k = hh.h1),
e AS (SELECT lang, h, h1, least(1, sum(w) FILTER (l <= own + 1e-9) / sum(w)) AS p, least(1, coalesce(sum(w) FILTER (k >= h1), 0) / sum(w)) AS greater FROM own JOIN w USING (lang, h) GROUP BY ALL)"""


def first_lines(spark, d):
    """(lang, word, h1, h, n1, n): tokens of the word in first lines and in all, and those of the language."""
    n = toks(spark, d).groupBy("lang", "word").agg(F.count_if("first").alias("h1"), F.count("*").alias("h"))
    totals = n.groupBy(F.col("lang").alias("l")).agg(F.sum("h1").alias("n1"), F.sum("h").alias("n"))
    return n.join(totals, F.col("lang").eqNullSafe(F.col("l"))).drop("l")


@query("c6_w3_exact_tests_holm", EXACT + ", j AS (SELECT word, p, row_number() OVER (ORDER BY p, word) AS r, count(*) OVER () AS m FROM t JOIN e USING (lang, h, h1) WHERE lang = 'en') SELECT word, round(p, 6) AS p, round(max(least(1, p * (m - r + 1))) OVER (ORDER BY r), 6) AS adjusted FROM j")
def c6(spark, d):
    """Fixed-margin exact tests of all English words in first lines, Holm-adjusted."""
    tested = exact.fixed_margins(first_lines(spark, d).filter("lang='en'"), "word")
    return contexts.holm(tested, "p", "word").select("word", r6("p").alias("p"), r6("adjusted").alias("adjusted"))


@query("c8_exact_shared", EXACT + " SELECT word, round(min(h1 * 1.0 / n1 - (h - h1) * 1.0 / (n - n1)), 6) + 0.0 AS effect, round(max(greater), 6) AS p FROM t JOIN m USING (lang) JOIN e USING (lang, h, h1) WHERE lang IN ('en', 'fr') GROUP BY word HAVING count(*) = 2")
def c8b(spark, d):
    """Words that are enriched in first lines of both populations, by exact one-sided tests."""
    s = exact.shared_enrichment(first_lines(spark, d).filter("lang in ('en','fr')"), "lang", "word")
    return s.select("word", r6("effect").alias("effect"), r6("p").alias("p"))


@query("c43_two_searches", "SELECT lang AS side, word, count(*) AS n FROM tokens WHERE lang IN ('en','de') AND word LIKE '%er' AND idx = 0 GROUP BY ALL")
def c43(spark, d):
    t = where(spark, d, glob("*er").where("li"))
    sides = [t.filter(F.col("lang") == s).select(F.lit(s).alias("side"), "word") for s in ("en", "de")]
    return sides[0].unionByName(sides[1]).groupBy("side", "word").agg(F.count("*").alias("n"))


@query("j13_population_overlap", "SELECT count(*) AS shared FROM (SELECT page, locus, idx FROM tokens WHERE lang='en' AND first) a SEMI JOIN (SELECT page, locus, idx FROM tokens WHERE source='src3') b USING (page, locus, idx)")
def j13(spark, d):
    t = toks(spark, d, keep=("lang", "source"))
    ids = ["page", "locus", "idx"]
    return t.filter("lang='en' and first").select(*ids).join(t.filter("source='src3'").select(*ids), ids, "left_semi").agg(F.count("*").alias("shared"))
