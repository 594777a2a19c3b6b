"""Queries: units, groups and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.operators import rates, units
from lexiflow.operators.ranks import numbered
from lexiflow.plans.base import query, r6
from lexiflow.plans.search import toks
from lexiflow.sources import corpus as C

HITS = {"ing": lambda w: w.endswith("ing"), "th": lambda w: w.startswith("th")}
UNIT = """, u AS (SELECT t.page, t.lang, coalesce('q' || l.quality, 'none') AS code, count(*) AS tokens, count(*) FILTER (word LIKE '%ing') AS ing, count(*) FILTER (word LIKE 'th%') AS th
  FROM tokens t LEFT JOIN labels l ON l.doc_id = t.page GROUP BY ALL),
ln AS (SELECT page, count(*) AS lines FROM lines GROUP BY page),
um AS (SELECT u.*, ln.lines FROM u JOIN ln USING (page))"""


def classes(spark, d):
    return C.table(spark, d, "labels").select(F.col("doc_id").alias("page"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("code"))


def model(spark, d):
    rows = units.unit_model(C.corpus(spark, d, "lang"), ["page", "lang"], HITS).filter("tokens > 0")
    return units.page_class(rows, classes(spark, d))


@query("a13_j2_j3_unit_model", UNIT + " SELECT page, lang, code, tokens, lines, ing, th FROM um")
def a13(spark, d):
    return model(spark, d).select("page", "lang", "code", "tokens", "lines", "ing", "th")


@query("a14_paragraph_units", ", p AS (SELECT *, sum(first::INT) OVER (PARTITION BY page ORDER BY locus) AS paragraph FROM lines) SELECT page, paragraph, count(*) AS lines, sum(len(list_filter(words, lambda w: w IS NOT NULL))) AS tokens, sum(len(list_filter(words, lambda w: w LIKE '%ing'))) AS ing FROM p GROUP BY page, paragraph")
def a14(spark, d):
    rows = units.paragraphs(C.corpus(spark, d))
    return units.unit_model(rows, ["page", "paragraph"], {"ing": HITS["ing"]}).select("page", "paragraph", "lines", "tokens", "ing")


@query("a15_a16_w6_group_statistics", UNIT + " SELECT coalesce(lang, 'all') AS lang, count(*) AS units, count(*) FILTER (ing > 0) AS with_match, sum(ing) AS matches, sum(tokens) AS tokens, sum(lines) AS lines, round(median(ing), 6) AS median, arg_max(page, ing * 100000000 - page) AS best, round(sum(ing) * 10000.0 / sum(tokens), 6) AS per10k, round(sum(ing) * 1.0 / sum(lines), 6) AS perline, round(sum(ing) * 1.0 / (SELECT sum(ing) FROM um), 6) AS share FROM um GROUP BY GROUPING SETS ((lang), ())")
def a15(spark, d):
    s = units.statistics(model(spark, d), "lang", "page", "ing")
    return s.select(F.coalesce("lang", F.lit("all")).alias("lang"), "units", "with_match", "matches", "tokens", "lines", r6("median").alias("median"), "best", r6("per10k").alias("per10k"), r6("perline").alias("perline"), r6("share").alias("share"))


@query("a17_pattern_shares", UNIT + " SELECT page, round(ing * 1.0 / nullif(ing + th, 0), 6) AS ing_share, round(th * 1.0 / nullif(ing + th, 0), 6) AS th_share FROM um")
def a17(spark, d):
    both = F.col("ing") + F.col("th")
    return model(spark, d).select("page", r6(F.try_divide(F.col("ing") * 1.0, both)).alias("ing_share"), r6(F.try_divide(F.col("th") * 1.0, both)).alias("th_share"))


@query("a18_correlations", UNIT + ", r AS (SELECT lang, ing::DOUBLE AS x, th::DOUBLE AS y, rank() OVER (PARTITION BY lang ORDER BY ing) + (count(*) OVER (PARTITION BY lang, ing) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY lang ORDER BY th) + (count(*) OVER (PARTITION BY lang, th) - 1) / 2.0 AS ry FROM um) SELECT lang, CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN round(corr(x, y), 6) END AS pearson, CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN round(corr(rx, ry), 6) END AS spearman FROM r GROUP BY lang")
def a18(spark, d):
    return units.correlations(model(spark, d), "ing", "th", "lang").select("lang", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


@query("a19_f12_histogram", UNIT + ", v AS (SELECT lang, ing * 10000.0 / tokens AS v FROM um), s AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.95) AS hi, min(v) AS lo FROM v WHERE v > 0) SELECT lang, CASE WHEN v <= 0 THEN 0 WHEN v > hi THEN -1 ELSE 1 + CAST(floor((v - lo) / ((hi - lo) / 12)) AS BIGINT) END AS bin, count(*) AS n FROM v, s GROUP BY ALL")
def a19(spark, d):
    rows = model(spark, d).select("lang", (F.col("ing") * 10000.0 / F.col("tokens")).alias("v"))
    return units.histogram(rows, "v", "lang", bins=12)


ROUND = UNIT + """, v AS (SELECT lang, {v} AS v FROM um), p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM v WHERE v > 0),
q AS (SELECT max(n) AS n, max(v) AS most, max(v) FILTER (i = floor(0.25 * (n - 1) + 0.5)) AS q1, max(v) FILTER (i = floor(0.75 * (n - 1) + 0.5)) AS q3, max(v) FILTER (i = floor(0.95 * (n - 1) + 0.5)) AS q95 FROM p),
up AS (SELECT most, CASE WHEN n >= 20 THEN q95 WHEN n >= 5 THEN least(most, q3 + 3 * (q3 - q1)) ELSE most END AS upper FROM q),
h AS (SELECT v, i, most, upper, count(*) OVER () AS n FROM p, up WHERE v <= upper),
f AS (SELECT max(most) AS most, max(upper) AS upper, max(n) AS n, 2 * (max(v) FILTER (i = floor(0.75 * (n - 1) + 0.5)) - max(v) FILTER (i = floor(0.25 * (n - 1) + 0.5))) / cbrt(max(n)) AS fd FROM h),
w AS (SELECT most, upper, upper / least(48, greatest(6, floor(CASE WHEN fd > 0 THEN upper / fd ELSE log2(n) + 1 END + 0.5))) AS raw FROM f), sc AS (SELECT *, pow(10.0, floor(log10(raw))) AS s FROM w),
nw AS (SELECT most, upper, s * CASE WHEN raw <= s * (1 + 1e-9) THEN 1 WHEN raw <= 2 * s * (1 + 1e-9) THEN 2 WHEN raw <= 2.5::DOUBLE * s * (1 + 1e-9) THEN 2.5::DOUBLE WHEN raw <= 5 * s * (1 + 1e-9) THEN 5 ELSE 10 END AS nice FROM sc),
e AS (SELECT most, width, ceil((upper - 1e-12) / width) * width AS top FROM (SELECT most, upper, {width} AS width FROM nw)),
b AS (SELECT lang, CASE WHEN v <= 0 THEN 0 WHEN v > top + 1e-12 THEN -1 ELSE ceil((v - 1e-12) / width) END::BIGINT AS bin, width, top, most FROM v, e)
SELECT lang, bin, round(CASE WHEN bin > 0 THEN (bin - 1) * width WHEN bin < 0 THEN top ELSE 0 END, 6) AS lo, round(CASE WHEN bin > 0 THEN bin * width WHEN bin < 0 THEN most ELSE 0 END, 6) AS hi, count(*) AS n FROM b GROUP BY ALL"""


def rounded(h):
    return h.select("lang", "bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


@query("a19_f12_round_histogram", ROUND.format(v="ing * 10000.0 / tokens", width="nice"))
def a19b(spark, d):
    """Matches per 10,000 words of each page on bins of a round width."""
    return rounded(units.round_histogram(model(spark, d).select("lang", (F.col("ing") * 10000.0 / F.col("tokens")).alias("v")), "v", "lang"))


@query("a19_f12_count_histogram", ROUND.format(v="ing::DOUBLE", width="greatest(1, ceil(nice))"))
def a19c(spark, d):
    """Matches of each page on bins of a whole, round width."""
    return rounded(units.round_histogram(model(spark, d).select("lang", F.col("ing").cast("double").alias("v")), "v", "lang", whole=True))


@query("a20_nearest_rank", UNIT + ", r AS (SELECT lang, tokens, row_number() OVER (PARTITION BY lang ORDER BY tokens) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM um) SELECT lang, tokens AS value FROM r WHERE i = floor(0.9 * (n - 1) + 0.5)")
def a20(spark, d):
    return units.nearest_rank(model(spark, d), "tokens", 0.9, "lang")


PATTERNS = {"ing": "%ing", "th": "th%", "e": "%e%", "short": "__"}


@query("a21_pattern_matrix", ", m AS (SELECT lang, unnest(list_filter([CASE WHEN word LIKE '%ing' THEN 'ing' END, CASE WHEN word LIKE 'th%' THEN 'th' END, CASE WHEN word LIKE '%e%' THEN 'e' END, CASE WHEN word LIKE '__' THEN 'short' END], lambda x: x IS NOT NULL)) AS pattern FROM tokens) SELECT lang, pattern, count(*) AS n FROM m GROUP BY ALL")
def a21(spark, d):
    return units.pattern_matrix(toks(spark, d), "lang", {n: F.col("word").like(p) for n, p in PATTERNS.items()})


@query("s7_matrix_export", "SELECT lang, count(*) FILTER (word LIKE '%ing') AS ing, count(*) FILTER (word LIKE 'th%') AS th, count(*) FILTER (word LIKE '__') AS short FROM tokens GROUP BY lang")
def s7(spark, d):
    m = units.pattern_matrix(toks(spark, d), "lang", {n: F.col("word").like(PATTERNS[n]) for n in ("ing", "th", "short")})
    return m.groupBy("lang").pivot("pattern", ["ing", "th", "short"]).agg(F.first("n")).fillna(0)


@query("c45_comparison_groups", ", g AS (SELECT unnest(CASE WHEN lang IN ('en','fr') THEN [lang, 'both'] ELSE ['other'] END) AS grp FROM tokens) SELECT grp, count(*) AS n FROM g GROUP BY grp")
def c45(spark, d):
    return toks(spark, d).select(units.comparison_groups(F.col("lang"), "en", "fr").alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))


@query("p29_hidden_groups", "SELECT lang, count(*) AS n FROM tokens WHERE lang NOT IN ('de', 'es') GROUP BY lang")
def p29(spark, d):
    return units.hide_groups(rates_by_lang(spark, d), "lang", ["de", "es"])


def rates_by_lang(spark, d):
    return toks(spark, d).groupBy("lang").agg(F.count("*").alias("n"))


@query("a48_group_pages", ", p AS (SELECT d.lang, coalesce('q' || l.quality, 'none') AS kind, d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT lang, kind, array_to_string(list_sort(list_distinct(list(lpad(doc_id::VARCHAR, 12, '0')))), ' ') AS pages FROM p GROUP BY lang, kind")
def a48(spark, d):
    docs = units.page_class(C.table(spark, d, "documents").select(F.col("doc_id").alias("page"), "lang"), classes(spark, d))
    ids = F.array_sort(F.collect_set(F.lpad(F.col("page").cast("string"), 12, "0")))
    return docs.groupBy("lang", F.col("code").alias("kind")).agg(F.array_join(ids, " ").alias("pages"))


@query("a48_page_places", ", p AS (SELECT d.lang, coalesce('q' || l.quality, 'none') AS kind, d.doc_id AS page FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT lang, kind, page, row_number() OVER (PARTITION BY lang, kind ORDER BY page) AS place FROM p")
def a48b(spark, d):
    """The same list with a row per page and its place in the group, for groups of any size."""
    docs = units.page_class(C.table(spark, d, "documents").select(F.col("doc_id").alias("page"), "lang"), classes(spark, d))
    return numbered(docs.select("lang", F.col("code").alias("kind"), "page"), [F.col("page").asc()], "lang", "kind")


@query("t1_paging", "SELECT word, n, rank FROM (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM wc WHERE lang='en') WHERE rank BETWEEN 41 AND 80")
def t1(spark, d):
    counts = rates.word_counts(toks(spark, d).filter("lang='en'"))
    return rates.pages_of_rank(counts, [F.desc("n"), F.asc("word")], 41, 80)


@query("t6_t7_w7_unit_orders", UNIT + ", o AS (SELECT lang, page, CASE WHEN code <> 'none' THEN ing * 10000.0 / tokens END AS position, page % 7 AS rank FROM um) SELECT lang, page, row_number() OVER (PARTITION BY lang ORDER BY round(position, 6) NULLS LAST, rank, page) AS place FROM o")
def t6(spark, d):
    rows = model(spark, d).select("lang", "page", F.when(F.col("code") != "none", r6(F.col("ing") * 10000.0 / F.col("tokens"))).alias("position"), (F.col("page") % 7).alias("rank"))
    order = units.path_order(rows, "position", "rank", "page")
    return numbered(rows, order, "lang").select("lang", "page", "place")
