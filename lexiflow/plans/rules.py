"""Queries: rules, simulations and the word graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.functions import words as W
from lexiflow.operators import graph, rates, rules
from lexiflow.plans.base import query, r6
from lexiflow.plans.search import bag, toks

RULES = [("ED_ING", "suffix", "ed", "ing"), ("ER_ING", "suffix", "er", "ing"), ("RE_ER", "suffix", "re", "er"), ("EN_ER", "suffix", "en", "er"), ("RE_IN", "prefix", "re", "in")]
FRACTIONS = (0.3, 0.25, 0.2, 0.1, 0.15)
CATALOG = [("ED_ING", "supported", "endings", True), ("ER_ING", "provisional", "endings", True), ("RE_ER", "supported", "endings", True), ("EN_ER", "experimental", "endings", False), ("RE_IN", "provisional", "beginnings", True)]
MENU = """, ew AS (SELECT regexp_replace(word, '^q', '') AS word, CAST(sum(n) AS BIGINT) AS n FROM wc WHERE lang = 'en' GROUP BY 1 HAVING regexp_replace(word, '^q', '') <> ''),
menu AS (SELECT 'ED_ING' AS code, word AS src, word[:-3] || 'ing' AS dst FROM ew WHERE word LIKE '%ed'
  UNION ALL SELECT 'ER_ING', word, word[:-3] || 'ing' FROM ew WHERE word LIKE '%er'
  UNION ALL SELECT 'RE_ER', word, word[:-3] || 'er' FROM ew WHERE word LIKE '%re'
  UNION ALL SELECT 'EN_ER', word, word[:-3] || 'er' FROM ew WHERE word LIKE '%en'
  UNION ALL SELECT 'RE_IN', word, 'in' || word[3:] FROM ew WHERE word LIKE 're%'),
edge AS MATERIALIZED (SELECT src, dst, array_to_string(list_sort(list_distinct(list(code))), '+') AS codes FROM menu WHERE dst IN (SELECT word FROM ew) AND dst <> src GROUP BY src, dst)"""


def english(spark, d):
    """Counts of the English words, merged: without an initial q."""
    merged = bag(spark, d, keep=(), lang="en").withColumn("word", W.merged(F.col("word")))
    return rates.word_counts(merged.filter("word <> ''"))


def menu(spark, d, which=RULES):
    return rules.menu(english(spark, d), which)


def edges(spark, d, which=RULES):
    words = graph.settled(english(spark, d))  # read twice
    return rules.edges(rules.attested(rules.menu(words, which), words))


def catalog(spark):
    return spark.createDataFrame(CATALOG, "code string, confidence string, grp string, active boolean")


@query("j4_f1_rule_menu", MENU + " SELECT code, src, dst FROM menu WHERE dst <> src")
def j4(spark, d):
    return menu(spark, d)


@query("u5_u8_edges", MENU + " SELECT src, dst, codes FROM edge")
def u5(spark, d):
    return edges(spark, d).withColumn("codes", F.array_join("codes", "+"))


@query("u5_unattested", MENU + " SELECT code, count(*) AS outputs FROM menu WHERE dst NOT IN (SELECT word FROM ew) GROUP BY code")
def u5b(spark, d):
    words = english(spark, d)
    made = rules.menu(words, RULES)
    return made.join(words.select(F.col("word").alias("dst")), "dst", "left_anti").groupBy("code").agg(F.count("*").alias("outputs"))


@query("u6_vocabulary", MENU + ", v AS (SELECT src AS word FROM edge UNION SELECT dst FROM edge UNION SELECT word FROM ew WHERE n >= 20) SELECT v.word, ew.n, round(ew.n * 10000.0 / (SELECT sum(n) FROM ew), 6) AS rate FROM v JOIN ew USING (word)")
def u6(spark, d):
    words, e = english(spark, d), edges(spark, d)
    v = e.select(F.col("src").alias("word")).union(e.select("dst")).union(words.filter("n >= 20").select("word")).distinct()
    return v.join(rates.rates(words), "word").select("word", "n", r6("rate").alias("rate"))


@query("j6_p23_live_routes", MENU + " SELECT src, dst, codes FROM edge WHERE codes NOT LIKE '%EN_ER%'")
def j6(spark, d):
    active = [c for c, _, _, on in CATALOG if on]
    return rules.live_routes(edges(spark, d), active).withColumn("codes", F.array_join("codes", "+"))


@query("p24_p25_rule_presets", MENU + ", p AS (SELECT * FROM (VALUES ('ED_ING','supported','supported'), ('RE_ER','supported','supported'), ('ED_ING','supported','all'), ('ER_ING','provisional','all'), ('RE_ER','supported','all'), ('RE_IN','provisional','all')) t(code, confidence, preset)) SELECT preset, code, confidence, count(*) AS inputs FROM p JOIN menu USING (code) WHERE dst <> src GROUP BY ALL")
def p24(spark, d):
    """The rules of each preset, with the words of the corpus that they take."""
    active = catalog(spark).filter("active")
    supported = active.filter(F.col("confidence") == "supported").withColumn("preset", F.lit("supported"))
    presets = supported.unionByName(active.withColumn("preset", F.lit("all")))
    inputs = menu(spark, d).groupBy("code").agg(F.count("*").alias("inputs"))
    return presets.join(inputs, "code").select("preset", "code", "confidence", "inputs")


@query("p26_f15_weakest", MENU + ", t AS (SELECT * FROM (VALUES ('ED_ING',0),('ER_ING',1),('RE_ER',0),('EN_ER',2),('RE_IN',1)) t(code, r)) SELECT src, dst, max(r) AS weakest FROM menu JOIN t USING (code) WHERE dst IN (SELECT word FROM ew) AND dst <> src GROUP BY src, dst")
def p26(spark, d):
    rank = F.create_map(*[F.lit(x) for c, conf, _, _ in CATALOG for x in (c, conf)])
    return edges(spark, d).select("src", "dst", rules.weakest(F.transform("codes", lambda c: rank[c])).alias("weakest"))


SIM = MENU + """, frac AS (SELECT * FROM (VALUES ('ED_ING',0.3),('ER_ING',0.25),('RE_ER',0.2),('EN_ER',0.1),('RE_IN',0.15)) t(code, w)),
route AS (SELECT src, dst, sum(n * w) AS mass FROM menu JOIN frac USING (code) JOIN ew ON ew.word = src WHERE dst <> src AND dst NOT LIKE 'q%' AND dst <> '' GROUP BY src, dst),
out AS (SELECT src, sum(mass) AS gone FROM route GROUP BY src),
after AS (SELECT word, sum(mass) AS mass FROM (SELECT word, n - coalesce(gone, 0) AS mass FROM ew LEFT JOIN out ON src = word UNION ALL SELECT dst, mass FROM route) GROUP BY word)"""


def simulated(spark, d):
    return rules.simulate(english(spark, d), [(*r, f) for r, f in zip(RULES, FRACTIONS, strict=True)])


@query("c1_j5_simulation", SIM + " SELECT word, round(mass, 6) AS mass FROM after")
def c1(spark, d):
    return simulated(spark, d)[0].select("word", r6("mass").alias("mass"))


@query("c2_routes", SIM + " SELECT src AS word, dst, round(mass, 6) AS mass FROM route")
def c2(spark, d):
    return simulated(spark, d)[1].select("word", "dst", r6("mass").alias("mass"))


@query("a6_simulation_summary", SIM + """, ne AS (SELECT sum(n) AS t FROM ew), f AS (SELECT word, rate AS b FROM wr WHERE lang = 'fr'),
r AS (SELECT word, coalesce(ew.n, 0) * 10000.0 / t AS a, coalesce(mass, 0) * 10000.0 / t AS z, coalesce(b, 0) AS b FROM ew FULL JOIN after USING (word) FULL JOIN f USING (word), ne)
SELECT round(sum(least(a,b)),6) AS overlap_before, round(sum(least(z,b)),6) AS overlap_after, round(sum(greatest(least(z,b)-least(a,b),0)),6) AS gained, round(sum(greatest(least(a,b)-least(z,b),0)),6) AS lost, round(sum(least(z,b)-least(a,b)),6) AS net, count(*) FILTER (least(z,b)-least(a,b) > 1e-9) AS improved, count(*) FILTER (least(z,b)-least(a,b) < -1e-9) AS worsened, round(sum(least(z,b)-least(a,b)) / sum(greatest(b-a,0)),6) AS repaired FROM r""")
def a6(spark, d):
    words = english(spark, d)
    total = words.agg(F.sum("n").alias("t"))
    after, _ = simulated(spark, d)
    fr = rates.rates(rates.word_counts(toks(spark, d).filter("lang='fr'"))).select("word", F.col("rate").alias("b"))
    rows = words.join(after, "word", "full_outer").join(fr, "word", "full_outer").fillna(0).crossJoin(F.broadcast(total))
    s = rates.change(rows.select((F.col("n") * 1e4 / F.col("t")).alias("a"), (F.col("mass") * 1e4 / F.col("t")).alias("z"), "b"))
    return s.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


CONTEXT = MENU + """, cx AS (SELECT regexp_replace(word, '^q', '') AS word, idx = 0 AS start, coalesce(prev LIKE 'th%', false) AS th, idx + 1 = size AS fin, first, count(*) AS n FROM tokens WHERE lang = 'en' AND word <> 'q' GROUP BY ALL),
br0 AS (SELECT word, n, 'ED_ING' AS code, [word[:-3] || 'ing'] AS outs, 0.3 AS w FROM cx WHERE start AND word LIKE '%ed'
  UNION ALL SELECT word, n, 'ER_ING', [word[:-3] || 'ing'], 0.25 FROM cx WHERE th AND word LIKE '%er'
  UNION ALL SELECT word, n, 'RE_ER', [word[:-3] || 'er'], 0.2 FROM cx WHERE first AND word LIKE '%re'
  UNION ALL SELECT cx.word, n, 'ANY', m.outs, 0.2 FROM cx JOIN (SELECT src, list(DISTINCT dst) AS outs FROM edge GROUP BY src) m ON m.src = cx.word WHERE fin),
br AS (SELECT word, code, unnest(outs) AS dst, n * w / len(outs) AS mass FROM br0 WHERE NOT (len(outs) = 1 AND outs[1] = word)),
go AS (SELECT word, dst, code, sum(mass) AS mass FROM br GROUP BY ALL)"""


def in_context(spark, d):
    """Rules that look at a word's place, line and neighbour, and a menu of all attested outputs at line ends."""
    t = toks(spark, d, "prev", "size").filter("lang='en'").withColumn("word", W.merged(F.col("word"))).filter("word <> ''")
    start, fin, th = F.col("idx") == 0, F.col("idx") + 1 == F.col("size"), F.coalesce(F.col("prev").startswith("th"), F.lit(False))
    cells = t.groupBy("word", start.alias("start"), th.alias("th"), fin.alias("fin"), "first").agg(F.count("*").alias("n"))
    known = edges(spark, d).groupBy(F.col("src").alias("word")).agg(F.collect_set("dst").alias("outs")).withColumn("code", F.lit("ANY"))
    case = rules.ContextRule
    which = [
        case("ED_ING", "suffix", 0.3, "ed", "ing", F.col("start")),
        case("ER_ING", "suffix", 0.25, "er", "ing", F.col("th")),
        case("RE_ER", "suffix", 0.2, "re", "er", F.col("first")),
        case("ANY", "known", 0.2, where=F.col("fin")),
    ]
    return rules.simulate_in_context(cells, which, known)


@query("c1_context_simulation", CONTEXT + " SELECT word, round(sum(mass), 6) AS mass FROM (SELECT word, n AS mass FROM ew UNION ALL SELECT word, -mass FROM go UNION ALL SELECT dst, mass FROM go) GROUP BY word")
def c1b(spark, d):
    return in_context(spark, d)[0].select("word", r6("mass").alias("mass"))


@query("j5_context_routes", CONTEXT + " SELECT word, dst, code, round(mass, 6) AS mass FROM go")
def j5(spark, d):
    return in_context(spark, d)[1].select("word", "dst", "code", r6("mass").alias("mass"))


# Graph


@query("a44_degrees", MENU + ", o AS (SELECT src AS word, count(*) AS o FROM edge GROUP BY src), i AS (SELECT dst AS word, count(*) AS i FROM edge GROUP BY dst), dg AS (SELECT word, coalesce(o, 0) AS outs, coalesce(i, 0) AS ins FROM o FULL JOIN i USING (word)) SELECT e.src, e.dst, CASE WHEN a.outs = 1 AND b.ins = 1 THEN '1:1' WHEN b.ins = 1 THEN '1:n' WHEN a.outs = 1 THEN 'n:1' ELSE 'n:m' END AS class FROM edge e JOIN dg a ON a.word = e.src JOIN dg b ON b.word = e.dst")
def a44(spark, d):
    return graph.multiplicity(edges(spark, d))


@query("a45_hubs", MENU + ", m AS (SELECT dst, count(*) AS sources FROM edge GROUP BY dst HAVING count(*) > 1), c AS (SELECT DISTINCT code, dst, sources FROM (SELECT unnest(str_split(codes, '+')) AS code, dst FROM edge) JOIN m USING (dst)) SELECT code, dst, sources FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY sources DESC, dst) AS k FROM c) WHERE k <= 2")
def a45(spark, d):
    return graph.hubs(edges(spark, d), 2)


@query("c10_incident", MENU + " SELECT word, array_to_string(list_sort(list(n)), ' ') AS near FROM (SELECT src AS word, dst AS n FROM edge UNION SELECT dst, src FROM edge) WHERE word LIKE 'thin%' GROUP BY word")
def c10(spark, d):
    return graph.incident(edges(spark, d)).filter("word like 'thin%'").groupBy("word").agg(F.array_join(F.array_sort(F.collect_list("near")), " ").alias("near"))


@query("c11_c48_components")
def c11(spark, d):
    """(word, component): the smallest word reachable."""
    return graph.components(edges(spark, d))


@query("c12_shortest_path")
def c12(spark, d):
    """Shortest paths from one word to all that it reaches."""
    e = edges(spark, d)
    return graph.distances(e, spark.createDataFrame([("anating",)], "word string")).drop("seed")


@query("c12_paths")
def c12b(spark, d):
    """Shortest paths from each of a family of words to all that it reaches."""
    e = graph.settled(edges(spark, d))
    return graph.distances(e, e.filter("src like 'an%'").select(F.col("src").alias("word")))


@query("c13_rule_removal")
def c13(spark, d):
    """Words that leave their component when a rule is taken out, for all rules in one job."""
    return graph.removal_impact(edges(spark, d), {c: [c] for c, *_ in RULES})


@query("c13_word_impact")
def c13b(spark, d):
    """Component of every word before and after each rule, and each group of rules, is taken out."""
    groups = {c: [c] for c, *_ in RULES}
    for code, _, group, _ in CATALOG:
        groups.setdefault(f"group {group}", []).append(code)
    return graph.word_impact(graph.settled(edges(spark, d)), groups)


@query("c14_j7_visible", MENU + " SELECT e.src, e.dst FROM edge e JOIN ew a ON a.word = e.src AND a.n >= 3 JOIN ew b ON b.word = e.dst AND b.n >= 3")
def c14(spark, d):
    return graph.between(edges(spark, d), english(spark, d).filter("n >= 3").select("word")).select("src", "dst")


@query("c47_alternative_spellings", ", x AS (SELECT lang, word, rate FROM wr WHERE word LIKE '%k%' AND lang IN ('en','de')), y AS (SELECT lang, word, rate FROM wr) SELECT x.lang, x.word, round(x.rate, 6) AS rate, round(coalesce(y.rate, 0), 6) AS other FROM x LEFT JOIN y ON y.lang = x.lang AND y.word = translate(x.word, 'kt', 'tk') WHERE x.word NOT LIKE '%ckh%' AND x.word NOT LIKE '%cth%'")
def c47(spark, d):
    r = rates.rates(rates.word_counts(toks(spark, d), "lang"), "lang")
    x = r.filter("word like '%k%' and lang in ('en','de') and word not like '%ckh%' and word not like '%cth%'").withColumn("o", W.swapped(F.col("word")))
    y = r.select("lang", F.col("word").alias("o"), F.col("rate").alias("other"))
    return x.join(y, ["lang", "o"], "left").select("lang", "word", r6("rate").alias("rate"), r6(F.coalesce("other", F.lit(0.0))).alias("other"))
