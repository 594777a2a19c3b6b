"""Queries: the chain of columns and the allocation of mass along its steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.functions import words as W
from lexiflow.operators import capacity, chain, graph
from lexiflow.operators import rates as rate_ops
from lexiflow.plans.base import query, r6
from lexiflow.plans.rules import MENU, edges
from lexiflow.plans.families import FAM, site, words
from lexiflow.plans.search import bag, toks
from lexiflow.sources import corpus as C

COL = """, cc AS (SELECT CAST(source[4:] AS INT) AS col, word, count(*) AS n, count(DISTINCT page) AS pages FROM tokens WHERE lang = 'en' GROUP BY ALL),
cr AS (SELECT *, sum(n) OVER (PARTITION BY col) AS total, n * 10000.0 / sum(n) OVER (PARTITION BY col) AS rate FROM cc)"""


def numbered(spark, d):
    """Words of the English sources that have a number, with it (col)."""
    return bag(spark, d, keep=(), lang="en", col=F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")).filter("col is not null")


def counts(spark, d):
    return chain.column_counts(numbered(spark, d), "col")


def order(spark, d) -> list[int]:
    """The columns of the chain: the numbers of all sources of English documents, a row each."""
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int").alias("col")
    return [r.col for r in C.table(spark, d, "documents").filter("lang='en'").select(number).filter("col is not null").distinct().sort("col").collect()]


def rates(spark, d):
    """Rates by column; pages are not counted, so only different words of a column are shuffled, and once."""
    return chain.column_rates(graph.settled(rate_ops.word_counts(numbered(spark, d), "col")), "col")


@query("a28_c26_columns", COL + " SELECT col, word, n, pages FROM cc")
def a28(spark, d):
    return counts(spark, d)


@query("a29_t2_series", COL + ", t AS (SELECT word FROM cr GROUP BY word ORDER BY round(sum(rate), 6) DESC, word LIMIT 12) SELECT col, CASE WHEN word IN (SELECT word FROM t) OR word = 'thering' THEN word ELSE '(other)' END AS band, round(sum(rate), 6) AS rate, min(total) < 20 AS sparse FROM cr GROUP BY ALL")
def a29(spark, d):
    return chain.bands(rates(spark, d), "col", 12, ("thering",)).select("col", "band", r6("rate").alias("rate"), "sparse")


@query("a30_series_by_front", COL + ", f AS (SELECT col, regexp_extract(word, '^([^ao]*)', 1) AS front, sum(rate) AS rate, min(total) AS total FROM cr GROUP BY ALL), t AS (SELECT front FROM f GROUP BY front ORDER BY round(sum(rate), 6) DESC, front LIMIT 8) SELECT col, CASE WHEN front IN (SELECT front FROM t) THEN front ELSE '(other)' END AS band, round(sum(rate), 6) AS rate FROM f GROUP BY ALL")
def a30(spark, d):
    r = rates(spark, d).withColumn("front", F.regexp_extract("word", "^([^ao]*)", 1)).groupBy("col", "front").agg(F.sum("rate").alias("rate"), F.first("total").alias("total"))
    return chain.bands(r, "col", 8, key="front").select("col", "band", r6("rate").alias("rate"))


@query("a31_bigrams", COL + ", u AS (SELECT col, rate, list_concat(['^'], regexp_extract_all(word, '(ckh|cth|cph|cfh|ch|sh|e{1,4}|i{1,4}|.)'), ['$']) AS u FROM cr), b AS (SELECT col, rate, unnest(list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1])) AS bigram FROM u) SELECT col, bigram, round(sum(rate), 6) AS rate FROM b GROUP BY ALL")
def a31(spark, d):
    return rates(spark, d).select("col", "rate", F.explode(chain.bigrams(F.col("word"))).alias("bigram")).groupBy("col", "bigram").agg(F.sum("rate").alias("rate")).select("col", "bigram", r6("rate").alias("rate"))


STEP = COL + ", st AS (SELECT s AS step, word, coalesce(sum(rate) FILTER (col = s), 0) AS a, coalesce(sum(rate) FILTER (col = s + 1), 0) AS b FROM cr, (SELECT DISTINCT col AS s FROM cc WHERE col < (SELECT max(col) FROM cc)) t WHERE col IN (s, s + 1) GROUP BY ALL)"


@query("c24_step_ledgers", STEP + " SELECT step, round(sum(least(a,b)),6) AS kept, round(sum(greatest(a-b,0)),6) AS loss, round(sum(greatest(b-a,0)),6) AS gain FROM st GROUP BY step")
def c24(spark, d):
    p = chain.step_pairs(rates(spark, d), "col", order(spark, d))
    none = spark.createDataFrame([], "step int, flow double")
    return capacity.accounting(p, none, "step").select("step", r6("retained").alias("kept"), r6("loss").alias("loss"), r6("gain").alias("gain"))


def step_flows(spark, d):
    """Pairs of words per step with their parked mass, and the allocation of the rest along the rule edges, all steps in one job."""
    pairs = graph.settled(chain.parked_pairs(graph.settled(rates(spark, d)), "col", order(spark, d)))
    loss, gain = chain.movable(pairs)
    routes = capacity.open_routes(loss, gain, edges(spark, d).select("src", "dst"), "step")
    return pairs, capacity.allocate(loss, gain, routes, "step")


@query("c24_step_flows")
def c24b(spark, d):
    """Ledger of each step with flows and dormancy. Checked in the tests against a brute-force maximum."""
    return chain.ledgers(*step_flows(spark, d)).select("step", *[r6(c).alias(c) for c in ("source", "target", "kept", "routed", "unplaced", "unfilled", "dormant_out", "dormant_in")])


@query("a33_rules_by_step")
def a33b(spark, d):
    """Routed mass of each step by label of rules, the six largest and the rest."""
    _, flows = step_flows(spark, d)
    labelled = flows.join(edges(spark, d), ["src", "dst"]).withColumn("label", F.array_join("codes", "+"))
    return chain.mass_by_label(labelled, 6).select("step", "label", r6("mass").alias("mass"))


#: Source and target language of each leg.
LEGS = [("en", "fr"), ("fr", "es"), ("en", "es"), ("es", "fr"), ("fr", "en"), ("es", "en"), ("en", "de"), ("de", "en")]


@query("c35_leg_flows")
def c35(spark, d):
    """Ledgers of eight pairs of languages, one allocation keyed by leg."""
    r = rate_ops.rates(rate_ops.word_counts(toks(spark, d), "lang"), "lang")
    pairs = graph.settled(chain.leg_pairs(r, "lang", LEGS).withColumnRenamed("step", "leg"))
    loss, gain = capacity.budgets(pairs, "leg")
    flows = capacity.allocate(loss, gain, capacity.open_routes(loss, gain, edges(spark, d).select("src", "dst"), "leg"), "leg")
    return capacity.accounting(pairs, flows, "leg").select("leg", *[r6(c).alias(c) for c in ("retained", "loss", "gain", "matched", "unplaced", "unfilled")])


@query("a32_bigram_ledger", STEP + ", u AS (SELECT step, a, b, list_concat(['^'], regexp_extract_all(word, '(ckh|cth|cph|cfh|ch|sh|e{1,4}|i{1,4}|.)'), ['$']) AS u FROM st), g AS (SELECT step, unnest(list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1])) AS bigram, a, b FROM u), s AS (SELECT step, bigram, sum(a) AS a, sum(b) AS b FROM g GROUP BY ALL) SELECT step, bigram, round(least(a,b),6) AS kept, round(greatest(a-b,0),6) AS sent, round(greatest(b-a,0),6) AS received FROM s")
def a32(spark, d):
    p = chain.step_pairs(rates(spark, d), "col", order(spark, d)).select("step", "a", "b", F.explode(chain.bigrams(F.col("word"))).alias("bigram"))
    s = p.groupBy("step", "bigram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return s.select("step", "bigram", r6(F.least("a", "b")).alias("kept"), r6(F.greatest(F.col("a") - F.col("b"), F.lit(0.0))).alias("sent"), r6(F.greatest(F.col("b") - F.col("a"), F.lit(0.0))).alias("received"))


@query("c25_hidden_columns", COL + ", s AS (SELECT word, coalesce(max(rate) FILTER (col=1),0) AS a, coalesce(max(rate) FILTER (col=3),0) AS b FROM cr WHERE col IN (1,3) GROUP BY word) SELECT round(sum(least(a,b)),6) AS kept FROM s")
def c25(spark, d):
    order = chain.hide([1, 2, 3], {2})
    return chain.step_pairs(rates(spark, d), "col", order).agg(r6(F.sum(F.least("a", "b"))).alias("kept"))


@query("w4_dormancy", COL + ", g AS (SELECT word, col AS l, lead(col) OVER w AS back, least(rate, lead(rate) OVER w) AS mass FROM cr WINDOW w AS (PARTITION BY word ORDER BY col)) SELECT word, l AS \"left\", back, round(mass, 6) AS mass FROM g WHERE back - l > 1")
def w4(spark, d):
    return chain.dormancy(rates(spark, d), "col").select("word", "left", "back", r6("mass").alias("mass"))


@query("a34_kept_since", COL + ", c AS (SELECT DISTINCT col FROM cc), f AS (SELECT w.word, list(coalesce(cr.rate, 0) ORDER BY c.col) AS r FROM (SELECT DISTINCT word FROM cr) w CROSS JOIN c LEFT JOIN cr ON cr.word = w.word AND cr.col = c.col GROUP BY w.word), mm AS (SELECT word, c.col, o.col AS origin, list_min(r[o.col + 1:c.col + 1]) AS least FROM f, c, c o WHERE o.col <= c.col), x AS (SELECT col, origin, least - coalesce(lag(least) OVER (PARTITION BY word, col ORDER BY origin), 0) AS mass FROM mm) SELECT col, origin, round(sum(mass), 6) AS mass FROM x WHERE mass > 0 GROUP BY ALL")
def a34(spark, d):
    return chain.kept_since(rates(spark, d), "col", len(order(spark, d))).select("col", "origin", r6("mass").alias("mass"))


CAPS = MENU + ", pc AS (SELECT CAST(source[4:] AS INT) % 2 AS pop, regexp_replace(word, '^q', '') AS word, count(*) AS n FROM tokens WHERE lang = 'en' AND word <> 'q' GROUP BY ALL), pw AS (SELECT pop, word, n * 10000.0 / sum(n) OVER (PARTITION BY pop) AS rate FROM pc), ab AS (SELECT word, coalesce(max(rate) FILTER (pop = 0), 0) AS a, coalesce(max(rate) FILTER (pop = 1), 0) AS b FROM pw GROUP BY word), cp AS (SELECT e.src, e.dst, greatest(s.a - s.b, 0) AS v, greatest(t.b - t.a, 0) AS w, least(greatest(s.a - s.b, 0), greatest(t.b - t.a, 0)) AS cap FROM edge e JOIN ab s ON s.word = e.src JOIN ab t ON t.word = e.dst)"


def halves(spark, d):
    """Rates of the merged words of English text in sources of even (a) and odd (b) number."""
    t = words(spark, d).withColumn("word", W.merged(F.col("word"))).filter("word <> ''")
    r = rate_ops.rates(graph.settled(rate_ops.word_counts(t, "pop")), "pop")
    return rate_ops.side_by_side(r.filter("pop = 'A'"), r.filter("pop = 'B'"))


def flow_inputs(spark, d):
    p = graph.settled(halves(spark, d))
    loss, gain = capacity.budgets(p)
    return p, loss, gain, capacity.open_routes(loss, gain, edges(spark, d).select("src", "dst"))


@query("c15_capacity_bound", CAPS + ", s AS (SELECT src, least(max(v), sum(cap)) AS x FROM cp WHERE cap > 0 GROUP BY src), t AS (SELECT dst, least(max(w), sum(cap)) AS x FROM cp WHERE cap > 0 GROUP BY dst) SELECT round((SELECT sum(x) FROM s), 6) AS sent, round((SELECT sum(x) FROM t), 6) AS received")
def c15b(spark, d):
    p = halves(spark, d)
    loss, gain = capacity.budgets(p)
    e = edges(spark, d).select("src", "dst").join(loss, "src").withColumnRenamed("v", "lv").join(gain, "dst").withColumnRenamed("v", "gv").withColumn("cap", F.least("lv", "gv"))
    side = lambda c, v, n: e.groupBy(c).agg(F.least(F.max(v), F.sum("cap")).alias("x")).agg(r6(F.sum("x")).alias(n))
    return side("src", "lv", "sent").crossJoin(side("dst", "gv", "received"))


@query("c15_c31_accounting")
def c15(spark, d):
    """Maximum allocation of the halves' differences along the rule edges. Checked in the tests against brute force."""
    p, loss, gain, e = flow_inputs(spark, d)
    flows = capacity.allocate(loss, gain, e)
    return capacity.accounting(p, flows).select(*[r6(c).alias(c) for c in ("retained", "loss", "gain", "matched", "unplaced", "unfilled")])


@query("a33_a35_mass_by_rule")
def a33(spark, d):
    """Allocated mass by label of rules, and into or out of a set of words."""
    _, loss, gain, e = flow_inputs(spark, d)
    flows = capacity.allocate(loss, gain, e).join(edges(spark, d), ["src", "dst"])
    removed = F.col("src").startswith("th") | F.col("dst").startswith("th")
    return flows.groupBy(F.array_join("codes", "+").alias("label")).agg(r6(F.sum("flow")).alias("mass"), r6(F.coalesce(F.sum(F.when(removed, F.col("flow"))), F.lit(0.0))).alias("removed"))


@query("c16_policies", FAM + ", r AS (SELECT prefix, tail, k_A*10000.0/n_a AS ka, t_A*10000.0/n_a AS ta, k_B*10000.0/n_b AS kb, t_B*10000.0/n_b AS tb, least(t_A, k_B) >= 3 AS common FROM pr, sz) SELECT round(sum(least(ka,kb)+least(ta,tb)),6) AS base, round(sum(least(ka,kb)+least(ta,tb)+least(greatest(ta-tb,0),greatest(kb-ka,0))),6) AS \"all\", round(sum(least(ka,kb)+least(ta,tb)+CASE WHEN common THEN least(greatest(ta-tb,0),greatest(kb-ka,0)) ELSE 0 END),6) AS common FROM r")
def c16(spark, d):
    """Credit of families under three policies: no exchange, any t to k exchange, exchanges of common words only."""
    from lexiflow.plans.families import pairs, sizes

    p = pairs(spark, d)
    r = p.crossJoin(F.broadcast(sizes(spark, d, p).select("n_a", "n_b")))
    v = {f"{s}{q}": F.col(f"{s}_{q}") * 1e4 / F.col(f"n_{q.lower()}") for s in "kt" for q in "AB"}
    same = F.least(v["kA"], v["kB"]) + F.least(v["tA"], v["tB"])
    swap = F.least(F.greatest(v["tA"] - v["tB"], F.lit(0.0)), F.greatest(v["kB"] - v["kA"], F.lit(0.0)))
    common = F.when(F.least("t_A", "k_B") >= 3, swap).otherwise(0.0)
    return r.agg(r6(F.sum(same)).alias("base"), r6(F.sum(same + swap)).alias("all"), r6(F.sum(same + common)).alias("common"))


@query("c23_member_connections", FAM + ", w AS (SELECT DISTINCT prefix, tail, site, word FROM fw), x AS (SELECT a.word AS src, b.word AS dst, p.k_A, p.t_A, p.k_B, p.t_B FROM w a JOIN w b ON a.prefix = b.prefix AND a.tail = b.tail AND a.site = 'o' AND b.site = 'a' JOIN pr p ON p.prefix = a.prefix AND p.tail = a.tail) SELECT src, dst, CASE WHEN t_A = 0 THEN 'absent' WHEN least(t_A, k_B) < 3 THEN 'excluded' WHEN t_A > t_B AND k_B > k_A THEN 'allocated' ELSE 'candidate' END AS status FROM x")
def c23(spark, d):
    from lexiflow.plans.families import pairs

    w = site(spark, d).select("prefix", "tail", "site", "word").distinct()
    src, dst = w.filter("site='o'").select("prefix", "tail", F.col("word").alias("src")), w.filter("site='a'").select("prefix", "tail", F.col("word").alias("dst"))
    rows = src.join(dst, ["prefix", "tail"]).join(pairs(spark, d), ["prefix", "tail"])
    status = F.when(F.col("t_A") == 0, "absent").when(F.least("t_A", "k_B") < 3, "excluded").when((F.col("t_A") > F.col("t_B")) & (F.col("k_B") > F.col("k_A")), "allocated").otherwise("candidate")
    return rows.select("src", "dst", status.alias("status"))


@query("f16_f17_degrees", MENU + ", dg AS (SELECT * FROM (VALUES ('ED_ING',1.0),('ER_ING',0.5),('RE_ER',-0.5),('EN_ER',1.0),('RE_IN',0.0)) t(code, g)), m AS (SELECT src, dst, min(g) AS lo, max(g) AS hi FROM menu JOIN dg USING (code) WHERE dst IN (SELECT word FROM ew) AND dst <> src GROUP BY src, dst) SELECT src, dst, CASE WHEN lo >= 0 THEN lo WHEN hi <= 0 THEN hi ELSE 0 END AS degree, dst LIKE '%ing%' AND src NOT LIKE '%ing%' AS adds FROM m")
def f17(spark, d):
    degree = F.create_map(*[F.lit(x) for kv in {"ED_ING": 1.0, "ER_ING": 0.5, "RE_ER": -0.5, "EN_ER": 1.0, "RE_IN": 0.0}.items() for x in kv])
    return edges(spark, d).select("src", "dst", chain.label_degree(F.col("codes"), degree).alias("degree"), chain.adds_ending(F.col("src"), F.col("dst"), "ing").alias("adds"))


@query("c28_lineage", MENU + COL.replace(", cc AS", ", cc AS", 1) + ", fl AS (SELECT s AS step, e.src, e.dst FROM edge e, range(0, 3) t(s) WHERE EXISTS (SELECT 1 FROM cr WHERE col = s AND word = e.src) AND EXISTS (SELECT 1 FROM cr WHERE col = s + 1 AND word = e.dst)), l1 AS (SELECT DISTINCT dst AS word FROM fl WHERE step = 0 AND src IN ('anre', 'anen', 'ered')), l2 AS (SELECT DISTINCT dst AS word FROM fl WHERE step = 1 AND src IN (SELECT word FROM l1)), l3 AS (SELECT DISTINCT dst AS word FROM fl WHERE step = 2 AND src IN (SELECT word FROM l2)) SELECT unnest(['anre', 'anen', 'ered']) AS word, 0 AS \"column\" UNION ALL SELECT word, 1 FROM l1 UNION ALL SELECT word, 2 FROM l2 UNION ALL SELECT word, 3 FROM l3")
def c28(spark, d):
    r, e = rates(spark, d), edges(spark, d).select("src", "dst")
    has = lambda s, c: r.filter(F.col("col") == s).select(F.col("word").alias(c))
    flows = None
    for s in range(3):
        part = e.join(has(s, "src"), "src", "left_semi").join(has(s + 1, "dst"), "dst", "left_semi").select(F.lit(s).alias("step"), "src", "dst")
        flows = part if flows is None else flows.unionByName(part)
    return chain.lineage(flows, ["anre", "anen", "ered"], 3)


@query("c29_middle_share", COL + ", m AS (SELECT word, coalesce(max(rate) FILTER (col=0),0) AS o, coalesce(max(rate) FILTER (col=1),0) AS mid, coalesce(max(rate) FILTER (col=2),0) AS a FROM cr WHERE col IN (0,1,2) GROUP BY word) SELECT word, round(greatest(0.0, least(1.0, (0.5 + (a-o)*(mid-o)) / (1.0 + (a-o)*(a-o)))), 6) AS share FROM m")
def c29(spark, d):
    at = lambda i, n: F.coalesce(F.max(F.when(F.col("col") == i, F.col("rate"))), F.lit(0.0)).alias(n)
    rows = rates(spark, d).filter("col in (0,1,2)").groupBy("word").agg(at(0, "o"), at(1, "mid"), at(2, "a"))
    return rows.select("word", r6(chain.middle_share(F.col("o"), F.col("mid"), F.col("a"), 0.5)).alias("share"))


@query("c27_members", MENU + " SELECT word, word LIKE '%ing' AS pattern, word IN (SELECT src FROM edge UNION SELECT dst FROM edge) AS linked, regexp_extract(word, '^([^ao]*)', 1) AS front FROM ew WHERE n >= 5")
def c27(spark, d):
    from lexiflow.plans.rules import english

    e = edges(spark, d)
    linked = e.select(F.col("src").alias("word")).union(e.select("dst")).distinct().withColumn("linked", F.lit(True))
    rows = english(spark, d).filter("n >= 5").join(linked, "word", "left")
    return rows.select("word", F.col("word").like("%ing").alias("pattern"), F.coalesce("linked", F.lit(False)).alias("linked"), F.regexp_extract("word", "^([^ao]*)", 1).alias("front"))


@query("j8_exact_pairs", MENU + ", v AS (SELECT src, dst, unnest(['', 'q']) AS q FROM edge), w AS (SELECT DISTINCT word FROM wc WHERE lang='en') SELECT q || src AS src, q || dst AS dst FROM v WHERE q || src IN (SELECT word FROM w) AND q || dst IN (SELECT word FROM w)")
def j8(spark, d):
    words = toks(spark, d).filter("lang='en'").select("word").distinct()
    v = edges(spark, d).select("src", "dst", F.explode(F.array(F.lit(""), F.lit("q"))).alias("q")).select(F.concat("q", "src").alias("src"), F.concat("q", "dst").alias("dst"))
    return graph.between(v, words).select("src", "dst")
