"""Queries: orders of columns, forks, schedules, ledgers under them, and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.operators import graph, paths
from lexiflow.plans.base import query, r6
from lexiflow.plans.chain import COL, rates
from lexiflow.plans.rules import MENU, english, edges
from lexiflow.plans.search import toks
from lexiflow.sources import corpus as C

#: The English sources in order of their numbers; the first half is the trunk of the fork, the others go to its arms in turn. The last third has alternate positions, in reverse.
ORDERS = """, ncol AS (SELECT count(DISTINCT col) AS nn FROM cc), ord AS (SELECT col, row_number() OVER (ORDER BY col) - 1 AS place FROM (SELECT DISTINCT col FROM cc)),
alt AS (SELECT col, place, row_number() OVER (ORDER BY place) AS k, row_number() OVER (ORDER BY -col, place) AS m FROM ord, ncol WHERE place >= 2 * nn // 3),
pth AS (SELECT 'proposed' AS kind, 0 AS path, place, col FROM ord
  UNION ALL SELECT 'alternate', 0, place, col FROM ord, ncol WHERE place < 2 * nn // 3
  UNION ALL SELECT 'alternate', 0, s.place, d.col FROM alt s JOIN alt d ON s.k = d.m
  UNION ALL SELECT 'fork', arm, row_number() OVER (PARTITION BY arm ORDER BY place) - 1, col FROM ord, ncol, (VALUES (0), (1)) t(arm) WHERE place < nn // 2 OR place % 2 = arm),
stp AS (SELECT kind, path, place, i, j FROM (SELECT kind, path, place, col AS i, lead(col) OVER (PARTITION BY kind, path ORDER BY place) AS j FROM pth) WHERE j IS NOT NULL)"""


def columns(spark, d):
    """(col, place, arm, alt) of the English sources."""
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int").alias("col")
    cols = C.table(spark, d, "documents").filter("lang = 'en'").select(number).filter("col is not null").distinct()
    placed = paths.proposed(cols.withColumn("place", F.col("col"))).select("col", "place")
    n = placed.agg(F.count("*").alias("n"))
    rows = placed.crossJoin(F.broadcast(n))  # one row
    arm = F.when(F.col("place") >= F.floor(F.col("n") / 2), F.col("place") % 2)
    return rows.select("col", "place", arm.alias("arm"), F.when(F.col("place") >= F.floor(2 * F.col("n") / 3), -F.col("col")).alias("alt"))


def order(spark, d, kind):
    return {"proposed": paths.proposed, "alternate": paths.alternate, "fork": paths.fork}[kind](columns(spark, d))


@query("c26_orders", COL + ORDERS + " SELECT kind, path, place, col FROM pth")
def c26(spark, d):
    out = None
    for kind in ("proposed", "alternate", "fork"):
        rows = order(spark, d, kind).select(F.lit(kind).alias("kind"), "path", "place", "col")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("c26_positions", "SELECT source, s[len(s) // 2 + 1] AS place FROM (SELECT source, list_sort(list(DISTINCT doc_id // 4)) AS s FROM documents WHERE lang = 'en' GROUP BY source)", base=False)
def c26b(spark, d):
    """The place of a source: the middle element of its sheets."""
    pools = C.table(spark, d, "documents").filter("lang = 'en'").select("source", F.floor(F.col("doc_id") / 4).alias("sheet"))
    return paths.middle_places(pools, "source", "sheet")


#: Parts of each step's ledger that need no allocation, on one line and on the fork.
STEPWORDS = ORDERS + """, sw AS (SELECT s.kind, s.i, s.j, word, coalesce(sum(rate) FILTER (col = s.i), 0) AS a, coalesce(sum(rate) FILTER (col = s.j), 0) AS b FROM (SELECT DISTINCT kind, i, j FROM stp) s JOIN cr ON cr.col IN (s.i, s.j) GROUP BY ALL),
gp AS (SELECT * FROM (SELECT kind, path, word, place, lead(place) OVER w AS back, least(rate, lead(rate) OVER w) AS mass FROM pth JOIN cr USING (col) WINDOW w AS (PARTITION BY kind, path, word ORDER BY place)) WHERE back - place > 1),
pk AS (SELECT kind, i, j, word, max(o) AS o, max(r) AS r FROM (SELECT kind, path, place, word, mass AS o, 0.0 AS r FROM gp UNION ALL SELECT kind, path, back - 1, word, 0.0, mass FROM gp) JOIN stp USING (kind, path, place) GROUP BY ALL),
sl AS (SELECT sw.*, coalesce(o, 0) AS dormant_out, coalesce(r, 0) AS dormant_in FROM sw LEFT JOIN pk USING (kind, i, j, word))"""


@query("w4_parked_on_orders", COL + STEPWORDS + " SELECT kind, i, j, round(sum(a), 6) AS source, round(sum(b), 6) AS target, round(sum(least(a, b)), 6) AS kept, round(sum(dormant_out), 6) AS dormant_out, round(sum(dormant_in), 6) AS dormant_in, round(sum(greatest(a - b - dormant_out, 0)), 6) AS loss, round(sum(greatest(b - a - dormant_in, 0)), 6) AS gain FROM sl GROUP BY kind, i, j")
def w4(spark, d):
    """Kept and parked mass of every step of the three orders."""
    r, out = graph.settled(rates(spark, d).select("col", "word", "rate")), None
    for kind in ("proposed", "alternate", "fork"):
        rows = paths.step_words(r, order(spark, d, kind)).withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    total = lambda c, n: r6(F.sum(c)).alias(n)
    more = lambda a, b, p: F.greatest(F.col(a) - F.col(b) - F.col(p), F.lit(0.0))
    return out.groupBy("kind", "i", "j").agg(total("a", "source"), total("b", "target"), total(F.least("a", "b"), "kept"), total("dormant_out", "dormant_out"), total("dormant_in", "dormant_in"), total(more("a", "b", "dormant_out"), "loss"), total(more("b", "a", "dormant_in"), "gain"))


@query("c25_bridged_steps", COL + ORDERS + ", lf AS (SELECT col, row_number() OVER (ORDER BY place) - 1 AS place FROM ord WHERE place % 3 <> 1), st AS (SELECT * FROM (SELECT col AS i, lead(col) OVER (ORDER BY place) AS j FROM lf) WHERE j IS NOT NULL), sw AS (SELECT i, j, word, coalesce(sum(rate) FILTER (col = i), 0) AS a, coalesce(sum(rate) FILTER (col = j), 0) AS b FROM st JOIN cr ON cr.col IN (i, j) GROUP BY ALL) SELECT i, j, round(sum(least(a, b)), 6) AS kept, round(sum(greatest(a - b, 0)), 6) AS loss, round(sum(greatest(b - a, 0)), 6) AS gain FROM sw GROUP BY i, j")
def c25(spark, d):
    """The chain of all columns with every third one hidden: steps bridge the gaps."""
    hidden = columns(spark, d).filter("place % 3 = 1").select("col")
    rows = paths.step_words(rates(spark, d), paths.without(order(spark, d, "proposed"), hidden))
    zero = F.lit(0.0)
    return rows.groupBy("i", "j").agg(r6(F.sum(F.least("a", "b"))).alias("kept"), r6(F.sum(F.greatest(F.col("a") - F.col("b"), zero))).alias("loss"), r6(F.sum(F.greatest(F.col("b") - F.col("a"), zero))).alias("gain"))


# Schedules: each rule's degree at a step depends on the step's place on its path; an even step is one whose first column has an even number.

DEGREES = [("ED_ING", 1.0, 1.0), ("ER_ING", 0.5, -0.5), ("RE_ER", -0.5, 0.0), ("EN_ER", 0.0, -1.0)]
SCHED = ORDERS + ", rule AS (SELECT * FROM (VALUES ('ED_ING', 1.0, 1.0), ('ER_ING', 0.5, -0.5), ('RE_ER', -0.5, 0.0), ('EN_ER', 0.0, -1.0)) t(code, even, odd)), sc AS (SELECT code, kind, i, j, CASE WHEN i % 2 = 0 THEN even ELSE odd END AS degree FROM rule, (SELECT DISTINCT kind, i, j FROM stp))"


def schedule(spark, line):
    """(code, i, j, degree) for the steps of a path table."""
    rules = spark.createDataFrame(DEGREES, "code string, even double, odd double")
    step = paths.steps(line).select("i", "j").distinct()
    return step.crossJoin(F.broadcast(rules)).select("code", "i", "j", F.when(F.col("i") % 2 == 0, F.col("even")).otherwise(F.col("odd")).alias("degree"))  # a handful of rules


def runs(spark, d, line):
    closed = paths.steps(line).filter("i % 3 = 0").select("i", "j").distinct()
    return paths.scheduled(edges(spark, d), schedule(spark, line), [c for c, *_ in DEGREES], closed, "ing")


@query(
    "f17_scheduled_edges",
    MENU + COL + SCHED + """, dg AS (SELECT e.src, e.dst, i, j, max(degree) AS up, min(degree) AS down FROM edge e JOIN sc ON kind = 'fork' AND list_contains(str_split(e.codes, '+'), sc.code) GROUP BY ALL),
    rn AS (SELECT i, j, CASE WHEN greatest(up, 0) > greatest(-down, 0) THEN src ELSE dst END AS s, CASE WHEN greatest(up, 0) > greatest(-down, 0) THEN dst ELSE src END AS t, greatest(up, -down, 0) AS factor FROM dg WHERE greatest(up, 0) <> greatest(-down, 0))
    SELECT i, j, s AS src, t AS dst, sum(factor) AS factor FROM rn WHERE NOT (i % 3 = 0 AND t LIKE '%ing%' AND s NOT LIKE '%ing%') GROUP BY ALL""",
)
def f17(spark, d):
    """Which edges run at which step of the fork, in which direction and to what share."""
    return runs(spark, d, order(spark, d, "fork"))


@query(
    "f18_spanned_schedule",
    COL + SCHED + """, lf AS (SELECT col, place, row_number() OVER (ORDER BY place) - 1 AS at FROM ord WHERE place % 3 <> 1), st AS (SELECT * FROM (SELECT col AS i, lead(col) OVER (ORDER BY place) AS j, place AS p, lead(place) OVER (ORDER BY place) AS q FROM lf) WHERE q - p > 1),
    sm AS (SELECT code, st.i, st.j, greatest(-1.0, least(1.0, sum(degree))) AS degree FROM st JOIN stp ON stp.kind = 'proposed' AND stp.place >= p AND stp.place < q JOIN sc ON sc.kind = 'proposed' AND sc.i = stp.i AND sc.j = stp.j GROUP BY ALL)
    SELECT code, i, j, degree FROM sm UNION ALL SELECT code, i, j, degree FROM sc WHERE kind = 'proposed'""",
)
def f18(spark, d):
    """The schedule of the whole line, with cells for the steps that bridge hidden columns."""
    line = order(spark, d, "proposed")
    left = paths.without(line, columns(spark, d).filter("place % 3 = 1").select("col"))
    return paths.spanned(schedule(spark, line), paths.spans(line, left))


def fork_ledger(spark, d):
    line = graph.settled(order(spark, d, "fork"))
    r = graph.settled(rates(spark, d).select("col", F.regexp_replace("word", "^q", "").alias("word"), "rate").filter("word <> ''").groupBy("col", "word").agg(F.sum("rate").alias("rate")))
    e = graph.settled(edges(spark, d))
    closed = paths.steps(line).filter("i % 3 = 0").select("i", "j").distinct()
    run = paths.scheduled(e, schedule(spark, line), [c for c, *_ in DEGREES], closed, "ing")
    return line, *paths.ledgers(paths.step_words(r, line), e, run)


@query("c24_scheduled_ledgers")
def c24(spark, d):
    """Ledger of each step of the fork under the schedule. Tested against a brute-force maximum."""
    _, rows, _ = fork_ledger(spark, d)
    t = paths.totals(rows)
    return t.select("i", "j", *[r6(c).alias(c) for c in t.columns[2:]])


@query("c28_lineages")
def c28(spark, d):
    """Words that the fork's flows link to each seed, forward and backward, on each arm; seeds are the words with most tokens at either end of a rule."""
    line, _, flows = fork_ledger(spark, d)
    linked = edges(spark, d).select(F.explode(F.array("src", "dst")).alias("word")).distinct()
    seeds = english(spark, d).join(linked, "word", "left_semi").orderBy(F.desc("n"), "word").limit(20)
    return paths.lineage(flows, line, seeds.select("word"))


@query("c29_middle_shares", COL + ORDERS + ", t AS (SELECT p.col AS middle, p.place AS q, cr.word, cr.rate, o.place AS pos FROM ord p, ncol, ord o JOIN cr ON cr.col = o.col WHERE p.place BETWEEN 1 AND nn - 2 AND abs(o.place - p.place) <= 1), m AS (SELECT middle, word, coalesce(max(rate) FILTER (pos = q - 1), 0) AS o, coalesce(max(rate) FILTER (pos = q), 0) AS mid, coalesce(max(rate) FILTER (pos = q + 1), 0) AS a FROM t GROUP BY ALL) SELECT middle, word, round(greatest(0.0, least(1.0, (0.5 + (a - o) * (mid - o)) / (1.0 + (a - o) * (a - o)))), 6) AS share FROM m")
def c29(spark, d):
    """How far each inner column of the line has come from the one before to the one after, word by word."""
    from lexiflow.operators.chain import middle_share

    placed = columns(spark, d).select("col", "place")
    n = placed.agg(F.max("place").alias("last"))
    side = F.explode(F.array(*[F.struct((F.col("place") + k).alias("q"), F.lit(-k).alias("at")) for k in (-1, 0, 1)]))
    rows = rates(spark, d).join(F.broadcast(placed), "col").select("word", "rate", side.alias("s")).select("word", "rate", "s.q", "s.at")
    rows = rows.join(F.broadcast(placed.select(F.col("col").alias("middle"), F.col("place").alias("q"))), "q").crossJoin(F.broadcast(n)).filter("q between 1 and last - 1")
    at = lambda k, name: F.coalesce(F.max(F.when(F.col("at") == k, F.col("rate"))), F.lit(0.0)).alias(name)
    m = rows.groupBy("middle", "word").agg(at(-1, "o"), at(0, "m"), at(1, "a"))
    return m.select("middle", "word", r6(middle_share(F.col("o"), F.col("m"), F.col("a"), 0.5)).alias("share"))
