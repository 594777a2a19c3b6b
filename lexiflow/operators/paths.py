"""Chains that fork: paths of columns, schedules on their steps, ledgers and lineage.

A path table (path, place, col) lists the columns of each path in order; a step
(i, j) leads from a column to the next one on some path. Such tables have a row
per column and path and are broadcast; words never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.operators import graph, network
from lexiflow.operators.chain import adds_ending

STEP = ["i", "j"]


# Orders


def proposed(columns: DataFrame) -> DataFrame:
    """One path of columns (col, place) in the order of their places, numbered from 0."""
    return columns.select(F.lit(0).alias("path"), (F.row_number().over(Window.orderBy("place", "col")) - 1).alias("place"), "col")  # a row per column


def alternate(columns: DataFrame) -> DataFrame:
    """One path of columns (col, place, alt): those with an alternate position are dealt anew, by it, over the slots that they hold."""
    line = columns.select("col", "alt", (F.row_number().over(Window.orderBy("place", "col")) - 1).alias("place"))
    mine = line.filter("alt is not null")
    slots = mine.select("place", F.row_number().over(Window.orderBy("place")).alias("k"))
    dealt = mine.select("col", F.row_number().over(Window.orderBy("alt", "place")).alias("k"))
    return line.filter("alt is null").select("place", "col").unionByName(slots.join(dealt, "k").select("place", "col")).select(F.lit(0).alias("path"), "place", "col")


def fork(columns: DataFrame) -> DataFrame:
    """A path per arm of columns (col, place, arm): the trunk (arm null) up to its last column, then the arm."""
    arms = columns.filter("arm is not null").select(F.col("arm").alias("path")).distinct()
    rows = columns.join(F.broadcast(arms), F.col("arm").isNull() | (F.col("arm") == F.col("path")))
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.col("arm").isNotNull(), "place", "col")) - 1
    return rows.select("path", place.alias("place"), "col")


def without(paths: DataFrame, hidden: DataFrame) -> DataFrame:
    """Paths without the columns ``hidden`` (col): neighbours close up; a path that is then the beginning of another goes."""
    left = paths.join(F.broadcast(hidden.select("col")), "col", "left_anti")
    left = left.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("place")) - 1).alias("place"), "col")
    lists = left.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "col"))), lambda x: x["col"]).alias("cols"))
    other = lists.select(F.col("path").alias("other"), F.col("cols").alias("longer"))
    longer = (F.size("longer") > F.size("cols")) | ((F.size("longer") == F.size("cols")) & (F.col("other") < F.col("path")))
    same = F.slice("longer", F.lit(1), F.size("cols")) == F.col("cols")
    return left.join(lists.join(other, longer & same, "left_semi").select("path"), "path", "left_anti")


def steps(paths: DataFrame) -> DataFrame:
    """(path, place, i, j): the steps of each path; place is that of i."""
    after = F.lead("col").over(Window.partitionBy("path").orderBy("place"))
    return paths.select("path", "place", F.col("col").alias("i"), after.alias("j")).filter("j is not null")


def middle_places(pools: DataFrame, group: str, position: str) -> DataFrame:
    """(group, place): the middle element of each group's positions (the upper of two)."""
    values = pools.select(group, position).distinct()
    n = values.groupBy(group).agg(F.count("*").alias("n"))
    # the position that as many come before as the middle wants: counted by range, then inside the range that holds it
    low = values.groupBy(group).agg(F.min(position).alias("low"), F.max(position).alias("high"))
    part = F.floor((F.col(position) - F.col("low")) * 1024 / (F.col("high") - F.col("low") + 1))
    rows = values.join(low, group).join(n, group).withColumn("part", part)
    counts = rows.groupBy(group, "part", "n").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.partitionBy(group).orderBy("part")) - F.col("c"))
    held = counts.filter((F.col("before") <= F.floor(F.col("n") / 2)) & (F.col("before") + F.col("c") > F.floor(F.col("n") / 2))).select(group, "part", "before")
    inside = rows.join(held, [group, "part"]).withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(position)) - 1 + F.col("before"))
    return inside.filter(F.col("k") == F.floor(F.col("n") / 2)).select(group, F.col(position).alias("place"))


# Schedules: (code, i, j, degree)


def spans(before: DataFrame, after: DataFrame) -> DataFrame:
    """(i, j, k, l): the steps (k, l) of paths ``before`` that each step (i, j) of ``after`` bridges."""
    at = before.select("path", "col", "place")
    new = steps(after).select("path", *STEP)
    ends = new.join(at.withColumnsRenamed({"col": "i", "place": "first"}), ["path", "i"]).join(at.withColumnsRenamed({"col": "j", "place": "last"}), ["path", "j"])
    old = steps(before).select("path", "place", F.col("i").alias("k"), F.col("j").alias("l"))
    return ends.join(old, "path").filter("place >= first and place < last").select(*STEP, "k", "l").distinct()


def spanned(schedule: DataFrame, bridged: DataFrame) -> DataFrame:
    """The schedule with cells for steps that bridge others: the sum of their degrees within -1 and 1; a cell of its own wins."""
    wide = bridged.join(bridged.groupBy(*STEP).count().filter("count > 1").select(*STEP), STEP)
    cells = schedule.withColumnsRenamed({"i": "k", "j": "l"})
    made = wide.join(cells, ["k", "l"]).groupBy("code", *STEP).agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum("degree"))).alias("degree"))
    return schedule.unionByName(made.join(schedule, ["code", *STEP], "left_anti").select(schedule.columns))


def parts(label: Column, known: list[str]) -> Column:
    """The scheduled codes that a label means: parts joined by +, a way through another word (``C1 (via x)``), sub-steps (``C1.2``)."""
    has = lambda c: c.isin(*known)
    base = F.split_part(label, F.lit(" (via "), F.lit(1))
    dot = lambda c, end: F.concat(c, F.lit(end))

    def expand(p):
        stem = F.split_part(p, F.lit("."), F.lit(1))
        return F.when(has(p), F.array(p)).when(has(dot(p, ".via")), F.array(dot(p, ".via"))).when(has(dot(p, ".1")) | has(dot(p, ".2")), F.array(dot(p, ".1"), dot(p, ".2"))).when(has(stem), F.array(stem)).otherwise(F.array(p))

    return F.flatten(F.transform(F.when(label.contains(" (via "), F.array(base)).otherwise(F.split(base, r"\+")), expand))


def label_degrees(labels: DataFrame, schedule: DataFrame, known: list[str]) -> DataFrame:
    """(label, i, j, degree): the weakest degree of a label's parts where all have one, of the same sign."""
    each = labels.select("label", F.explode(parts(F.col("label"), known)).alias("code"))
    n = each.groupBy("label").agg(F.count("*").alias("n"))
    cells = each.join(F.broadcast(schedule.filter("degree <> 0")), "code").groupBy("label", *STEP).agg(F.count("*").alias("have"), F.min("degree").alias("low"), F.max("degree").alias("high"))
    whole = cells.join(n, "label").filter("have = n and low * high > 0")
    return whole.select("label", *STEP, F.when(F.col("low") > 0, F.col("low")).otherwise(F.col("high")).alias("degree"))


def scheduled(edges: DataFrame, schedule: DataFrame, known: list[str], closed: DataFrame | None = None, ending: str = "dy") -> DataFrame:
    """(i, j, src, dst, factor): the direction and share in which each edge (src, dst, codes) runs at a step.

    Of an edge's labels the largest degree counts, and none if two of opposite
    sign are largest. A negative degree turns the edge round. At ``closed``
    steps (i, j) an edge that adds the ending does not run.
    """
    labelled = edges.select("src", "dst", F.explode("codes").alias("label"))
    d = label_degrees(labelled.select("label").distinct(), schedule, known)
    best = labelled.join(F.broadcast(d), "label").groupBy(*STEP, "src", "dst").agg(F.max("degree").alias("up"), F.min("degree").alias("down"))
    up, down = F.greatest(F.col("up"), F.lit(0.0)), F.greatest(-F.col("down"), F.lit(0.0))
    runs = best.select(*STEP, F.when(up > down, F.col("src")).otherwise(F.col("dst")).alias("from"), F.when(up > down, F.col("dst")).otherwise(F.col("src")).alias("to"), F.greatest(up, down).alias("factor"), (up == down).alias("even")).filter("not even")
    if closed is not None:
        shut = runs.join(F.broadcast(closed.select(*STEP)), STEP, "left_semi").filter(adds_ending(F.col("from"), F.col("to"), ending))
        runs = runs.join(shut.select(*STEP, "from", "to"), [*STEP, "from", "to"], "left_anti")
    return runs.groupBy(*STEP, F.col("from").alias("src"), F.col("to").alias("dst")).agg(F.sum("factor").alias("factor"))


# Ledgers


def step_words(rates: DataFrame, paths: DataFrame) -> DataFrame:
    """(i, j, word, a, b, dormant_out, dormant_in) for every step and word of rates (col, word, rate).

    A word that is absent from the columns between two of a path parks the
    smaller of its two rates: on the step out of the first and on the one into
    the second. A step on several paths parks the largest of theirs.
    """
    rates = rates.filter("rate > 0").select("col", "word", "rate")
    step = F.broadcast(steps(paths))
    each = steps(paths).select(*STEP).distinct()
    ends = each.select("i", "j", F.col("i").alias("col"), F.lit("a").alias("side")).unionByName(each.select("i", "j", F.col("j").alias("col"), F.lit("b").alias("side")))
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("rate"))), F.lit(0.0)).alias(s)
    pairs = rates.join(F.broadcast(ends), "col").groupBy(*STEP, "word").agg(side("a"), side("b"))
    on = rates.join(F.broadcast(paths), "col")
    w = Window.partitionBy("word", "path").orderBy("place")
    gaps = on.select("path", "word", "place", F.lead("place").over(w).alias("back"), F.least("rate", F.lead("rate").over(w)).alias("mass")).filter("back - place > 1")
    out = gaps.select("path", "place", "word", F.col("mass").alias("dormant_out"), F.lit(0.0).alias("dormant_in"))
    back = gaps.select("path", (F.col("back") - 1).alias("place"), "word", F.lit(0.0).alias("dormant_out"), F.col("mass").alias("dormant_in"))
    parked = out.unionByName(back).join(step, ["path", "place"]).groupBy(*STEP, "word").agg(F.max("dormant_out").alias("dormant_out"), F.max("dormant_in").alias("dormant_in"))
    return pairs.join(parked, [*STEP, "word"], "left").fillna(0.0, ["dormant_out", "dormant_in"])


def ledgers(words: DataFrame, edges: DataFrame, runs: DataFrame | None = None, most: int = network.ARCS) -> tuple[DataFrame, DataFrame]:
    """(rows per step and word, flows (i, j, src, dst, flow)) of ``step_words``: a = kept + sent + unplaced + dormant_out, b = kept + received + unfilled + dormant_in.

    ``runs`` (i, j, src, dst, factor) says which edges run at which step, and
    caps each at factor times the smaller of loss and gain; without it every
    edge (src, dst) runs both ways at every step.
    """
    zero = F.lit(0.0)
    rows = words.withColumns({
        "kept": F.least("a", "b"),
        "loss": F.greatest(F.col("a") - F.col("b") - F.col("dormant_out"), zero),
        "gain": F.greatest(F.col("b") - F.col("a") - F.col("dormant_in"), zero),
    })
    rows = graph.settled(rows)
    loss = rows.filter("loss > 0").select(*STEP, F.col("word").alias("src"), "loss")
    gain = rows.filter("gain > 0").select(*STEP, F.col("word").alias("dst"), "gain")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    arcs = loss.join(both, "src") if runs is None else loss.join(runs, [*STEP, "src"])
    arcs = arcs.join(gain, [*STEP, "dst"]).withColumn("cap", F.least("loss", "gain") * (F.lit(1.0) if runs is None else F.col("factor")))
    of = graph.settled(graph.components(edges))
    key = [*STEP, "component"]
    node = lambda layer, c: F.concat(F.lit(layer), F.col(c))
    arcs = arcs.join(of.withColumnRenamed("word", "src"), "src").select(*key, node("e:", "src").alias("a"), node("h:", "dst").alias("b"), "cap")
    supply = loss.join(of.withColumnRenamed("word", "src"), "src").select(*key, node("e:", "src").alias("node"), F.col("loss").alias("v"))
    demand = gain.join(of.withColumnRenamed("word", "dst"), "dst").select(*key, node("h:", "dst").alias("node"), F.col("gain").alias("v"), F.lit(1).alias("tier"))
    flows = network.maximum(arcs, supply, demand, *key, most=most).select(*STEP, F.expr("substring(a, 3)").alias("src"), F.expr("substring(b, 3)").alias("dst"), "flow").filter("flow > 1e-9")
    sent = flows.groupBy(*STEP, F.col("src").alias("word")).agg(F.sum("flow").alias("sent"))
    got = flows.groupBy(*STEP, F.col("dst").alias("word")).agg(F.sum("flow").alias("received"))
    out = rows.join(sent, [*STEP, "word"], "left").join(got, [*STEP, "word"], "left").fillna(0.0, ["sent", "received"])
    left = lambda whole, used, parked: F.greatest(zero, F.col(whole) - F.col("kept") - F.col(used) - F.col(parked))
    return out.select(*STEP, "word", "a", "b", "kept", "sent", "received", left("a", "sent", "dormant_out").alias("unplaced"), left("b", "received", "dormant_in").alias("unfilled"), "dormant_out", "dormant_in"), flows


def totals(ledger: DataFrame) -> DataFrame:
    """(i, j, source, target, kept, routed, unplaced, unfilled, dormant_out, dormant_in) of ``ledgers``."""
    total = [F.sum(c).alias(n) for c, n in (("a", "source"), ("b", "target"), ("kept", "kept"), ("sent", "routed"), ("unplaced", "unplaced"), ("unfilled", "unfilled"), ("dormant_out", "dormant_out"), ("dormant_in", "dormant_in"))]
    return ledger.groupBy(*STEP).agg(*total)


def lineage(flows: DataFrame, paths: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, path, direction, word, place) of the words that flows (i, j, src, dst) link to each seed (word), along each path by itself.

    Forward from the first step to the last, a flow out of a word reached leads
    to its target; backward likewise from the last step to the first. place is
    the step at which a word is reached first (null for the seed itself). A
    flow over several steps counts at each. One join a step, for all seeds and
    paths.
    """
    at = paths.select("path", "col", "place")
    on = flows.select(*STEP, "src", "dst").join(F.broadcast(at.withColumnsRenamed({"col": "i", "place": "first"})), "i").join(F.broadcast(at.withColumnsRenamed({"col": "j", "place": "last"})), ["path", "j"])
    on = on.filter("first < last").select("path", "src", "dst", F.explode(F.sequence("first", F.col("last") - 1)).alias("place"))
    on = graph.settled(on.distinct())
    last = paths.agg(F.max("place")).first()[0] or 0  # one number
    start = seeds.select(F.col("word").alias("seed"), "word").distinct().join(F.broadcast(paths.select("path").distinct())).select("seed", "path", "word", F.lit(None).cast("int").alias("place"))
    out = None
    for direction, order, source, target in (("forward", range(last), "src", "dst"), ("backward", range(last - 1, -1, -1), "dst", "src")):
        reached = start
        for k in order:
            step = on.filter(F.col("place") == k).select("path", F.col(source).alias("word"), F.col(target).alias("next"))
            new = step.join(reached.select("seed", "path", "word"), ["path", "word"]).select("seed", "path", F.col("next").alias("word")).distinct()
            new = new.join(reached.select("seed", "path", "word"), ["seed", "path", "word"], "left_anti")
            reached = graph.settled(reached.unionByName(new.withColumn("place", F.lit(k))))
        reached = reached.select("seed", "path", F.lit(direction).alias("direction"), "word", "place")
        out = reached if out is None else out.unionByName(reached)
    return out
