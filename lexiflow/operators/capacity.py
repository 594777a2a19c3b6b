"""Shared-capacity accounting: how much mass of losing words can reach gaining words along edges.

All keys (component, step, policy) are solved in one job. Rounds of
proportional offers place most of the mass; augmenting rounds then move it
along residual paths, one path per search tree and round, until none is left:
the total is then the maximum for every key. Each loser with mass left grows a
tree of its own and no node is in two trees, so the paths of a round are
disjoint and all of them hold at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.operators.graph import settled

EPS = 1e-9


def bound(loss: DataFrame, gain: DataFrame, edges: DataFrame, *key: str) -> DataFrame:
    """(key, bound): what each side could place at most if it had the other for itself.

    loss (key, src, v), gain (key, dst, v), edges (key, src, dst, cap).
    """
    k = list(key)
    out = edges.groupBy(*k, "src").agg(F.sum("cap").alias("cap")).join(loss, [*k, "src"]).groupBy(*k).agg(F.sum(F.least("v", "cap")).alias("s"))
    into = edges.groupBy(*k, "dst").agg(F.sum("cap").alias("cap")).join(gain, [*k, "dst"]).groupBy(*k).agg(F.sum(F.least("v", "cap")).alias("r"))
    return out.join(into, k).select(*k, F.least("s", "r").alias("bound"))


def allocate(loss: DataFrame, gain: DataFrame, edges: DataFrame, *key: str, rounds: int = 6) -> DataFrame:
    """(key, src, dst, cap, flow) of a maximum allocation. Only its total per key is unique."""
    k = list(key)
    flow = settled(
        edges.join(loss.select(*k, "src", F.col("v").alias("have")), [*k, "src"]).join(gain.select(*k, "dst", F.col("v").alias("want")), [*k, "dst"])
        .filter((F.col("have") > EPS) & (F.col("want") > EPS) & (F.col("cap") > EPS))
        .select(*k, "src", "dst", "have", "want", "cap", F.lit(0.0).alias("flow"))
    )
    by_src, by_dst = Window.partitionBy(*k, "src"), Window.partitionBy(*k, "dst")
    for _ in range(rounds):
        rows = flow.withColumn("left", F.greatest(F.lit(0.0), F.col("have") - F.sum("flow").over(by_src)))
        rows = rows.withColumn("room", F.greatest(F.lit(0.0), F.col("want") - F.sum("flow").over(by_dst)))
        live = F.when(F.col("cap") - F.col("flow") > EPS, F.col("room")).otherwise(0.0)
        offer = F.coalesce(F.try_divide(F.col("left") * live, F.sum(live).over(by_src)), F.lit(0.0))
        rows = rows.withColumn("offer", F.least(offer, F.col("cap") - F.col("flow")))
        scale = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("room"), F.sum("offer").over(by_dst)), F.lit(1.0)))
        flow = rows.withColumn("flow", F.col("flow") + F.col("offer") * scale).select(*k, "src", "dst", "have", "want", "cap", "flow")
    flow = settled(flow)
    while True:
        paths = _paths(flow, k)
        if paths.isEmpty():
            return flow.select(*k, "src", "dst", "cap", "flow")
        change = paths.select(*k, "push", F.explode("path").alias("e")).select(*k, F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), (F.col("push") * F.col("e.sign")).alias("d"))
        flow = settled(flow.join(change, [*k, "src", "dst"], "left").withColumn("flow", F.col("flow") + F.coalesce("d", F.lit(0.0))).drop("d"))


def _paths(flow: DataFrame, k: list[str]) -> DataFrame:
    """(key, root, path, push): disjoint residual paths, at most one from each loser (root), by frontier joins over all keys at once."""
    sent, got = flow.groupBy(*k, "src").agg(F.sum("flow").alias("f"), F.first("have").alias("v")), flow.groupBy(*k, "dst").agg(F.sum("flow").alias("f"), F.first("want").alias("v"))
    room = settled(got.filter(F.col("v") - F.col("f") > EPS).select(*k, "dst", (F.col("v") - F.col("f")).alias("room")))
    empty = F.array().cast("array<struct<src:string,dst:string,sign:int>>")
    front = settled(sent.filter(F.col("v") - F.col("f") > EPS).select(*k, "src", F.col("src").alias("root"), empty.alias("path"), (F.col("v") - F.col("f")).alias("push")))
    forward = flow.filter(F.col("cap") - F.col("flow") > EPS).select(*k, "src", "dst", (F.col("cap") - F.col("flow")).alias("c"))
    back = flow.filter(F.col("flow") > EPS).select(*k, "src", "dst", F.col("flow").alias("c"))
    seen_src, seen_dst, found = front.select(*k, "src"), None, None
    widest = F.max_by(F.struct("root", "path", "push"), F.struct(F.col("push"), F.to_json("path"))).alias("b")

    def step(rows, node, sign):
        edge = F.struct("src", "dst", F.lit(sign).alias("sign"))
        rows = rows.withColumn("path", F.concat("path", F.array(edge))).withColumn("push", F.least("push", "c"))
        return rows.groupBy(*k, node).agg(widest).select(*k, node, "b.*")

    while True:
        reach = step(front.join(forward, [*k, "src"]), "dst", 1)
        if seen_dst is not None:
            reach = reach.join(seen_dst, [*k, "dst"], "left_anti")
        reach = settled(reach)
        ends = reach.join(room, [*k, "dst"]).withColumn("push", F.least("push", "room"))
        best = settled(ends.groupBy(*k, F.col("root").alias("tree")).agg(widest).select(*k, "b.*"))
        found = best if found is None else found.unionByName(best)
        # trees that have their path wait for the next round; the others search on from the receivers they reached
        more = reach.join(found.select(*k, "root"), [*k, "root"], "left_anti")
        seen_dst = reach.select(*k, "dst") if seen_dst is None else seen_dst.unionByName(reach.select(*k, "dst"))
        front = settled(step(more.join(back, [*k, "dst"]), "src", -1).join(seen_src, [*k, "src"], "left_anti"))
        if front.isEmpty():
            return found
        seen_src = seen_src.unionByName(front.select(*k, "src"))


def open_routes(loss: DataFrame, gain: DataFrame, edges: DataFrame, *key: str) -> DataFrame:
    """(key, src, dst, cap): edges (src, dst) from words that lose to words that gain, capped by both."""
    out = edges.join(loss, "src").withColumnRenamed("v", "have")
    return out.join(gain, [*key, "dst"]).select(*key, "src", "dst", F.least("have", "v").alias("cap"))


def budgets(pairs: DataFrame, *key: str, basis: str = "signed") -> tuple[DataFrame, DataFrame]:
    """loss and gain of words with rates a and b: what changes (signed), or all there is (stock)."""
    a, b = F.col("a"), F.col("b")
    loss = F.greatest(a - b, F.lit(0.0)) if basis == "signed" else a
    gain = F.greatest(b - a, F.lit(0.0)) if basis == "signed" else b
    return pairs.select(*key, F.col("word").alias("src"), loss.alias("v")).filter("v > 0"), pairs.select(*key, F.col("word").alias("dst"), gain.alias("v")).filter("v > 0")


def accounting(pairs: DataFrame, flows: DataFrame, *key: str) -> DataFrame:
    """Ledger per key: retained, loss, gain, matched, unplaced, unfilled."""
    k = list(key)
    sums = pairs.groupBy(*k).agg(F.sum(F.least("a", "b")).alias("retained"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0.0))).alias("loss"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0.0))).alias("gain"))
    matched = flows.groupBy(*k).agg(F.sum("flow").alias("matched"))
    rows = (sums.join(matched, k, "left") if k else sums.crossJoin(matched)).fillna(0.0, ["matched"])
    return rows.select("*", (F.col("loss") - F.col("matched")).alias("unplaced"), (F.col("gain") - F.col("matched")).alias("unfilled"))
