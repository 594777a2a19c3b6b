"""Largest flows through networks of words, all keys (component, leg, policy, step) in one job.

A network has arcs (key, a, b, cap), supply (key, node, v) and demand (key,
node, v, tier). Mass for the first tier is placed first; a later tier takes
what can still be placed without taking from an earlier one.

Keys with at most ``ARCS`` arcs are solved where Spark has brought their rows
together, one key after another. Larger ones are solved by joins: each supply
with mass left grows a tree along arcs with room (or back along used ones), no
node is in two trees, and the disjoint paths of a round hold all at once. Both
stop when no path is left, so totals per key and tier are the same.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators.graph import settled

EPS = 1e-9
#: Arcs of a key that one task solves.
ARCS = 20_000


def solve(arcs: list[tuple[str, str, float]], supply: dict[str, float], demand: list[tuple[str, float, int]]) -> list[float]:
    """Flow of each arc: shortest paths from any supply left to any demand of the tier, until there is none."""
    room, ends, leaving = [], [], defaultdict(list)
    for a, b, cap in arcs:
        for node, end, r in ((a, b, cap), (b, a, 0.0)):  # an arc and its way back are neighbours
            leaving[node].append(len(room))
            room.append(r)
            ends.append(end)
    left = dict(supply)
    for tier in sorted({t for _, _, t in demand}):
        want = {n: v for n, v, t in demand if t == tier}
        while True:
            came = {n: -1 for n, v in left.items() if v > EPS}
            queue, end = deque(came), next((n for n in came if want.get(n, 0.0) > EPS), None)
            while queue and end is None:
                for e in leaving[queue.popleft()]:
                    if room[e] > EPS and ends[e] not in came:
                        came[ends[e]] = e
                        queue.append(ends[e])
                        if want.get(ends[e], 0.0) > EPS:
                            end = ends[e]
                            break
            if end is None:
                break
            path, node = [], end
            while came[node] >= 0:
                path.append(came[node])
                node = ends[came[node] ^ 1]
            push = min([left[node], want[end], *(room[e] for e in path)])
            left[node] -= push
            want[end] -= push
            for e in path:
                room[e] -= push
                room[e ^ 1] += push
    return [room[2 * i + 1] for i in range(len(arcs))]


def _in_place(arcs: DataFrame, supply: DataFrame, demand: DataFrame, key: list[str]) -> DataFrame:
    none = F.lit(None)
    rows = (
        arcs.select(*key, F.lit(0).alias("kind"), "a", "b", F.col("cap").alias("v"), F.lit(0).alias("tier"))
        .unionByName(supply.select(*key, F.lit(1).alias("kind"), F.col("node").alias("a"), none.cast("string").alias("b"), "v", F.lit(0).alias("tier")))
        .unionByName(demand.select(*key, F.lit(2).alias("kind"), F.col("node").alias("a"), none.cast("string").alias("b"), "v", "tier"))
    )
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)

    def flows(group: list[tuple]) -> Iterator[tuple]:
        mine = [r[-4:-1] for r in group if r[-5] == 0]
        if mine:
            flow = solve(mine, {r[-4]: r[-2] for r in group if r[-5] == 1}, [(r[-4], r[-2], r[-1]) for r in group if r[-5] == 2])
            yield from ((*group[0][: len(key)], *arc, f) for arc, f in zip(mine, flow, strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, out, now = [], [], None
        names = [*key, "a", "b", "cap", "flow"]
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if row[: len(key)] != now:
                    out.extend(flows(group))
                    group, now = [], row[: len(key)]
                    if len(out) > 50_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                group.append(row)
        out.extend(flows(group))
        if out:
            yield pd.DataFrame(out, columns=names)

    # dealt by a hash of the key: a union's parts may count as dealt by the key already, and then meet in different tasks
    dealt = rows.withColumn("dealt", F.xxhash64(*key)).repartition("dealt").sortWithinPartitions(*key, "kind", "a", "b")
    return dealt.drop("dealt").mapInPandas(run, f"{kinds}, a string, b string, cap double, flow double")


def _paths(flow: DataFrame, supply: DataFrame, demand: DataFrame, key: list[str]) -> DataFrame:
    """(key, path, push): disjoint paths, at most one from each supply with mass left."""
    net = flow.select(*key, F.col("a").alias("node"), (-F.col("flow")).alias("f")).unionByName(flow.select(*key, F.col("b").alias("node"), F.col("flow").alias("f"))).groupBy(*key, "node").agg(F.sum("f").alias("f"))
    of = [*key, "node"]
    have = supply.join(net, of, "left").withColumn("push", F.col("v") + F.coalesce("f", F.lit(0.0))).filter(F.col("push") > EPS)
    want = settled(demand.join(net, of, "left").withColumn("want", F.col("v") - F.coalesce("f", F.lit(0.0))).filter(F.col("want") > EPS).select(*of, "want"))
    residual = settled(
        flow.filter(F.col("cap") - F.col("flow") > EPS).select(*key, F.col("a").alias("node"), F.col("b").alias("to"), "a", "b", F.lit(1).alias("sign"), (F.col("cap") - F.col("flow")).alias("c"))
        .unionByName(flow.filter(F.col("flow") > EPS).select(*key, F.col("b").alias("node"), F.col("a").alias("to"), "a", "b", F.lit(-1).alias("sign"), F.col("flow").alias("c")))
    )
    empty = F.array().cast("array<struct<a:string,b:string,sign:int>>")
    front = settled(have.select(*of, F.col("node").alias("root"), empty.alias("path"), "push"))
    seen, found = front.select(*of), None
    widest = F.max_by(F.struct("root", "path", "push"), F.struct("push", "root", F.to_json("path"))).alias("best")
    while True:
        ends = front.join(want, of).withColumn("push", F.least("push", "want")).groupBy(*key, F.col("root").alias("tree")).agg(widest).select(*key, "best.*")
        found = settled(ends if found is None else found.unionByName(ends))
        on = front.join(found.select(*key, "root"), [*key, "root"], "left_anti").join(residual, of)
        step = on.select(*key, F.col("to").alias("node"), "root", F.concat("path", F.array(F.struct("a", "b", "sign"))).alias("path"), F.least("push", "c").alias("push"))
        front = settled(step.groupBy(*of).agg(widest).select(*of, "best.*").join(seen, of, "left_anti"))
        if front.isEmpty():
            return found
        seen = seen.unionByName(front.select(*of))


def _by_joins(arcs: DataFrame, supply: DataFrame, demand: DataFrame, key: list[str]) -> DataFrame:
    flow = settled(arcs.select(*key, "a", "b", "cap", F.lit(0.0).alias("flow")))
    for (tier,) in sorted(demand.select("tier").distinct().collect()):  # a handful
        while True:
            paths = _paths(flow, supply, demand.filter(F.col("tier") == tier), key)
            if paths.isEmpty():
                break
            arc = paths.select(*key, "push", F.explode("path").alias("e"))
            change = arc.groupBy(*key, F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(F.sum(F.col("push") * F.col("e.sign")).alias("d"))
            flow = settled(flow.join(change, [*key, "a", "b"], "left").withColumn("flow", F.col("flow") + F.coalesce("d", F.lit(0.0))).drop("d"))
    return flow


def maximum(arcs: DataFrame, supply: DataFrame, demand: DataFrame, *key: str, most: int = ARCS) -> DataFrame:
    """(key, a, b, cap, flow) for all ``arcs``; only the totals per key and tier are unique.

    Nodes are strings, one supply and one demand row per node at most (and
    tier), one arc per pair. Arcs are positive; keys are not null. Keys without
    supply or demand get no flow.
    """
    k = list(key)
    arcs, supply, demand = (settled(x) for x in (arcs, supply, demand))
    large = settled(arcs.groupBy(*k).count().filter(F.col("count") > most).select(*k))
    if large.isEmpty():
        return settled(_in_place(arcs, supply, demand, k))
    some = lambda x, how: x.join(large, k, how)
    small = _in_place(*(some(x, "left_anti") for x in (arcs, supply, demand)), k)
    return settled(small.unionByName(_by_joins(*(some(x, "left_semi") for x in (arcs, supply, demand)), k)))
