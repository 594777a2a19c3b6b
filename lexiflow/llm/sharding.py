"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual`` points of the ring. A row belongs to the first
point at or after the hash of its key. A shard takes rows up to its bound; rows
beyond it continue clockwise to the next point whose shard has room. Which rows
those are only depends on how many rows each arc of the ring holds, so the walk
is done over these counts (one number per point), and the rows then read their
shard off a broadcast table of at most a few intervals per point.
"""

from __future__ import annotations

import bisect
import json
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import read

SHARDS = 40
#: Points of a shard on the ring.
VIRTUAL = 64
_BITS, _CELLS = 52, 4096


def _place(*cols) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << _BITS))


def ring(spark: SparkSession, shards: int, virtual: int = VIRTUAL, seed: int = 7) -> list[tuple[int, int]]:
    """(place, shard) of all points, clockwise. Bounded by shards x virtual. A shard's points don't depend on how many shards there are."""
    shard, nth = F.floor(F.col("id") / virtual).cast("int"), F.col("id") % virtual
    points = spark.range(shards * virtual).select(_place(F.lit(seed), F.lit("point"), shard, nth).alias("place"), shard.alias("shard"))
    return sorted((r.place, r.shard) for r in points.collect())


def walk(counts: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, last rank, shard, slot of the first) for rows that arrive arc by arc.

    Clockwise sweep: a point's shard first takes the rows of its own arc in
    ring order, then the oldest of those that have been carried on.
    """
    out, used, carried = [], [0] * len(room), deque()

    def take(arc, first, n, shard):
        out.append((arc, first, first + n - 1, shard, used[shard]))
        used[shard] += n

    for sweep in range(2):
        for arc, shard in enumerate(owners):
            own = counts.get(arc, 0) if sweep == 0 else 0
            if own and (n := min(own, room[shard] - used[shard])):
                take(arc, 0, n, shard)
            else:
                n = 0
            if own > n:
                carried.append((arc, n, own - n))
            while carried and used[shard] < room[shard]:
                a, first, left = carried.popleft()
                m = min(left, room[shard] - used[shard])
                take(a, first, m, shard)
                if left > m:
                    carried.appendleft((a, first + m, left - m))
        if not carried:
            break
    return out


def rooms(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Bounds of the shards: with no slack they differ by one at most and hold exactly all rows."""
    if slack:
        return [-(-int(rows * (1 + slack)) // shards) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def assign_shards(docs: DataFrame, shards: int, key_col: str = "doc_id", text_col: str = "text", slack: float = 0.0, virtual: int = VIRTUAL, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: key_col, size, text_crc32, shard, slot.

    ``slack`` 0 gives shards whose row counts are at most one apart; a
    positive one lets shards exceed the mean by that share, and fewer rows move
    when the number of shards changes. Rows without a key are placed by their
    text. Rows that repeat a key lie side by side on the ring. Null texts have
    no bytes. An empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    points = ring(spark, shards, virtual, seed)
    places, cell = [p for p, _ in points], 1 << (_BITS - 12)
    starts = [bisect.bisect_left(places, c * cell) for c in range(_CELLS + 1)]
    lit = lambda xs: F.from_json(F.lit(json.dumps(xs)), "array<bigint>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(key_col).alias("key"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        _place(F.lit(seed), F.col(key_col), F.when(F.col(key_col).isNull(), text)).alias("place"),
    )
    at = F.shiftright("place", _BITS - 12).cast("int")
    first, after = F.get(lit(starts), at), F.get(lit(starts), at + 1)
    near = F.slice(lit(places), first + 1, after - first)
    passed = F.size(F.filter(near, lambda p: p < F.col("place")))
    rows = rows.withColumn("arc", ((first + passed) % len(points)).cast("int"))
    counts = {r.arc: r.n for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    taken = walk(counts, [s for _, s in points], rooms(sum(counts.values()), shards, slack))
    spans = [dict(zip(("arc", "first", "last", "shard", "slot0"), x, strict=True)) for x in taken]
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(spans)), "array<struct<arc:int,first:bigint,last:bigint,shard:int,slot0:bigint>>")))
    order = Window.partitionBy("arc").orderBy("place", "key", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    # at most 2 intervals a point and one more a shard: a few thousand rows at any size of the input
    placed = ranked.join(F.broadcast(table), "arc").filter("rank between first and last")
    return placed.select(F.col("key").alias(key_col), "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"))


def op10_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(read(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
