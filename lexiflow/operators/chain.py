"""Words along an ordered chain of columns (groups of text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.operators.rates import PER

#: Units of a spelling: compound letters, runs of e and i, or one letter.
UNITS = r"(ckh|cth|cph|cfh|ch|sh|e{1,4}|i{1,4}|.)"


def column_counts(toks: DataFrame, col: str, page: str = "page") -> DataFrame:
    """(col, word, n, pages): pages are counted over rows combined per page first."""
    per = toks.groupBy(col, "word", page).agg(F.count("*").alias("n"))
    return per.groupBy(col, "word").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))


def column_rates(counts: DataFrame, col: str) -> DataFrame:
    n = counts.groupBy(col).agg(F.sum("n").alias("total"))  # one row per column
    return counts.join(F.broadcast(n), col).withColumn("rate", F.col("n") * PER / F.col("total"))


def bands(rates: DataFrame, col: str, cap: int, pinned: tuple[str, ...] = (), key: str = "word", sparse: int = 20) -> DataFrame:
    """(col, band, rate, sparse): the ``cap`` keys of the largest summed rates and pinned ones; the rest pooled."""
    total = rates.groupBy(key).agg(F.round(F.sum("rate"), 6).alias("s"))
    top = total.orderBy(F.desc("s"), key).limit(cap).select(key, F.lit(True).alias("kept"))
    rows = rates.join(F.broadcast(top), key, "left")
    band = F.when(F.col("kept") | F.col(key).isin(*pinned), F.col(key)).otherwise("(other)")
    return rows.groupBy(col, band.alias("band")).agg(F.sum("rate").alias("rate"), (F.first("total") < sparse).alias("sparse"))


def steps(order: list) -> list[tuple]:
    return list(zip(order, order[1:], strict=False))


def hide(order: list, hidden: set) -> list:
    """The chain without hidden columns; steps then bridge their gap."""
    return [c for c in order if c not in hidden]


def step_pairs(rates: DataFrame, col: str, order: list) -> DataFrame:
    """(step, word, a, b) for neighbouring columns."""
    return leg_pairs(rates, col, steps(order))


def leg_pairs(rates: DataFrame, col: str, legs: list[tuple]) -> DataFrame:
    """(step, word, a, b) for legs (source, target), numbered: each column's rates go to the legs it takes part in, no self-join."""
    ends = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(str(c)).alias("c"), F.lit(side).alias("side")) for i, pair in enumerate(legs) for c, side in zip(pair, "ab", strict=True)])
    mine = F.filter(ends, lambda e: e["c"] == F.col(col).cast("string"))
    rows = rates.select("word", "rate", F.explode(mine).alias("e"))
    side = lambda s: F.coalesce(F.sum(F.when(F.col("e.side") == s, F.col("rate"))), F.lit(0.0))
    return rows.groupBy(F.col("e.step").alias("step"), "word").agg(side("a").alias("a"), side("b").alias("b"))


def dormancy(rates: DataFrame, place: str) -> DataFrame:
    """(word, left, back, mass): absences between two columns (by place) where the word occurs; parks the smaller rate."""
    w = Window.partitionBy("word").orderBy(place)
    rows = rates.filter("rate > 0").select("word", F.col(place).alias("left"), F.lead(place).over(w).alias("back"), F.least("rate", F.lead("rate").over(w)).alias("mass"))
    return rows.filter("back - left > 1")


def parked_pairs(rates: DataFrame, col: str, order: list) -> DataFrame:
    """``step_pairs`` with dormant_out and dormant_in: mass that leaves a word for a later column, and mass that comes back to it."""
    place = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)])
    parked = dormancy(rates.withColumn("place", place[F.col(col)]), "place")
    out = parked.select(F.col("left").alias("step"), "word", F.col("mass").alias("dormant_out"))
    back = parked.select((F.col("back") - 1).alias("step"), "word", F.col("mass").alias("dormant_in"))
    rows = step_pairs(rates, col, order).join(out, ["step", "word"], "left").join(back, ["step", "word"], "left")
    return rows.fillna(0.0, ["dormant_out", "dormant_in"])


def movable(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """loss (step, src, v) and gain (step, dst, v) of ``parked_pairs``: changes that dormancy does not explain."""
    loss = F.greatest(F.col("a") - F.col("b") - F.col("dormant_out"), F.lit(0.0))
    gain = F.greatest(F.col("b") - F.col("a") - F.col("dormant_in"), F.lit(0.0))
    return pairs.select("step", F.col("word").alias("src"), loss.alias("v")).filter("v > 0"), pairs.select("step", F.col("word").alias("dst"), gain.alias("v")).filter("v > 0")


def ledgers(pairs: DataFrame, flows: DataFrame) -> DataFrame:
    """Totals per step: source, target, kept, routed, unplaced, unfilled, dormant_out, dormant_in."""
    loss, gain = movable(pairs)
    sums = pairs.groupBy("step").agg(F.sum("a").alias("source"), F.sum("b").alias("target"), F.sum(F.least("a", "b")).alias("kept"), F.sum("dormant_out").alias("dormant_out"), F.sum("dormant_in").alias("dormant_in"))
    for rows, value, name in ((loss, "v", "loss"), (gain, "v", "gain"), (flows, "flow", "routed")):
        sums = sums.join(rows.groupBy("step").agg(F.sum(value).alias(name)), "step", "left").fillna(0.0, [name])
    return sums.select("step", "source", "target", "kept", "routed", (F.col("loss") - F.col("routed")).alias("unplaced"), (F.col("gain") - F.col("routed")).alias("unfilled"), "dormant_out", "dormant_in")


def mass_by_label(flows: DataFrame, cap: int, other: str = "other rules") -> DataFrame:
    """(step, label, mass) for flows (step, label, flow): the ``cap`` labels of most mass over all steps, the rest pooled."""
    per = flows.groupBy("step", "label").agg(F.sum("flow").alias("mass"))
    top = per.groupBy("label").agg(F.sum("mass").alias("s")).orderBy(F.desc(F.round("s", 6)), "label").limit(cap).select("label", F.lit(True).alias("kept"))
    rows = per.join(F.broadcast(top), "label", "left")
    return rows.groupBy("step", F.when(F.col("kept"), F.col("label")).otherwise(other).alias("label")).agg(F.sum("mass").alias("mass"))


def kept_since(rates: DataFrame, place: str, columns: int) -> DataFrame:
    """(col, origin, mass): rate of each column that has been kept since each origin column.

    The mass kept since origin j is the smallest rate from j to the column,
    less that since j - 1. Each word's rates go into one array of the chain.
    """
    at = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda i: F.coalesce(F.try_element_at(F.map_from_entries(F.collect_list(F.struct(place, "rate"))), i), F.lit(0.0)))
    rows = rates.groupBy("word").agg(at.alias("r"))
    least = lambda i, j: F.array_min(F.slice("r", j + 1, i - j + 1))
    cells = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(columns - 1)),
            lambda i: F.transform(F.sequence(F.lit(0), i), lambda j: F.struct(i.alias("col"), j.alias("origin"), (least(i, j) - F.when(j > 0, least(i, F.greatest(j - 1, F.lit(0)))).otherwise(0.0)).alias("mass"))),
        )
    )
    return rows.select(F.explode(cells).alias("c")).select("c.*").filter("mass > 0").groupBy("col", "origin").agg(F.sum("mass").alias("mass"))


def units_of(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit(UNITS), F.lit(1))


def bigrams(word: Column) -> Column:
    u = F.concat(F.array(F.lit("^")), units_of(word), F.array(F.lit("$")))
    return F.transform(F.sequence(F.lit(0), F.size(u) - 2), lambda i: F.concat_ws(" ", F.get(u, i), F.get(u, i + 1)))


def label_degree(codes: Column, degree: Column) -> Column:
    """Degree of a label of several rules by a map code -> degree: the weakest if all have one sign, else 0."""
    ds = F.transform(codes, lambda c: F.coalesce(degree[c], F.lit(0.0)))
    low, high = F.array_min(ds), F.array_max(ds)
    return F.when(low >= 0, low).when(high <= 0, high).otherwise(0.0)


def span_degree(degrees: Column, own: Column) -> Column:
    """Over hidden columns: the sum of the steps' degrees within -1 and 1, unless a cell of its own exists."""
    total = F.aggregate(degrees, F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(own, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total)))


def adds_ending(src: Column, dst: Column, ending: str = "dy") -> Column:
    return dst.contains(ending) & ~src.contains(ending)


def lineage(flows: DataFrame, seeds: list[str], n_steps: int) -> DataFrame:
    """(column, word) reachable from seeds at column 0 along flows (step, src, dst): one ordered join a step."""
    spark = flows.sparkSession
    now = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in seeds])).alias("word"), F.lit(0).alias("column"))
    out = now
    for i in range(n_steps):
        edge = flows.filter(F.col("step") == i).select("src", "dst")
        now = edge.join(now.select(F.col("word").alias("src")), "src", "left_semi").select(F.col("dst").alias("word")).distinct().withColumn("column", F.lit(i + 1))
        out = out.unionByName(now)
    return out


def middle_share(o: Column, m: Column, a: Column, prior: float, weight: float = 1.0, ridge: float = 1.0) -> Column:
    """Share of the change from o to a that the middle column m has made: ridge estimate around ``prior``, within 0 and 1."""
    b = a - o
    raw = (ridge * prior + weight * b * (m - o)) / (ridge + weight * b * b)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
