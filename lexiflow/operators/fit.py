"""Rule fractions fitted on one half of the sheets and evaluated on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.operators.graph import settled
from lexiflow.operators.rates import PER

#: Weights of first lines and body lines; support that a cell needs.
WEIGHTS = {"first": 0.5, "body": 0.5}
SUPPORT = 5


def class_counts(toks: DataFrame, *by: str) -> DataFrame:
    """(by, cls, word, n): first and body lines apart."""
    return toks.groupBy(*by, F.when(F.col("first"), "first").otherwise("body").alias("cls"), "word").agg(F.count("*").alias("n"))


def class_rates(counts: DataFrame, *by: str) -> DataFrame:
    total = counts.groupBy(*by, "cls").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), [*by, "cls"]).withColumn("rate", F.col("n") * PER / F.col("total"))


def cells(counts: DataFrame, hits: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(word, cls, rule, front, cell): the cell is rule|front where supported, else rule|other if the rule's rest is, else null."""
    rows = counts.join(hits.select("word", "rule", "front").distinct(), "word")
    sums = rows.groupBy("rule", "front").agg(F.sum("n").alias("support")).withColumn("own", (F.col("support") >= support) & (F.col("front") != "other"))
    rest = sums.filter("not own").groupBy("rule").agg(F.sum("support").alias("rest"))
    named = sums.join(rest, "rule", "left").withColumn("cell", F.when(F.col("own"), F.concat_ws("|", "rule", "front")).when(F.col("rest") >= support, F.concat(F.col("rule"), F.lit("|other"))))
    return rows.join(F.broadcast(named.select("rule", "front", "cell")), ["rule", "front"]).select("word", "cls", "rule", "front", "n", "cell")


def moved(rates: DataFrame, hits: DataFrame, theta: DataFrame) -> DataFrame:
    """(cls, word, before, after): rates after each hit moves its fraction; fractions over 1 in sum are scaled down.

    hits (word, rule, front, dst), theta (rule, front, theta). The outputs of
    one hit share its fraction equally.
    """
    t = hits.join(F.broadcast(theta), ["rule", "front"]).filter("theta > 0")
    per = Window.partitionBy("word", "rule", "front")
    t = t.withColumn("outs", F.count("*").over(per)).withColumn("part", F.col("theta") / F.col("outs"))
    t = t.withColumn("sum", F.sum("part").over(Window.partitionBy("word"))).withColumn("part", F.col("part") / F.greatest(F.lit(1.0), F.col("sum")))
    flow = rates.join(t, "word").select("cls", "word", "dst", (F.col("rate") * F.col("part")).alias("m"))
    change = flow.select("cls", "word", (-F.col("m")).alias("d")).unionByName(flow.select("cls", F.col("dst").alias("word"), F.col("m").alias("d"))).groupBy("cls", "word").agg(F.sum("d").alias("d"))
    joined = rates.select("cls", "word", F.col("rate").alias("before")).join(change, ["cls", "word"], "full_outer").fillna(0.0, ["before", "d"])
    return joined.select("cls", "word", "before", (F.col("before") + F.col("d")).alias("after"))


def evaluate(rates_a: DataFrame, rates_b: DataFrame, hits: DataFrame, theta: DataFrame) -> DataFrame:
    """(cls, before, after, net): overlap of A with B by class."""
    rows = moved(rates_a, hits, theta).join(rates_b.select("cls", "word", F.col("rate").alias("b")), ["cls", "word"], "full_outer").fillna(0.0)
    out = rows.groupBy("cls").agg(F.sum(F.least("before", "b")).alias("before"), F.sum(F.least("after", "b")).alias("after"))
    return out.withColumn("net", F.col("after") - F.col("before"))


def fit_theta(rates_a: DataFrame, rates_b: DataFrame, hits: DataFrame, steps: int = 12, rate: float = 0.4) -> DataFrame:
    """(rule, front, theta) by projected subgradient ascent on the weighted overlap; the best iterate is returned.

    A word's mass in surplus gains by leaving, an output in shortfall by being
    reached; each step sums these slopes per cell in one job. theta is a row per
    cell of rules, so it is small and broadcast.
    """
    cells = settled(hits.select("rule", "front").distinct())
    theta = settled(cells.withColumn("theta", F.lit(0.1)))
    weight = F.when(F.col("cls") == "first", WEIGHTS["first"]).otherwise(WEIGHTS["body"])
    mass = settled(rates_a.join(hits, "word").select("cls", "word", "rule", "front", "dst", "rate"))
    b = rates_b.select("cls", "word", F.col("rate").alias("b"))
    best, best_value = theta, None
    for i in range(steps):
        rows = settled(moved(rates_a, hits, theta).join(b, ["cls", "word"], "full_outer").fillna(0.0))
        value = rows.agg(F.sum(weight * F.least("after", "b"))).first()[0] or 0.0
        if best_value is None or value > best_value:
            best, best_value = theta, value
        state = rows.select("cls", "word", (F.col("after") - F.col("b")).alias("over"))
        s = state.withColumnRenamed("over", "src_over")
        t = state.select("cls", F.col("word").alias("dst"), F.col("over").alias("dst_over"))
        slope = weight * F.col("rate") * (F.when(F.col("dst_over") < 0, 1).otherwise(0) - F.when(F.col("src_over") <= 0, 1).otherwise(0))
        g = mass.join(s, ["cls", "word"]).join(t, ["cls", "dst"]).groupBy("rule", "front").agg((F.sum(slope) / F.sum("rate")).alias("g"))
        theta = settled(theta.join(g, ["rule", "front"], "left").select("rule", "front", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("theta") + rate / (1 + i) * F.coalesce("g", F.lit(0.0)))).alias("theta")))
    return best


# Many fits at once: every split and rule set is a key, and each round sums for all of them.

#: Rounds without a better value after which the search ends, the gain that counts, rounds at most, and the first step.
PATIENCE, BETTER, ROUNDS, FIRST_STEP = 4, 1e-4, 40, 0.4
#: Cells of all splits and rule sets together.
MOST_CELLS = 100_000
KEY = ["split", "rules"]


def blocks(counts: DataFrame) -> DataFrame:
    """(split, half, pop, cls, word, n, rate) of rows without rate: rates within each half, population and class."""
    return class_rates(counts, "split", "half", "pop")


def environments(counts: DataFrame, hits: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(split, rules, rule, front, cell) from counts (split, word, n) of the fitted block and hits (rules, word, rule, front).

    A rule's front is a cell of its own if the words that it takes there have
    ``support`` tokens; the rule's other fronts are one cell together if they
    have, else they are not fitted.
    """
    rows = counts.join(hits.select("rules", "word", "rule", "front").distinct(), "word")
    sums = rows.groupBy(*KEY, "rule", "front").agg(F.sum("n").alias("support"))
    sums = sums.withColumn("own", (F.col("support") >= support) & (F.col("front") != "other"))
    rest = sums.filter("not own").groupBy(*KEY, "rule").agg(F.sum("support").alias("rest"))
    cell = F.when(F.col("own"), F.concat_ws("|", "rule", "front")).when(F.col("rest") >= support, F.concat(F.col("rule"), F.lit("|other")))
    return sums.join(rest, [*KEY, "rule"], "left").select(*KEY, "rule", "front", cell.alias("cell")).filter("cell is not null")


def _moves(a: DataFrame, hits: DataFrame, cells: DataFrame) -> DataFrame:
    """(key, cls, word, dst, cell, m, part): what a fraction of 1 would move along each output, and its part of the hit."""
    outs = hits.groupBy("rules", "word", "rule", "front").agg(F.collect_set("dst").alias("dsts"))
    rows = a.select("split", "cls", "word", "rate").join(outs, "word").join(F.broadcast(cells), [*KEY, "rule", "front"])  # rows of cells: rules x fronts
    return rows.select(*KEY, "cls", "word", "cell", "rate", (1.0 / F.size("dsts")).alias("part"), F.explode("dsts").alias("dst"))


def _after(moves: DataFrame, sides: DataFrame, theta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sides with after, moves with theta): rates once each cell moves its fraction; fractions over 1 of a word are scaled down."""
    t = moves.join(F.broadcast(theta), [*KEY, "cell"])
    whole = F.sum(F.col("theta") * F.col("part")).over(Window.partitionBy(*KEY, "cls", "word"))
    t = t.withColumn("scale", 1 / F.greatest(F.lit(1.0), whole))
    flow = t.filter("theta > 0").select(*KEY, "cls", "word", "dst", (F.col("rate") * F.col("part") * F.col("theta") * F.col("scale")).alias("f"))
    change = flow.select(*KEY, "cls", "word", (-F.col("f")).alias("d")).unionByName(flow.select(*KEY, "cls", F.col("dst").alias("word"), F.col("f").alias("d"))).groupBy(*KEY, "cls", "word").agg(F.sum("d").alias("d"))
    rows = sides.join(change, [*KEY, "cls", "word"], "left")
    return rows.withColumn("after", F.col("a") + F.coalesce("d", F.lit(0.0))).drop("d"), t


def _sides(a: DataFrame, b: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, cls, word, a, b) for every rule set."""
    on = ["split", "cls", "word"]
    rows = a.select(*on, F.col("rate").alias("a")).join(b.select(*on, F.col("rate").alias("b")), on, "full_outer").fillna(0.0, ["a", "b"])
    return rows.crossJoin(F.broadcast(rules))  # a handful


def _with_outputs(sides: DataFrame, moves: DataFrame) -> DataFrame:
    """``sides`` of words that move or are reached, new ones with rates of 0."""
    reached = moves.select(*KEY, "cls", "word").unionByName(moves.select(*KEY, "cls", F.col("dst").alias("word"))).distinct()
    return reached.join(sides, [*KEY, "cls", "word"], "left").fillna(0.0, ["a", "b"])


def fit_many(a: DataFrame, b: DataFrame, hits: DataFrame, support: int = SUPPORT, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(theta (split, rules, cell, theta), values (split, rules, value)): fractions for every split and rule set at once.

    a, b (split, cls, word, n, rate) are the fitted blocks of two populations,
    hits (rules, word, rule, front, dst). Projected subgradient ascent on the
    class-weighted overlap, best iterate of each key; it ends when no key has
    become better for PATIENCE rounds. value is the overlap of the words that
    rules touch.
    """
    cells = settled(environments(a.groupBy("split", "word").agg(F.sum("n").alias("n")), hits, support))
    moves = settled(_moves(a, hits, cells))
    sides = settled(_with_outputs(_sides(a, b, hits.select("rules").distinct()), moves))
    weight = F.when(F.col("cls") == "first", WEIGHTS["first"]).otherwise(WEIGHTS["body"])
    spark = a.sparkSession
    as_rows = lambda x: spark.createDataFrame([(*k, v) for k, v in x.items()], "split string, rules string, cell string, theta double")
    # a number per cell: rules x fronts of each split and rule set, counted before they come to the driver
    named = cells.select(*KEY, "cell").distinct()
    if named.count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of rules")
    theta = {tuple(r): 0.1 for r in named.collect()}
    best, values, still = dict(theta), {}, 0
    for i in range(rounds):
        state, moving = _after(moves, sides, as_rows(theta))
        state = settled(state)
        over = state.select(*KEY, "cls", "word", (F.col("after") - F.col("b")).alias("over"))
        near = moving.join(over, [*KEY, "cls", "word"]).join(over.withColumnsRenamed({"word": "dst", "over": "dst_over"}), [*KEY, "cls", "dst"])
        slope = weight * F.col("rate") * F.col("part") * F.col("scale") * (F.when(F.col("dst_over") < 0, 1).otherwise(0) - F.when(F.col("over") <= 0, 1).otherwise(0))
        g = near.groupBy(*KEY, "cell").agg((F.sum(slope) / F.sum(weight * F.col("rate") * F.col("part"))).alias("x"))
        value = state.groupBy(*KEY).agg(F.sum(weight * F.least("after", "b")).alias("x")).select(*KEY, F.lit(None).cast("string").alias("cell"), "x")
        found = {tuple(r)[:3]: r.x for r in value.unionByName(g).collect()}
        gained = False
        for split, rules in {k[:2] for k in theta}:
            now, known = found.get((split, rules, None), 0.0), values.get((split, rules))
            if known is None or now > known:
                gained |= known is None or now > known + BETTER * max(1.0, abs(known))
                values[split, rules] = now
                best.update({k: t for k, t in theta.items() if k[:2] == (split, rules)})
        still = 0 if gained else still + 1
        if still >= PATIENCE:
            break
        theta = {k: min(1.0, max(0.0, t + FIRST_STEP / (1 + i) ** 0.7 * (found.get(k) or 0.0))) for k, t in theta.items()}
    scores = spark.createDataFrame([(*k, v) for k, v in values.items()], "split string, rules string, value double")
    return as_rows(best), scores


def evaluate_many(a: DataFrame, b: DataFrame, hits: DataFrame, theta: DataFrame) -> DataFrame:
    """(split, rules, before, after): overlap of two populations with the classes pooled by their tokens, without rules and with fitted ones.

    A hit takes its own cell's fraction, else that of its rule's other fronts,
    else none.
    """
    fronts = hits.select("rules", "rule", "front").distinct()
    own = theta.withColumn("rule", F.split_part("cell", F.lit("|"), F.lit(1))).withColumn("at", F.split_part("cell", F.lit("|"), F.lit(2)))
    named = fronts.join(own, ["rules", "rule"]).filter((F.col("at") == F.col("front")) | (F.col("at") == "other"))
    named = named.groupBy(*KEY, "rule", "front").agg(F.max_by("cell", F.col("at") == F.col("front")).alias("cell"))
    moves = _moves(a, hits, named)
    sides = _sides(a, b, hits.select("rules").distinct())
    on = [*KEY, "cls", "word"]
    everything = sides.select(*on).unionByName(moves.select(*KEY, "cls", F.col("dst").alias("word"))).distinct().join(sides, on, "left").fillna(0.0, ["a", "b"])
    state, _ = _after(moves, everything, theta)
    share = lambda rows, name: rows.groupBy("split", "cls").agg(F.sum("n").alias("n")).withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy("split"))).select("split", "cls", name)  # noqa: E731  two classes a split
    rows = state.join(F.broadcast(share(a, "wa")), ["split", "cls"], "left").join(F.broadcast(share(b, "wb")), ["split", "cls"], "left").fillna(0.0, ["wa", "wb"])
    pooled = rows.groupBy(*KEY, "word").agg(F.sum(F.col("a") * F.col("wa")).alias("a"), F.sum(F.col("after") * F.col("wa")).alias("after"), F.sum(F.col("b") * F.col("wb")).alias("b"))
    return pooled.groupBy(*KEY).agg(F.sum(F.least("a", "b")).alias("before"), F.sum(F.least("after", "b")).alias("after"))


def compare_rules(scores: DataFrame, active: str, other: str, gap: float = 0.005) -> DataFrame:
    """(split, before, compared, active, difference, higher, lower) of ``evaluate_many`` for two rule sets; the row ``mean`` has means, and counts of splits."""
    at = lambda name, c: F.max(F.when(F.col("rules") == name, F.col(c)))
    rows = scores.groupBy("split").agg(at(active, "before").alias("before"), at(other, "after").alias("compared"), at(active, "after").alias("active"))
    rows = rows.withColumn("difference", F.col("active") - F.col("compared"))
    rows = rows.withColumn("higher", (F.col("difference") > gap).cast("int")).withColumn("lower", (F.col("difference") < -gap).cast("int"))
    mean = rows.agg(*[F.avg(c).alias(c) for c in ("before", "compared", "active", "difference")], F.sum("higher").cast("int").alias("higher"), F.sum("lower").cast("int").alias("lower"))
    return rows.unionByName(mean.select(F.lit("mean").alias("split"), "*"))
