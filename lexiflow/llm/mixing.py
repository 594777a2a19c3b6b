"""Mixing sources to target weights by pivotal dependent rounding.

A source with target t and size s wants every document t / s times: a whole
number of copies, and a fraction that is a probability of one copy more. These
probabilities are paired: in a fold, the largest document duels with the pool
of the fold's smaller ones. Words move at random from its probability to theirs
or back, until the document is decided (0 or 1) or the whole pool is; then the
next largest duels with what is left. A duel changes neither the words that are
expected nor any document's expectation, and a fold leaves one document
undecided, its smallest unless a document outweighs all others. A reduction
tree deals documents to folds of about ``FAN``, takes the undecided ones up to
the next level, and draws the one left at the root. So a source's mix keeps its
target to within that document.

All draws are hashes of ids and a seed; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import WORD, cut, let, read, uniform

WEIGHTS = (5, 2, 1)
#: Copies of a document at most, and so of a source's target over its size.
MOST = 3
#: Documents that one fold of the reduction tree takes.
FAN = 128


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources in code-point order, null last, take the weights in turn. Targets
    share the sum of all sizes by weight; a source stops at ``most`` times its
    size, and what it leaves is shared again by weight.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(everything) - 1) % len(weights))
    rows = sizes.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # Filled in order of cap per weight, the level at which the rest is spread is known before each source.
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    since = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(since)
    rows = rows.withColumn("level", level).withColumn("full", F.col("cap") < F.col("level") * F.col("w"))
    # levels fall from the first source that is not full, whose level is the final one
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(final, F.lit(0.0)) * F.col("w")).cast("double").alias("target"))


def _duels(units: Column, level: int, seed: int) -> Column:
    """One fold of the tree: units (size, key, nth, p) with their new p, at most one of them undecided (0 < p < 1).

    The pool's probabilities change together: each is ``scale * p + shift``.
    """
    ordered = F.sort_array(units, asc=False)  # the largest first
    total = lambda f: F.aggregate(ordered, F.lit(0.0), lambda x, u: x + f(u))
    start = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"), total(lambda u: u["p"] * u["size"]).alias("mass"), total(lambda u: u["size"].cast("double")).alias("words"), F.array().cast("array<double>").alias("ps"))

    def settle(x):
        return F.when(x < 1e-9, 0.0).when(x > 1 - 1e-9, 1.0).otherwise(x)

    def step(st, u):
        def duel(z):
            up = F.least((1 - z["p"]) * u["size"], z["held"])  # words that can go from the pool to the document
            down = F.least(z["p"] * u["size"], z["words"] - z["held"])  # and back
            rises = uniform(F.lit(seed), F.lit(level), u["key"], u["nth"]) * (up + down) < down
            p = F.when(rises, z["p"] + up / u["size"]).otherwise(z["p"] - down / u["size"])
            left = 1 - F.coalesce(F.when(rises, F.try_divide(up, z["held"])).otherwise(F.try_divide(down, z["words"] - z["held"])), F.lit(0.0))
            return let(F.struct(rises.alias("rises"), settle(p).alias("p"), settle(left).alias("left")), lambda r: close(z, r))

        def close(z, r):
            return F.struct(
                (st["scale"] * r["left"]).alias("scale"),
                (st["shift"] * r["left"] + F.when(r["rises"], 0.0).otherwise(1 - r["left"])).alias("shift"),
                z["mass"].alias("mass"),
                z["words"].alias("words"),
                F.concat(st["ps"], F.array(r["p"])).alias("ps"),
            )

        words, mass = F.greatest(st["words"] - u["size"], F.lit(0.0)), F.greatest(st["mass"] - u["p"] * u["size"], F.lit(0.0))
        held = F.greatest(F.lit(0.0), F.least(words, st["scale"] * mass + st["shift"] * words))
        return let(F.struct(settle(st["scale"] * u["p"] + st["shift"]).alias("p"), words.alias("words"), mass.alias("mass"), held.alias("held")), duel)

    return F.zip_with(ordered, F.aggregate(ordered, start, step, lambda st: st["ps"]), lambda u, p: u.withField("p", p))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 11, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: id_col, size, source_size, target, copies.

    Null texts have no words; texts without words take the whole part of their
    source's rate. Rows without a source form a source of their own, the last
    one. Ids may have any type that can be grouped. Rows without an id or with
    a repeated one are told apart by size only; rows alike in all of these are
    drawn apart all the same. An empty table gives an empty one; other columns
    are ignored.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("key"),
        F.col(f"`{source_col}`").alias("source"),
        F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )
    # repeated ids become one row with a count, and are numbered again below
    rows = cut(rows.groupBy("key", "source", "size").agg(F.count("*").alias("times")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).cast("long").alias("source_size"))
    targets = cut(source_targets(sizes, weights, most))
    each = rows.select("key", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"))
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    each = each.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    each = each.withColumn("rate", F.least(F.lit(float(most)), rate)).withColumn("low", F.floor("rate")).withColumn("p", F.col("rate") - F.col("low"))
    whole = (F.col("size") == 0) | (F.col("p") == 0)
    drawn = each.filter(~whole)
    folds = drawn.groupBy("source").agg(F.ceil(F.count("*") / fan).alias("folds")).withColumnRenamed("source", "s")
    fold = F.pmod(F.xxhash64(F.lit(seed), "key", "nth", "size"), F.col("folds"))
    units = drawn.join(folds, F.col("source").eqNullSafe(F.col("s"))).select("source", fold.alias("fold"), F.struct("size", "key", "nth", "p").alias("u"))
    decided, level = [each.filter(whole).select("source", "key", "size", F.lit(0.0).alias("p"))], 0
    most_folds = folds.agg(F.max("folds")).first()[0] or 0
    while most_folds:
        duels = units.groupBy("source", "fold").agg(F.collect_list("u").alias("us"))  # about fan units each
        done = cut(duels.select("source", "fold", F.explode(_duels(F.col("us"), level, seed)).alias("u")))
        is_open = (F.col("u.p") > 0) & (F.col("u.p") < 1)
        p = F.col("u.p")
        if most_folds == 1:  # the root: what is left of a source is drawn by its probability
            p = F.when(is_open, F.when(uniform(F.lit(seed), F.lit("root"), "u.key", "u.nth") < p, 1.0).otherwise(0.0)).otherwise(p)
            decided.append(done.select("source", "u.key", "u.size", p.alias("p")))
            break
        decided.append(done.filter(~is_open).select("source", "u.key", "u.size", "u.p"))
        units = done.filter(is_open).select("source", F.floor(F.col("fold") / fan).alias("fold"), "u")
        most_folds, level = -(-most_folds // fan), level + 1
    picked = decided[0]
    for part in decided[1:]:
        picked = picked.unionByName(part)
    out = picked.join(t, F.col("source").eqNullSafe(F.col("s")))
    rate = F.least(F.lit(float(most)), F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)))
    return out.select(F.col("key").alias(id_col), "source", "size", "source_size", "target", (F.floor(rate) + F.col("p")).cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as ``mix`` takes it.

    Rows are told apart by two 64-bit hashes of all their columns, so ids may
    be null, repeated or of any type, and columns may have any names. Rows that
    are equal in all columns share the copies that they are given together.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = [x for c in columns for x in (c, c.isNull())]  # a null leaves a hash as it is
    key = F.struct(F.xxhash64(*whole).alias("one"), F.xxhash64(F.lit(1), *whole).alias("two")).alias("key")
    plan = docs.select(key, F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").alias("source"))
    taken = mix(plan, "key", **options).groupBy("key").agg(F.sum("copies").cast("int").alias("taken"), F.count("*").alias("times"))
    taken = cut(taken.filter("taken > 0").select(F.col("key.one").alias("one"), F.col("key.two").alias("two"), "taken", "times"))
    rows = docs.select(F.struct(*columns).alias("row"), key).select("row", "key.one", "key.two").join(taken, ["one", "two"])
    if not taken.filter("times > 1").isEmpty():  # equal rows become one first
        same = rows.filter("times > 1").groupBy("one", "two").agg(F.any_value("row").alias("row"), F.any_value("taken").alias("taken"))
        rows = rows.filter("times = 1").select("row", "taken").unionByName(same.select("row", "taken"))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("taken")))).select("row.*")


def op9_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
