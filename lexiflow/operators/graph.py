"""The word graph: neighbours, components, distances and the impact of rules."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint in the cluster's folder. Only a local master gets a temporary one where none is set."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir", None) and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


def incident(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("word"), F.col("dst").alias("near")).union(edges.select("dst", "src")).distinct()


def between(edges: DataFrame, words: DataFrame) -> DataFrame:
    """Edges with both ends among ``words`` (word)."""
    return edges.join(words.select(F.col("word").alias("src")), "src", "left_semi").join(words.select(F.col("word").alias("dst")), "dst", "left_semi")


def multiplicity(edges: DataFrame) -> DataFrame:
    outs = edges.groupBy("src").agg(F.count("*").alias("o"))
    ins = edges.groupBy("dst").agg(F.count("*").alias("i"))
    cls = F.when((F.col("o") == 1) & (F.col("i") == 1), "1:1").when(F.col("i") == 1, "1:n").when(F.col("o") == 1, "n:1").otherwise("n:m")
    return edges.join(outs, "src").join(ins, "dst").select("src", "dst", cls.alias("class"))


def hubs(edges: DataFrame, top: int) -> DataFrame:
    """The ``top`` outputs with most sources among those that each rule makes."""
    many = edges.groupBy("dst").agg(F.count("*").alias("sources")).filter("sources > 1")
    per = edges.select(F.explode("codes").alias("code"), "dst").distinct().join(many, "dst")
    order = Window.partitionBy("code").orderBy(F.desc("sources"), "dst")
    return per.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top).select("code", "dst", "sources")


def components(edges: DataFrame, *key: str) -> DataFrame:
    """(key, word, component) by min-label propagation with pointer jumping; stops when no label changes."""
    both = settled(edges.select(*key, F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(*key, "dst", "src")).distinct())
    on = list(key)
    now = settled(both.groupBy(*key, F.col("a").alias("word")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(now.withColumnRenamed("word", "b"), [*on, "b"]).groupBy(*key, "a").agg(F.min("component").alias("near"))
        step = now.join(near.withColumnRenamed("a", "word"), [*on, "word"]).withColumn("best", F.least("component", "near"))
        step = settled(step.select(*key, "word", F.col("component").alias("old"), "best"))
        jump = step.select(*key, F.col("word").alias("best"), F.col("best").alias("further"))
        new = settled(step.join(jump, [*on, "best"]).select(*key, "word", "old", F.least("best", "further").alias("component")))
        if new.filter("component <> old").isEmpty():
            return new.drop("old")
        now = new.drop("old")


def distances(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(seed, word, distance, parent, codes) of all words that seeds (word) reach, or those within ``most`` steps.

    Parents lead back along a shortest path; on ties the least word. Steps of all
    seeds are one join: a word's neighbours lie at most one step from it, so a
    new layer is told from old words by the last two layers alone.
    """
    both = edges.select("src", "dst", "codes").union(edges.select("dst", "src", "codes"))
    both = settled(both.groupBy("src", "dst").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes")))
    first = seeds.select("word").distinct().select(F.col("word").alias("seed"), "word", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("codes"))
    layers = [settled(first)]
    while most is None or len(layers) <= most:
        edge = layers[-1].select("seed", F.col("word").alias("src"))
        found = both.join(edge, "src").groupBy("seed", F.col("dst").alias("word")).agg(F.min(F.struct(F.col("src").alias("parent"), "codes")).alias("via"))
        known = reduce(DataFrame.union, [layer.select("seed", "word") for layer in layers[-2:]])
        new = settled(found.join(known, ["seed", "word"], "left_anti").select("seed", "word", F.lit(len(layers)).alias("distance"), "via.parent", "via.codes"))
        if new.isEmpty():
            break
        layers.append(new)
    return reduce(DataFrame.unionByName, layers).withColumn("codes", F.array_join("codes", "+"))


def without(edges: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(removed, src, dst, codes, left): edges once for no removal ('') and once for each group of rules, with the codes left.

    Codes of an edge are alternatives; a composed code (parts joined by +) goes with any of its parts, C1.2 with C1.
    """
    cases = [F.struct(F.lit(name).alias("removed"), F.array(*map(F.lit, codes)).cast("array<string>").alias("out")) for name, codes in [("", []), *groups.items()]]
    rows = edges.select(F.explode(F.array(*cases)).alias("c"), "src", "dst", "codes").select("c.*", "src", "dst", "codes")
    return rows.withColumn("left", F.filter("codes", lambda c: ~F.arrays_overlap(F.transform(F.split(c, r"\+"), lambda p: F.regexp_replace(p, r"\.\d+$", "")), F.col("out")))).drop("out")


def removal_impact(edges: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(removed, isolated, split): words left without an edge and components that arise, one component job for all removals."""
    found = settled(components(without(edges, groups).filter(F.size("left") > 0), "removed"))
    sizes = found.groupBy("removed").agg(F.count("*").alias("words"), F.countDistinct("component").alias("components"))
    base = sizes.filter("removed = ''").select(F.col("words").alias("all_words"), F.col("components").alias("all_components"))
    left = edges.sparkSession.createDataFrame([(name,) for name in groups], "removed string").join(sizes, "removed", "left").fillna(0)  # a row per group
    lost = F.col("all_words") - F.col("words")
    return left.crossJoin(F.broadcast(base)).select("removed", lost.alias("isolated"), (F.col("components") - F.col("all_components") + lost).alias("split"))


def word_impact(edges: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(removed, word, members, remaining, detached, links) of every word and group of rules.

    Size of the word's component before and after the removal, and the links
    (an edge counts once per code) that go in the component it was in.
    """
    rows = without(edges, groups)
    found = settled(components(rows.filter(F.size("left") > 0), "removed"))
    sized = settled(found.join(found.groupBy("removed", "component").agg(F.count("*").alias("size")), ["removed", "component"]))
    before = sized.filter("removed = ''").select("word", F.col("component").alias("whole"), F.col("size").alias("members"))
    gone = rows.filter("removed <> ''").select("removed", F.col("src").alias("word"), (F.size("codes") - F.size("left")).alias("gone")).groupBy("removed", "word").agg(F.sum("gone").alias("gone"))
    links = gone.join(before.select("word", "whole"), "word").groupBy("removed", "whole").agg(F.sum("gone").alias("links"))
    every = before.withColumn("removed", F.explode(F.array(*[F.lit(name) for name in groups])))
    out = every.join(sized.filter("removed <> ''").select("removed", "word", "size"), ["removed", "word"], "left").join(links, ["removed", "whole"], "left")
    remaining = F.coalesce("size", F.lit(1))
    return out.select("removed", "word", "members", remaining.alias("remaining"), (F.col("members") - remaining).alias("detached"), F.coalesce("links", F.lit(0)).alias("links"))
