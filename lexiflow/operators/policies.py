"""Credit of word families under policies that admit or bar exchanges.

A family has words with rates a and b and routes; some routes are exchanges.
Each policy, basis and family is a key of one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators import network
from lexiflow.operators.graph import settled

#: Policies: which exchanges they admit, and whether both ends must be common.
POLICIES = {"none": ("none", False), "all": ("all", False), "after_o": ("after_o", False), "all_common": ("all", True), "after_o_common": ("after_o", True)}
#: Occurrences that make the two ends of an exchange common.
COMMON = 3


def admitted(routes: DataFrame, words: DataFrame, policies: dict = POLICIES, common: int = COMMON) -> DataFrame:
    """(policy, family, source, target): the routes (family, source, target, exchange, after_o) that each policy admits."""
    n = words.select("family", "word", "n_a", "n_b")
    rows = routes.join(n.select("family", F.col("word").alias("source"), F.col("n_a").alias("s")), ["family", "source"]).join(n.select("family", F.col("word").alias("target"), F.col("n_b").alias("t")), ["family", "target"])
    kinds = F.explode(F.array(*[F.struct(F.lit(name).alias("policy"), F.lit(which).alias("which"), F.lit(both).alias("both")) for name, (which, both) in policies.items()]))
    rows = rows.withColumn("p", kinds)
    which = (F.col("p.which") == "all") | ((F.col("p.which") == "after_o") & F.col("after_o"))
    fits = ~F.col("exchange") | (which & (~F.col("p.both") | (F.least("s", "t") >= common)))
    return rows.filter(fits).select("p.policy", "family", "source", "target").distinct()


def solve(words: DataFrame, routes: DataFrame, policies: dict = POLICIES, bases: tuple[str, ...] = ("stock", "signed"), most: int = network.ARCS) -> tuple[DataFrame, DataFrame]:
    """(credits (policy, basis, family, credit, identity, unplaced, unfilled), destinations (policy, basis, family, word, mass)).

    words (family, word, a, b, n_a, n_b). ``stock``: all mass may move or stay;
    ``signed``: what stays is credited first, and only losses and gains move.
    """
    key = ["policy", "basis", "family"]
    zero = F.lit(0.0)
    cases = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(b).alias("basis")) for p in policies for b in bases])).alias("c")
    each = settled(words.select("family", "word", "a", "b", cases).select("c.*", "family", "word", "a", "b"))
    signed = F.col("basis") == "signed"
    each = each.withColumn("have", F.when(signed, F.greatest(F.col("a") - F.col("b"), zero)).otherwise(F.col("a"))).withColumn("want", F.when(signed, F.greatest(F.col("b") - F.col("a"), zero)).otherwise(F.col("b")))
    node = lambda layer, c: F.concat(F.lit(layer), F.col(c))
    have, want = each.filter("have > 1e-9"), each.filter("want > 1e-9")
    open_ = admitted(routes, words, policies).filter("source <> target")
    moves = have.select(*key, F.col("word").alias("source"), "have").join(open_, ["policy", "family", "source"]).join(want.select(*key, F.col("word").alias("target"), "want"), [*key, "target"])
    stays = each.filter("basis = 'stock' and have > 1e-9 and want > 1e-9").select(*key, F.col("word").alias("source"), F.col("word").alias("target"), "have", "want")
    arcs = moves.select(*key, "source", "target", "have", "want").unionByName(stays).select(*key, node("e:", "source").alias("a"), node("h:", "target").alias("b"), F.least("have", "want").alias("cap"))
    flows = network.maximum(arcs, have.select(*key, node("e:", "word").alias("node"), F.col("have").alias("v")), want.select(*key, node("h:", "word").alias("node"), F.col("want").alias("v"), F.lit(1).alias("tier")), *key, most=most)
    into = settled(flows.groupBy(*key, F.expr("substring(b, 3)").alias("word")).agg(F.sum("flow").alias("mass")).filter("mass > 1e-9"))
    routed = into.groupBy(*key).agg(F.sum("mass").alias("routed"))
    sums = each.groupBy(*key).agg(F.sum("a").alias("source"), F.sum("b").alias("target"), F.sum(F.least("a", "b")).alias("identity"))
    rows = sums.join(routed, key, "left").fillna(0.0, ["routed"])
    credit = F.col("routed") + F.when(signed, F.col("identity")).otherwise(0.0)
    rows = rows.withColumn("credit", credit)
    return settled(rows.select(*key, "credit", "identity", F.greatest(zero, F.col("source") - F.col("credit")).alias("unplaced"), F.greatest(zero, F.col("target") - F.col("credit")).alias("unfilled"))), into


def against_none(credits: DataFrame, destinations: DataFrame) -> DataFrame:
    """(policy, basis, family, before, after, gain, gross_gain, loss): each policy against ``none``; the last two by destination."""
    base = credits.filter("policy = 'none'").select("basis", "family", F.col("credit").alias("before"))
    rows = credits.filter("policy <> 'none'").select("policy", "basis", "family", F.col("credit").alias("after")).join(base, ["basis", "family"])
    names = rows.select("policy").distinct()  # a handful
    old = destinations.filter("policy = 'none'").drop("policy").crossJoin(F.broadcast(names)).select("policy", "basis", "family", "word", F.col("mass").alias("x"))
    both = destinations.filter("policy <> 'none'").join(old, ["policy", "basis", "family", "word"], "full_outer").fillna(0.0, ["mass", "x"])
    moved = both.groupBy("policy", "basis", "family").agg(F.sum(F.greatest(F.col("mass") - F.col("x"), F.lit(0.0))).alias("gross_gain"), F.sum(F.greatest(F.col("x") - F.col("mass"), F.lit(0.0))).alias("loss"))
    out = rows.join(moved, ["policy", "basis", "family"], "left").fillna(0.0, ["gross_gain", "loss"])
    return out.select("policy", "basis", "family", "before", "after", (F.col("after") - F.col("before")).alias("gain"), "gross_gain", "loss")
