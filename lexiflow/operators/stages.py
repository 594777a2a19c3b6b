"""Accounting through a middle population: direct and staged routes of mass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.operators import graph, network


def same_spelling(rows: DataFrame) -> DataFrame:
    """Credit of keeping a spelling: direct (source to target) and staged (through the middle): rows (word, a, m, b)."""
    staged = F.least("a", "m", "b")
    return rows.select("word", F.least("a", "b").alias("direct"), staged.alias("staged"), F.least("a", "m").alias("arrived"), (F.least("a", "m") - staged).alias("stops"))


def routed(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """(word, routed): mass that reaches each middle word over routes (src, dst) within what identity leaves of both sides.

    Capacity left at a source is dealt to its routes in equal parts, so this is
    a lower bound of the maximum that the allocation job finds.
    """
    left = rows.select(F.col("word").alias("src"), (F.col("a") - F.least("a", "m")).alias("left")).filter("left > 0")
    room = rows.select(F.col("word").alias("dst"), (F.col("m") - F.least("a", "m")).alias("room")).filter("room > 0")
    open_routes = routes.join(left, "src").join(room, "dst")
    n = open_routes.groupBy("src").agg(F.count("*").alias("n"))
    offers = open_routes.join(n, "src").groupBy("dst", "room").agg(F.sum(F.col("left") / F.col("n")).alias("offer"))
    return offers.select(F.col("dst").alias("word"), F.least("room", "offer").alias("routed"))


def timed(pairs: DataFrame, first: bool, second: bool, swap) -> DataFrame:
    """Where an exchange takes place on a leg: (word, at_middle, at_target) by ``swap`` on the first and second leg."""
    middle = swap(F.col("word")) if first else F.col("word")
    rows = pairs.select("word", middle.alias("at_middle"))
    return rows.withColumn("at_target", swap(F.col("at_middle")) if second else F.col("at_middle"))


# Routed accounting: same spellings in closed form, the rest as a largest flow through three layers.

#: Settings of an account: how mass may travel, and on which leg the exchange takes place.
MODES, TIMINGS = ("direct", "staged", "both"), {"none": (False, False), "first": (True, False), "second": (False, True), "both": (True, True)}
TOTALS = ("source", "middle", "target", "same", "direct", "staged", "stops", "routed", "credited", "through", "left", "missing", "unreached", "baseline", "gained", "lost", "net")
EPS = 1e-9


def linked(words: DataFrame, routes: DataFrame, swap=None) -> DataFrame:
    """(word, component) of ``words`` (word) that a route (src, dst) or the exchange joins to another of them."""
    pairs = routes.select("src", "dst")
    if swap is not None:
        # an exchange before or after a route joins its ends' exchanged spellings as well
        pairs = pairs.unionByName(words.select(F.col("word").alias("src"), swap(F.col("word")).alias("dst")))
        pairs = pairs.unionByName(routes.select(swap(F.col("src")).alias("src"), "dst")).unionByName(routes.select("src", swap(F.col("dst")).alias("dst")))
    return graph.components(pairs.filter("src <> dst").distinct()).join(words.select("word").distinct(), "word", "left_semi")


def settings(modes=MODES, timings=("none",)) -> list[tuple[str, str, bool, bool]]:
    return [(m, t, *TIMINGS[t]) for m in modes for t in timings]


def account(rows: DataFrame, routes: DataFrame, *key: str, modes=MODES, timings=("none",), swap=None, stops: bool = True, most: int = network.ARCS) -> tuple[DataFrame, DataFrame]:
    """Accounts of mass from a source through a middle to a target population: (ledgers per word, flows).

    rows (key, word, a, m, b): rates of the three populations; routes (src,
    dst): pairs along which mass may move, in that direction. ``swap`` is an
    exchange of spellings that is its own inverse; a timing says on which legs
    it takes place. All keys, modes and timings are solved in one job.

    A word keeps its (exchanged) spelling first. What is left of a source goes
    along a route straight to a target, or to a middle word within its rate and
    from there to a target, as much as can be credited; only then is mass that
    reaches the middle counted as stopping there.

    Words that no route touches, nor their exchanged spellings, need no
    network: each source has one middle and one target there (``_unrouted``).
    """
    swapped = swap is not None
    exchange = swap or (lambda c: c)
    ends = routes.select(F.col("src").alias("word")).unionByName(routes.select(F.col("dst").alias("word")))
    if swapped:
        ends = ends.unionByName(ends.select(exchange(F.col("word")).alias("word")))
    ends = graph.settled(ends.distinct())
    rest, ways = _unrouted(rows.join(ends, "word", "left_anti"), key, modes, timings, swap, stops)
    ledger, flows = _routed_account(graph.settled(rows.join(ends, "word", "left_semi")), routes, *key, modes=modes, timings=timings, swap=swap, stops=stops, most=most)
    return ledger.unionByName(rest), flows.unionByName(ways)


def _cases(modes, timings):
    return F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(t).alias("timing"), F.lit(f).alias("first"), F.lit(s).alias("second")) for m, t, f, s in settings(modes, timings)])).alias("s")


def _unrouted(rows: DataFrame, key, modes, timings, swap, stops: bool) -> tuple[DataFrame, DataFrame]:
    """``account`` of words without routes, side by side with their exchanged spellings (x and y).

    What keeps its spelling leaves nothing for the network's first tier: a
    source, its middle or its target is used up. The rest stops at the middle.
    """
    k, zero, names = list(key), F.lit(0.0), ("a", "m", "b")
    wide = rows.select(*k, "word", *[F.col(c).alias(f"{c}x") for c in names])
    if swap is not None and tuple(timings) != ("none",):
        other = rows.select(*k, F.col("word").alias("partner"), *[F.col(c).alias(f"{c}y") for c in names])
        wide = wide.withColumn("partner", swap(F.col("word"))).join(other, [*k, "partner"], "left").fillna(0.0, [f"{c}y" for c in names])
    else:
        wide = wide.withColumn("partner", F.col("word") if swap is None else swap(F.col("word"))).withColumns({f"{c}y": F.col(f"{c}x") for c in names})
    each = wide.select("*", _cases(modes, timings)).select(*wide.columns, "s.*")
    turn = lambda on, x, y: F.when(on, F.col(y)).otherwise(F.col(x))
    first, second, direct, staged = F.col("first"), F.col("second"), F.col("mode") == "direct", F.col("mode") == "staged"
    cross = first != second
    pair = lambda name, f: {f"{name}x": f("x", "y"), f"{name}y": f("y", "x")}
    each = each.withColumns(pair("m", lambda x, _: F.when(direct, zero).otherwise(F.col(f"m{x}"))))
    each = each.withColumns(pair("mp", lambda x, y: turn(first, f"m{x}", f"m{y}")) | pair("bq", lambda x, y: turn(cross, f"b{x}", f"b{y}")))
    each = each.withColumns(pair("s", lambda x, _: F.when(staged, F.least(f"a{x}", f"bq{x}", f"mp{x}")).otherwise(F.least(f"a{x}", f"bq{x}"))))
    each = each.withColumns(pair("in", lambda x, y: turn(cross, f"s{x}", f"s{y}")) | pair("th", lambda x, y: F.when(staged, turn(first, f"s{x}", f"s{y}")).otherwise(zero)))
    each = each.withColumns(pair("ar", lambda x, _: F.col(f"a{x}") - F.col(f"s{x}")) | pair("br", lambda x, _: F.col(f"b{x}") - F.col(f"in{x}")) | pair("mr", lambda x, _: F.col(f"m{x}") - F.col(f"th{x}")))
    each = each.withColumns(pair("to", lambda x, y: turn(first, f"mr{x}", f"mr{y}")))  # room at the middle that a source leads to
    stopped = lambda x: F.when(~direct & (F.col(f"ar{x}") > EPS) & (F.col(f"to{x}") > EPS) & F.lit(stops), F.least(f"ar{x}", f"to{x}")).otherwise(zero)
    each = each.withColumns(pair("out", lambda x, _: stopped(x)))
    came = turn(first, "outx", "outy")
    component = F.least("word", "partner")
    ledger = each.select(
        *k, "mode", "timing", component.alias("component"), "word", F.col("ax").alias("source"), F.col("mx").alias("middle"), F.col("bx").alias("target"), F.col("sx").alias("same"), F.col("inx").alias("same_in"), F.col("thx").alias("same_through"), zero.alias("direct"), F.col("outx").alias("to_middle"),
        (F.col("thx") + came).alias("inflow"), F.col("thx").alias("passed"), came.alias("stops"), zero.alias("received"),
        F.col("inx").alias("credited"), F.greatest(zero, F.col("arx") - F.col("outx")).alias("left"), F.greatest(zero, F.col("bx") - F.col("inx")).alias("missing"),
        F.greatest(zero, F.col("mx") - F.col("thx") - came).alias("unreached"), F.least("ax", "bx").alias("baseline"),
    )
    w, p = F.col("word"), F.col("partner")
    arc = lambda on, dst, kind, flow: F.when(on & ~direct, F.struct(dst.alias("dst"), F.lit(kind).alias("kind"), flow.alias("flow")))
    ways = F.array(
        arc((F.col("arx") > EPS) & (F.col("tox") > EPS), F.when(first, p).otherwise(w), "leg1", F.col("outx")),
        arc(F.col("mrx") > EPS, w, "through", came),
        arc((F.col("mrx") > EPS) & (turn(second, "brx", "bry") > EPS), F.when(second, p).otherwise(w), "leg2", zero),
    )
    flows = each.select(*k, "mode", "timing", component.alias("component"), w.alias("src"), F.explode(F.array_compact(ways)).alias("f"))
    return ledger, flows.select(*k, "mode", "timing", "component", "src", "f.*")


def _routed_account(rows: DataFrame, routes: DataFrame, *key: str, modes, timings, swap, stops: bool, most: int) -> tuple[DataFrame, DataFrame]:
    """``account`` of words that routes touch."""
    identity = lambda c: c
    swap = swap or identity
    k = [*key, "mode", "timing"]
    cases = _cases(modes, timings)
    w = F.col("word")
    each = rows.select(*key, "word", "a", "m", "b", cases).select(*key, "word", "a", "m", "b", "s.*")
    each = each.withColumn("m", F.when(F.col("mode") == "direct", 0.0).otherwise(F.col("m")))
    each = each.withColumn("at_middle", F.when(F.col("first"), swap(w)).otherwise(w))
    each = each.withColumn("to_target", F.when(F.col("first") != F.col("second"), swap(w)).otherwise(w)).withColumn("on", F.when(F.col("second"), swap(w)).otherwise(w))
    each = graph.settled(each)
    # 1. same spellings
    b = each.select(*k, w.alias("to_target"), F.col("b").alias("b_there"))
    m = each.select(*k, w.alias("at_middle"), F.col("m").alias("m_there"))
    own = each.join(b, [*k, "to_target"], "left").join(m, [*k, "at_middle"], "left")
    same = F.when(F.col("mode") == "staged", F.least("a", F.coalesce("b_there", F.lit(0.0)), F.coalesce("m_there", F.lit(0.0)))).otherwise(F.least("a", F.coalesce("b_there", F.lit(0.0))))
    own = graph.settled(own.select(*k, "word", "a", "m", "b", "at_middle", "to_target", "on", same.alias("same")))
    got = own.select(*k, F.col("to_target").alias("word"), F.col("same").alias("same_in"))
    passed = own.filter("mode = 'staged'").select(*k, F.col("at_middle").alias("word"), F.col("same").alias("same_through"))
    left = own.join(got, [*k, "word"], "left").join(passed, [*k, "word"], "left").fillna(0.0, ["same_in", "same_through"])
    left = left.withColumns({"ar": F.col("a") - F.col("same"), "br": F.col("b") - F.col("same_in"), "mr": F.col("m") - F.col("same_through")})
    groups = linked(rows.select("word").distinct(), routes, None if swap is identity else swap)
    left = graph.settled(left.join(groups, "word", "left").withColumn("component", F.coalesce("component", "word")))
    # 2. what is left, over routes
    g = [*k, "component"]
    sources, targets, middles = left.filter(F.col("ar") > EPS), left.filter(F.col("br") > EPS), left.filter((F.col("mr") > EPS) & (F.col("mode") != "direct"))
    node = lambda layer, c: F.concat(F.lit(layer), c)
    arc = lambda a, b, cap, kind: (a.alias("a"), b.alias("b"), cap.alias("cap"), F.lit(kind).alias("kind"))
    there = targets.select(*k, w.alias("dst"), "br")
    half = middles.select(*k, w.alias("dst"), "mr")
    stay = lambda df, c: df.select(*g, "word", *[x for x in ("ar", "mr") if x in df.columns], F.col(c).alias("dst"))
    along = lambda df, c: df.withColumn("src", F.col(c)).join(routes, "src").filter(F.col("dst") != F.col("src"))
    straight = along(sources.filter(F.col("mode") != "staged"), "to_target").select(*g, "word", "ar", "dst").join(there, [*k, "dst"])
    leg1 = along(sources.filter(F.col("mode") != "direct"), "at_middle").select(*g, "word", "ar", "dst").unionByName(stay(sources.filter(F.col("mode") != "direct").select(*g, "word", "ar", "at_middle"), "at_middle")).join(half, [*k, "dst"])
    leg2 = along(middles, "on").select(*g, "word", "mr", "dst").unionByName(stay(middles.select(*g, "word", "mr", "on"), "on")).join(there, [*k, "dst"])
    arcs = (
        straight.select(*g, *arc(node("e:", w), node("h:", F.col("dst")), F.least("ar", "br"), "direct"))
        .unionByName(leg1.select(*g, *arc(node("e:", w), node("i:", F.col("dst")), F.least("ar", "mr"), "leg1")))
        .unionByName(middles.select(*g, *arc(node("i:", w), node("o:", w), F.col("mr"), "through")))
        .unionByName(leg2.select(*g, *arc(node("o:", w), node("h:", F.col("dst")), F.least("mr", "br"), "leg2")))
    )
    supply = sources.select(*g, node("e:", w).alias("node"), F.col("ar").alias("v"))
    demand = targets.select(*g, node("h:", w).alias("node"), F.col("br").alias("v"), F.lit(1).alias("tier"))
    if stops:
        demand = demand.unionByName(middles.select(*g, node("o:", w).alias("node"), F.col("mr").alias("v"), F.lit(2).alias("tier")))
    solved = network.maximum(arcs.drop("kind"), supply, demand, *g, most=most)
    layer = F.concat(F.substring("a", 1, 1), F.substring("b", 1, 1))
    kind = F.when(layer == "eh", "direct").when(layer == "ei", "leg1").when(layer == "io", "through").otherwise("leg2")
    flows = graph.settled(solved.select(*g, F.expr("substring(a, 3)").alias("src"), F.expr("substring(b, 3)").alias("dst"), kind.alias("kind"), "flow"))
    # 3. ledgers
    leaves = flows.groupBy(*k, F.col("src").alias("word")).agg(*[F.sum(F.when(F.col("kind") == x, F.col("flow")).otherwise(0.0)).alias(n) for x, n in (("direct", "direct"), ("leg1", "to_middle"), ("leg2", "passed_on"), ("through", "inflow_routed"))])
    comes = flows.filter("kind in ('direct', 'leg2')").groupBy(*k, F.col("dst").alias("word")).agg(F.sum("flow").alias("received"))
    out = left.join(leaves, [*k, "word"], "left").join(comes, [*k, "word"], "left").fillna(0.0, ["direct", "to_middle", "passed_on", "inflow_routed", "received"])
    zero = F.lit(0.0)
    credited, inflow = F.col("same_in") + F.col("received"), F.col("same_through") + F.col("inflow_routed")
    ledger = out.select(
        *k, "component", "word", F.col("a").alias("source"), F.col("m").alias("middle"), F.col("b").alias("target"), "same", "same_in", "same_through", "direct", "to_middle",
        inflow.alias("inflow"), (F.col("same_through") + F.col("passed_on")).alias("passed"), F.greatest(zero, F.col("inflow_routed") - F.col("passed_on")).alias("stops"), "received",
        credited.alias("credited"), F.greatest(zero, F.col("ar") - F.col("direct") - F.col("to_middle")).alias("left"), F.greatest(zero, F.col("b") - credited).alias("missing"),
        F.greatest(zero, F.col("m") - inflow).alias("unreached"), F.least("a", "b").alias("baseline"),
    )
    return graph.settled(ledger), flows


def account_totals(ledger: DataFrame, *by: str) -> DataFrame:
    """TOTALS per group ``by`` of the ledgers of ``account``."""
    total = lambda c, n: F.sum(c).alias(n)
    gain = F.col("credited") - F.col("baseline")
    rows = ledger.groupBy(*by).agg(
        *[total(c, c) for c in ("source", "middle", "target", "same", "direct", "stops", "left", "missing", "unreached", "baseline", "credited")],
        total(F.col("passed") - F.col("same_through"), "staged"), total("passed", "through"),
        total(F.greatest(gain, F.lit(0.0)), "gained"), total(F.greatest(-gain, F.lit(0.0)), "lost"),
    )
    rows = rows.withColumn("routed", F.col("direct") + F.col("staged")).withColumn("net", F.col("credited") - F.col("baseline"))
    return rows.select(*by, *TOTALS)


def unexplained(ledger: DataFrame, top: int, *by: str) -> DataFrame:
    """(by, component, lead, size, missing, left): the components of two words or more with most mass missing and left; lead: the word of the largest source and target rates."""
    weight = F.col("source") + F.col("target")
    rows = ledger.groupBy(*by, "component").agg(F.max_by("word", F.struct(F.round(weight, 6), "word")).alias("lead"), F.count("*").alias("size"), F.sum("missing").alias("missing"), F.sum("left").alias("left"))
    rows = rows.filter("size > 1")
    order = [F.desc(F.round(F.col("missing") + F.col("left"), 6)), F.col("component")]
    if not by:
        return rows.orderBy(*order).limit(top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top).drop("rank")


def exchange_effect(ledger: DataFrame, label, *by: str) -> DataFrame:
    """(by, without, with, gain, and the credit moved into words of each label): accounts with timing none against those with another, by class and mode.

    ``label`` names words (k, t, kt or null) into which moved credit is counted.
    """
    plain = F.col("timing") == "none"
    words = ledger.groupBy(*by, "word").agg(F.sum(F.when(plain, F.col("credited")).otherwise(0.0)).alias("x"), F.sum(F.when(~plain, F.col("credited")).otherwise(0.0)).alias("y"))
    moved = lambda name: F.coalesce(F.sum(F.when(label == name, F.col("y") - F.col("x"))), F.lit(0.0)).alias(f"into_{name}")
    rows = words.groupBy(*by).agg(F.count("*").alias("words"), F.sum("x").alias("without"), F.sum("y").alias("with"), *[moved(n) for n in ("k", "t", "kt")])
    return rows.withColumn("gain", F.col("with") - F.col("without"))
