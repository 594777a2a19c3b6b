"""Neighbour contexts: filters, cells per sheet, contrasts and exact tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.operators.graph import settled
from lexiflow.operators.ranks import numbered, running


def without_neighbours(toks: DataFrame, label: str, names: list[str]) -> DataFrame:
    return toks.filter(~F.col(label).isin(*names)) if names else toks


def only_neighbours(toks: DataFrame, label: str, names: list[str]) -> DataFrame:
    return toks.filter(F.col(label).isin(*names)) if names else toks


def group_filters(toks: DataFrame, only: dict[str, list[str]], exclude: dict[str, list[str]]) -> DataFrame:
    """Any of the ``only`` classes on each side that names some, and none of the ``exclude`` classes."""
    for c, names in only.items():
        toks = only_neighbours(toks, c, names)
    for c, names in exclude.items():
        toks = without_neighbours(toks, c, names)
    return toks


def cells(toks: DataFrame, cluster: str, cls: str, hit: Column) -> DataFrame:
    return toks.groupBy(cluster, cls).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))


def cluster_sums(rows: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Counts of each class in each part and the squared sheet scores of the weighted sum of its shares.

    rows: sheet, class (not null), part (0, 1, ...; one per weight). Gives class,
    t0.. (rows of the class), n0.. (rows), g0.. (sheets) of the parts, g (sheets)
    and ss. A sheet without the class scores by its row totals alone: the sum of
    these over all sheets is a form of few products, so that only sheets that
    hold a class are visited.
    """
    parts = range(len(weights))
    cells = settled(rows.groupBy("sheet", "class").agg(*[F.count_if(F.col("part") == i).cast("double").alias(f"h{i}") for i in parts]))
    sheets = cells.groupBy("sheet").agg(*[F.sum(f"h{i}").alias(f"m{i}") for i in parts])
    square = [F.sum(F.col(f"m{i}") * F.col(f"m{j}")).alias(f"q{i}{j}") for i in parts for j in parts]
    totals = sheets.agg(*[F.sum(f"m{i}").alias(f"n{i}") for i in parts], *[F.count_if(F.col(f"m{i}") > 0).alias(f"g{i}") for i in parts], F.count("*").alias("g"), *square)  # one row
    classes = cells.groupBy("class").agg(*[F.sum(f"h{i}").alias(f"t{i}") for i in parts])
    pull = [F.try_divide(F.lit(float(w)) * F.col(f"t{i}"), F.col(f"n{i}") * F.col(f"n{i}")) for i, w in enumerate(weights)]
    base = -sum((F.col(f"m{i}") * pull[i] for i in parts), F.lit(0.0))
    own = sum((F.try_divide(F.lit(float(w)) * F.col(f"h{i}"), F.col(f"n{i}")) for i, w in enumerate(weights)), F.lit(0.0))
    held = cells.join(sheets, "sheet").join(classes, "class").crossJoin(F.broadcast(totals))
    more = held.groupBy("class").agg(F.sum(own * (own + 2 * base)).alias("_more"))
    every = sum((pull[i] * pull[j] * F.col(f"q{i}{j}") for i in parts for j in parts), F.lit(0.0))
    out = classes.join(more, "class").crossJoin(F.broadcast(totals))
    return out.select("class", *[f"{c}{i}" for c in "tng" for i in parts], "g", F.greatest(F.lit(0.0), F.col("_more") + every).alias("ss"))


def contrast(rows: DataFrame, gap: float = 0.01, lift: float = 2.0, large: float = 0.05) -> DataFrame:
    """Share of each class in focus rows less its share in the others, with a cluster-robust error by sheet.

    rows: sheet, class, focus. Sheets without a class still count, with a score
    of their row totals.
    """
    sums = cluster_sums(rows.select("sheet", "class", F.when(F.col("focus"), 0).otherwise(1).alias("part")), (1.0, -1.0))
    a, b, n = F.col("t0") / F.col("n0"), F.col("t1") / F.col("n1"), F.col("n0") + F.col("n1")
    hits = F.col("t0") + F.col("t1")
    far = (F.abs(a - b) >= gap) & ((a >= lift * b) | (b >= lift * a)) | (F.abs(a - b) >= large)
    return sums.select(
        "class",
        (a - b).alias("effect"),
        F.sqrt(F.col("ss") * F.col("g") / (F.col("g") - 1) * (n - 1) / (n - 2)).alias("se"),
        (F.col("g") - 1).alias("df"),
        ((F.col("g") >= 6) & (hits >= 5) & (n - hits >= 5)).alias("supported"),
        far.alias("review"),
    )


def weighted_contrast(rows: DataFrame, weights: tuple[float, ...], sheets: int = 6, least: int = 5) -> DataFrame:
    """(class, effect, se, df, supported): weighted sum of a class's shares of the parts, rows (sheet, class, part).

    Two populations: weights (-1, 1). Their focus rows against their others, parts
    (focus, others, focus, others): (-1, 1, 1, -1). The degrees of freedom are
    those of the part with fewest sheets. Supported: every part has ``sheets``
    sheets and ``least`` rows with and without the class. A part without rows
    gives a null effect and error.
    """
    parts, sums = range(len(weights)), cluster_sums(rows, weights)
    effect = sum((F.lit(float(w)) * F.try_divide(F.col(f"t{i}"), F.col(f"n{i}")) for i, w in enumerate(weights)), F.lit(0.0))
    n = sum((F.col(f"n{i}") for i in parts), F.lit(0.0))
    se = F.sqrt(F.try_divide(F.col("ss") * F.col("g"), F.col("g") - 1) * F.try_divide(n - 1, n - len(weights)))
    enough = [(F.col(f"g{i}") >= sheets) & (F.col(f"t{i}") >= least) & (F.col(f"n{i}") - F.col(f"t{i}") >= least) for i in parts]
    return sums.select("class", effect.alias("effect"), F.when(effect.isNotNull(), se).alias("se"), (F.least(*[F.col(f"g{i}") for i in parts]) - 1).alias("df"), reduce(Column.__and__, enough).alias("supported"))


def review(rows: DataFrame, gap: float = 0.01, lift: float = 2.0, large: float = 0.05) -> DataFrame:
    """(class, kind, effect, lift, flagged) of two populations, rows (class, part): focus and others of the first, then of the second.

    ``section`` compares the populations, ``selection`` what focus changes in each
    (against all rows of the population), ``shared`` takes the smaller change.
    Flagged: a gap of ``large``, or of ``gap`` with rates ``lift`` times apart;
    a shared one only if both changes are upward and notable. Without rows effects are null.
    A lift over a rate of 0 is infinite.
    """
    count = [F.count_if(F.col("part") == i).cast("double").alias(f"h{i}") for i in range(4)]
    per = settled(rows.groupBy("class").agg(*count))
    totals = per.agg(*[F.sum(f"h{i}").alias(f"n{i}") for i in range(4)])  # one row
    share = lambda *parts: F.try_divide(sum((F.col(f"h{i}") for i in parts), F.lit(0.0)), sum((F.col(f"n{i}") for i in parts), F.lit(0.0)))
    ratio = lambda a, b: F.when(a == b, 1.0).when(b == 0, float("inf")).otherwise(F.try_divide(a, b))
    near = 1e-12
    notable = lambda e, f: (F.abs(e) > near) & ((F.abs(e) + near >= large) | (F.abs(e) + near >= gap) & ((f >= lift) | (f <= 1 / lift)))
    per = per.crossJoin(F.broadcast(totals)).select("class", share(0, 1).alias("a"), share(2, 3).alias("b"), share(0).alias("fa"), share(2).alias("fb"))
    per = per.select("*", (F.col("fa") - F.col("a")).alias("ea"), (F.col("fb") - F.col("b")).alias("eb"), ratio(F.col("fa"), F.col("a")).alias("la"), ratio(F.col("fb"), F.col("b")).alias("lb"))
    a, b, ea, eb, la, lb = (F.col(c) for c in ("a", "b", "ea", "eb", "la", "lb"))
    ready = ea.isNotNull() & eb.isNotNull()
    both = (ea > 0) & notable(ea, la) & (eb > 0) & notable(eb, lb)
    kinds = [("section", b - a, ratio(b, a), notable(b - a, ratio(b, a))), ("selection", eb - ea, ratio(lb, la), notable(eb - ea, ratio(lb, la))), ("shared", F.when(ready, F.least(ea, eb)), F.when(ready, F.least(la, lb)), both)]
    made = [F.struct(F.lit(k).alias("kind"), e.alias("effect"), F.when(e.isNotNull(), f).alias("lift"), F.coalesce(g, F.lit(False)).alias("flagged")) for k, e, f, g in kinds]
    return per.select("class", F.explode(F.array(*made)).alias("k")).select("class", "k.*")


def holm(tests: DataFrame, p: str, *ties: str) -> DataFrame:
    """Step-down adjusted p; a missing one counts as 1 and stays missing. Families of any size: ranks and maxima are put together from ranges."""
    filled = F.coalesce(F.col(p), F.lit(1.0))
    order = [filled.asc(), *[F.col(t).asc() for t in ties]]
    m = tests.agg(F.count("*").alias("_m"))  # one row
    ranked = numbered(tests, order, name="_rank").crossJoin(F.broadcast(m))
    step = F.least(F.lit(1.0), filled * (F.col("_m") - F.col("_rank") + 1))
    out = running(ranked, step, [F.col("_rank").asc()], name="_most", largest=True)
    return out.withColumn("adjusted", F.when(F.col(p).isNotNull(), F.col("_most"))).drop("_rank", "_m", "_most")

