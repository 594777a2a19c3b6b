"""Exact tests of fixed margins: one 2x2 table, two strata with equal odds, and enrichment in two populations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms of a walk that are held at a time.
BLOCK = 8192
#: exp of anything below is 0 in double precision.
NOTHING = -746.0
#: Logarithms of weights this near count as equal.
TIE = 1e-9
MARGINS = ("h1", "h", "n1", "n")
RESULT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("p", "less", "greater")])


def _step(x, a, b):
    """ln w(x + 1) - ln w(x), x hits of the first table selected and, where there is one, ``total - x`` of the second."""
    h, n1, n = a
    up = np.log(n1 - x) + np.log(h - x) - np.log(x + 1.0) - np.log(n - n1 - h + x + 1.0)
    if b is None:
        return up
    h2, m1, m, total = b
    y = total - x
    return up + np.log(y) + np.log(m - m1 - h2 + y) - np.log(m1 - y + 1.0) - np.log(h2 - y + 1.0)


def _walk(a, b, start: int, end: int):
    """(x, ln w(x) - ln w(start)) in blocks from ``start`` to ``end``, either way, up to where weights vanish."""
    sign, log = (1 if end >= start else -1), 0.0
    yield np.array([start]), np.array([0.0])
    while start != end and log > NOTHING:
        x = start + sign * np.arange(1, min(BLOCK, abs(end - start)) + 1)
        logs = log + sign * np.cumsum(_step((x if sign < 0 else x - 1).astype(float), a, b))
        yield x, logs
        start, log = int(x[-1]), float(logs[-1])


def _exact(h1: int, h: int, n1: int, n: int, g1: int, g: int, m1: int, m: int) -> tuple[float, float, float]:
    """Two-sided, lower and upper p of h1, given its margins and, unless m is negative, the second table's and h1 + g1.

    Weights have one peak, found by halving; both ways from it they are summed
    until they vanish, some 80 standard deviations, so a table of h hits takes
    time of order sqrt(h) and the memory of one block.
    """
    lo, hi, a, b = max(0, h - (n - n1)), min(h, n1), (h, n1, n), None
    if m >= 0:
        total = h1 + g1
        lo, hi, b = max(lo, total - min(g, m1)), min(hi, total - max(0, g - (m - m1))), (g, m1, m, total)
    low, high = lo, hi
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if _step(float(mid), a, b) > 0 else (low, mid)
    own = -np.inf
    for x, logs in _walk(a, b, low, h1):
        if x[0] <= h1 <= x[-1] or x[-1] <= h1 <= x[0]:
            own = logs[abs(h1 - int(x[0]))]
    sums = np.zeros(4)
    for end in (lo, hi):
        for i, (x, logs) in enumerate(_walk(a, b, low, end)):
            if i or end == lo:  # the peak counts once
                w = np.exp(logs)
                sums += w.sum(), w[logs <= own + TIE].sum(), w[x <= h1].sum(), w[x >= h1].sum()
    return tuple(np.minimum(1.0, sums[1:] / sums[0]))


@F.pandas_udf(RESULT)
def _tested(h1: pd.Series, h: pd.Series, n1: pd.Series, n: pd.Series, g1: pd.Series, g: pd.Series, m1: pd.Series, m: pd.Series) -> pd.DataFrame:
    rows = [_exact(*map(int, r)) for r in zip(h1, h, n1, n, g1, g, m1, m, strict=True)]
    return pd.DataFrame(rows, columns=["p", "less", "greater"], dtype=float)


def _probed(rows: DataFrame, margins: list[str]) -> DataFrame:
    """``rows`` with p, less and greater; different tables are tested once each, spread over all cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    once = rows.select(*margins).distinct().repartition(cores, *margins)
    return rows.join(once.select(*margins, _tested(*margins).alias("_t")), margins).select(*rows.columns, "_t.*")


def fixed_margins(tables: DataFrame, *keys: str) -> DataFrame:
    """(keys, p, less, greater) of tables h1 hits among n1 selected, h hits among n: Fisher's test.

    ``p`` sums all tables as unlikely as the observed one or more; ``less`` and
    ``greater`` are one-sided. One possible table gives 1. Margins are not null.
    """
    other = {c: F.lit(-1).cast("long") for c in ("_g1", "_g", "_m1", "_m")}
    rows = tables.select(*keys, *[F.col(c).cast("long").alias(c) for c in MARGINS]).withColumns(other)
    return _probed(rows, [*MARGINS, *other]).select(*keys, "p", "less", "greater")


def equal_odds(strata: DataFrame, *keys: str) -> DataFrame:
    """(keys, p, less, greater): whether two strata have the same odds ratio.

    Tables (keys, stratum, h1, h, n1, n), one per stratum. Given the margins of
    both and their selected hits together, the common odds ratio drops out, and
    only how the hits divide is left; the smaller stratum is the one observed. A key
    with one stratum has one possible division and gets 1.
    """
    table = F.struct("stratum", *[F.col(c).cast("long").alias(c) for c in MARGINS])
    both = strata.groupBy(*keys).agg(F.min(table).alias("a"), F.max(table).alias("b"), F.count("*").alias("_sides"))
    second = lambda c: F.when(F.col("_sides") > 1, F.col(f"b.{c}")).otherwise(F.lit(0).cast("long"))
    other = dict(zip(("_g1", "_g", "_m1", "_m"), map(second, MARGINS), strict=True))
    rows = both.select(*keys, *[F.col(f"a.{c}").alias(c) for c in MARGINS], *[v.alias(k) for k, v in other.items()])
    return _probed(rows, [*MARGINS, *other]).select(*keys, "p", "less", "greater")


def shared_enrichment(tables: DataFrame, side: str, *keys: str) -> DataFrame:
    """(keys, effect, p) of keys with a table on both sides: the smaller gap of rates and the larger upper p.

    A gap is the rate of hits among the selected less that among the rest, so
    neither side can carry the other. No selected or no other rows on a side
    gives a null effect and p.
    """
    gap: Column = F.try_divide(F.col("h1").cast("double"), F.col("n1")) - F.try_divide((F.col("h") - F.col("h1")).cast("double"), F.col("n") - F.col("n1"))
    tested = fixed_margins(tables.withColumn("_gap", gap), side, *keys, "_gap")
    known = lambda c: F.when(F.count("_gap") == 2, c)
    out = tested.groupBy(*keys).agg(F.count("*").alias("_sides"), known(F.min("_gap")).alias("effect"), known(F.max("greater")).alias("p"))
    return out.filter("_sides = 2").drop("_sides")
