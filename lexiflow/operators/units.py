"""Matches per unit (page, paragraph, sheet) and group, and the statistics of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.words import nice_step
from lexiflow.operators.graph import settled
from lexiflow.operators.ranks import running
from lexiflow.operators.rates import PER


def paragraphs(lines: DataFrame) -> DataFrame:
    """With ``paragraph``: the number of first lines of the page up to the line."""
    order = Window.partitionBy("page").orderBy("locus").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("paragraph", F.sum(F.col("first").cast("int")).over(order))


def page_class(rows: DataFrame, classes: DataFrame, key: str = "page", code: str = "code", missing: str = "none") -> DataFrame:
    """Left join of one class per page; pages without one get ``missing``."""
    return rows.join(classes, key, "left").withColumn(code, F.coalesce(code, F.lit(missing)))


def comparison_groups(group: Column, a: str, b: str) -> Column:
    """A row of a or b counts for its own group and for 'both'; any other for 'other'."""
    return F.explode(F.when(group.isin(a, b), F.array(group, F.lit("both"))).otherwise(F.array(F.lit("other"))))


def hide_groups(rows: DataFrame, group: str, hidden: list[str]) -> DataFrame:
    """Without the hidden groups; all rows if that leaves none."""
    left = rows.filter(~F.col(group).isin(*hidden)) if hidden else rows
    return rows if left.isEmpty() else left


def unit_model(lines: DataFrame, units: list[str], hits: dict[str, Column]) -> DataFrame:
    """tokens, lines and matches of each unit; hits are tests of a word ``w``, counted within each line's array."""
    count = lambda test: F.size(F.filter("words", lambda w: w.isNotNull() & test(w)))
    per = lines.select(*units, F.size(F.filter("words", lambda w: w.isNotNull())).alias("t"), *[count(t).alias(n) for n, t in hits.items()])
    return per.groupBy(*units).agg(F.sum("t").alias("tokens"), F.count("*").alias("lines"), *[F.sum(n).alias(n) for n in hits])


def measures(match: Column, tokens: Column, lines: Column) -> dict[str, Column]:
    return {"percent": F.try_divide(100.0 * match, tokens), "per10k": F.try_divide(PER * match, tokens), "perline": F.try_divide(match * 1.0, lines)}


def counted(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, value, c, upto): the different values, their number, and that of all up to them. No group is sorted in one task."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    return running(counts, F.col("c"), [F.col(value).asc()], *by, name="upto")


def at_place(value: Column, place: Column) -> Column:
    """The value at a place (from 0) of the sorted ones, as an aggregate over ``upto``."""
    return F.min(F.when(F.col("upto") > place, value))


def _beside(rows: DataFrame, small: DataFrame, *by: str) -> DataFrame:
    """Rows with the columns of their group's one row; groups may be null. Spark broadcasts it if its measured size allows."""
    if not by:
        return rows.crossJoin(F.broadcast(small))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return rows.join(small.withColumnsRenamed({c: f"_b_{c}" for c in by}), on).drop(*[f"_b_{c}" for c in by])


def statistics(rows: DataFrame, group: str, unit: str, match: str) -> DataFrame:
    """Statistics of each group and, with a null group, of all: rows (group, unit, tokens, lines, match).

    Units with as many matches are put together first; all figures come from
    these, the medians by running counts.
    """
    m = F.col(match)
    level = F.array(F.struct(F.lit(0).alias("is_total"), F.col(group).alias(group)), F.struct(F.lit(1).alias("is_total"), F.lit(None).cast(rows.schema[group].dataType).alias(group)))
    cells = rows.groupBy(group, match).agg(F.count("*").alias("c"), F.sum("tokens").alias("tokens"), F.sum("lines").alias("lines"), F.min(unit).alias("unit"))
    each = settled(cells.select(F.explode(level).alias("_l"), match, "c", "tokens", "lines", "unit").select("_l.*", match, "c", "tokens", "lines", "unit"))
    agg = each.groupBy("is_total", group).agg(
        F.sum("c").alias("units"),
        F.coalesce(F.sum(F.when(m > 0, F.col("c"))), F.lit(0)).alias("with_match"),
        F.sum(m * F.col("c")).alias("matches"),
        F.sum("tokens").alias("tokens"),
        F.sum("lines").alias("lines"),
        F.max(F.struct(m.alias("most"), (-F.col("unit")).alias("unit"))).alias("best"),
    )
    counts = each.filter(m.isNotNull()).groupBy("is_total", group, match).agg(F.sum("c").alias("c"))
    ranked = running(counts, F.col("c"), [m.asc()], "is_total", group, name="upto")
    last = ranked.groupBy("is_total", group).agg((F.max("upto") - 1).alias("_last"))
    middle = (at_place(m, F.floor(F.col("_last") / 2)) + at_place(m, F.ceil(F.col("_last") / 2))) / 2
    medians = _beside(ranked, last, "is_total", group).groupBy("is_total", group).agg(middle.alias("median"))
    everything = each.filter("is_total = 1").agg(F.sum(m * F.col("c")).alias("_all"))
    rate = measures(F.col("matches"), F.col("tokens"), F.col("lines"))
    out = _beside(_beside(agg, medians, "is_total", group), everything)
    out = out.select("*", rate["per10k"].alias("per10k"), rate["perline"].alias("perline"), F.try_divide(F.col("matches") * 1.0, F.col("_all")).alias("share"))
    return out.withColumn("best", -F.col("best.unit")).drop("_all")  # the first of the units with most matches


def correlations(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Pearson and Spearman (average ranks); null under three rows or where a side is constant."""
    # equal pairs are counted first; ranks come from the counts of different values, so that no group is sorted in one task
    by = list(by)
    pairs = settled(rows.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).groupBy(*by, "x", "y").agg(F.count("*").alias("c")))

    def ranked(c):
        counts = pairs.filter(F.col(c).isNotNull()).groupBy(*by, c).agg(F.sum("c").alias("k"))
        upto = running(counts, F.col("k"), [F.col(c)], *by, name="upto")
        return upto.select(*[F.col(g).alias(f"{c}_{g}") for g in by], F.col(c).alias(f"{c}_value"), (F.col("upto") - (F.col("k") - 1) / 2).alias(f"r{c}"))

    for c in ("x", "y"):
        on = F.col(c) == F.col(f"{c}_value")
        for g in by:
            on = on & F.col(g).eqNullSafe(F.col(f"{c}_{g}"))
        pairs = pairs.join(ranked(c), on, "left").drop(f"{c}_value", *[f"{c}_{g}" for g in by])

    def pearson(a, b):
        total = lambda v: F.sum(v * F.col("c"))
        a, b, n = F.col(a), F.col(b), F.sum("c")
        cov = n * total(a * b) - total(a) * total(b)
        va, vb = n * total(a * a) - total(a) * total(a), n * total(b * b) - total(b) * total(b)
        return F.when((n >= 3) & (va > 1e-9) & (vb > 1e-9), F.try_divide(cov, F.sqrt(va * vb)))

    return pairs.groupBy(*by).agg(pearson("x", "y").alias("pearson"), pearson("rx", "ry").alias("spearman"))


def nearest_rank(rows: DataFrame, value: str, q: float, *by: str) -> DataFrame:
    """The value at place round(q (n - 1)) of the sorted ones."""
    ranked = counted(rows, value, *by)
    last = ranked.groupBy(*by).agg((F.max("upto") - 1).alias("_last"))
    return _beside(ranked, last, *by).groupBy(*by).agg(at_place(F.col(value), F.floor(q * F.col("_last") + 0.5)).alias("value"))


def histogram(rows: DataFrame, value: str, group: str, bins: int | None = None) -> DataFrame:
    """Counts per group over shared bins from the least value above zero: zero has a bin (0), outliers beyond the 95th percentile one (-1).

    Width: Freedman-Diaconis over the values above zero, or Sturges where
    quartiles coincide, or by the number of bins asked for. Percentiles lie
    between the two nearest values.
    """
    v = F.col(value)
    ranked = settled(counted(rows.filter(v > 0), value))
    last = ranked.agg((F.max("upto") - 1).alias("_last"))

    def between(q):
        place = q * F.col("_last")
        low, high = at_place(v, F.floor(place)), at_place(v, F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    s = _beside(ranked, last).agg(F.array(*[between(q) for q in (0.25, 0.75, 0.95)]).alias("q"), (F.max("_last") + 1).alias("n"), F.min(v).alias("lo"))
    span = F.col("q")[2] - F.col("lo")
    iqr = F.col("q")[1] - F.col("q")[0]
    auto = F.when(iqr > 0, 2 * iqr / F.cbrt("n")).otherwise(span / F.ceil(F.log2("n") + 1))
    width = (span / bins) if bins else auto
    edges = s.select(F.col("lo"), F.greatest(width, F.lit(1e-9)).alias("width"), F.col("q")[2].alias("hi"))
    bin_no = F.when(v <= 0, 0).when(v > F.col("hi"), -1).otherwise(1 + F.floor((v - F.col("lo")) / F.col("width")))
    return rows.crossJoin(F.broadcast(edges)).groupBy(group, bin_no.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def round_histogram(rows: DataFrame, value: str, group: str, bins: int | None = None, whole: bool = False, clip: bool = True) -> DataFrame:
    """(group, bin, lo, hi, n): counts over shared bins of a round width from zero; empty bins have no row.

    Values are not negative. Bin 0 holds zeros, bin k those above ``lo`` up to
    ``hi``, bin -1 the outliers: with ``clip``, values beyond the 95th percentile
    of those above zero (20 or more), or beyond three interquartile ranges above
    the upper quartile (5 to 19). The width is the round one above
    Freedman-Diaconis', or Sturges' where quartiles coincide (6 to 48 bins), or
    above that of the number of bins asked for; ``whole`` rounds it up to a whole
    number. Nulls are left out.
    """
    v, rows = F.col(value), rows.filter(F.col(value).isNotNull())
    ranked = settled(counted(rows.filter(v > 0), value))
    near = lambda q, last: at_place(v, F.floor(q * F.col(last) + 0.5))
    last = ranked.agg((F.max("upto") - 1).alias("_last"))
    s = _beside(ranked, last).agg(near(0.25, "_last").alias("q1"), near(0.75, "_last").alias("q3"), near(0.95, "_last").alias("q95"), F.max(v).alias("most"), (F.max("_last") + 1).alias("n"))
    fence = F.col("q3") + 3 * (F.col("q3") - F.col("q1"))
    cut = F.when(F.col("n") >= 20, F.col("q95")).when(F.col("n") >= 5, fence)
    upper = F.least(cut, "most") if clip else F.col("most")  # least passes over a null
    held = _beside(ranked, s.select(upper.alias("upper"), "most")).filter(v <= F.col("upper"))
    last = held.agg((F.max("upto") - 1).alias("_held"))
    s = _beside(held, last).agg(near(0.25, "_held").alias("q1"), near(0.75, "_held").alias("q3"), (F.max("_held") + 1).alias("n"), F.max("upper").alias("upper"), F.max("most").alias("most"))
    fd = 2 * (F.col("q3") - F.col("q1")) / F.cbrt("n")
    auto = F.when(fd > 0, F.col("upper") / fd).otherwise(F.log2("n") + 1)
    k = F.lit(float(bins)) if bins else F.least(F.lit(48.0), F.greatest(F.lit(6.0), F.floor(auto + 0.5).cast("double")))
    step = nice_step(F.col("upper") / k)
    edges = s.select((F.greatest(F.lit(1.0), F.ceil(step).cast("double")) if whole else step).alias("width"), "upper", "most")
    place = lambda x: F.ceil((x - 1e-12) / F.col("width"))
    top = place(F.col("upper")) * F.col("width")
    bin_no = F.when(v <= 0, 0).when(v > top + 1e-12, -1).otherwise(place(v)).cast("long").alias("bin")
    out = _beside(rows.groupBy(group, value).agg(F.count("*").alias("c")), edges).groupBy(group, bin_no, "width", top.alias("top"), "most").agg(F.sum("c").alias("n"))
    lo = F.when(F.col("bin") > 0, (F.col("bin") - 1) * F.col("width")).when(F.col("bin") < 0, F.col("top")).otherwise(0.0)
    hi = F.when(F.col("bin") > 0, F.col("bin") * F.col("width")).when(F.col("bin") < 0, F.col("most")).otherwise(0.0)
    return out.select(group, "bin", lo.alias("lo"), hi.alias("hi"), "n")


def pattern_matrix(toks: DataFrame, group: str, patterns: dict[str, Column]) -> DataFrame:
    """(group, pattern, n): one pass over the tokens for all patterns."""
    hits = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in patterns.items()]), lambda p: p.isNotNull())
    return toks.select(group, F.explode(hits).alias("pattern")).groupBy(group, "pattern").agg(F.count("*").alias("n"))


def path_order(rows: DataFrame, position: str, rank: str, *then: str) -> list[Column]:
    return [F.col(position).asc_nulls_last(), F.col(rank).asc_nulls_last(), *[F.col(c).asc() for c in then]]
