"""Word counts, rates and the comparison of two distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rates are per this many tokens.
PER = 10_000.0


def word_counts(toks: DataFrame, *by: str) -> DataFrame:
    return toks.groupBy(*by, "word").agg(F.count("*").alias("n"))


def collapsed(toks: DataFrame) -> DataFrame:
    """Without words equal to the readable word right before them; needs the column prev."""
    return toks.filter(~F.col("word").eqNullSafe(F.col("prev")))


def rates(counts: DataFrame, *by: str) -> DataFrame:
    """With ``rate`` per PER of the sum of each population. The sums are joined, so no population meets in one task."""
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = counts.join(F.broadcast(totals), list(by)) if by else counts.crossJoin(F.broadcast(totals))
    return joined.withColumn("rate", F.try_divide(F.col("n") * PER, F.col("total"))).drop("total")


def side_by_side(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
    """Full outer join of two rate tables (on, rate) to (on, a, b)."""
    on = on or ("word",)
    left, right = a.select(*on, F.col("rate").alias("a")), b.select(*on, F.col("rate").alias("b"))
    return left.join(right, list(on), "full_outer").fillna(0.0, ["a", "b"])


def overlap(pairs: DataFrame) -> DataFrame:
    """Sums of shared mass, surplus and shortfall of rates a and b."""
    return pairs.agg(
        F.sum(F.least("a", "b")).alias("overlap"),
        F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0.0))).alias("surplus"),
        F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0.0))).alias("shortfall"),
        F.count("*").alias("words"),
    )


def change(rows: DataFrame) -> DataFrame:
    """Overlap before and after a change of a to z, against b: gained, lost and net mass."""
    delta = F.least("z", "b") - F.least("a", "b")
    return rows.agg(
        F.sum(F.least("a", "b")).alias("overlap_before"),
        F.sum(F.least("z", "b")).alias("overlap_after"),
        F.sum(F.greatest(delta, F.lit(0.0))).alias("gained"),
        F.sum(F.greatest(-delta, F.lit(0.0))).alias("lost"),
        F.sum(delta).alias("net"),
        F.sum(F.when(delta > 1e-9, 1).otherwise(0)).alias("improved"),
        F.sum(F.when(delta < -1e-9, 1).otherwise(0)).alias("worsened"),
        F.try_divide(F.sum(delta), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0.0)))).alias("repaired"),
    )


def rate_comparison(count: Column, selected: Column, baseline_count: Column, section: Column) -> dict[str, Column]:
    s = F.coalesce(F.try_divide(count, selected), F.lit(0.0))
    b = F.coalesce(F.try_divide(baseline_count, section), F.lit(0.0))
    return {"selected": s, "baseline": b, "lift": F.try_divide(s, b), "per10k": F.coalesce(F.try_divide(count * PER, section), F.lit(0.0))}


def pages_of_rank(rows: DataFrame, order: list[Column], first: int, last: int, *by: str) -> DataFrame:
    """Rows ranked ``first`` to ``last``. Without ``by`` the ranking is cut by a limit, so it runs as a top-k."""
    if not by:
        top = rows.orderBy(*order).limit(last)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).filter(F.col("rank") >= first)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank").between(first, last))
