"""Exact deduplication by skew-safe combining.

Equal texts are combined three times: inside each input partition, within
salted digest groups, and over all salts. Each time the grouping key holds the
whole text beside its digest, so that no two different texts are ever taken for
one. A group of copies of any size reaches the shuffle as one row per input
partition, so no task gathers it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import cut, read

#: Groups that a digest's rows are spread over before the last merge.
SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _combined(rows: DataFrame, best: str, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    """(digest, text, best, n) for rows (text, best): one row per different text with its greatest ``best``."""
    salted = rows.select("text", best, digest(F.col("text")).alias("digest"), (F.spark_partition_id() % salts).alias("salt"))
    local = salted.groupBy("digest", "salt", "text").agg(F.max(best).alias(best), F.count("*").alias("n"))
    # dealt by digest alone: the texts that share a digest meet in one partition
    merged = local.repartition("digest").groupBy("digest", "text")
    return merged.agg(F.max(best).alias(best), F.sum("n").alias("n"))


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, digest.

    The row with the largest id of equal texts stays. Null texts count as
    empty ones. Rows without an id never stay unless their whole group has
    none; rows that repeat both id and text all say they stay (they are the
    same row). An empty table gives an empty one; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = F.count("*").over(Window.partitionBy("digest"))
    winners = _combined(rows, "id", digest, salts).withColumn("texts", texts)
    # the text itself is only needed further where a digest stands for several texts
    winners = cut(winners.select("digest", F.when(F.col("texts") > 1, F.col("text")).alias("own"), F.col("id").alias("keep_id"), "n", "texts"))
    plain = rows.select("id", digest(F.col("text")).alias("digest"))
    found = plain.join(winners.filter("texts = 1").select("digest", "keep_id", "n"), "digest")
    shared = winners.filter("texts > 1").select("digest", F.col("own").alias("text"), "keep_id", "n")
    if not shared.isEmpty():
        full = rows.withColumn("digest", digest(F.col("text")))
        found = found.unionByName(full.join(shared, ["digest", "text"]).drop("text"))
    return found.select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per different text.

    Of equal texts the row with the largest id stays; among rows of one id the
    one with the greatest other columns. Null and empty texts are one group,
    of which a row with an empty text stays if ids tie.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    best = F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").isNotNull().alias("given"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("c")).alias("rest"))
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), best.alias("best"))
    kept = _combined(rows, "best", sha256, salts)
    value = {id_col: F.col("best.id"), text_col: F.when(F.col("best.given"), F.col("text"))} | {c: F.col(f"best.rest.c{i}") for i, c in enumerate(others)}
    return kept.select(*[value[c].alias(c) for c in docs.columns])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = duplicate_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP7_SQL = """
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(txt) AS text_sha256
FROM (SELECT doc_id, txt, max(doc_id) OVER (PARTITION BY txt) AS keep_id, count(*) OVER (PARTITION BY txt) AS group_size
      FROM (SELECT doc_id, coalesce(text, '') AS txt FROM documents))
"""
