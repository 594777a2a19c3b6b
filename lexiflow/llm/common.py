"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows and bytes of one Arrow batch: texts can be long, and each executor holds several batches at once. A longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Holds Arrow batches of whole texts to ``rows`` and BATCH_BYTES while a job runs inside; the session's settings come back."""
    before = {key: spark.conf.get(key) for key in (_ROWS, _BYTES)}
    _hold(spark, rows)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _hold(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    most = int(spark.conf.get(_ROWS))  # 0 or less: no limit
    spark.conf.set(_ROWS, str(min(most, rows) if most > 0 else rows))
    spark.conf.set(_BYTES, str(BATCH_BYTES))


def few_rows(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches held to BATCH_ROWS and BATCH_BYTES from now on: for queries and stages whose last step reads whole texts."""
    _hold(df.sparkSession)
    return df


def cut(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage. Texts inside go through small Arrow batches of at most ``rows``.

    The folder is the cluster's ``spark.checkpoint.dir``. Only a local master
    gets a temporary one where none is set; on a cluster that is an error, as
    executors would write to their own disks.
    """
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir", None) and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    with small_batches(df.sparkSession, rows):
        return df.checkpoint()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, inside an expression."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def uniform(*cols) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / float(1 << 52)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2 (a null id counts as empty text)."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2
