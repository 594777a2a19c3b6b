"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. Near duplicates are texts whose five-word shingles have a similarity of
0.8 or more, found by wider fingerprints. A document that the mix takes several times appears that often; documents it takes no copy of go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.bpe import Bpe
from lexiflow.llm.common import few_rows, read
from lexiflow.llm.exact_dedup import drop_copies
from lexiflow.llm.mixing import mixed_rows
from lexiflow.llm.quality_rules import keep_good
from lexiflow.llm.simhash import drop_similar


#: Words of the encoder's broadcast table: a cache without effect on results, smaller here as workers still hold the earlier stages' memory.
FREQUENT = 150_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(few_rows(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(few_rows(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, whatever its id."""
    return mixed_rows(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the encoded texts, each proven by decoding."""
    bpe = Bpe(dictionary=FREQUENT)
    encoded = bpe.encode(few_rows(docs))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(bpe.decode(F.col("ids")), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("byte bpe", bpe_stage),
]
#: SimHash, the mix and BPE have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` through all stages: one row (doc_id, n_tokens, ids, decoded_sha256) per text that the mix takes, as often as it takes it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
