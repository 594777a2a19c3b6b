"""Quality classifier by co-training.

Two views of a document: its text (character classes, word shapes, repetition)
and its page metadata (language, source and stated size, nothing of the text).
A logistic model per view is fitted on labelled rows; in each round either
model gives its most confident labels, over all unlabelled rows, to the
training rows of the other, and those rows leave the unlabelled pool. The views
are then calibrated on labelled rows kept apart and combined.

Fits see about ``LABELLED`` labelled rows at most (a share of them by a hash of
the id) and ``SHARED`` pseudo-labels per view, class and round, which reach the
driver as one row; everything else is computed for all rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import cut, held_out, read, uniform

LABELLED, SHARED, ROUNDS = 12_000, 300, 3
#: Buckets of word shapes, of sources and of languages.
SHAPES, SOURCES, LANGS = 32, 32, 8
#: Documents of at least this quality probability are kept.
THRESHOLD = 0.5
_CLASSES = bytes(97 if chr(c).isalpha() and chr(c).islower() else 65 if chr(c).isalpha() and chr(c).isupper() else 48 if chr(c).isdigit() else c for c in range(128)) + bytes([97] * 128)
_RUNS = re.compile(rb"([aA0])\1+")


def text_view(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    classes = data.translate(_CLASSES)
    words, shapes = data.split(), _RUNS.sub(rb"\1", classes).split()
    n, chars = max(1, len(words)), max(1, len(data))
    count = lambda c: classes.count(c) / chars
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    lengths = sum(map(len, words)) / n
    stats = [math.log1p(len(words)) / 5, math.log1p(lengths), len(set(words)) / n, again, count(b"A") * 3, count(b"0") * 3, count(b".") * 10, count(b",") * 10, count(b"!") * 10, count(b"|") * 10]
    stats += [sum(map(data.count, b"#*$%&<>")) / n, data.count(b"\n") / n]
    hashed = [0.0] * SHAPES
    for shape, k in Counter(shapes).items():
        hashed[zlib.crc32(shape) % SHAPES] += k / n
    return stats + hashed


def metadata_view(lang: str | None, source: str | None, size: float | None) -> list[float]:
    """Language, source and stated size."""
    known = size is not None and size == size and size >= 0
    log = math.log1p(size) / 8 if known else 0.0
    one = [0.0] * (LANGS + SOURCES)
    one[zlib.crc32((lang or "").encode("utf-8", "surrogatepass")) % LANGS] = 1.0
    one[LANGS + zlib.crc32((source or "").encode("utf-8", "surrogatepass")) % SOURCES] = 1.0
    return [float(known), log, log * log, *one]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Weights and bias (last) by Newton steps with a ridge; a single class gives its smoothed log odds."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if y.min(initial=1) == y.max(initial=0):
        return w
    penalty = ridge * len(x) / 100 * np.ones(len(w)) + 1e-6
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + penalty * w
        h = (a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + np.diag(penalty)
        move = np.linalg.solve(h, g)
        w -= move * min(1.0, 5 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w


def _views(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, size_col: str) -> DataFrame:
    @F.pandas_udf("struct<t:array<float>,m:array<float>>")
    def udf(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, langs, sources, sizes in batches:
            yield pd.DataFrame({"t": [text_view(t) for t in texts], "m": [metadata_view(*m) for m in zip(langs, sources, sizes, strict=True)]})

    size = F.col(size_col).cast("double") if size_col in docs.columns else F.lit(None).cast("double")
    v = udf(F.col(text_col), F.col(lang_col).cast("string"), F.col(source_col).cast("string"), size)
    return docs.select(F.col(id_col).alias("id"), v.alias("v")).select("id", "v.t", "v.m")


def _logits(weights: dict[str, np.ndarray]):
    """A struct of the views' log odds."""

    @F.pandas_udf("struct<t:double,m:double>")
    def udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for t, m in batches:
            out = {}
            for name, rows in (("t", t), ("m", m)):
                w = weights[name]
                out[name] = np.stack(rows.to_numpy()) @ w[:-1] + w[-1] if len(rows) else np.empty(0)
            yield pd.DataFrame(out)

    return udf("t", "m")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars", label_col: str = "quality", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: id_col, text_score, metadata_score, score, kept.

    ``labels`` (id_col, label_col 0 or 1) are the only labels learnt from; a
    fifth of them, by a hash of the id, only calibrates. Of repeated labels of
    an id the largest counts. Null and empty texts have zero text features; a
    table without ``size_col`` has no sizes. Rows without an id are scored but
    neither labelled nor given a label. Without any label all scores are 0.5 and all rows are kept. Repeated rows
    give a row each; an empty table gives an empty one.
    """
    views = cut(_views(docs, id_col, text_col, lang_col, source_col, size_col))
    known = labels.select(F.col(id_col).alias("l"), F.col(label_col).cast("int").alias("y")).filter("l is not null and y in (0, 1)").groupBy("l").agg(F.max("y").alias("y"))
    rows = views.join(known, F.col("id") == F.col("l"), "left").drop("l")
    with_label = cut(rows.filter("y is not null"))
    share = LABELLED / max(1, with_label.count())
    data = with_label.filter(uniform(F.lit("labelled"), "id") < share).withColumn("apart", F.pmod(F.xxhash64(F.lit("apart"), "id"), F.lit(5)) == 0)
    labelled = sorted(data.select("t", "m", "y", "apart", "id").collect(), key=lambda r: (r.id, r.t, r.m))
    if not labelled:
        half = F.lit(0.5)
        return views.select(F.col("id").alias(id_col), half.alias("text_score"), half.alias("metadata_score"), half.alias("score"), F.lit(True).alias("kept"))
    own = [r for r in labelled if not r.apart] or labelled
    apart = [r for r in labelled if r.apart] or labelled
    train = {v: ([list(r[v]) for r in own], [r.y for r in own]) for v in ("t", "m")}
    unlabelled = rows.filter("y is null").select("id", "t", "m")

    def fitted():
        return {v: fit_logistic(np.array(x, float), np.array(y, float)) for v, (x, y) in train.items()}

    weights = fitted()
    used: set = set()
    for _ in range(rounds):
        scored = unlabelled.withColumn("s", _logits(weights)).select("id", "t", "m", F.col("s.t").alias("st"), F.col("s.m").alias("sm")).filter("id is not null")
        if used:  # rows that have been given a label leave the pool; at most 4 * SHARED a round
            gone = docs.sparkSession.createDataFrame([(i,) for i in sorted(used)], rows.select("id").schema)
            scored = scored.join(F.broadcast(gone), "id", "left_anti")
        for teacher, pupil in (("st", "m"), ("sm", "t")):
            for label, order in ((1, F.desc(teacher)), (0, F.asc(teacher))):
                sure = scored.filter(F.col(teacher) > 1 if label else F.col(teacher) < -1).orderBy(order, "id").limit(SHARED)
                # gathered by a task, not by the driver, which would get SHARED rows of every partition
                given = sure.agg(F.sort_array(F.collect_list(F.struct("id", pupil))).alias("given")).first().given
                train[pupil][0].extend(list(r[pupil]) for r in given)
                train[pupil][1].extend([label] * len(given))
                used |= {r.id for r in given}
        weights = fitted()
    y = np.array([r.y for r in apart], float)
    raw = np.array([[np.dot(r[v], weights[v][:-1]) + weights[v][-1] for v in ("t", "m")] for r in apart])
    scales = [fit_logistic(raw[:, [i]] / 10, y) for i in range(2)]
    calibrated = np.stack([raw[:, i] / 10 * scales[i][0] + scales[i][1] for i in range(2)], axis=1)
    joint = fit_logistic(calibrated / 10, y)
    s = views.withColumn("s", _logits(weights)).select("id", *[(F.col(f"s.{v}") / 10 * float(w[0]) + float(w[1])).alias(v) for v, w in zip(("t", "m"), scales, strict=True)])
    prob = lambda x: 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x))))
    both = F.col("t") / 10 * float(joint[0]) + F.col("m") / 10 * float(joint[1]) + float(joint[2])
    out = s.select(F.col("id").alias(id_col), prob(F.col("t")).alias("text_score"), prob(F.col("m")).alias("metadata_score"), prob(both).alias("score"))
    return out.withColumn("kept", F.col("score") >= THRESHOLD)


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels of rows that are not held out, as the toxicity query does."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = classify(docs, labels.filter(~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "text_score", "metadata_score", "score", "kept")
