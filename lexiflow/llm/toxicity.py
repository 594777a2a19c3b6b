"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training texts, labelled or
not, are unlabelled. Features are the presence of words and word beginnings
that, by their frequencies in positives and overall and the class prior, mostly
mark toxic texts; their document counts cover all training rows. Linear numpy classifiers are trained in Spark tasks, each on
the positives and an own share of the unlabelled texts, with the non-negative
risk estimator

    prior * E_p[l(f, +1)] + max(0, E_u[l(f, -1)] - prior * E_p[l(f, -1)])

and their mean scores every whole text. Only what is learnt from is a bounded
sample: ``CONFIRMED`` positives, and ``POSITIVES`` and ``UNLABELLED`` rows for
each of ``MEMBERS`` classifiers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import cut, held_out, read, uniform

#: Confirmed toxic rows that are learnt from at most.
CONFIRMED = 20_000
#: Features of a classifier; rows that one classifier is fitted on at most; classifiers.
FEATURES, POSITIVES, UNLABELLED, MEMBERS = 800, 6000, 12000, 4
#: Positives that must hold a feature at least (a number, and a share of all), and candidates counted in all texts at most.
SUPPORT, SUPPORT_SHARE, CANDIDATES = 3, 0.01, 20_000
#: Characters of a word that are features as its beginning.
BEGINNINGS = (3, 4, 5, 6)
#: Bounds of the share of a feature's texts that are toxic, by its counts and the class prior.
PURE, CHANCE = 0.5, 1.8
#: Loss of one row at most.
CAP = 6.0
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Different words (letters only, lower case) and their beginnings, marked by a star."""
    words = set(_WORD.findall((text or "").lower()))
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + "*" for w in words if len(w) >= n])
    return out


def _positive_features(docs: DataFrame) -> DataFrame:
    """(feature, n): documents of ``docs`` with each feature."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter[str] = Counter()
            for t in pdf["text"]:
                seen.update(features(t))
                if len(seen) > 200_000:
                    yield pd.DataFrame(seen.items(), columns=["feature", "n"])
                    seen = Counter()
            yield pd.DataFrame(list(seen.items()), columns=["feature", "n"])

    return docs.select("text").mapInPandas(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _count_in(docs: DataFrame, names: set[str]) -> DataFrame:
    """(feature, n) for given features only; each batch gives one row per feature it holds."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                seen.update(names & features(t))
        yield pd.DataFrame(list(seen.items()), columns=["feature", "n"])

    return docs.select("text").mapInPandas(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def nnpu_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 900, rate: float = 0.05, decay: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Weights and bias (last) of a linear classifier; logistic loss, Adam, mini-batches."""
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    w, m, v, step = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1), 0
    w[-1] = np.log(prior / (1 - prior))
    batches = max(1, min(len(positive), len(unlabelled)) // 256)

    def grad(x, sign):
        """Mean loss of labelling all of x by sign, and its gradient."""
        f = x @ w[:-1] + w[-1]
        loss = np.minimum(np.logaddexp(0, -sign * f), CAP)  # bounded, as the negative part of the risk needs it
        g = np.where(loss < CAP, -sign / (1 + np.exp(np.clip(sign * f, -50, 50))), 0.0) / len(x)
        return loss.mean(), np.append(g @ x, g.sum())

    for _ in range(-(-steps // batches)):
        ps, us = np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches)
        for pi, ui in zip(ps, us, strict=True):
            xp, xu = positive[pi].astype(np.float32), unlabelled[ui].astype(np.float32)
            _, g_pos = grad(xp, 1)
            l_pos, g_neg = grad(xp, -1)
            l_unl, g_unl = grad(xu, -1)
            negative = l_unl - prior * l_pos
            # where the negative part of the risk falls below zero, only undo that
            g = prior * g_pos + g_unl - prior * g_neg if negative >= 0 else prior * g_neg - g_unl
            g[:-1] += decay * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


class ToxicityModel:
    """Feature names with the mean weights of the classifiers; bounded by FEATURES."""

    def __init__(self, names: list[str], weights: np.ndarray):
        self.weight = dict(zip(names, weights[:-1].tolist(), strict=True))
        self.bias = float(weights[-1])

    def score_texts(self, texts) -> np.ndarray:
        weight, keys = self.weight, self.weight.keys()
        f = np.array([sum(weight[x] for x in sorted(keys & features(t))) for t in texts], dtype=float) + self.bias
        return 1 / (1 + np.exp(-np.clip(f, -500, 500)))

    def score(self, docs: DataFrame, text_col: str = "text"):
        model = self

        @F.pandas_udf("double")
        def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(model.score_texts(texts))

        return udf(docs[text_col])


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> ToxicityModel:
    """Fit on training ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); both without held-out rows.

    The class prior, where not given, is the toxic share of the labelled rows.
    Without a confirmed toxic text the model scores every text alike, near 0.
    Rows without an id have no label; of repeated labels of an id any toxic
    one counts.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        return ToxicityModel([], np.array([-6.0]))
    prior = min(0.5, max(1e-4, n_toxic / n)) if prior is None else prior
    # at most CONFIRMED ids: of proven size, so that the texts need no shuffle to be found
    toxic = known.filter("toxic = 1").select("doc_id").orderBy(F.xxhash64(F.lit("confirmed"), "doc_id"), "doc_id").limit(CONFIRMED)
    positives = docs.join(F.broadcast(toxic), "doc_id", "left_semi").select("doc_id", "text")
    positives = cut(positives.repartition(F.xxhash64("doc_id", "text")))
    n_pos, n_all = positives.count(), docs.count()
    support = max(min(SUPPORT, max(1, n_pos // 4)), SUPPORT_SHARE * n_pos)
    most = _positive_features(positives).filter(F.col("n") >= support)
    found = {r.feature: r.n for r in most.orderBy(F.desc("n"), "feature").limit(CANDIDATES).collect()}
    names = set(found)
    overall = {r.feature: r.n for r in _count_in(docs, names).collect()}

    def weight(x):  # G statistic of a feature that positives hold more often than all texts do
        p, q = found[x] / max(1, n_pos), (max(overall.get(x, 0), found[x]) + 1) / (n_all + 1)
        share = prior * p / q  # about 1 for a pure mark; far over 1 if mere chance put it into positives
        return found[x] * np.log(p / q) if PURE <= share <= CHANCE else 0.0

    chosen = sorted((x for x in names if weight(x) > 0), key=lambda x: (-weight(x), x))[:FEATURES]
    if not chosen:
        return ToxicityModel([], np.array([np.log(prior / (1 - prior))]))
    at = {x: i for i, x in enumerate(chosen)}

    def matrix(texts) -> np.ndarray:
        out = np.zeros((len(texts), len(at)), np.uint8)
        for row, t in zip(out, texts, strict=True):
            for x in at.keys() & features(t):
                row[at[x]] = 1
        return out

    share = uniform(F.lit("sample"), "doc_id", "text")
    each = F.explode(F.array(*[F.lit(i) for i in range(MEMBERS)])).alias("member")
    pos = positives.filter(share < POSITIVES / max(1, n_pos)).select(each, F.lit(True).alias("positive"), "text")
    member = F.pmod(F.xxhash64(F.lit("member"), "doc_id", "text"), F.lit(MEMBERS)).cast("int").alias("member")
    unl = docs.filter(share < MEMBERS * UNLABELLED / max(1, n_all)).select(member, F.lit(False).alias("positive"), "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"member": pdf["member"], "positive": pdf["positive"], "x": [r.tobytes() for r in np.packbits(matrix(pdf["text"].tolist()), axis=1)]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["positive", "x"])  # the order in which rows arrive must not matter
        x = np.unpackbits(np.frombuffer(b"".join(pdf["x"]), np.uint8).reshape(len(pdf), -1), axis=1)[:, : len(at)]
        p = pdf["positive"].to_numpy(bool)
        usable = p.any() and (~p).any()
        w = nnpu_fit(x[p], x[~p], prior, seed=int(pdf["member"].iloc[0])) if usable else None
        return pd.DataFrame({"w": pd.Series([w.tolist()] if usable else [], dtype=object)})

    rows = pos.unionByName(unl).mapInPandas(encode, "member int, positive boolean, x binary")
    fitted = rows.groupBy("member").applyInPandas(fit, "w array<double>").collect()
    weights = np.mean(sorted(list(r.w) for r in fitted), axis=0) if fitted else np.append(np.zeros(len(chosen)), np.log(prior / (1 - prior)))
    return ToxicityModel(chosen, weights)


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs.filter(~held_out()).select("doc_id", "text"), labels.filter(~held_out()).select("doc_id", "toxic"))
    scored = docs.select("doc_id", held_out().alias("held_out"), model.score(docs).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
