"""Quality rules: robust multivariate outliers.

Each document's statistics become a vector that varies from text to text: log
mean word length, log rate of punctuation, log of different words against a
power of all words, log rate of symbols. The first three are pulled to their
language's median as far as a text is short. For each language and source, the
minimum covariance determinant (MCD) location and scatter are found by
concentration steps over all rows: the rows nearest to the present estimate
give the next one, until no determinant falls any more; the smallest found counts. Two starts are tried,
medians with the quartile range and all rows' mean and covariance, and the
smaller determinant wins. A document is rejected when its squared Mahalanobis
distance is over ``BOUND``.

Groups of every size are judged by the same rule: a group's estimate is mixed
with its language's by its number of rows against ``LANGUAGE_ROWS``, and a
language's scatter with a weak wide one of ``WEAK_ROWS`` rows.

A step is one aggregation: rows are counted and summed by group and distance
(in narrow steps of its logarithm), and the nearest of these sums are added up.
Nothing comes to the driver, and a group of any size is only ever summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import cut, read

SYMBOLS = "#*$%&|<>"
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_different")
STAT_TYPE = "struct<" + ",".join(f"{c}:long" for c in STATS) + ">"
#: Dimensions of the vector.
P = 4
#: Share of a group's rows that each concentration step keeps, the fall of a log determinant that counts, and steps after which the search ends in any case.
KEEP, STILL, MOST_STEPS = 0.75, 1e-2, 60
#: Squared distance over which a document is an outlier: distances of clean texts have a heavier tail than chi-square with 4 degrees of freedom.
BOUND = 40.0
#: Rows for which a language counts in the scatter and in the location of each of its groups.
LANGUAGE_ROWS, LOCATION_ROWS = 50, 5
#: Rows and standard deviations of the weak scatter that keeps few rows from being taken for a distribution.
WEAK_ROWS, WEAK = 4, (0.15, 0.4, 0.15, 1.5)
#: Kept shares of KEEP make scatters too small by this factor (chi-square consistency, P = 4).
CONSISTENT = 1.33
#: Steps of distance to a doubling.
FINE = 32
#: Groups whose rules are broadcast (0.3 KB each) rather than joined by a shuffle.
MOST_RULES = 20_000
#: Words of its language's median that a text's own are mixed with, and the growth of different words with all.
PRIOR_WORDS, GROWTH = 60, 0.85
MARKS = ".,;:!?"


def _repeated_words(words: list[bytes], window: int = WINDOW) -> tuple[int, int]:
    """(words in windows that occur twice or more, different words); exact: windows are numbered by doubling 1, 2, 4, 8 words."""
    n, seen = len(words), {}
    if n <= window:
        return 0, len(set(words))
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0, n
    width = 1
    while width < window:
        _, ids, counts = np.unique(ids[:-width] * (n + 1) + ids[width:], return_inverse=True, return_counts=True)
        if len(counts) == len(ids):
            return 0, len(seen)
        width *= 2
    twice = np.flatnonzero(counts[ids] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum()), len(seen)


def statistics(text: str | None) -> tuple[int, ...]:
    """STATS of one whole text; all 0 for null and empty ones."""
    if not text:
        return (0,) * len(STATS)
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").split()]
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    repeated, different = _repeated_words(words)
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), sum(map(text.count, MARKS)), different


def stats_of(text: Column) -> Column:
    """A struct of STATS."""

    @F.pandas_udf(STAT_TYPE)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics(t) for t in texts], columns=list(STATS))

    return udf(text)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.ln(F.greatest(F.col("word_chars") / n, F.lit(1e-3))),
        F.ln((F.col("n_marks") + 1) / (n + 2)),
        F.ln(F.greatest(F.col("n_different"), F.lit(1))) - GROWTH * F.ln(n),
        F.ln((F.col("n_symbols") + 1) / (n + 2)),
    ]


_XS = [f"x{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_GROUP, _SUMS = ["lang", "source"], [f"s{i}" for i in range(P)] + [f"q{i}{j}" for i in range(P) for j in range(i, P)]


def _distance(mean: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance; inverse holds the upper triangle."""
    d = [F.col(x) - F.get(mean, F.lit(i)) for i, x in enumerate(_XS)]
    terms = [(1 if i == j else 2) * F.get(inverse, F.lit(k)) * d[i] * d[j] for k, (i, j) in enumerate(_PAIRS)]
    return sum(terms[1:], terms[0])


def _estimate(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of groups beside their languages' (l_) to mean, inverse scatter and log determinant, one row per group."""
    n, of = pdf["n"].to_numpy(float), pdf["l_n"].to_numpy(float)
    mean = pdf[[f"s{i}" for i in range(P)]].to_numpy(float) / n[:, None]
    centre = pdf[[f"l_s{i}" for i in range(P)]].to_numpy(float) / of[:, None]
    square = lambda prefix: np.stack([np.stack([pdf[f"{prefix}{min(i, j)}{max(i, j)}"].to_numpy(float) for j in range(P)], axis=1) for i in range(P)], axis=1)
    language = (square("l_c") + WEAK_ROWS * np.diag(np.square(WEAK))) / (of + WEAK_ROWS)[:, None, None]
    cov = CONSISTENT * (square("c") + LANGUAGE_ROWS * language) / (n + LANGUAGE_ROWS)[:, None, None]
    mean = (n[:, None] * mean + LOCATION_ROWS * centre) / (n + LOCATION_ROWS)[:, None]
    inverse, (_, logdet) = np.linalg.inv(cov), np.linalg.slogdet(cov)
    return pdf[["lang", "source", "start"]].assign(mean=list(mean), inverse=[[m[i, j] for i, j in _PAIRS] for m in inverse], logdet=logdet)


_EST = "lang string, source string, start int, mean array<double>, inverse array<double>, logdet double"


def _from_sums(sums: DataFrame) -> DataFrame:
    """Estimates of groups from rows (lang, source, start, n, _SUMS)."""
    scatter = [(F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")).alias(f"c{i}{j}") for i, j in _PAIRS]
    rows = sums.select(*_GROUP, "start", "n", *_SUMS[:P], *scatter)
    summed = ["n", *_SUMS[:P], *[f"c{i}{j}" for i, j in _PAIRS]]
    language = Window.partitionBy("lang", "start")  # a row per source
    return rows.select("*", *[F.sum(c).over(language).alias(f"l_{c}") for c in summed]).mapInPandas(lambda it: (_estimate(pdf) for pdf in it if len(pdf)), _EST)


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(_XS)] + [F.sum(F.col(_XS[i]) * F.col(_XS[j])).alias(f"q{i}{j}") for i, j in _PAIRS]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def _medians(rows: DataFrame, by: list[str], shares: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Exact quantiles of the vector in hundredths, of which there are a bounded number."""
    return rows.groupBy(*by).agg(*[F.percentile(F.round(x, 2), list(shares)).alias(x) for x in _XS])


def fit(stats: DataFrame) -> DataFrame:
    """MCD estimates: one row (lang, source, mean, inverse, logdet) per group of ``stats`` (lang, source, x0..); its keys are not null."""
    stats = cut(stats)
    quartiles = _medians(stats, _GROUP, (0.25, 0.5, 0.75))
    spread = [F.pow((F.get(x, F.lit(2)) - F.get(x, F.lit(0))) / 1.349, 2) + 1e-2 * WEAK[i] ** 2 for i, x in enumerate(_XS)]
    medians = quartiles.select(*_GROUP, F.lit(0).alias("start"), F.array(*[F.get(x, F.lit(1)) for x in _XS]).alias("mean"), F.array(*[1 / spread[i] if i == j else F.lit(0.0) for i, j in _PAIRS]).alias("inverse"), F.lit(None).cast("double").alias("logdet"))
    everything = _summed(stats, *_GROUP).withColumn("start", F.lit(1))
    own = F.struct("mean", "inverse", "logdet")
    now = cut(medians.unionByName(_from_sums(everything)).withColumn("best", F.when(F.col("logdet").isNotNull(), own)))
    small = _of_bounded_number(now)
    of = [*_GROUP, "start"]
    nearest = Window.partitionBy(*of).orderBy("far").rowsBetween(Window.unboundedPreceding, -1)  # a row per step of distance
    for _ in range(MOST_STEPS):
        scored = stats.join(small(now.select(*of, "mean", "inverse")), _GROUP)
        far = F.floor(F.log2(_distance(F.col("mean"), F.col("inverse")) + 1e-6) * FINE)
        rings = _summed(scored.withColumn("far", far), *of, "far").withColumn("before", F.coalesce(F.sum("n").over(nearest), F.lit(0)))
        whole = F.sum("n").over(Window.partitionBy(*of))
        core = rings.withColumn("all", whole).filter(F.col("before") < KEEP * F.col("all"))
        estimate = _from_sums(core.groupBy(*of).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _SUMS]))
        beside = estimate.join(small(now.select(*of, F.col("best").alias("was"))), of)
        less = F.coalesce(F.col("logdet") < F.col("was.logdet"), F.lit(True))
        now = cut(beside.select(*of, "mean", "inverse", "logdet", F.when(less, own).otherwise(F.col("was")).alias("best"), F.coalesce(F.col("was.logdet") - F.col("logdet") > STILL, F.lit(True)).alias("fell")))
        if now.filter("fell").isEmpty():
            break
    return now.groupBy(*_GROUP).agg(F.min_by("best", F.struct("best.logdet", "start")).alias("best")).select(*_GROUP, "best.*")


def _of_bounded_number(groups: DataFrame):
    """``F.broadcast`` if there are at most MOST_RULES rows, else nothing."""
    return F.broadcast if groups.limit(MOST_RULES + 1).count() <= MOST_RULES else lambda df: df


def _named(docs: DataFrame, lang_col: str, source_col: str, *more: Column) -> DataFrame:
    """lang and source as keys that are never null, and ``more``."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))
    return docs.select(key(lang_col).alias("lang"), key(source_col).alias("source"), *more)


def _placed(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """``rows`` (lang, STATS) with their vectors, pulled to ``centres`` (lang, x0..) as far as a text is short."""
    own = F.col("n_words") / (F.col("n_words") + PRIOR_WORDS)
    at = lambda i: F.get(f"c_{_XS[i]}", F.lit(0))
    x = [at(i) + (v - at(i)) * own if i < P - 1 else v for i, v in enumerate(_vector())]
    joined = rows.join(centres.withColumnsRenamed({c: f"c_{c}" for c in _XS}), "lang")
    return joined.withColumns(dict(zip(_XS, x, strict=True))).drop(*[f"c_{c}" for c in _XS])


def _rules(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(centres of languages, estimates of groups) of the rows of ``stats`` (lang, source, STATS) that pass the base rule."""
    passed = stats.filter(~base_failed())
    centres = cut(_medians(passed.withColumns(dict(zip(_XS, _vector(), strict=True))), ["lang"]))
    centres = _of_bounded_number(centres)(centres)
    rules = cut(fit(_placed(passed, centres).select(*_GROUP, *_XS)))
    return centres, _of_bounded_number(rules)(rules.select(*_GROUP, "mean", "inverse"))


def _judged(rows: DataFrame, centres: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (lang, source, STATS, ...) with base_failed, distance (null for groups of which no row passes the base rule) and kept."""
    own = rules.withColumnsRenamed({"lang": "r_lang", "source": "r_source"})
    empty = F.array(F.lit(None).cast("double"))
    all_centres = rows.select("lang").distinct().join(centres, "lang", "left").select("lang", *[F.coalesce(x, empty).alias(x) for x in _XS])
    joined = _placed(rows, _of_bounded_number(all_centres)(all_centres)).join(own, (F.col("lang") == F.col("r_lang")) & (F.col("source") == F.col("r_source")), "left")
    joined = joined.withColumn("base_failed", base_failed()).withColumn("distance", _distance(F.col("mean"), F.col("inverse")))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= BOUND)
    return joined.withColumn("kept", kept).drop("r_lang", "r_source", "mean", "inverse", *_XS)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id_col, STATS, base_failed, distance, kept.

    Null and empty texts have no words and fail the base rule. A null language
    or source is a group of its own. Where nothing of a group passes the base
    rule there is no estimate, and none is needed. Repeated rows give a row
    each; an empty table gives an empty one; other columns are ignored.
    """
    named = _named(docs, lang_col, source_col, F.col(f"`{id_col}`").alias("id"), stats_of(F.col(f"`{text_col}`")).alias("s"))
    stats = cut(named.select("id", "lang", "source", "s.*"))
    return _judged(stats, *_rules(stats)).select(F.col("id").alias(id_col), *STATS, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns. Texts are read twice and never shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = stats_of(F.col(f"`{text_col}`")).alias("s")
    stats = cut(_named(docs, lang_col, source_col, text).select("lang", "source", "s.*"))
    centres, rules = _rules(stats)
    return _judged(_named(docs, lang_col, source_col, row, text).select("row", "lang", "source", "s.*"), centres, rules).filter("kept").select("row.*")


def op3_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = judge(read(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
