"""Corpus tables: lines, tokens and populations, and the exports of result tables.

A document is a page, each of its lines a row with its words in order; a word
without a letter is an unreadable gap (null). Neighbours are read off the
line's word array, so no token is ever shuffled to find them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line categories of each scope.
SCOPES = {"running": ("user", "assistant"), "all": ("user", "assistant", "system"), "user": ("user",), "assistant": ("assistant",), "system": ("system",)}
#: Lines of a paragraph, pages of a sheet.
PARAGRAPH, SHEET = 5, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(line: Column) -> Column:
    """Words of a line in lower case with letters a-z only; null where none is left."""
    kept = F.regexp_replace(F.lower(line), "[^a-z ]", "")  # one call a line, not a word
    return F.transform(F.split(kept, " "), lambda w: F.nullif(w, F.lit("")))


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """page, locus, first, page_first, sheet, words and the columns ``keep``, a row per line."""
    at = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("locus", "line")
    rows = docs.select(F.col("doc_id").alias("page"), *keep, at)
    return rows.select(
        "page",
        *keep,
        F.floor(F.col("page") / SHEET).alias("sheet"),
        "locus",
        (F.col("locus") % PARAGRAPH == 0).alias("first"),
        (F.col("locus") == 0).alias("page_first"),
        words_of(F.col("line")).alias("words"),
    )


def corpus(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents"), *keep)


def bag(docs: DataFrame, *keep: str) -> DataFrame:
    """(page, keep, sheet, word): the readable words of ``tokens`` without their places, which most counts do not need: a text is split once."""
    kept = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z \n]+", "")
    rows = docs.select(F.col("doc_id").alias("page"), *keep, F.floor(F.col("doc_id") / SHEET).alias("sheet"), F.explode(F.split(F.replace(kept, F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    return rows.filter("word <> ''")


def in_scope(rows: DataFrame, scope: str, category: str = "role") -> DataFrame:
    return rows.filter(F.col(category).isin(*SCOPES[scope]))


def in_population(rows: DataFrame, name: str, sections: str = "sections") -> DataFrame:
    return rows.filter(F.array_contains(sections, name))


def reached(words: Column, i: Column, k: int) -> Column:
    """The word ``k`` places from position ``i`` (0-based), null past a line end or a gap."""
    if k == 0:
        return F.get(words, i)
    start = i + (2 if k > 0 else k + 1)
    whole = (i + k >= 0) & (i + k < F.size(words))
    return F.when(whole & ~F.exists(F.slice(words, F.when(whole, start).otherwise(1), abs(k)), lambda w: w.isNull()), F.get(words, i + k))


NEIGHBOURS = {
    "prev2": lambda ws, i: F.when((i >= 2) & F.get(ws, i - 1).isNotNull(), F.get(ws, i - 2)),
    "prev": lambda ws, i: F.get(ws, i - 1),
    "next": lambda ws, i: F.get(ws, i + 1),
    "prev_label": lambda ws, i: F.when(i == 0, "(line boundary)").otherwise(F.coalesce(F.get(ws, i - 1), F.lit("(unreadable)"))),
    "next_label": lambda ws, i: F.when(i + 1 == F.size(ws), "(line boundary)").otherwise(F.coalesce(F.get(ws, i + 1), F.lit("(unreadable)"))),
    "size": lambda ws, i: F.size(ws),
}


def tokens(rows: DataFrame, *wanted: str, **more) -> DataFrame:
    """A row per readable word: the columns of ``rows`` but words, idx, word, and the wanted neighbour columns.

    ``more`` adds columns by functions of (words, position).
    """
    fields = {name: NEIGHBOURS[name] for name in wanted} | more
    build = lambda w, i: F.struct(i.alias("idx"), w.alias("word"), *[f(F.col("words"), i).alias(n) for n, f in fields.items()])
    others = [c for c in rows.columns if c != "words"]
    out = rows.select(*others, F.explode(F.transform("words", build)).alias("t"))
    return out.select(*others, "t.*").filter("word is not null")


# Exports: writers of Spark; they write a folder of part files.


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def tsv_safe(df: DataFrame) -> DataFrame:
    """Tabs and line ends in strings become spaces."""
    return df.select(*[F.regexp_replace(c, r"[\t\r\n]", " ").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def export_tsv(df: DataFrame, path: str) -> None:
    tsv_safe(df).write.mode("overwrite").option("header", True).option("sep", "\t").option("quote", "").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
