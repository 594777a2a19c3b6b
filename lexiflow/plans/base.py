"""Registry of queries, and the SQL that all of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Lines and tokens of all documents, as lexiflow.sources.corpus makes them.
BASE = """
WITH lines AS (
  SELECT page, lang, source, page // 4 AS sheet, locus, locus % 5 = 0 AS first, locus = 0 AS page_first,
         list_transform(str_split(line, ' '), lambda x: nullif(regexp_replace(lower(x), '[^a-z]', '', 'g'), '')) AS words
  FROM (SELECT doc_id AS page, lang, source, unnest(str_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(str_split(coalesce(text, ''), chr(10))))) AS locus FROM documents)),
toks AS (
  SELECT page, lang, source, sheet, locus, first, page_first, words, len(words) AS size, unnest(words) AS word, unnest(range(len(words))) AS idx FROM lines),
tokens AS (
  SELECT *, CASE WHEN idx >= 2 AND words[idx] IS NOT NULL THEN words[idx - 1] END AS prev2, CASE WHEN idx >= 1 THEN words[idx] END AS prev,
         words[idx + 2] AS next FROM toks WHERE word IS NOT NULL),
wc AS (SELECT lang, word, count(*) AS n FROM tokens GROUP BY ALL),
wr AS (SELECT lang, word, n, n * 10000.0 / sum(n) OVER (PARTITION BY lang) AS rate FROM wc)
"""


def query(name: str, sql: str | None = None, base: bool = True):
    """Registers a query; ``sql`` continues BASE unless ``base`` is false."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (BASE if base else "") + sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
