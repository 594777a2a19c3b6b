"""URL filter: rules by host and path, and for the rest segmented words.

Host and path names are split into words by unigram Viterbi, with word counts
of all pages' texts; multinomial naive Bayes scores these words. There are no
labels: its block class starts from a lexicon, the words of ``SEEDS``, and
learns which other words go with them from the hosts that hold one; its allow
class learns from all other hosts, and both lean on the words of all. A host is never judged
by what its own pages taught: hosts fall into ``FOLDS``, and each fold is
scored with the counts of the others. Every word of the corpus counts: names
meet the words they contain in a join. The driver sees how many words have each
count, the counts of ``SEEDS`` and class counts of ``BUCKETS`` in each fold.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import cut, read

#: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words of hosts to block; those under four letters only count as a whole name.
SEEDS = frozenset("adult ads adserver bet bets betting casino casinos escort gambling hentai jackpot loan loans malware nude payday pharmacy phishing pills poker porn sex slots spam torrent track tracker tracking viagra warez xxx".split())
#: Buckets that tokens are hashed to for class counts.
BUCKETS = 1 << 15
#: Tokens that the lexicon and all urls' tokens count for in a class, smoothing of the latter, folds of hosts.
LEXICON, BACKGROUND, ALPHA, FOLDS = 5.0, 20.0, 1e-4, 5
_NAME = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where no :// is."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n): the words (a-z) of the pages' texts."""
    text = F.regexp_replace(F.lower(F.coalesce(F.col(html_col), F.lit(""))), r"<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit("[a-z]{2,}"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


#: Letters by which a word is found in a name.
PIECE = 24


class Segmenter:
    """Unigram Viterbi. A letter sequence outside the vocabulary costs the more the longer it is.

    ``counts`` are of all words, or, with ``spread`` (words and their greatest
    length by count) of all words, those of SEEDS; other words' counts then
    come with each name.
    """

    def __init__(self, counts: dict[str, int], spread: dict[int, tuple[int, int]] | None = None):
        if spread is None:
            spread = {}
            for w, n in counts.items():
                k, longest = spread.get(n, (0, 0))
                spread[n] = (k + 1, max(longest, len(w)))
        usual, left = 1, sum(k for k, _ in spread.values()) // 2
        for n, (k, _) in sorted(spread.items()):
            if left < k:
                usual = n
                break
            left -= k
        seeds = {w: max(counts.get(w, 0), 10 * usual) for w in SEEDS}
        self.total = sum(n * k for n, (k, _) in spread.items()) + sum(n - counts.get(w, 0) for w, n in seeds.items())
        self.cost = {w: -math.log(n / self.total) for w, n in {**counts, **seeds}.items()}

    def unknown(self, length: int) -> float:
        return math.log(self.total) + 2.3 * (length - 1)

    def pieces(self, name: str) -> list[str]:
        """Different parts of ``name`` that can be words of at most PIECE letters, or begin longer ones."""
        return sorted({name[i : i + k] for i in range(len(name)) for k in range(2, min(PIECE, len(name) - i) + 1)})

    def split(self, name: str, counts: dict[str, int] | None = None) -> tuple[str, ...]:
        known = {**{w: -math.log(n / self.total) for w, n in counts.items()}, **self.cost} if counts else self.cost
        lengths = sorted({len(w) for w in known})
        best, back = [0.0], [0]
        loose, since = math.inf, 0  # the best that ends in an unknown sequence, and where that one began
        for end in range(1, len(name) + 1):
            longer, anew = loose + self.unknown(2) - self.unknown(1), best[end - 1] + self.unknown(1)
            loose, since = (longer, since) if longer <= anew else (anew, end - 1)
            options = [(best[end - k] + known[w], end - k) for k in lengths if k <= end and (w := name[end - k : end]) in known]
            cost, start = min([*options, (loose, since)])
            best.append(cost)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(out))


def segmented(urls: DataFrame, words: DataFrame) -> DataFrame:
    """(host, path, pages, tokens, seeded) of ``urls`` (host, path, pages); seeded: the host has a word of SEEDS."""
    spread = {r.n: (r.words, r.longest) for r in words.groupBy("n").agg(F.count("*").alias("words"), F.max(F.length("word")).alias("longest")).collect()}
    segmenter = Segmenter({r.word: r.n for r in words.filter(F.col("word").isin(*SEEDS)).collect()}, spread)

    @F.pandas_udf("array<string>")
    def names(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: _NAME.findall(p.lower()))

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(segmenter.pieces)

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for name, word, n in batches:
            yield pd.Series([list(segmenter.split(x, {} if w is None else dict(zip(w, k, strict=True)))) for x, w, k in zip(name, word, n, strict=True)], dtype=object)

    both = urls.select("host", "path", "pages", names("host").alias("of_host"), names("path").alias("of_path"))
    each = both.select("host", "path", "pages", F.size("of_host").alias("hosts"), F.posexplode_outer(F.concat("of_host", "of_path")).alias("at", "name"))
    each = cut(each)
    different = each.filter(~F.col("name").rlike("^[0-9]")).select("name").distinct().withColumn("key", F.sha2("name", 256))
    begun = words.withColumn("piece", F.left("word", F.lit(PIECE)))  # longer words are found by their beginning
    found = different.select("key", F.explode(pieces("name")).alias("piece")).join(begun, "piece").groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    parts = different.join(found, "key", "left").select("name", split("name", F.col("found.word"), F.col("found.n")).alias("parts"))
    joined = each.join(parts, "name", "left")
    split_to = F.when(F.col("name").isNull(), F.array().cast("array<string>")).otherwise(F.coalesce("parts", F.array(F.lit("#"))))
    of_host = F.col("at") < F.col("hosts")
    tokens = F.when(of_host, split_to).otherwise(F.transform(split_to, lambda w: F.concat(F.lit("/"), w)))
    seeded = F.col("name").isin(*SEEDS) | F.exists(split_to, lambda w: w.isin(*[s for s in SEEDS if len(s) > 3]))
    rows = joined.select("host", "path", "pages", F.struct("at", tokens.alias("tokens")).alias("t"), F.coalesce(of_host & seeded, F.lit(False)).alias("seeded"))
    grouped = rows.groupBy("host", "path").agg(F.max("pages").alias("pages"), F.array_sort(F.collect_list("t")).alias("t"), F.max("seeded").alias("seeded"))
    return grouped.select("host", "path", "pages", F.flatten("t.tokens").alias("tokens"), "seeded")


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


class NaiveBayes:
    """Log odds of block from class counts (bucket, seeded) -> n and numbers of pages."""

    def __init__(self, counts: dict[tuple[int, bool], int], pages: dict[bool, int]):
        counts = Counter(counts)
        totals = {c: sum(n for (_, k), n in counts.items() if k == c) for c in (True, False)}
        lexicon = Counter(_bucket(w) for w in SEEDS)
        every = sum(totals.values()) + ALPHA * BUCKETS

        def log(b: int, c: bool) -> float:
            usual = (counts[(b, True)] + counts[(b, False)] + ALPHA) / every
            known = LEXICON if c else 0.0
            return math.log((counts[(b, c)] + BACKGROUND * usual + known * lexicon[b] / len(SEEDS)) / (totals[c] + BACKGROUND + known))

        self.odds = {b: log(b, True) - log(b, False) for b in {b for b, _ in list(counts)} | set(lexicon)}
        self.prior = math.log((pages.get(True, 0) + 0.5) / (pages.get(False, 0) + 0.5))

    def score(self, tokens: list[str]) -> float:
        # a token seen in neither class says nothing
        return self.prior + sum(self.odds.get(_bucket(t), 0.0) for t in sorted(set(tokens)))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """One row per row of ``pages``: id_col, host, path, rule, score (log odds of block), verdict.

    Where no rule fits, the score decides: block above 0. Urls that are null or
    hold no :// have empty host and path, so that the score is the log odds of
    block alone. Null ids and repeated rows give a row each; urls of any length
    are read whole; an empty table gives an empty one; other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = cut(segmented(parts.groupBy("host", "path").agg(F.count("*").alias("pages")), cut(word_counts(pages, html_col))))

    fold = F.pmod(F.xxhash64(F.lit("fold"), "host"), F.lit(FOLDS)).cast("int").alias("fold")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for pdf in batches:
            for tokens, seeded, k, f in zip(pdf["tokens"], pdf["seeded"], pdf["pages"], pdf["fold"], strict=True):
                for t in set(tokens):  # once a url: one that repeats itself teaches no more
                    n[(f, _bucket(t), seeded)] += k
                n[(f, -1, seeded)] += k
        yield pd.DataFrame([(*key, k) for key, k in n.items()], columns=["fold", "bucket", "seeded", "n"])

    counted = urls.filter("host != ''").select("tokens", "seeded", "pages", fold).mapInPandas(count, "fold int, bucket int, seeded boolean, n long")
    sums = counted.groupBy("fold", "bucket", "seeded").agg(F.sum("n").alias("n")).collect()
    models = []
    for f in range(FOLDS):
        others: Counter = Counter()
        for r in sums:
            if r.fold != f:
                others[(r.bucket, r.seeded)] += r.n
        models.append(NaiveBayes({k: n for k, n in others.items() if k[0] >= 0}, {c: others[(-1, c)] for c in (True, False)}))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for folds, tokens in batches:
            yield pd.Series([models[f].score(t) for f, t in zip(folds, tokens, strict=True)], dtype=float)

    scores = urls.select("host", "path", score(fold, "tokens").alias("score"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    scored = parts.join(scores, ["host", "path"], "left")
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, own).alias("verdict"))


def op6_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
