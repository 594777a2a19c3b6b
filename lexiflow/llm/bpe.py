"""Byte-level BPE encoding and decoding with Spark higher-order functions.

A word (one match of the pattern) starts as the tokens of its single bytes. Its
ranked merges are the tokens among its substrings, and ``aggregate`` folds them
in rank order: each joins, from the left, all neighbours that a literal map
gives for its rank. One pair per rank is enough: while the ends of a token's
bytes are still ends of pieces, what lies between them has been merged exactly
as if it stood alone. So the fold equals the library's loop, which always takes
the leftmost of the lowest-ranked pairs, wherever the parts of a token have
lower ranks than the token, as in all files trained by merging. Each token is a
character of its own, so that a merge is one replacement in a string.

The frequent words of the corpus are folded once each and broadcast as an Arrow
table of bounded size; documents take their ids from it batch by batch, and
words outside it are folded where they stand, by the same expression. Nothing
is cut, dropped or approximated.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import cut, few_rows, read

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Rows of the broadcast table of frequent words at most (about 20 MB).
DICTIONARY = 400_000
#: Counts of words fall into this many classes per doubling.
CLASSES = 16
_WORD = "struct<pieces:string,merges:array<int>>"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _char(token: int) -> str:
    """The character of a token; surrogates are left out."""
    return chr(token + 1 if token < 0xD7FF else token + 0x801)


def _token(char: Column) -> Column:
    point = F.ascii(char)
    return F.when(point < 0xD800, point - 1).otherwise(point - 0x801)


def _pair(token: bytes, ranks: dict[bytes, int]) -> str:
    """The characters of the two tokens that merge into ``token``; empty if no merges lead to it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        low, i = min((ranks.get(a + b, len(ranks) << 8), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if low >= ranks[token]:
            return ""
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return "".join(_char(ranks[p]) for p in parts)


class Merges:
    """For each word: the characters of its bytes, and the ranks of its merges in order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest: dict[bytes, int] = {}  # of tokens that begin with these two or three bytes
        for token in ranks:
            for head in (token[:2], token[:3]):
                self.longest[head] = max(self.longest.get(head, 0), len(token))
        self.bytes = {b: _char(ranks[bytes([b])]) for b in range(256) if bytes([b]) in ranks}

    def of(self, word: str) -> tuple[str, list[int]]:
        data, get, longest = word.encode(), self.ranks.get, self.longest.get
        if (whole := get(data)) is not None:
            return _char(whole), []
        n = len(data)
        found = {get(data[i:j]) for i in range(n - 1) for j in range(i + 2, min(n, i + longest(data[i : i + 3], 2)) + 1)}
        found.discard(None)
        return "".join(map(self.bytes.__getitem__, data)), sorted(found)

    def of_all(self, words: pa.StringArray) -> pa.StructArray:
        different = words.dictionary_encode()
        rows = [self.of(w) for w in different.dictionary.to_pylist()]
        found = pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["pieces", "merges"])
        return found.take(different.indices)


class Bpe:
    """Encoder and decoder for one rank file.

    The file is read on the driver (a vocabulary, so bounded); executors get it
    as literals of the plan.
    """

    def __init__(self, path: str | None = None, dictionary: int = DICTIONARY):
        ranks = load_ranks(path or public_tokenizers.path(TOKENIZER))
        self.dictionary, self._merges = dictionary, Merges(ranks)
        names, pairs = ([""] * (max(ranks.values()) + 1) for _ in range(2))
        for token, rank in ranks.items():
            names[rank] = token.decode("latin-1")
            pairs[rank] = _pair(token, ranks) if len(token) > 1 else ""
        literal = lambda xs: F.from_json(F.lit(json.dumps(xs)), "array<string>")
        self._pairs, self._pieces = literal(pairs), literal(names)
        self._chars = literal([_char(n) for n in range(len(names))])
        self._little = literal([n.to_bytes(4, "little").decode("latin-1") for n in range(len(names))])

    def _fold(self, word: Column) -> Column:
        """Ids of one word, from its pieces and merges."""

        def merge(pieces: Column, rank: Column) -> Column:
            return F.replace(pieces, F.get(self._pairs, rank), F.get(self._chars, rank))  # an empty pair changes nothing

        return F.aggregate(word["merges"], word["pieces"], merge, lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: _token(F.substring(s, i, F.lit(1)))))

    def encode_words(self, words: DataFrame) -> DataFrame:
        """(word, ids) for rows with a column ``word`` (a match of the pattern, not empty)."""
        merges = self._merges

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), merges.of_all(batch.column(0))], ["word", "w"])

        return words.select("word").mapInArrow(found, f"word string, w {_WORD}").select("word", self._fold(F.col("w")).alias("ids"))

    def frequent(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(word, ids) of the most frequent words of all texts, ``dictionary`` at most."""
        counts = docs.select(_words(text_col)).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
        counts = cut(counts.select("word", F.floor(F.log2("n") * CLASSES).cast("int").alias("class")))
        sizes = sorted(((r["class"], r["words"]) for r in counts.groupBy("class").agg(F.count("*").alias("words")).collect()), reverse=True)
        least, held = 1 << 30, 0
        for at, words in sizes:  # classes of counts from the top, while they fit
            if held + words > self.dictionary:
                break
            least, held = at, held + words
        return self.encode_words(counts.filter(F.col("class") >= least))

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per row of ``docs``: the id and ``ids`` (array of int).

        Null and empty texts give an empty array; repeated rows, null or
        repeated ids give one row each; other columns are ignored; an empty
        table gives an empty one. A text or word of any length is encoded
        whole, in time that grows in proportion to it.
        """
        table = self.frequent(docs, text_col).toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table.combine_chunks())
        known = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
        merges = self._merges

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = pa.ipc.open_stream(known.value).read_all().combine_chunks()
            words, ids = (held.column(c).chunk(0) if len(held) else pa.array([], t) for c, t in (("word", pa.string()), ("ids", pa.list_(pa.int32()))))
            for batch in batches:
                stretches, others = _placed(batch.column(1), words, ids)
                rare = pa.ListArray.from_arrays(others.offsets, merges.of_all(others.values))
                yield pa.RecordBatch.from_arrays([batch.column(0), stretches, rare], ["id", "known", "rare"])

        rows = docs.select(F.col(id_col).alias("id"), _words(text_col))
        placed = rows.mapInArrow(place, f"id {rows.schema['id'].dataType.simpleString()}, known array<array<int>>, rare array<{_WORD}>")
        both = F.zip_with("known", "rare", lambda before, word: F.when(word.isNull(), before).otherwise(F.concat(before, self._fold(word))))
        return placed.select(F.col("id").alias(id_col), F.flatten(F.when(F.size("rare") == 0, F.col("known")).otherwise(both)).alias("ids"))

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids: the binary pieces joined. Ids outside the vocabulary add nothing."""
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(self._pieces, i)), ""), "ISO-8859-1")

    def little_endian(self, ids: Column) -> Column:
        """Ids as little-endian unsigned 32-bit integers, in one binary."""
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(self._little, i)), ""), "ISO-8859-1")


def _words(text_col: str) -> Column:
    """The matches of the pattern in a text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.regexp_extract_all(text, F.lit("(?U)" + public_tokenizers.PATTERN), F.lit(0)).alias("words")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) for each batch."""
    for batch in batches:
        counted = pc.value_counts(batch.column(0).flatten())
        yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["word", "n"])


def _placed(docs: pa.ListArray, words: pa.StringArray, ids: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
    """For each document (its words): the ids of known words, in stretches between the other words; those words."""
    starts = docs.offsets.to_numpy() - (docs.offsets[0].as_py() if len(docs) else 0)
    flat = docs.flatten()
    at = pc.index_in(flat, value_set=words)
    rare = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
    row = at.fill_null(0).to_numpy(zero_copy_only=False)
    if len(words):
        first = ids.offsets.to_numpy()[row].astype(np.int64)
        size = ids.offsets.to_numpy()[row + 1] - first
        size[rare] = 0
    else:
        first = size = np.zeros(len(flat), np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])  # ids before each word
    tokens = np.repeat(first - ends[:-1], size) + np.arange(ends[-1])
    tokens = ids.values.to_numpy()[tokens] if len(words) else np.empty(0, np.int32)
    # a stretch begins with each document and after each rare word
    order = np.argsort(np.concatenate([starts[:-1] * 2, rare * 2 + 1]), kind="stable")
    cuts = ends[np.concatenate([starts[:-1], rare])[order]]
    before = np.searchsorted(rare, starts)
    stretches = pa.ListArray.from_arrays(pa.array(np.append(cuts, ends[-1]), pa.int32()), pa.array(tokens, pa.int32()))
    known = pa.ListArray.from_arrays(pa.array(np.arange(len(starts)) + before, pa.int32()), stretches)
    return known, pa.ListArray.from_arrays(pa.array(before, pa.int32()), flat.take(pa.array(rare)))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; a null or empty text has no tokens and the digests of no bytes."""
    bpe = Bpe()
    encoded = bpe.encode(few_rows(read(spark, sf_dir, "documents")))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.little_endian(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )
