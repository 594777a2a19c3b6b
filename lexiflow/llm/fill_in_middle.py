"""Fill-in-middle transformation over seekable compressed frames.

A text is cut into units (a run of letters A-Z, or any other single character)
and kept as independent zstandard frames of ``FRAME`` units. Each frame knows
how many units and characters come before it, so a cut at any unit needs one
frame only: its number is found among the cumulative counts, and that frame
alone is decompressed to find the character. Outputs, their digests and the
digests of the restored texts are streamed frame by frame in the order of the
form; a text is never held uncompressed beside its output.

Everything is one pass over the rows; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import few_rows, read

#: Units of a frame, and code points that are looked at together while frames are cut.
FRAME, BLOCK = 4096, 1 << 20
#: Shares in per cent: of texts left plain, and of the others that begin with their suffix.
PLAIN, SPM = 10, 20
#: Marks that begin the parts of an output.
MARKS = ("<P>", "<S>", "<M>")
ORDERS = {"psm": (b"<P>", b"<S>", b"<M>"), "spm": (b"<S>", b"<P>", b"<M>")}
FRAMES = "array<struct<units:long,chars:long,data:binary>>"
#: (frame, character inside it, character in the text)
Cut = tuple[int, int, int]


def unit_starts(text: str, after_letter: bool = False) -> np.ndarray:
    """Code points at which units begin; ``after_letter``: the text goes on after a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((points | 0x20) - np.uint32(97)) < 26
    before = np.concatenate(([after_letter], letter[:-1]))
    return np.flatnonzero(~(letter & before))


def frames_of(text: str, size: int = FRAME, block: int = BLOCK) -> tuple[int, list[dict]]:
    """(units, frames): frames (units and chars before it, data); none for an empty text."""
    n, begins, after = 0, [], False
    for at in range(0, len(text), block):
        part = text[at : at + block]
        starts = unit_starts(part, after)
        begins += (at + starts[-n % size :: size]).tolist()
        n, after = n + len(starts), part[-1].isascii() and part[-1].isalpha()
    pack = zstandard.ZstdCompressor().compress
    ends = [*begins[1:], len(text)] if begins else []
    return n, [{"units": i * size, "chars": a, "data": pack(text[a:b].encode("utf-8", "surrogatepass"))} for i, (a, b) in enumerate(zip(begins, ends, strict=True))]


def opened(frame: dict) -> str:
    return zstandard.ZstdDecompressor().decompress(frame["data"]).decode("utf-8", "surrogatepass")


def cut_at(frames: list[dict], unit: int) -> Cut:
    """Where unit number ``unit`` begins (or the text ends): decompresses the frame that holds it."""
    k = bisect_right([f["units"] for f in frames], unit) - 1
    text = opened(frames[k])
    starts = unit_starts(text)
    inside = int(starts[unit - frames[k]["units"]]) if unit - frames[k]["units"] < len(starts) else len(text)
    return k, inside, frames[k]["chars"] + inside


def stretch(frames: list[dict], start: Cut | None, end: Cut | None) -> Iterator[bytes]:
    """UTF-8 of the text between two cuts, a piece per frame; None: from its beginning, to its end."""
    first, last = start[0] if start else 0, end[0] if end else len(frames) - 1
    for k in range(first, last + 1):
        piece = opened(frames[k])
        piece = piece[: end[1]] if end and k == last else piece
        yield (piece[start[1] :] if start and k == first else piece).encode("utf-8", "surrogatepass")


def output(frames: list[dict], form: str, one: Cut | None, two: Cut | None) -> Iterator[bytes]:
    """The transformed text as UTF-8 pieces; ``one`` and ``two`` end its prefix and its middle."""
    if form == "plain":
        yield from stretch(frames, None, None)
        return
    parts = {b"<P>": (None, one), b"<S>": (two, None), b"<M>": (one, two)}
    for mark in ORDERS[form]:
        yield mark
        yield from stretch(frames, *parts[mark])


def _sections(pieces: Iterable[bytes], order: tuple[bytes, ...]) -> Iterator[tuple[bytes, bytes]]:
    """(mark, piece) of the parts of an output; marks may be torn between pieces."""
    held, k = b"", -1
    for piece in pieces:
        held += piece
        while k + 1 < len(order) and (at := held.find(order[k + 1])) >= 0:
            if at:
                yield order[k], held[:at]
            held, k = held[at + 3 :], k + 1
        sure = len(held) - 2 if k + 1 < len(order) else len(held)
        if sure > 0:
            yield order[k], held[:sure]
            held = held[sure:]
    if held:
        yield order[k], held


def restored(pieces: Iterable[bytes], form: str) -> Iterator[bytes]:
    """The original text from an output's pieces and its form; the suffix waits compressed for the middle."""
    if form == "plain":
        yield from pieces
        return
    pack, waiting = zstandard.ZstdCompressor().compress, []
    for mark, piece in _sections(pieces, ORDERS[form]):
        if mark == b"<S>":
            waiting.append(pack(piece))
        else:
            yield piece
    for piece in waiting:
        yield zstandard.ZstdDecompressor().decompress(piece)


def _digest(pieces: Iterable[bytes]) -> str:
    sha = hashlib.sha256()
    for piece in pieces:
        sha.update(piece)
    return sha.hexdigest()


def framed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = FRAME) -> DataFrame:
    """One row per row of ``docs``: id, n (units), marked (empty or with a mark of MARKS inside), frames."""
    kind = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            made = [frames_of(t, size) for t in texts]
            marked = [not t or any(m in t for m in MARKS) for t in texts]
            columns = [batch.column("id"), pa.array([n for n, _ in made], pa.int64()), pa.array(marked, pa.bool_()), pa.array([f for _, f in made], kind)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "marked", "frames"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, marked boolean, frames {FRAMES}")


def _hashes(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the sha256 of ``seed:id`` as numbers."""
    text = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(text, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def planned(frames: DataFrame, seed: int = 1, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """``framed`` with form, and one and two: units before the middle and before the suffix (0 where plain)."""
    h1, h2, h3, h4 = _hashes(F.col("id"), seed)
    form = F.when(F.col("marked") | (h3 % 100 >= 100 - plain), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = frames.withColumn("form", form)
    at = lambda f: F.when(F.col("form") == "plain", 0).otherwise(f(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)))
    return rows.withColumns({"one": at(F.least), "two": at(F.greatest)})


def _cuts(frames: list[dict], form: str, one: int, two: int) -> tuple[Cut | None, Cut | None]:
    return (None, None) if form == "plain" else (cut_at(frames, one), cut_at(frames, two))


def with_digests(plan: DataFrame) -> DataFrame:
    """``planned`` rows with prefix_chars, middle_chars, output_sha256 and restored_sha256; the last is read off the output itself."""

    @F.pandas_udf("prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
    def digests(frames: pd.Series, form: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        rows = []
        for f, kind, a, b in zip(frames, form, one, two, strict=True):
            first, second = _cuts(f, kind, a, b)
            sizes = (first[2], second[2] - first[2]) if first else (None, None)
            rows.append((*sizes, _digest(output(f, kind, first, second)), _digest(restored(output(f, kind, first, second), kind))))
        made = pd.DataFrame(rows, columns=["prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])
        return made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return plan.withColumn("d", digests("frames", "form", "one", "two")).select("id", "n", "form", "d.*")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """One row per row of ``docs``: id_col, n, form, and output, the transformed text.

    Null texts count as empty ones, which stay plain, as do texts that hold a
    mark. Rows of one id get the same draws; a null id counts as an empty one.
    An empty table gives an empty one; other columns are ignored.
    """

    @F.pandas_udf("string")
    def written(frames: pd.Series, form: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([b"".join(output(f, k, *_cuts(f, k, a, b))).decode("utf-8", "surrogatepass") for f, k, a, b in zip(frames, form, one, two, strict=True)], dtype=object)

    plan = planned(framed(few_rows(docs), id_col, text_col), seed, plain, spm)
    return plan.select(F.col("id").alias(id_col), "n", "form", written("frames", "form", "one", "two").alias("output"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = few_rows(read(spark, sf_dir, "documents"))
    return with_digests(planned(framed(docs))).withColumnRenamed("id", "doc_id")
