"""Vector code compression by Ball k-means.

Vectors of integers are cut into ``PARTS`` parts; each part position has a
codebook of ``ENTRIES`` entries, fitted in ``ROUNDS`` rounds. The first
assignment compares every part with every entry. Later ones use balls: the
parts of an entry form a ball round the moved entry, whose radius tells which
entries can be nearer to any of its parts at all (its neighbours, at most twice
the radius away). Neighbours sorted by distance cut a ball into rings: a part
at distance r meets only neighbours within 2 r, and a part of the stable core,
with no neighbour within 2 r, keeps its entry without any comparison. All
comparisons are of squared integers, so assignments are exact, ties included.

A round is one pass over the rows and one grouped sum of what each task has
summed by itself; codebooks (PARTS x ENTRIES entries) are the only thing that
passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import cut, read

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of at most this size are compared as 64-bit integers, larger ones as Python integers of any size.
SMALL = 1 << 25
#: Sums leave a task in limbs of this many bits.
LIMB = 32
#: Largest number of a long; larger errors count as this.
MOST = (1 << 63) - 1
#: Labels whose sums are broadcast rather than joined by a shuffle.
MOST_LABELS = 100_000


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite floats: 64-bit integers where all are SMALL, else Python integers."""
    wide = values.astype(np.float64)
    if not wide.size or np.abs(wide).max() < SMALL / scale:
        return np.floor(wide * scale).astype(np.int64)
    exact = [int(x) * scale if abs(x) > 1 << 52 else int(np.floor(x * scale)) for x in wide.ravel().tolist()]  # such large ones have no fraction
    out = np.empty(wide.size, dtype=object)
    out[:] = exact
    return out.reshape(wide.shape)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, a component at a time."""
    total = 0
    for i in range(a.shape[-1]):
        total = total + (a[..., i] - b[..., i]) ** 2
    return total


def nearest_of_all(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of each row of x; ties to the lower index."""
    d = _squares(x[:, None, :], entries[None, :, :])
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def nearest_by_balls(x: np.ndarray, own: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``nearest_of_all`` for parts that stood at ``own`` before the entries moved, and the number of comparisons made."""
    k, n = len(entries), len(x)
    d = _squares(x, entries[own])
    apart = _squares(entries[:, None, :], entries[None, :, :])
    radius = np.zeros(k, dtype=d.dtype)
    np.maximum.at(radius, own, d)
    neighbours, limits, counts = np.zeros((k, k), np.int64), [None] * k, np.zeros(n, np.int64)
    for i in np.unique(own):
        near = np.array([j for j in np.argsort(apart[i], kind="stable") if j != i and apart[i, j] <= 4 * radius[i]], dtype=np.int64)
        neighbours[i, : len(near)], limits[i] = near, apart[i, near]
        mine = np.flatnonzero(own == i)
        # the ring of a part: how many neighbours are within twice its distance
        counts[mine] = np.searchsorted(limits[i], 4 * d[mine], side="right")
    outer = np.flatnonzero(counts)  # all others are in their ball's stable core
    if not len(outer):
        return own, d, 0
    sizes = counts[outer]
    begins = np.cumsum(sizes) - sizes
    row = np.repeat(outer, sizes)
    candidate = neighbours[own[row], np.arange(len(row)) - np.repeat(begins, sizes)]
    far = _squares(x[row], entries[candidate])
    least = np.minimum(np.minimum.reduceat(far, begins), d[outer])
    index = np.where(far == np.repeat(least, sizes), candidate, k)
    winner = np.minimum(np.minimum.reduceat(index, begins), np.where(d[outer] == least, own[outer], k))
    best, dist = own.copy(), d.copy()
    best[outer], dist[outer] = winner, least
    return best, dist, len(row)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), width)


def _assigned(rows: DataFrame, books: list, width: int, last: bool = False) -> DataFrame:
    """``rows`` (id, label, v[, code]) with the code of each part, one byte each; with error if ``last``."""
    part = width // PARTS
    tables = [_table(book) for book in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("v"), width)
            before = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64) if "code" in batch.schema.names else None
            codes, error = np.zeros((len(x), PARTS), np.uint8), 0
            for p in range(PARTS):
                mine = x[:, p * part : (p + 1) * part]
                best, dist = nearest_of_all(mine, tables[p]) if before is None else nearest_by_balls(mine, before[:, p], tables[p])[:2]
                codes[:, p], error = best, error + dist
            columns = [batch.column("id"), batch.column("label"), batch.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())]
            if last:
                columns[2] = pa.array([min(int(e), MOST) for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "error" if last else "v", "code"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"id {kind['id']}, label {kind['label']}, {'error long' if last else 'v ' + kind['v']}, code binary")


def _table(book: list[list[int]]) -> np.ndarray:
    small = all(abs(c) <= SMALL for entry in book for c in entry)
    return np.array(book, dtype=np.int64 if small else object)


def _moved(rows: DataFrame, books: list, width: int) -> list:
    """The codebooks after one round: floors of the means of ``rows`` (v, code); unused entries stay."""
    part, k = width // PARTS, len(books[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = {}, np.zeros((PARTS, k), np.int64)
        for batch in batches:
            x = _vectors(batch.column("v"), width)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                counts[p] += np.bincount(codes[:, p], minlength=k)
                each = np.zeros((k, part), dtype=x.dtype)
                np.add.at(each, codes[:, p], x[:, p * part : (p + 1) * part])
                total[p] = total.get(p, 0) + each.astype(object)
        out = [(p, e, -1, 0, int(counts[p, e])) for p in range(PARTS) for e in range(k) if counts[p, e]]
        for p, e, _, _, _ in list(out):
            for i, value in enumerate(total[p][e].tolist()):
                limb = 0
                while value not in (0, -1) and abs(value) >> LIMB:
                    value, low = divmod(value, 1 << LIMB)
                    out.append((p, e, i, limb, low))
                    limb += 1
                out.append((p, e, i, limb, value))
        if out:
            yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(("part", "entry", "at", "limb", "value"), zip(*out, strict=True), strict=True)}, schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))

    partial = rows.select("v", "code").mapInArrow(sums, "part int, entry int, at int, limb int, value long")
    found = {}
    for r in partial.groupBy("part", "entry", "at", "limb").agg(F.sum("value").alias("value")).collect():  # PARTS x ENTRIES entries
        found[r.part, r.entry, r.at] = found.get((r.part, r.entry, r.at), 0) + (r.value << (LIMB * r.limb))
    mean = lambda p, e: [found[p, e, i] // found[p, e, -1] for i in range(part)]
    return [[mean(p, e) if (p, e, -1) in found else old for e, old in enumerate(book)] for p, book in enumerate(books)]


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v) of rows whose vector and its components are neither null nor infinite nor no number."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list]:
    """(rows, codebooks): one row (id_col, label, error, code) per kept vector; code has a byte per part.

    Codebooks start as the vectors of the smallest ids, nulls last, ties by
    vector; with fewer vectors than ``entries`` they are that much smaller.
    Vectors must have the length of the first of these (the smallest id whose
    length is a multiple of PARTS): others cannot be cut into comparable parts
    and are dropped like invalid ones. Errors over a long count as its largest
    number. Repeated rows give a row each; an empty table gives an empty one
    and no codebooks; other columns are ignored.
    """
    rows = kept_vectors(vectors, id_col, vector_col, label_col).filter((F.size("v") > 0) & (F.size("v") % PARTS == 0))
    order = [F.col("id").asc_nulls_last(), "v"]
    width = (rows.orderBy(*order).select(F.size("v")).first() or [0])[0]
    rows = rows.filter(F.size("v") == width)
    first = rows.orderBy(*order).limit(entries).select("v").collect()
    if not first:
        return rows.select(F.col("id").alias(id_col), "label", F.lit(0).cast("long").alias("error"), F.lit(b"").alias("code")), []
    part = width // PARTS
    start = [[int(c) for c in scaled(np.array(r.v, dtype=np.float64))] for r in first]
    books = [[v[p * part : (p + 1) * part] for v in start] for p in range(PARTS)]
    for _ in range(rounds):
        rows = cut(_assigned(rows, books, width))
        books = _moved(rows, books, width)
    done = _assigned(rows, books, width, last=True)
    return done.select(F.col("id").alias(id_col), "label", "error", "code"), books


def digest(books: list) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error: the errors of all rows of the label (null is one), a long at most."""
    total = F.sum(F.col("error").cast("decimal(20,0)"))
    sums = cut(rows.groupBy(F.col("label").alias("of_label")).agg(F.least(total, F.lit(MOST).cast("decimal(30,0)")).cast("long").alias("label_error")))
    small = sums.limit(MOST_LABELS + 1).count() <= MOST_LABELS
    return rows.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")


def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(read(spark, sf_dir, "embeddings"))
    done = with_label_errors(cut(rows))
    return done.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
