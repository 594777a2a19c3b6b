"""SimHash near-duplicates by tiled exact comparison.

Fingerprints of 64 bits link when they differ in at most ``RADIUS`` bits. Their
bits are cut into five blocks; two fingerprints that link agree in at least two
of them, so each pair of blocks deals the different fingerprints into buckets
and every link lies within some bucket. A bucket is compared exactly, tile by
tile: numpy exclusive-or and bit counts over tiles ordered by population count,
skipping tile pairs whose counts are further apart than the radius. Buckets
over ``BUCKET`` fingerprints are split into parts whose pairs go to separate
tasks. A comparison returns the links of a spanning forest (never all pairs),
and classes follow by min-label propagation with pointer jumping.

``drop_similar`` does the same for word shingles of a stated similarity, where
64 bits and a small radius would miss most pairs: 256 bits, a radius that
covers the similarity, buckets dealt by shared shingles, exact proof.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexiflow.llm.common import cut, read

SHINGLE, SEED, RADIUS = 3, 42, 3
#: (lowest bit, bits) of the blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of a bucket that one task compares with each other.
BUCKET = 4096
TILE = 512
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half the XXH64 hashes of the word shingles, repeats included; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    h64, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((h64(join(words[i : i + shingle]), SEED) for i in range(n)), dtype=np.uint64, count=n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """(id, fp) and ``more``: one row per row of ``docs``; fp is the fingerprint's bits as a signed long."""

    @F.pandas_udf(LongType())
    def fp(texts):
        out = np.fromiter((fingerprint(t) for t in texts), dtype=np.uint64, count=len(texts))
        import pandas as pd

        return pd.Series(out.view(np.int64))

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"), *more)


class _Forest:
    """Union-find over the positions of a bucket; records the links that join two trees."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        la, lb = self.label[a], self.label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        _, first = np.unique(np.minimum(la, lb) * len(self.label) + np.maximum(la, lb), return_index=True)
        root: dict[int, int] = {}

        def find(x):
            while x in root:
                x = root[x]
            return x

        for i in first:
            x, y = find(int(la[i])), find(int(lb[i]))
            if x != y:
                root[max(x, y)] = min(x, y)
                self.links.append((int(a[i]), int(b[i])))
        if root:
            table = np.arange(len(self.label))
            for x in sorted(root):
                table[x] = table[root[x]]  # roots are smaller and come first
            self.label = table[self.label]


def _ones(bits: np.ndarray, words: int) -> np.ndarray:
    """Set bits of fingerprints of one 64-bit word (a value each) or of several (a last axis)."""
    ones = np.bitwise_count(bits)
    return ones if words == 1 else ones.sum(axis=-1, dtype=np.int32)


def compare(fps: np.ndarray, radii: tuple[int, ...] = (RADIUS,), tile: int = TILE) -> list[tuple[int, int]]:
    """Positions of links that span all links of the last radius among different fingerprints ordered by population count.

    The radii grow: closer fingerprints are linked first. Tiles that already
    belong to one tree have nothing left to link.
    """
    n, words = len(fps), 1 if fps.ndim == 1 else fps.shape[1]
    ones = _ones(fps, words).astype(np.int64)
    forest = _Forest(n)
    for radius in radii:
        for i in range(0, n, tile):
            left = fps[i : i + tile]
            for j in range(i, n, tile):
                if ones[j] - ones[min(i + tile, n) - 1] > radius:
                    break  # ordered: all later tiles are further apart
                tree = forest.label[i]
                if (forest.label[i : i + tile] == tree).all() and (forest.label[j : j + tile] == tree).all():
                    continue
                near = _ones(left[:, None] ^ fps[None, j : j + tile], words) <= radius
                a, b = np.nonzero(near)
                a, b = a + i, b + j
                ordered = a < b
                if ordered.any():
                    forest.join(a[ordered], b[ordered])
    return forest.links


def _links_of(fps: np.ndarray, starts: np.ndarray, radii: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Links within each bucket of rows in bucket order; starts has the first row of each bucket and the end."""
    words = 1 if fps.ndim == 1 else fps.shape[1]
    sizes = np.diff(starts)
    ends = np.repeat(starts[1:], sizes)
    at, small = np.arange(len(fps)), np.repeat(sizes, sizes) <= 32
    left, right = [], []
    for d in range(1, 32):  # all small buckets at once: each row against the d-th after it
        i = at[small & (at + d < ends)]
        if not len(i):
            break
        near = i[_ones(fps[i] ^ fps[i + d], words) <= radii[-1]]
        left.append(fps[near])
        right.append(fps[near + d])
    for k in np.flatnonzero(sizes > 32):
        own = fps[starts[k] : starts[k + 1]]
        own = own[np.argsort(_ones(own, words), kind="stable")]
        if links := compare(own, radii):
            a, b = np.array(links).T
            left.append(own[a])
            right.append(own[b])
    return np.concatenate([fps[:0], *left]), np.concatenate([fps[:0], *right])


def _values(column: pa.Array) -> np.ndarray:
    """Longs as they are; binary fingerprints as rows of 64-bit words."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _column(fps: np.ndarray) -> pa.Array:
    if fps.ndim == 1:
        return pa.array(fps.view(np.int64))
    return pa.array([row.tobytes() for row in np.ascontiguousarray(fps)], pa.binary())


def _compare_batches(batches: Iterator[pa.RecordBatch], radii: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, part, fp) in bucket order to links (a, b); a bucket may run over several batches."""

    def done(bucket, part, fps, upto):
        cuts = np.flatnonzero((np.diff(bucket[:upto]) != 0) | (np.diff(part[:upto]) != 0)) + 1
        a, b = _links_of(fps[:upto].view(np.uint64), np.concatenate([[0], cuts, [upto]]), radii)
        return pa.RecordBatch.from_arrays([_column(a), _column(b)], ["a", "b"])

    held = []
    for batch in batches:
        now = [_values(batch.column(i)) for i in range(3)]
        if held:
            now = [np.concatenate(pair) for pair in zip(held, now, strict=True)]
        bucket, part, _ = now
        if not len(bucket):
            continue
        last = np.flatnonzero((bucket != bucket[-1]) | (part != part[-1]))
        upto = int(last[-1]) + 1 if len(last) else 0
        if upto:
            yield done(*now, upto)
        held = [x[upto:] for x in now]
    if held:
        yield done(*held, len(held[0]))


def links(fps: DataFrame, bucket_size: int = BUCKET) -> DataFrame:
    """Links (a, b) among the different values of fp that span every link of RADIUS bits or fewer."""
    keys = []
    for n, pair in enumerate(combinations(BLOCKS, 2)):
        bits = [F.shiftrightunsigned("fp", low).bitwiseAND((1 << size) - 1) for low, size in pair]
        keys.append(bits[0] * (1 << 13) + bits[1] + n * (1 << 26))
    return bucket_links(fps.select("fp", F.explode(F.array(*keys)).alias("bucket")), (RADIUS,), bucket_size)


def bucket_links(rows: DataFrame, radii: tuple[int, ...], bucket_size: int = BUCKET, fps: DataFrame | None = None) -> DataFrame:
    """Links (a, b) among the different fps of each bucket, for rows (fp, bucket): they span all links of the last radius.

    With ``fps`` (node, fp) the rows hold nodes; fingerprints are fetched for
    buckets of several nodes alone.
    """
    kind = dict((rows if fps is None else fps).dtypes)["fp"]
    # most buckets hold one fingerprint: they go before Python sees them
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(sizes.select("bucket", F.ceil(F.col("n") / bucket_size).cast("int").alias("parts")), "bucket")
    if fps is not None:
        rows = rows.join(fps, "node")
    rows = _in_order(_parts(rows).select("bucket", "part", "fp"))
    return rows.mapInArrow(lambda batches: _compare_batches(batches, radii), f"a {kind}, b {kind}").distinct()


def _parts(rows: DataFrame) -> DataFrame:
    """Rows (bucket, parts, fp) with a column part, a row for each part that it goes to: each pair of a bucket's rows meets in some part."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    part = F.least("own", "other") * F.lit(1 << 20).cast("long") + F.greatest("own", "other")
    return rows.withColumn("part", part)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part")


def prove(fps: np.ndarray, classes: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Positions of links that join all classes which a pair within ``radius`` and of that similarity joins, directly or through others.

    ``classes`` are numbers below the number of rows. Every pair within the
    radius is held against its two whole sets unless earlier links have joined
    its ends: the links are at most as many as the classes, less one.
    """
    forest, sizes = _Forest(len(fps)), np.array([len(s) for s in sets])
    forest.label = classes
    # each different shingle of the bucket gets a number: common ones are read off a table of marks
    _, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    marks = np.zeros(int(numbers.max()) + 1, np.uint8)
    numbers = np.split(numbers.astype(np.int32), np.cumsum(sizes)[:-1])
    for i in range(0, len(fps), TILE):
        for j in range(i, len(fps), TILE):
            left, right = forest.label[i : i + TILE], forest.label[j : j + TILE]
            if (left == left[0]).all() and (right == left[0]).all():
                continue
            near = (left[:, None] != right[None, :]) & (_ones(fps[i : i + TILE, None] ^ fps[None, j : j + TILE], fps.shape[1]) <= radius)
            near = np.triu(near, 1) if i == j else near
            for x in np.flatnonzero(near.any(axis=1)):
                a, b = i + x, j + np.flatnonzero(near[x])
                b = b[forest.label[b] != forest.label[a]]
                if not len(b):
                    continue
                marks[numbers[a]] = 1
                starts = np.cumsum(sizes[b]) - sizes[b]
                common = np.add.reduceat(marks[np.concatenate([numbers[k] for k in b])], starts, dtype=np.int64)
                marks[numbers[a]] = 0
                b = b[common + 1e-9 >= similarity * (sizes[a] + sizes[b] - common)]
                forest.join(np.full(len(b), a), b)
    return forest.links


def _prove_batches(batches: Iterator[pa.RecordBatch], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, part, fp, class, set) in bucket order to the links (a, b) of ``prove``; a bucket may run over several batches."""

    def rows():
        for batch in batches:
            sets = batch.column(4)
            each = np.split(sets.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(sets.offsets.to_numpy()))[:-1])
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)), each, strict=True)

    for _, group in groupby(rows(), key=lambda r: r[:2]):
        group = sorted(group, key=lambda r: r[3])  # tiles of one class have nothing to link
        known = {c: n for n, c in enumerate(dict.fromkeys(r[3] for r in group))}
        if len(known) > 1:
            fps = np.frombuffer(b"".join(r[2] for r in group), "<u8").reshape(len(group), -1)
            if links := prove(fps, np.array([known[r[3]] for r in group]), [r[4] for r in group], radius, similarity):
                yield pa.RecordBatch.from_arrays([pa.array([group[link[end]][2] for link in links], pa.binary()) for end in (0, 1)], ["a", "b"])


def between_classes(rows: DataFrame, sets: DataFrame, radius: int, similarity: float, bucket_size: int) -> DataFrame:
    """Proven links (a, b) between different classes of each bucket, for rows (bucket, fp, class, size) and sets (fp, set).

    They join all classes that a pair within ``radius`` and of that similarity
    joins: at most one link less than a part of a bucket has classes, never all
    pairs. Buckets over ``bucket_size`` rows or SHINGLES shingles are split into
    parts whose pairs go to separate tasks.
    """
    each = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.min("class").alias("least"), F.max("class").alias("most")).filter("least <> most")
    parts = F.ceil(F.greatest(F.col("n") / bucket_size, F.col("all") / SHINGLES)).cast("int")
    parted = _parts(rows.join(each.select("bucket", parts.alias("parts")), "bucket")).select("fp", "bucket", "part", "class")
    held = _in_order(parted.join(sets, "fp").select("bucket", "part", "fp", "class", "set"))
    return held.mapInArrow(lambda batches: _prove_batches(batches, radius, similarity), "a binary, b binary").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, label): the smallest label reachable over undirected edges (a, b), for nodes (fp, label) that have one.

    Each round takes the smallest label next to each node, then the label of
    the node that the label came from; rounds stop when nothing changes.
    """
    both = cut(edges.union(edges.select("b", "a")).distinct())
    ends = both.select(F.col("a").alias("fp")).distinct()
    # (root, label): labels stay beside the node that they come from
    now = cut(nodes.join(ends, "fp").select("fp", F.struct("label", F.col("fp").alias("root")).alias("best")))
    while True:
        near = both.join(now, F.col("b") == F.col("fp")).groupBy("a").agg(F.min("best").alias("near"))
        step = now.join(near, F.col("fp") == F.col("a")).select("fp", F.col("best").alias("old"), F.least("best", "near").alias("best"))
        step = cut(step)
        roots = step.select(F.col("fp").alias("root"), F.col("best").alias("further"))
        jumped = step.withColumn("root", F.col("best.root")).join(roots, "root").select("fp", "old", F.least("best", "further").alias("best"))
        jumped = cut(jumped)
        moved = not jumped.filter(~F.col("best").eqNullSafe(F.col("old"))).isEmpty()
        now = jumped.select("fp", "best")
        if not moved:
            return now.select("fp", F.col("best.label").alias("label"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, fp (long), component_id.

    component_id is the smallest id of all rows whose fingerprints are reached
    by links. Null and empty texts have the fingerprint 0, which links like any
    other. Rows without an id get the class of their text; a class without any
    id has a null component_id. Repeated rows give a row each; an empty table
    gives an empty one; other columns are ignored.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    label = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"))  # ids before no id
    labelled = nodes.select("fp", label.alias("label"))
    reached = components(labelled, links(nodes.select("fp"))).select("fp", F.col("label.id").alias("class"), F.lit(True).alias("linked"))
    classes = nodes.join(reached, "fp", "left").select("fp", F.when(F.col("linked"), F.col("class")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, of each class: that of the smallest id; without any id, one of its rows.

    Rows are told apart by fingerprint, not by id: rows without an id and rows
    of a repeated id stay or go with their own class. Rows of one id and class
    are decided by fingerprint, text and the other columns.
    """
    rows = cut(fingerprints(docs, id_col, text_col, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    labelled = nodes.select("fp", F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "fp").alias("label"))
    # a class's label holds the fingerprint that stays
    lost = components(labelled, links(nodes.select("fp"))).filter("fp != label.fp").select("fp")
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    order = F.struct(F.col("id").isNull(), "id", F.col(f"row.`{text_col}`"), F.to_json(F.struct(F.lit(0), *others)))
    # combined in each task before the shuffle, so that a large group reaches no task as a whole
    kept = rows.groupBy("fp").agg(F.min_by("row", order).alias("row")).join(lost, "fp", "left_anti")
    return kept.select("row.*")


#: Shingles and similarity of ``drop_similar``; its fingerprints have WORDS words of 64 bits.
SIMILAR_SHINGLE, SIMILARITY, WORDS = 5, 0.8, 4
#: Radii in 256 bits. A pair of similarity 0.8 differs in 39 on average, deviation 6; closer pairs are linked first.
RADII = (20, 30, 40, 58)
#: Each pair of a set's smallest hashes is a bucket. Two sets of similarity 0.8 have two of the seven smallest of
#: their union in common, thus a bucket, in 1 - 7 * 0.8 * 0.2**6 - 0.2**7 = 99.96 % of pairs, more above 0.8.
SMALLEST = 7
#: Shingles of a bucket that one task proves against each other (two such parts at most are held at once); a longer text is a part's share of its own.
SHINGLES = 1 << 20
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The different word shingles of the whole text as ordered 64-bit hashes; fewer words: the whole sequence; none: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size, n = min(shingle, len(words)), max(1, len(words) - shingle + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = rolled * _STEP + hashes[k : k + n]
    return np.unique(_mixed(rolled))


def wide_fingerprint(shingles: np.ndarray, words: int = WORDS) -> bytes:
    """64 * ``words`` bits: those set in over half the shingles' hashes; zero without a shingle."""
    n, counts, steps = len(shingles), np.zeros(64 * words, np.int64), _STEP * np.arange(1, words + 1, dtype=np.uint64)
    for i in range(0, n, 1 << 13):
        hashes = _mixed(shingles[i : i + (1 << 13), None] + steps)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").tobytes()


def _keys(shingles: np.ndarray) -> np.ndarray:
    """A hash of each pair (i, j), i < j, of the smallest SMALLEST shingle hashes, by j and then i."""
    few = shingles[:SMALLEST]
    j, i = np.tril_indices(len(few), -1)
    return _mixed(few[i] * _STEP + few[j]).view(np.int64)


def similar_links(nodes: DataFrame, text: Column, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, radii: tuple[int, ...] = RADII, bucket_size: int = BUCKET) -> DataFrame:
    """Links (a, b) between the fingerprints of ``nodes`` (fp, keys, one text each), each proven by the shingle sets.

    The keys deal the fingerprints into buckets; a passage that many texts
    share makes no large one, as two of its shingles must be among a text's
    smallest. The tiled comparison finds the close fingerprints, and the exact
    similarity of the two whole texts decides. A forest passes over pairs that
    its own links join: where one of its links is refused, the texts of the
    bucket meet again with their sets, and only proven links join them.
    """

    @F.pandas_udf("array<bigint>")
    def shingles(texts):
        return texts.map(lambda t: shingle_set(t, shingle).view(np.int64))

    node = F.xxhash64("fp").alias("node")  # two fingerprints of one number only meet more often
    dealt = nodes.select(node, F.explode("keys").alias("bucket"))
    found = cut(bucket_links(dealt, radii, bucket_size, nodes.select(node, "fp")))
    ends = found.select(F.col("a").alias("fp")).union(found.select(F.col("b").alias("fp"))).distinct()
    sets = cut(nodes.join(ends, "fp").select("fp", "keys", shingles(text).alias("set")))
    left, right = (sets.select(F.col("fp").alias(end), F.col("keys").alias(f"keys_{end}"), F.col("set").alias(f"set_{end}")) for end in ("a", "b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    enough = common + 1e-9 >= similarity * (F.size("set_a") + F.size("set_b") - common)
    judged = found.join(left, "a").join(right, "b").withColumn("holds", enough)
    judged = cut(judged.select("a", "b", "holds", F.when(~F.col("holds"), F.array_intersect("keys_a", "keys_b")).alias("broken")))
    held, broken = judged.filter("holds").select("a", "b"), judged.select(F.explode("broken").alias("key")).distinct()
    if broken.isEmpty():
        return held
    classes = components(sets.select("fp", F.col("fp").alias("label")), held)
    # texts without a link of the forests have no other within the radius. A text goes to the smaller hash of each broken
    # bucket's pair: six times at most instead of 21, and two that share a broken bucket still meet
    first = F.array(*[F.lit(int(i) + 1) for i in np.tril_indices(SMALLEST, -1)[1]])
    at = F.transform("keys", lambda key, n: F.struct(key.alias("key"), F.element_at("set", F.element_at(first, n + 1)).alias("bucket")))
    rows = sets.select("fp", F.size("set").alias("size"), F.explode(at).alias("at")).select("fp", "size", "at.*")
    rows = rows.join(broken, "key", "left_semi").select("fp", "size", "bucket").distinct().join(classes, "fp", "left")
    rows = cut(rows.select("fp", "size", "bucket", F.coalesce("label", "fp").alias("class")))
    return held.unionByName(between_classes(rows, sets.select("fp", "set"), radii[-1], similarity, bucket_size))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs``, all columns, of each class of texts whose word shingles are as similar as ``similarity`` (Jaccard).

    The row of the smallest id stays; without any id, one of the rows. Rows
    without an id and rows of a repeated id stay or go with their own class.
    Texts without a word (null, empty, blank) are one class. Links are those
    that the buckets and the fingerprints' radius cover (over 99.8 % of pairs
    at 0.8); none is less similar than ``similarity``. Where a spanning
    forest's link is refused, the pairs of its buckets between the classes
    proven so far are judged until proven links have joined them.
    An empty table gives an empty one.
    """

    @F.pandas_udf("fp binary, keys array<bigint>")
    def node(texts):
        import pandas as pd

        sets = [shingle_set(t, shingle) for t in texts]
        return pd.DataFrame({"fp": [wide_fingerprint(x) for x in sets], "keys": [_keys(x) for x in sets]})

    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(F.col(id_col).alias("id"), node(F.col(text_col)).alias("node"), row.alias("row"))
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    # digests: the order travels with each row
    order = F.struct(F.col("id").isNull(), "id", F.sha2(F.col(f"row.`{text_col}`").cast("binary"), 256), F.sha2(F.to_json(F.struct(F.lit(0), *others)), 256))
    best = F.min_by(F.struct("id", "node.keys", "row"), order)
    # one row a fingerprint, combined in each task before the shuffle
    nodes = cut(rows.groupBy(F.col("node.fp").alias("fp")).agg(best.alias("best")).select("fp", "best.*"))
    links = cut(similar_links(nodes, F.col(f"row.`{text_col}`"), shingle, similarity))
    label = F.struct(F.col("id").isNull().alias("none"), "id", "fp").alias("label")  # holds the fingerprint that stays
    lost = components(nodes.select("fp", label), links).filter("fp != label.fp").select("fp")
    return nodes.join(lost, "fp", "left_anti").select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicate_classes(read(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
