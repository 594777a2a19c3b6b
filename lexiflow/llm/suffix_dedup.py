"""Suffix-array dedup: passages of ``LENGTH`` bytes that start earlier elsewhere are cut out.

Texts are byte strings. A byte goes if a string of LENGTH bytes that covers it
also starts earlier: in a row of smaller id, or earlier in the same text.

Suffixes are sorted where equal strings can meet. Every string of LENGTH bytes
has an anchor, the GRAM bytes of the smallest hash inside it, so equal strings
have equal anchors at the same place. Neighbouring strings with one anchor form
a segment. Segments are combined first, inside each task and then over all: of
equal segments (96 bits and more of hashes) only the first goes on, the others
are cut out whole. Where an anchor still has several different segments, their
bytes are fetched and halved at the anchor; halves that agree on all bytes any
of their strings must share are one group, and the suffixes of a group are
sorted.

The sort is a mergesort whose comparisons find the common extension of two
suffixes by binary search over prefix polynomial hashes, a logarithmic number
of steps. Neighbours in the sorted order are then compared byte by byte; a
group whose order a hash collision has spoilt is sorted again by its bytes.
Runs of neighbours that share LENGTH bytes keep their first string.

Hot passages reach a shuffle as one row per task. A group of more than GROUP
pieces is not sorted in one task: its strings are dealt out one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import cut, few_rows, read

LENGTH, GRAM = 100, 20
#: Strings that can hold one anchor; strings whose anchor is at most HALF bytes in are right halves.
STRINGS, HALF = LENGTH - GRAM + 1, (LENGTH - GRAM) // 2
#: Bytes of text that are hashed together, and segments that a task combines together.
CHUNK, COMBINED = 1 << 19, 400_000
#: Pieces of a group that one task sorts, and strings that it sorts together.
GROUP, SORTED = 4096, 150_000
#: Rows of an Arrow batch; its bytes are bounded as well.
ROWS = 10_000
#: Bases of the two prefix polynomials modulo 2^64 (odd, so that powers have inverses).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(n + n // 4, b, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _POWERS[base] = tuple(tables)
    return _POWERS[base]


class Hashed:
    """Prefix polynomial hashes of a byte string: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        power, self.inverse = _powers(base, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.inverse[start]

    def all_of(self, length: int) -> np.ndarray:
        """Hashes of all substrings of a length, by start."""
        n = len(self.prefix) - length
        return (self.prefix[length:] - self.prefix[:n]) * self.inverse[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, last, anchor, hash of the anchor, hash of the segment) of texts joined in ``data`` that end at ``ends``.

    first and last are where a segment's first and last string start.
    """
    hashed = Hashed(data)
    grams = _mixed(hashed.all_of(GRAM))
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)  # hash, then place: the leftmost of equal ones
    width = 1
    while width * 2 <= STRINGS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < STRINGS:
        least = np.minimum(least[: len(least) - (STRINGS - width)], least[STRINGS - width :])
    anchor = (least & _LOW).astype(np.int64)
    for end in ends:  # strings that would run over the end of a text
        anchor[max(0, end - LENGTH + 1) : end] = -1
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.concatenate((first[1:], [len(anchor)])) - 1
    real = anchor[first] >= 0
    first, last = first[real], last[real]
    whole = _mixed(Hashed(data, BASES[1]).of(first, last - first + LENGTH))
    return first, last, anchor[first], grams[anchor[first]], whole


def _order_of(docs: list[tuple]) -> np.ndarray:
    """Rank of each (id, tie): ids ascending, null last."""
    place = {d: i for i, d in enumerate(sorted(set(docs), key=lambda d: (d[0] is None, d[0] if d[0] is not None else 0, d[1])))}
    return np.array([place[d] for d in docs], np.int64)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of intervals per doc, touching ones joined."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((end, start, doc))
    doc, start, end = doc[o], start[o], end[o]
    shift = (end.max() + 1) * (doc - doc.min())  # docs one after another, so that one running maximum serves all
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] + shift[1:] > reach[:-1])))
    begins = np.flatnonzero(new)
    return doc[begins], start[begins], np.maximum.reduceat(end, begins)


_ANCHORED = "tie long, anchor long, whole long, packed long, length long"


def _anchored(docs: DataFrame) -> DataFrame:
    """Segments of ``docs`` (id, tie, data), combined per task: those that may be first (packed: start, strings - 1, place of the anchor), and stretches (packed: start) already known to be later copies, with their length."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size, found, docs_seen, n_found = [], 0, [], [], 0
        id_type = None

        def hashed():
            data = np.frombuffer(b"".join(t for _, _, t in texts), np.uint8)
            ends = np.cumsum([len(t) for _, _, t in texts])
            first, last, anchor, gram, whole = segments(data, ends)
            which = np.searchsorted(ends, first, side="right")
            begin = np.concatenate(([0], ends))[which]
            doc, offset = np.array([d for d, _, _ in texts])[which], np.array([o for _, o, _ in texts])[which]
            return doc, first - begin + offset, last - first, anchor - first, gram.view(np.int64), whole.view(np.int64)

        def combined():
            doc, start, more, at, gram, whole = (np.concatenate(c) for c in zip(*found, strict=True))
            rank = _order_of(docs_seen)[doc]
            o = np.lexsort((start, rank, whole, gram))
            doc, start, more, at, gram, whole, rank = (c[o] for c in (doc, start, more, at, gram, whole, rank))
            new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1])))
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            later = (rank != rank[head]) | (start != start[head])
            cut_doc, cut_start, cut_end = merged(doc[later], start[later], (start + more + LENGTH)[later])
            docs_of = np.concatenate((doc[new], cut_doc))
            ids = pa.array([d[0] for d in docs_seen], id_type).take(pa.array(docs_of))
            tie = np.array([d[1] for d in docs_seen], np.int64)[docs_of]
            none = np.zeros(len(cut_doc), np.int64)
            packed = np.concatenate(((start[new] << 14) | (more[new] << 7) | at[new], cut_start))
            length = pa.array(np.concatenate((more[new], cut_end - cut_start)), pa.int64(), mask=np.arange(len(packed)) < int(new.sum()))
            anchor = np.concatenate((gram[new], tie[len(tie) - len(none) :]))
            columns = [ids, pa.array(tie), pa.array(anchor), pa.array(np.concatenate((whole[new], none))), pa.array(packed), length]
            for at_row in range(0, len(packed), ROWS):
                yield pa.RecordBatch.from_arrays([c[at_row : at_row + ROWS] for c in columns], ["id", "tie", "anchor", "whole", "packed", "length"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for doc_id, tie, text in zip(batch.column("id").to_pylist(), batch.column("tie").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if len(text) < LENGTH:
                    continue
                docs_seen.append((doc_id, tie))
                for at in range(0, len(text) - LENGTH + 1, CHUNK):
                    texts.append((len(docs_seen) - 1, at, text[at : at + CHUNK + LENGTH - 1]))
                    size += len(texts[-1][2])
                    if size >= CHUNK:
                        found.append(hashed())
                        n_found, texts, size = n_found + len(found[-1][0]), [], 0
            if n_found >= COMBINED:
                if texts:
                    found.append(hashed())
                yield from combined()
                texts, size, found, docs_seen, n_found = [], 0, [], [], 0
        if texts:
            found.append(hashed())
        if found:
            yield from combined()

    return docs.mapInArrow(run, f"id {kind}, {_ANCHORED}")


def _equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    """a == b with null equal to null."""
    return pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))


def _firsts(rows: DataFrame) -> DataFrame:
    """Later copies among ``rows`` (id, tie, anchor, whole, packed, length) as stretches (id, tie, start, length); first segments whose anchor has others beside them also carry anchor and at.

    Rows are dealt by anchor and read in order, so a task holds one batch and
    one row of any anchor, however many rows that has.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = held = crowded = None  # the last first segment, the same if it is alone so far, the anchor known to have several

        def out(table, start, length, at=None):
            n = table.num_rows
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([table.column("id"), table.column("tie"), pa.array(start, pa.int64()), pa.array(length, pa.int64()), none if at is None else table.column("anchor"), none if at is None else pa.array(at, pa.int64())], ["id", "tie", "start", "length", "anchor", "at"])

        for batch in batches:
            known = batch.column("length").is_valid()
            stretches = batch.filter(known)
            if stretches.num_rows:
                yield out(stretches, stretches.column("packed"), stretches.column("length"))
            batch = batch.filter(pc.invert(known))
            if not batch.num_rows:
                continue
            if head is not None:
                batch = pa.Table.from_batches([head, batch]).combine_chunks().to_batches()[0]
            anchor, whole, packed = (batch.column(c).to_numpy() for c in ("anchor", "whole", "packed"))
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])))
            at_head = pa.array(np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)))
            same = _equal(batch.column("id"), batch.column("id").take(at_head)) & _equal(batch.column("tie"), batch.column("tie").take(at_head)) & (packed == packed[at_head.to_numpy()])
            later = batch.filter(pa.array(~same))
            if later.num_rows:
                p = later.column("packed").to_numpy()
                yield out(later, p >> 14, ((p >> 7) & 127) + LENGTH)
            heads = batch.filter(pa.array(new))
            names = heads.column("anchor").to_numpy()
            counts = np.diff(np.append(np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))), len(names)))
            several = np.repeat(counts > 1, counts) | (names == crowded if crowded is not None else False)
            if head is not None and held is None:
                several[0] = False  # its segment went out with the batch before
            head = heads.slice(heads.num_rows - 1)
            last_several = counts[-1] > 1 or (crowded is not None and names[-1] == crowded)
            crowded, held = (names[-1], None) if last_several else (None, head)
            asked = heads.filter(pa.array(several))
            if asked.num_rows:
                p = asked.column("packed").to_numpy()
                yield out(asked, p >> 14, ((p >> 7) & 127) + LENGTH, p & 127)

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "whole", F.col("id").asc_nulls_last(), "tie", "packed")
    return dealt.mapInArrow(run, f"id {kind}, tie long, start long, length long, anchor long, at long")


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _pieces(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, id, tie, start, data): the halves of the segments ``asked`` for, cut from their texts; key: the bytes that a half's strings share."""
    kind = docs.schema["id"].dataType.simpleString()
    per = asked.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "length", "at")).alias("asked"))  # fewer than a text has bytes
    joined = docs.join(per.withColumnsRenamed({"id": "of_id", "tie": "of_tie"}), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("tie") == F.col("of_tie")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, starts, datas = [], [], [], []
            for i, (packed, wanted) in enumerate(zip(batch.column("packed").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
                text = zstandard.ZstdDecompressor().decompress(packed)
                for s in wanted:
                    begin, end, at = s["start"], s["start"] + s["length"], s["start"] + s["at"]
                    middle = max(begin, at - HALF)  # the first string of the right half
                    if middle + LENGTH <= end:
                        keys.append(_signed(xxhash.xxh64_intdigest(text[at : at + LENGTH - HALF])))
                        rows.append(i)
                        starts.append(middle)
                        datas.append(text[middle:end])
                    if begin < middle:
                        stop = min(end, middle - 1 + LENGTH)
                        keys.append(_signed(xxhash.xxh64_intdigest(text[at - HALF - 1 : at + GRAM], seed=1)))
                        rows.append(i)
                        starts.append(begin)
                        datas.append(text[begin:stop])
            if rows:
                at_rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("id").take(at_rows), batch.column("tie").take(at_rows), pa.array(starts, pa.int64()), pa.array(datas, pa.binary())], ["key", "id", "tie", "start", "data"])

    return joined.select("id", "tie", "packed", "asked").mapInArrow(run, f"key long, id {kind}, tie long, start long, data binary")


class Suffixes:
    """Suffixes of a byte string, compared over at most LENGTH bytes through prefix hashes."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        self.data, self.hashed = data, Hashed(data, base)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common extension of suffixes x and y: binary search over the lengths at which their hashes agree."""
        prefix = self.hashed.prefix
        px, py, ix, iy = prefix[x], prefix[y], self.hashed.inverse[x], self.hashed.inverse[y]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), LENGTH, np.int64)
        for _ in range(LENGTH.bit_length()):
            middle = (low + high + 1) >> 1
            agree = (prefix[x + middle] - px) * ix == (prefix[y + middle] - py) * iy
            low, high = np.where(agree, middle, low), np.where(agree, high, np.maximum(low, middle - 1))
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        far = self.extension(x, y)
        inside = np.minimum(far, LENGTH - 1)
        return (far < LENGTH) & (self.data[x + inside] < self.data[y + inside])

    def sort(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Suffixes ``at``, grouped in blocks of ``sizes``, sorted inside each block by merges of doubled width."""
        n = len(at)
        begin, size = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
        slot = np.arange(n)
        inside, width = slot - begin, 1
        while width < sizes.max():
            run = inside // width
            other = (run ^ 1) * width
            live = np.flatnonzero(other < size)
            low = begin[live] + other[live]
            high = begin[live] + np.minimum(other[live] + width, size[live])
            first, left, me = low.copy(), (run[live] & 1) == 0, at[live]
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) >> 1
                a, b, is_left = at[middle], me[open_], left[open_]
                # from the left run: how many are less; from the right: how many are not greater
                ahead = self.less(np.where(is_left, a, b), np.where(is_left, b, a)) == is_left
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            goes = slot.copy()
            goes[live] = begin[live] + (run[live] & ~1) * width + inside[live] % width + (low - first)
            after = at.copy()
            after[goes] = at
            at, width = after, width * 2
        return at

    def shared(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes that each suffix really shares with the one before it, is the order of the two right), byte by byte."""
        far, right = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for i in range(1, len(at), ROWS):
            x, y = at[i - 1 : i + ROWS - 1][: len(at[i : i + ROWS])], at[i : i + ROWS]
            a, b = self.data[x[:, None] + np.arange(LENGTH)], self.data[y[:, None] + np.arange(LENGTH)]
            differs = a != b
            any_ = differs.any(axis=1)
            first = np.where(any_, differs.argmax(axis=1), LENGTH)
            inside = np.minimum(first, LENGTH - 1)
            far[i : i + ROWS] = first
            right[i : i + ROWS] = ~any_ | (a[np.arange(len(x)), inside] < b[np.arange(len(x)), inside])
        return far, right


def later_strings(pieces: list[bytes], sizes: list[int], doc: np.ndarray, start: np.ndarray, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, string) of the strings of ``pieces`` that start earlier too; pieces are in groups of ``sizes``, from docs (by rank) and starts."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(p) for p in pieces], np.int64)
    strings = lengths - LENGTH + 1
    which = np.repeat(np.arange(len(pieces)), strings)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = (np.cumsum(lengths) - lengths)[which] + nth
    group = np.repeat(np.arange(len(sizes)), sizes)[which]
    blocks = np.bincount(group, minlength=len(sizes))
    suffixes = Suffixes(data, base)
    order = suffixes.sort(at, blocks)
    far, right = suffixes.shared(order)
    begins = np.cumsum(blocks) - blocks
    far[begins], right[begins] = 0, True
    string_at = np.full(len(data), -1, np.int64)
    string_at[at] = np.arange(len(at))
    met = np.zeros(len(at), bool)
    met[string_at[order]] = True
    for g in np.unique(group[~right | ~met]):  # blocks stand in the order of groups; a collision has spoilt this one
        block = slice(begins[g], begins[g] + blocks[g])
        order[block] = sorted(at[block].tolist(), key=lambda i: data[i : i + LENGTH].tobytes())
        far[block] = suffixes.shared(order[block])[0]
        far[begins[g]] = 0
    s = string_at[order]
    place = doc[which[s]] << 44 | (start[which[s]] + nth[s])
    runs = np.flatnonzero(far < LENGTH)
    first = np.repeat(np.minimum.reduceat(place, runs), np.diff(np.append(runs, len(place))))
    late = s[place > first]
    return which[late], nth[late]


def _sorted(pieces: DataFrame, most: int) -> DataFrame:
    """Stretches (id, tie, start, length) of later strings among ``pieces`` of equal key; strings of groups over ``most`` pieces come out unsorted, with their hash (high, low) and length LENGTH."""
    kind = pieces.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n_strings, id_type = [], 0, None  # whole groups: lists of (id, tie, start, data)
        group, key, large = [], None, False

        def batch_of(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["id", "tie", "start", "length", "high", "low"])

        def dealt_out():
            for doc_id, tie, start, data in group:
                hashes = [xxhash.xxh128_intdigest(data[i : i + LENGTH]) for i in range(len(data) - LENGTH + 1)]
                yield batch_of([(doc_id, tie, start + i, LENGTH, _signed(h >> 64), _signed(h & (1 << 64) - 1)) for i, h in enumerate(hashes)])

        def sort():
            rows = [r for g in waiting for r in g]
            doc = _order_of([r[:2] for r in rows])
            start = np.array([r[2] for r in rows], np.int64)
            piece, nth = later_strings([r[3] for r in rows], [len(g) for g in waiting], doc, start)
            if len(piece):
                piece, begin, end = merged(piece, nth, nth + LENGTH)
                yield batch_of([(*rows[p][:2], int(start[p] + b), int(e - b), None, None) for p, b, e in zip(piece.tolist(), begin.tolist(), end.tolist(), strict=True)])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "tie", "start", "data")), strict=True):
                if k != key:
                    if large:
                        yield from dealt_out()
                    elif len(group) > 1:
                        waiting.append(group)
                        n_strings += sum(len(r[3]) - LENGTH + 1 for r in group)
                        if n_strings >= SORTED:
                            yield from sort()
                            waiting, n_strings = [], 0
                    group, key, large = [], k, False
                group.append(tuple(row))
                if len(group) > most:
                    yield from dealt_out()
                    group, large = [], True
        if large:
            yield from dealt_out()
        elif len(group) > 1:
            waiting.append(group)
        if waiting:
            yield from sort()

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"id {kind}, tie long, start long, length long, high long, low long")


def later_stretches(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(id, tie, start, length) of all bytes of ``docs`` (id, tie, data) that go; stretches may overlap."""
    first = cut(_firsts(_anchored(docs)), ROWS)
    asked = first.filter(F.col("anchor").isNotNull())
    found = first.filter(F.col("anchor").isNull()).select("id", "tie", "start", "length")
    sorted_ = cut(_sorted(_pieces(_packed(docs), asked), group), ROWS)
    found = found.unionByName(sorted_.filter("high is null").select("id", "tie", "start", "length"))
    strings = sorted_.filter("high is not null")
    if strings.isEmpty():
        return found
    one_by_one = strings.select("id", "tie", F.col("high").alias("anchor"), F.col("low").alias("whole"), F.shiftleft("start", 14).alias("packed"), F.lit(None).cast("long").alias("length"))
    return found.unionByName(_firsts(one_by_one).filter(F.col("anchor").isNull()).select("id", "tie", "start", "length"))


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` (id, tie, data) with data compressed for a shuffle: id, tie, packed."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor().compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), pa.array([pack(d) for d in batch.column("data").to_pylist()], pa.binary())], ["id", "tie", "packed"])

    return docs.mapInArrow(run, f"id {kind}, tie long, packed binary")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: id_col, n_bytes, spans (start, end) of the runs of bytes that go, kept (binary): the other bytes.

    Null texts count as empty ones. Ids count in ascending order, null last;
    rows of one id in the order of a 64-bit hash of their texts, by which they
    are told apart; of rows that repeat both, one is the first and the others
    are later copies of it. Texts under LENGTH bytes stay whole. An empty table
    gives an empty one; other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = few_rows(docs).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("data"))
    stretches = later_stretches(rows, group)
    per = stretches.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "length")).alias("gone"))  # fewer than a text has bytes
    joined = _packed(rows).join(per.withColumnsRenamed({"id": "of_id", "tie": "of_tie"}), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("tie") == F.col("of_tie")), "left")
    again = F.lit(False)
    if not rows.groupBy("id", "tie").count().filter("count > 1").isEmpty():
        again = F.row_number().over(Window.partitionBy("id", "tie").orderBy(F.lit(1))) > 1
    kind = rows.schema["id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for packed, gone, copy in zip(*(batch.column(c).to_pylist() for c in ("packed", "gone", "again")), strict=True):
                data = zstandard.ZstdDecompressor().decompress(packed)
                begin, end = (np.array([s[c] for s in gone or []], np.int64) for c in ("start", "length"))
                _, begin, end = merged(np.zeros(len(begin), np.int64), begin, begin + end)
                mine = [(0, len(data))] if copy and len(data) >= LENGTH else list(zip(begin.tolist(), end.tolist(), strict=True))
                edges = [0, *[e for span in mine for e in span], len(data)]
                sizes.append(len(data))
                spans.append([{"start": b, "end": e} for b, e in mine])
                kept.append(b"".join(data[b:e] for b, e in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    done = joined.select("id", "packed", "gone", again.alias("again")).mapInArrow(run, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return done.withColumnRenamed("id", id_col)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
