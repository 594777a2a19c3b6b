"""Fill-in-middle, vector codes and suffix dedup against brute force and odd tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import fill_in_middle as fim
from lexiflow.llm import suffix_dedup as sd
from lexiflow.llm import vector_codes as vc

ODD = [
    (1, "one two three four five six", "en"),
    (1, "one two three four five six", "en"),
    (2, None, None),
    (2, "", "en"),
    (None, "text without an id <P> mark", "fr"),
    (None, None, "fr"),
    (3, "é ü ퟿\n\t  tabs\r\n  " + "long " * 3000, "de"),
    (4, "ONE Two \U0001f600 THREE four <S five M> six", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, 7, 7) for r in ODD], "doc_id long, text string, lang string, id long, n long, tie long")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def sha(b):
    return hashlib.sha256(b).hexdigest()


# 11


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha(f"1:{'' if doc_id is None else doc_id}".encode())
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    form = "plain" if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return (doc_id, len(units), form, *sizes, sha(out.encode()), sha(text.encode())), out


def test_fim_equals_brute_force(spark, sf, docs):
    rows = fim.op11_fill_in_middle(spark, sf)
    got = {r.doc_id: tuple(r) for r in rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()}
    want = {r.doc_id: brute_fim(r.doc_id, r.text)[0] for r in docs.select("doc_id", "text").collect()}
    assert got == want and {v[2] for v in want.values()} == {"plain", "psm", "spm"}


def test_fim_of_odd_tables(spark, odd):
    rows = fim.with_digests(fim.planned(fim.framed(odd)))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, rows.collect()), key=str) == sorted((brute_fim(i, t)[0] for i, t, _ in ODD), key=str)
    texts = fim.fill_in_middle(odd).collect()
    assert sorted((r.output for r in texts)) == sorted(brute_fim(i, t)[1] for i, t, _ in ODD) and key(texts[0])
    assert fim.fill_in_middle(odd.limit(0)).count() == 0


def test_frames_cut_anywhere():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice("aB zé\n<>PSM\U0001f600") for _ in range(rng.randrange(1, 50)))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        n, frames = fim.frames_of(text, rng.choice([1, 2, 7, 50]), rng.choice([1, 3, 10, 100]))
        assert n == len(units)
        cuts = [fim.cut_at(frames, u) for u in range(n + 1)]
        assert [c[2] for c in cuts] == [len("".join(units[:u])) for u in range(n + 1)]
        if any(m in text for m in fim.MARKS):
            continue
        one, two = sorted(rng.choices(cuts, k=2), key=lambda c: c[2])
        for form in fim.ORDERS:
            raw, k = b"".join(fim.output(frames, form, one, two)), rng.randrange(1, 5)
            torn = [raw[i : i + k] for i in range(0, len(raw), k)]
            assert b"".join(fim.restored(torn, form)).decode() == text


def test_a_cut_opens_one_frame(monkeypatch):
    _, frames = fim.frames_of("word " * 5000, 100)
    opened, real = [], fim.opened
    monkeypatch.setattr(fim, "opened", lambda f: opened.append(f) or real(f))
    fim.cut_at(frames, 4321)
    assert len(opened) == 1


# 12


def brute_codes(rows):
    kept = sorted(((i, l, [int(np.floor(256 * float(x))) for x in v]) for i, v, l in rows if v and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(kept[0][2]) // 16
    x = np.array([r[2] for r in kept], dtype=object).reshape(len(kept), 16, d)
    entries = x[:64].copy().transpose(1, 0, 2)

    def assigned():
        far = ((x[:, :, None, :] - entries[None]) ** 2).sum(-1)
        return far.argmin(-1), far.min(-1).sum(-1)

    for _ in range(2):
        codes, _ = assigned()
        for p in range(16):
            for k in range(entries.shape[1]):
                mine = codes[:, p] == k
                if mine.any():
                    entries[p, k] = [int(s) // int(mine.sum()) for s in x[mine, p].sum(0)]
    codes, errors = assigned()
    errors = [min(int(e), vc.MOST) for e in errors]
    of_label = {}
    for r, e in zip(kept, errors, strict=True):
        of_label[r[1]] = of_label.get(r[1], 0) + e
    digest = sha(",".join(str(v) for v in entries.ravel()).encode())
    return sorted(((r[0], "".join(f"{c:02x}" for c in cs), e, min(of_label[r[1]], vc.MOST), digest) for r, cs, e in zip(kept, codes, errors, strict=True)), key=str)


def codes_of(rows, books):
    done = vc.with_label_errors(rows)
    return sorted((tuple(r) for r in done.select("vec_id", F.lower(F.hex("code")), "error", "label_error", F.lit(vc.digest(books))).collect()), key=str)


def test_codes_equal_brute_force(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = [tuple(r) for r in vc.op12_ball_codes(spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got, key=str) == brute_codes([tuple(r) for r in vectors.select("vec_id", "embedding", "label").collect()])


def test_codes_of_odd_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-3, 4)) / 256 + (i % 3) for _ in range(32)], rng.choice([1, 2, None])) for i in range(150)]
    rows += [(7, rows[7][1], 1), (None, rows[8][1], None), (200, None, 1), (201, [0.5] * 31 + [None], 1), (202, [float("nan")] * 32, 2), (203, [float("inf")] * 32, 2)]
    rows += [(204, [3e38] * 32, 2), (205, [-3e38, 1e9] * 16, None), (206, [-1e-9] * 32, 2)]
    kind = "vec_id long, embedding array<float>, label int, id long, v int, code string"
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], kind).withColumn("embedding", F.col("embedding").cast("array<float>"))
    exact = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    assert codes_of(*vc.compress(frame)) == brute_codes(exact)
    other = frame.union(spark.createDataFrame([(999, [1.0] * 16, 1, 1, 2, "x"), (998, [], 1, 1, 2, "x")], kind))
    assert codes_of(*vc.compress(other)) == brute_codes(exact)  # vectors of other lengths go
    few = frame.filter("vec_id < 5")
    assert codes_of(*vc.compress(few)) == brute_codes([r for r in exact if r[0] is not None and r[0] < 5])
    assert codes_of(*vc.compress(frame.limit(0))) == []


def test_balls_compare_less_and_equal_all():
    rng = np.random.default_rng(1)
    entries = rng.integers(-500, 500, (64, 4))
    x = entries[rng.integers(0, 64, 4000)] + rng.integers(-90, 90, (4000, 4))
    own, _ = vc.nearest_of_all(x, entries)
    moved = entries + rng.integers(-20, 20, entries.shape)
    best, far = vc.nearest_of_all(x, moved)
    got, dist, compared = vc.nearest_by_balls(x, own, moved)
    assert (got == best).all() and (dist == far).all() and compared < 0.25 * x.shape[0] * 63
    tied = np.array([[0], [2], [2], [0]])
    assert vc.nearest_by_balls(np.array([[1], [2]]), np.array([3, 2]), tied)[0].tolist() == [0, 1]  # ties to the lower index


# 13


def brute_repeats(rows):
    seen, out = set(), []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for doc_id, text in order:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - sd.LENGTH + 1):
            if b[j : j + sd.LENGTH] in seen:
                gone[j : j + sd.LENGTH] = b"\1" * sd.LENGTH
            else:
                seen.add(b[j : j + sd.LENGTH])
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((doc_id, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return sorted(out, key=str)


def repeats_of(docs, **options):
    rows = sd.cut_repeats(docs, **options)
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), sha(bytes(r.kept))) for r in rows.collect()), key=str)


def test_repeats_equal_brute_force(spark, sf, docs):
    got = [tuple(r) for r in sd.op13_suffix_dedup(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute_repeats([tuple(r) for r in docs.select("doc_id", "text").collect()])


def planted():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [text(rng.randrange(0, 30)), rng.choice(passages), text(rng.randrange(0, 9)), rng.choice(passages)[rng.randrange(0, 90) :]]
        rng.shuffle(parts)
        rows.append((i, "".join(parts[: rng.randrange(1, 5)])))
    rows += [(500, "x" * 2500), (501, "x" * 99), (502, "x" * 100), (503, None), (504, ""), (505, "ab" * 700), (None, passages[0] + "!"), (506, text(30) + rows[0][1] * 3)]
    return rows


def test_planted_passages_by_small_batches_and_groups(spark):
    rows = planted()
    frame = spark.createDataFrame([(*r, 1, "a", 2) for r in rows], "doc_id long, text string, tie long, key string, data int").repartition(7, "doc_id")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        want = brute_repeats(rows)
        assert repeats_of(frame) == want
        assert repeats_of(frame, group=2) == want  # larger groups are dealt out string by string
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_repeats_of_long_texts_and_repeated_rows(spark, odd):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(sd.CHUNK + 3000))
    rows = [(2, long), (1, long[sd.CHUNK - 700 : sd.CHUNK + 900]), (3, "." + long[1000:5000] + ".")]
    assert repeats_of(spark.createDataFrame(rows, "doc_id long, text string")) == brute_repeats(rows)
    twice = [(5, "once upon a time " * 9), (5, "once upon a time " * 9), (None, "z" * 150), (None, "z" * 150), (6, "short"), (6, "short")]
    assert repeats_of(spark.createDataFrame(twice, "doc_id long, text string")) == brute_repeats(twice)
    assert repeats_of(odd.limit(0)) == []
    assert repeats_of(odd) == brute_repeats([(r[0], r[1]) for r in ODD])
    named = spark.createDataFrame([("b", "q" * 300), ("a", "q" * 200)], "name string, body string")
    got = {r.name: (r.n_bytes, len(bytes(r.kept))) for r in sd.cut_repeats(named, "name", "body").collect()}
    assert got == {"a": (200, 1), "b": (300, 0)}  # overlaps count


@pytest.mark.parametrize("base", [sd.BASES[0], 1])
def test_suffix_sort_and_collisions(base):
    """Base 1 makes all strings of the same letters collide; the bytes then decide."""
    rng = random.Random(3)
    for t in range(30):
        letters = b"ab" if t % 2 else b"abcdefgh"
        text = bytes(rng.choice(letters) for _ in range(300))
        pieces, sizes = [], []
        for _ in range(rng.randrange(1, 5)):
            sizes.append(rng.randrange(2, 6))
            for _ in range(sizes[-1]):
                a = rng.randrange(150)
                piece = bytearray(text[a : a + rng.randrange(sd.LENGTH, 140)])
                piece[rng.randrange(len(piece))] = rng.choice(piece)
                pieces.append(bytes(piece))
        doc, start = (np.array([rng.randrange(n) for _ in pieces]) for n in (4, 1000))
        piece, nth = sd.later_strings(pieces, sizes, doc, start, base)
        want, at = set(), 0
        for n in sizes:
            seen = {}
            for p in range(at, at + n):
                for j in range(len(pieces[p]) - sd.LENGTH + 1):
                    seen.setdefault(pieces[p][j : j + sd.LENGTH], []).append(((doc[p], start[p] + j), p, j))
            want |= {(p, j) for same in seen.values() for place, p, j in same if place > min(same)[0]}
            at += n
        assert set(zip(piece.tolist(), nth.tolist(), strict=True)) == want
