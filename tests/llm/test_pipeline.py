"""The pipeline's stages on a small table, each against a brute-force version of it."""

import pytest

pytest.importorskip("corpus_pipeline")
from collections import Counter

from tests.llm.test_operators import WORDS, brute_similar, brute_stats


def test_stages(spark, sf, tmp_path):
    import corpus_pipeline
    from lexiflow.llm import mixing

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, sf).write.parquet(out)
        after_df = spark.read.parquet(out)
        after = after_df.collect()
        ids = sorted(r.doc_id for r in after)
        if name != "byte bpe":
            assert sorted(after_df.columns) == sorted(columns)
        if name == "quality rules":
            for r in before:
                n, _, _, _, repeat = brute_stats(r.text)
                if n < 20 or 100 * repeat > 30 * n:
                    assert r.doc_id not in ids
            assert len(ids) > 0.6 * len(before)
        elif name == "exact dedup":
            best = {}
            for r in before:
                best[r.text] = max(best.get(r.text, -1), r.doc_id)
            assert ids == sorted(best.values())
        elif name == "simhash near-dedup":
            assert ids == sorted({*brute_similar([(r.doc_id, r.text) for r in before]).values()})
        elif name == "mixing":
            target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
            size, words = {r.doc_id: len(WORDS.findall(r.text or "")) for r in before}, Counter()
            for r in after:
                words[r.source] += size[r.doc_id]
            largest = {s: max(size[r.doc_id] for r in before if r.source == s) for s in target}
            assert all(abs(words[s] - t) <= largest[s] + 1 for s, t in target.items())
            assert max(Counter(ids).values()) <= 3
        else:
            assert ids == sorted(r.doc_id for r in before) and all(r.n_tokens == len(r.ids) for r in after)
        docs, before = after_df, after


ODD = [(1, "a b c d e f " * 9, "en", "s1"), (1, "x y z " * 30, "en", "s1"), (None, "m n o p " * 25, "en", "s1"), (None, "m n o p " * 25, "en", "s1"), (None, "q r " * 40, None, None), (2, None, "en", "s2"), (3, "", "fr", "s2"), (4, "long " * 5000 + "end", "fr", "s2"), (None, None, None, None)]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_and_empty_tables(spark, sf, k):
    """Nulls in every column, repeated ids and rows, empty and long texts, and columns with names that stages use inside."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    frame = spark.createDataFrame([(*r, 100 + i % 2, 5, "k", 1) for i, r in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long, taken int, taken_id string, key int")
    out = stage(spark, frame, sf)
    rows = out.collect()
    assert stage(spark, frame.limit(0), sf).count() == 0
    if name == "byte bpe":
        assert len(rows) == len(ODD) and sum(r.n_tokens == 0 for r in rows) == 3
        return
    assert out.columns == frame.columns
    known = set(map(tuple, frame.collect()))
    assert {tuple(r) for r in rows} <= known
    texts = Counter(r.text or "" for r in rows)
    if name == "exact dedup":
        assert texts == Counter({r[1] or "": 1 for r in ODD})


def test_the_mix_keeps_its_law_without_ids(spark):
    """Half of the rows have no id; every source's words come near its target all the same."""
    import corpus_pipeline
    from lexiflow.llm import mixing

    rows = [(i if i % 2 else None, "w " * (20 + i * 7 % 90), "en", f"s{i % 3}", i) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    target = {r.source: r.target for r in mixing.mix(frame).select("source", "target").distinct().collect()}
    out = corpus_pipeline.mixing_stage(spark, frame, "").collect()
    words, copies = Counter(), Counter(tuple(r) for r in out)
    for r in out:
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - t) <= 110 for s, t in target.items()) and max(copies.values()) <= 3
    same = spark.createDataFrame([(None, "a b c d", "en", "s", 1)] * 40 + [(7, "a b", "en", "t", 1)], frame.schema)
    taken = Counter(r.source for r in corpus_pipeline.mixing_stage(spark, same, "").collect())
    assert abs(taken["s"] * 4 - next(r.target for r in mixing.mix(same).filter("source = 's'").collect())) <= 4
