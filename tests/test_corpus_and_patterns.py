"""Gap, boundary and q semantics of tokens, and the pattern builder."""

import pytest
from pyspark.sql import functions as F

from lexiflow.functions import words as W
from lexiflow.functions.pattern import glob, literal_word, matcher, places_used, rate_base
from lexiflow.operators import rates
from lexiflow.sources import corpus as C

TEXT = "Chol chol 123 chol daiin\n7 qokey q\nend 99"


@pytest.fixture()
def lines(spark):
    return C.lines(spark.createDataFrame([(8, TEXT), (9, None), (10, "")], "doc_id long, text string"))


def test_tokens_gaps_and_neighbours(lines):
    rows = C.tokens(lines, "prev2", "prev", "next", "prev_label", "next_label").orderBy("page", "locus", "idx").collect()
    got = [(r.locus, r.idx, r.word, r.prev2, r.prev, r.next) for r in rows]
    assert got == [
        (0, 0, "chol", None, None, "chol"),
        (0, 1, "chol", None, "chol", None),
        (0, 3, "chol", None, None, "daiin"),
        (0, 4, "daiin", None, "chol", None),
        (1, 1, "qokey", None, None, "q"),
        (1, 2, "q", None, "qokey", None),
        (2, 0, "end", None, None, None),
    ]
    assert [(r.prev_label, r.next_label) for r in rows][:3] == [("(line boundary)", "chol"), ("chol", "(unreadable)"), ("(unreadable)", "daiin")]
    assert rows[0].first and rows[0].page_first and not rows[4].first


def test_repeat_across_a_gap_is_no_repeat(lines):
    n = {r.word: r.n for r in rates.word_counts(rates.collapsed(C.tokens(lines, "prev"))).collect()}
    assert n["chol"] == 2


def matched(lines, node):
    return {(r.locus, r.idx) for r in C.tokens(lines, hit=matcher(node)).filter("hit").collect()}


def test_patterns(lines):
    assert matched(lines, glob("ch?l")) == {(0, 0), (0, 1), (0, 3)}
    assert matched(lines, glob("*") & ~glob("chol")) == {(0, 4), (1, 1), (1, 2), (2, 0)}
    # a missing neighbour matches no term, so NOT keeps it
    assert matched(lines, glob("chol") & ~glob("chol").at(-1)) == {(0, 0), (0, 3)}
    # an offset does not reach over a gap
    assert matched(lines, glob("*").at(2)) == set()
    assert matched(lines, glob("*").where("lf")) == {(0, 4), (1, 2)}
    assert matched(lines, glob("daiin").at(1).where("lf")) == {(0, 3)}
    assert matched(lines, glob("*").where("!li", "pgi")) == {(0, 1), (0, 3), (0, 4)}


def test_like_escapes(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), ("a_b",)], "word string")
    from lexiflow.functions.pattern import like

    assert [r[0] for r in df.filter(like(F.col("word"), "a%b")).collect()] == ["a%b"]


def test_builder_introspection(lines):
    node = glob("p*").where("pi") & ~glob("*").where("li")
    assert places_used(node) == ["pi", "li"]
    assert str(node) == "[pi]p* AND NOT ([li]*)"
    assert literal_word(glob("chol")) == "chol" and literal_word(glob("ch*")) == ""
    base = C.tokens(lines, base=rate_base(node)).filter("base")
    assert {(r.locus, r.idx) for r in base.collect()} == {(0, 1), (0, 3), (0, 4)}
    assert C.tokens(lines, base=rate_base(~glob("chol").where("li"))).filter("base").count() == 7
    with pytest.raises(ValueError):
        glob("x" * 161)
    with pytest.raises(ValueError):
        glob("x").where("nowhere")


def test_word_functions(spark):
    w = lambda c, *rows: [r[0] for r in spark.createDataFrame([(x,) for x in rows], "word string").select(c).collect()]
    word = F.col("word")
    assert w(W.merged(word), "qokey", "q", "okq") == ["okey", "", "okq"]
    assert w(W.stripped(word), "qokey", "q") == ["okey", "q"]
    assert w(W.edit(word, "contains", "a", "o"), "banana", "x") == ["bonana", None]
    assert w(W.edit(word, "suffix", "ed", "ing"), "ed", "red") == ["ing", "ring"]
    assert w(W.edit(word, "prefix", "re", ""), "red") == ["d"]
    assert w(W.swapped(word), "okal", "ockhtal") == ["otal", "ockhkal"]
    assert w(W.swapped(W.swapped(word)), "ktcthckh") == ["ktcthckh"]
    assert w(W.gallows_class(word), "ckhot", "chol", None) == ["T + cKh", "none", "boundary / unreadable"]
    assert w(W.prev_class(word), "chol", "dal", "y", None) == ["-ol", "-l (other)", "-y", "boundary / unreadable"]
    assert w(W.next_class(word), "cheol", "ckhy", "dal") == ["ch-", "ckh-", "d-"]
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert val(W.balance(F.lit(0.0), F.lit(2.0))) == float("inf") and val(W.balance(F.lit(0.0), F.lit(0.0))) is None
    assert val(W.bounded_residual(F.lit(3.0), F.lit(1.0))) == 0.5
    assert [val(W.nice_step(F.lit(x))) for x in (0.3, 1.0, 2.1, 70.0)] == [0.5, 1.0, 2.5, 100.0]
    assert [val(c) for c in W.folio(F.lit("f12r3"))] == [12, "r", "3"]
    assert [val(c) for c in W.evaluation_key(F.lit("B|fit2_eval1|merged"))] == ["2", "2", "1"]
    assert val(W.tie_weight(F.lit("x"))) == pytest.approx(1 + 1e-3 * int("2d7116", 16) / 16**6)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([('a "b"', "x\ty\nz", 1)], "a string, b string, n int")
    C.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv")).first()
    assert (back.a, back.b) == ('a "b"', "x\ty\nz")
    C.export_tsv(df, str(tmp_path / "tsv"))
    assert spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(str(tmp_path / "tsv")).first().b == "x y z"
    C.export_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().n == 1


def test_bag_holds_the_words_of_tokens(spark):
    from collections import Counter

    from lexiflow.sources import corpus

    texts = ["One two\n\ntwo  ÉTÉ 3 q-z\r\nİx\tΣ", "", None, "\n", "é 1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    columns = ["page", "sheet", "word"]
    want = Counter(map(tuple, corpus.tokens(corpus.lines(docs)).select(*columns).collect()))
    assert Counter(map(tuple, corpus.bag(docs).select(*columns).collect())) == want and sum(want.values()) > 5
