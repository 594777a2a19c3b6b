"""Ranks, running sums and maxima over many tasks, against plain Python."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import contexts, ranks, units


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(9), i, rng.randrange(50)) for i in range(600)]


def test_numbers_and_running_values(spark, rows):
    frame = spark.createDataFrame(rows, "g string, x int, id int, v int").repartition(5)
    order = [F.col("x").desc(), F.col("id").asc()]
    place = {r.id: r.k for r in ranks.numbered(frame, order, "g", name="k").collect()}
    total = {r.id: r.t for r in ranks.running(frame, F.col("v"), order, "g", name="t").collect()}
    most = {r.id: r.t for r in ranks.running(frame, F.col("v"), order, "g", name="t", largest=True).collect()}
    for g in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [place[r[2]] for r in mine] == list(range(1, len(mine) + 1))
        assert [total[r[2]] for r in mine] == list(accumulate(r[3] for r in mine))
        assert [most[r[2]] for r in mine] == list(accumulate((r[3] for r in mine), max))
    assert ranks.numbered(frame.limit(0), order, "g").count() == 0


def test_holm_and_spearman_of_many_rows(spark, rows):
    rng = random.Random(8)
    ps = [(f"w{i:03d}", round(rng.random() ** 3, 3) if i % 17 else None) for i in range(300)]
    got = {r.w: r.adjusted for r in contexts.holm(spark.createDataFrame(ps, "w string, p double").repartition(4), "p", "w").collect()}
    most = 0.0
    for k, (w, p) in enumerate(sorted(ps, key=lambda r: (1.0 if r[1] is None else r[1], r[0]))):
        most = max(most, min(1.0, (1.0 if p is None else p) * (len(ps) - k)))
        assert got[w] is None if p is None else got[w] == pytest.approx(most)
    frame = spark.createDataFrame([(g or "c", x, v) for g, x, _, v in rows], "g string, x int, v int")
    found = {r.g: r for r in units.correlations(frame, "x", "v", "g").collect()}
    for g, r in found.items():
        mine = [(x, v) for h, x, v in frame.collect() if h == g]
        rank = lambda i, mine=mine: [sum(y[i] < z[i] for y in mine) + (sum(y[i] == z[i] for y in mine) + 1) / 2 for z in mine]
        a, b = rank(0), rank(1)
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        want = sum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True)) / (sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b)) ** 0.5
        assert r.spearman == pytest.approx(want)
