"""Contrasts of two populations against plain Python."""

import math
import random

import pytest

from lexiflow.operators import contexts


def brute(rows, weights, cls):
    parts = range(len(weights))
    n = [sum(p == i for _, _, p in rows) for i in parts]
    if not all(n):
        return None, None
    t = [sum(p == i and c == cls for _, c, p in rows) for i in parts]
    sheets = {s for s, _, _ in rows}
    total = 0.0
    for s in sheets:
        mine = [(c, p) for x, c, p in rows if x == s]
        total += sum(weights[i] * (sum(p == i and c == cls for c, p in mine) - t[i] / n[i] * sum(p == i for _, p in mine)) / n[i] for i in parts) ** 2
    size, g = len(rows), len(sheets)
    return sum(w * t[i] / n[i] for i, w in enumerate(weights)), math.sqrt(total * g / (g - 1) * (size - 1) / (size - len(weights)))


@pytest.mark.parametrize("weights", [(-1, 1), (-1, 1, 1, -1)])
def test_weighted_contrast(spark, weights):
    rng = random.Random(len(weights))
    rows = [(rng.randrange(9), rng.choice("aaabbc" if i % 3 else "ad"), rng.randrange(len(weights))) for i in range(300)] + [(50, "only", 0)]
    schema = "sheet long, class string, part int"
    got = {r["class"]: r for r in contexts.weighted_contrast(spark.createDataFrame(rows, schema).repartition(3), weights).collect()}
    assert set(got) == {c for _, c, _ in rows}
    for c, r in got.items():
        assert (r.effect, r.se) == pytest.approx(brute(rows, weights, c)), c
        hits = [sum(p == i and k == c for _, k, p in rows) for i in range(len(weights))]
        assert r.df == min(len({s for s, _, p in rows if p == i}) for i in range(len(weights))) - 1 and r.supported == (min(hits) >= 5)
    short = [r for r in rows if r[2]]
    assert {(r.effect, r.se, r.supported) for r in contexts.weighted_contrast(spark.createDataFrame(short, schema), weights).collect()} == {(None, None, False)}
    assert contexts.weighted_contrast(spark.createDataFrame([], schema), weights).count() == 0


def test_review(spark):
    counts = {"up": (40, 10, 30, 20), "down": (0, 60, 1, 60), "new": (0, 0, 5, 0), "even": (60, 30, 64, 20)}
    rows = [(c, i) for c, ns in counts.items() for i, n in enumerate(ns) for _ in range(n)]
    got = {(r["class"], r.kind): r for r in contexts.review(spark.createDataFrame(rows, "class string, part int")).collect()}
    n = [sum(ns[i] for ns in counts.values()) for i in range(4)]
    for c, h in counts.items():
        a, b, fa, fb = (h[0] + h[1]) / (n[0] + n[1]), (h[2] + h[3]) / (n[2] + n[3]), h[0] / n[0], h[2] / n[2]
        assert got[c, "section"].effect == pytest.approx(b - a) and got[c, "selection"].effect == pytest.approx(fb - b - fa + a) and got[c, "shared"].effect == pytest.approx(min(fa - a, fb - b))
    assert got["up", "shared"].flagged and not got["down", "shared"].flagged and not got["even", "section"].flagged
    assert got["new", "section"].lift == math.inf and got["new", "section"].flagged
    one = {r.kind: (r.effect, r.lift, r.flagged) for r in contexts.review(spark.createDataFrame([("x", 0), ("x", 1)], "class string, part int")).collect()}
    assert one == dict.fromkeys(("section", "selection", "shared"), (None, None, False))
