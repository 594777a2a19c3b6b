"""Exact tests against sums over all tables in whole numbers."""

import math
import random
from fractions import Fraction

import pytest

from lexiflow.operators import exact


def weights(h, n1, n):
    return {k: math.comb(n1, k) * math.comb(n - n1, h - k) for k in range(max(0, h - n + n1), min(h, n1) + 1)}


def brute(h1, all_tables):
    total, own = sum(all_tables.values()), all_tables[h1]
    near = Fraction(own) * (1 + Fraction(1, 10**9))
    parts = (lambda k, w: w <= near, lambda k, w: k <= h1, lambda k, w: k >= h1)
    return [float(Fraction(sum(w for k, w in all_tables.items() if f(k, w)), total)) for f in parts]


def table(rng, most):
    n = rng.randrange(1, most)
    n1, h = rng.randrange(n + 1), rng.randrange(n + 1)
    return rng.choice(list(weights(h, n1, n))), h, n1, n


def test_fixed_margins(spark):
    rng = random.Random(2)
    rows = [(str(i), *table(rng, 90)) for i in range(60)] + [("all", 4, 4, 9, 9), ("none", 0, 0, 3, 8), ("big", 700, 1500, 9000, 30000), ("twin", 3, 5, 10, 40), ("equal", 2, 6, 10, 20)]
    rows += [("again", *r[1:]) for r in rows[:1]] + [(None, *rows[1][1:])]
    t = spark.createDataFrame(rows, "w string, h1 long, h long, n1 long, n long")
    got = {r.w: (r.p, r.less, r.greater) for r in exact.fixed_margins(t, "w").collect()}
    assert len(got) == len(rows)
    for w, h1, h, n1, n in rows:
        assert got[w] == pytest.approx(brute(h1, weights(h, n1, n)), rel=1e-8), w
    assert exact.fixed_margins(t.limit(0), "w").count() == 0


def test_equal_odds(spark):
    rng = random.Random(3)
    cases = {str(i): [table(rng, 60), table(rng, 80)] for i in range(40)} | {"alone": [(3, 5, 10, 40)], "long": [(500, 900, 4000, 8000), (300, 700, 3000, 9000)]}
    rows = [(w, f"s{i}", *c) for w, cs in cases.items() for i, c in enumerate(cs)]
    t = spark.createDataFrame(rows, "w string, stratum string, h1 long, h long, n1 long, n long")
    got = {r.w: (r.p, r.less, r.greater) for r in exact.equal_odds(t, "w").collect()}
    assert got.pop("alone") == (1, 1, 1) and len(got) == 41
    for w in got:
        (h1, *a), (g1, *b) = cases[w]
        left, right = weights(*a), weights(*b)
        both = {k: v * right[h1 + g1 - k] for k, v in left.items() if h1 + g1 - k in right}
        assert got[w] == pytest.approx(brute(h1, both), rel=1e-8), w


def test_walks_stop_where_weights_vanish():
    h1, h, n1, n = 150_200, 500_000, 3_000_000, 10_000_000
    terms = sum(len(x) for x, _ in exact._walk((h, n1, n), None, 150_000, h))
    assert terms < 60_000  # of 350,000
    p, less, greater = exact._exact(h1, h, n1, n, -1, -1, -1, -1)
    sd = math.sqrt(h * (n1 / n) * (1 - n1 / n) * (n - h) / (n - 1))
    assert greater == pytest.approx(0.5 * math.erfc((h1 - 0.5 - 150_000) / sd / math.sqrt(2)), rel=1e-3)
    assert p == pytest.approx(2 * greater, rel=1e-2) and less + greater > 1
    assert exact._exact(h, h, n1, n, -1, -1, -1, -1)[0] == 0.0  # beyond double precision


def test_shared_enrichment(spark):
    rows = [("en", "u", 4, 5, 10, 40), ("fr", "u", 2, 9, 12, 30), ("en", "v", 1, 3, 10, 40), ("en", "z", 0, 2, 10, 40), ("fr", "z", 0, 2, 0, 30)]
    t = spark.createDataFrame(rows, "lang string, w string, h1 long, h long, n1 long, n long")
    got = {r.w: (r.effect, r.p) for r in exact.shared_enrichment(t, "lang", "w").collect()}
    assert set(got) == {"u", "z"} and got["z"] == (None, None)
    gaps = (4 / 10 - 1 / 30, 2 / 12 - 7 / 18)
    assert got["u"] == pytest.approx((min(gaps), max(brute(4, weights(5, 10, 40))[2], brute(2, weights(9, 12, 30))[2])))
