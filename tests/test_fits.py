"""Many fits at once against a grid of fractions, and their scores against plain Python."""

import itertools
from collections import defaultdict

import pytest

from lexiflow.operators import fit

A = {("s", "body", "walked"): 40, ("s", "body", "talked"): 20, ("s", "body", "red"): 40, ("s", "first", "walked"): 10, ("s", "first", "ring"): 10, ("t", "body", "walked"): 30, ("t", "body", "other"): 30, ("t", "first", "talked"): 10}
B = {("s", "body", "walking"): 25, ("s", "body", "walked"): 15, ("s", "body", "talking"): 4, ("s", "body", "talked"): 16, ("s", "body", "red"): 40, ("s", "first", "walking"): 10, ("s", "first", "walked"): 10, ("t", "body", "walked"): 30, ("t", "body", "other"): 10, ("t", "body", "walking"): 5, ("t", "first", "talking"): 9, ("t", "first", "talked"): 1}
HITS = [("x", "walked", "ED", "w", "walking"), ("x", "talked", "ED", "t", "talking"), ("x", "red", "ED", "other", "ring"), ("y", "walked", "ED", "w", "walking"), ("y", "walked", "W2", "w", "other"), ("y", "walked", "W2", "w", "walking")]


def rates(counts):
    total = defaultdict(int)
    for (s, c, _), n in counts.items():
        total[s, c] += n
    return {(s, c, w): 1e4 * n / total[s, c] for (s, c, w), n in counts.items()}


def moved(split, rules, theta):
    """Rates of A after each hit moves its cell's fraction."""
    a = defaultdict(float, {k: v for k, v in rates(A).items() if k[0] == split})
    outs = defaultdict(set)
    for r, w, rule, front, dst in HITS:
        if r == rules:
            outs[w, rule, front].add(dst)
    for (s, c, w), rate in rates(A).items():
        mine = [(theta.get(f"{rule}|{front}", theta.get(f"{rule}|other", 0.0)), ds) for (x, rule, front), ds in outs.items() if x == w and s == split]
        scale = 1 / max(1.0, sum(t for t, _ in mine))
        for t, ds in mine:
            a[s, c, w] -= rate * t * scale
            for d in ds:
                a[s, c, d] += rate * t * scale / len(ds)
    return a


def overlap(split, rules, theta):
    a, b = moved(split, rules, theta), rates(B)
    return sum(0.5 * min(v, b.get(k, 0.0)) for k, v in a.items())


def test_all_fits_reach_the_best_of_a_grid(spark):
    frame = lambda counts: spark.createDataFrame([(*k, n, rates(counts)[k]) for k, n in counts.items()], "split string, cls string, word string, n long, rate double")
    hits = spark.createDataFrame(HITS, "rules string, word string, rule string, front string, dst string")
    theta, _ = fit.fit_many(frame(A), frame(B), hits, support=5)
    got = defaultdict(dict)
    for r in theta.collect():
        got[r.split, r.rules][r.cell] = r.theta
    assert set(got) == {(s, r) for s in "st" for r in "xy"}
    assert set(got["s", "x"]) == {"ED|w", "ED|t", "ED|other"} and set(got["s", "y"]) == {"ED|w", "W2|w"}
    scores = {(r.split, r.rules): r for r in fit.evaluate_many(frame(A), frame(B), hits, theta).collect()}
    for (split, rules), mine in got.items():
        best = max(overlap(split, rules, dict(zip(mine, point, strict=True))) for point in itertools.product([i / 20 for i in range(21)], repeat=len(mine)) if rules == "x" or sum(point) <= 1)
        start = overlap(split, rules, {})
        assert overlap(split, rules, mine) >= start + 0.95 * (best - start)
        n = defaultdict(lambda: defaultdict(float))
        for side, counts in (("a", A), ("b", B)):
            for (s, c, _), k in counts.items():
                n[side, s][c] += k
        weigh = lambda side, rows: {k: v * n[side, k[0]][k[1]] / sum(n[side, k[0]].values()) for k, v in rows.items()}

        def pooled(rows, side, split=split, weigh=weigh):
            out = defaultdict(float)
            for (s, _, w), v in weigh(side, rows).items():
                if s == split:
                    out[w] += v
            return out

        b = pooled(rates(B), "b")
        for name, rows in (("before", rates(A)), ("after", moved(split, rules, mine))):
            assert scores[split, rules][name] == pytest.approx(sum(min(v, b[w]) for w, v in pooled(rows, "a").items()))
    table = {r.split: r for r in fit.compare_rules(fit.evaluate_many(frame(A), frame(B), hits, theta), "x", "y").collect()}
    assert table["mean"].higher + table["mean"].lower <= 2 and table["mean"].active == pytest.approx((table["s"].active + table["t"].active) / 2)
