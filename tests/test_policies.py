"""Credits of families under policies, against brute force."""

import random
from collections import defaultdict

import pytest

from lexiflow.operators import policies
from tests.test_networks import largest


def test_policies_equal_brute_force(spark):
    rng = random.Random(12)
    words, routes = {}, []
    for f in ("f", "g"):
        names = [f"{f}{i}" for i in range(6)]
        for w in names:
            n = rng.choice([0, rng.randrange(1, 9)]), rng.choice([0, rng.randrange(1, 9)])
            words[f, w] = (n[0] * 1.5, n[1] * 1.25, *n)
        routes += [(f, a, b, rng.random() < 0.6, rng.random() < 0.5) for a in names for b in names if a != b and rng.random() < 0.35]
    W = spark.createDataFrame([(*k, *v) for k, v in words.items()], "family string, word string, a double, b double, n_a long, n_b long")
    R = spark.createDataFrame(routes, "family string, source string, target string, exchange boolean, after_o boolean")
    credits, into = policies.solve(W, R)
    got = {(r.policy, r.basis, r.family): r for r in credits.collect()}
    assert len(got) == 5 * 2 * 2
    for (policy, basis, family), r in got.items():
        which, common = policies.POLICIES[policy]
        mine = {w: v for (f, w), v in words.items() if f == family}
        same = sum(min(v[0], v[1]) for v in mine.values())
        signed = basis == "signed"
        cap = defaultdict(float)
        for w, (a, b, *_) in mine.items():
            cap["S", "e" + w] = max(a - b, 0) if signed else a
            cap["h" + w, "T"] = max(b - a, 0) if signed else b
            if not signed:
                cap["e" + w, "h" + w] = min(a, b)
        for f, s, t, exchange, after in routes:
            fits = not exchange or (which == "all" or which == "after_o" and after) and (not common or min(mine[s][2], mine[t][3]) >= 3) if f == family else False
            if fits:
                cap["e" + s, "h" + t] = 1e9
        want = largest(cap) + (same if signed else 0)
        assert r.credit == pytest.approx(want) and r.identity == pytest.approx(same)
        assert r.unplaced == pytest.approx(sum(v[0] for v in mine.values()) - want)
    diff = {(r.policy, r.basis, r.family): r for r in policies.against_none(credits, into).collect()}
    assert len(diff) == 4 * 2 * 2
    for (policy, basis, family), r in diff.items():
        assert r.gain == pytest.approx(got[policy, basis, family].credit - got["none", basis, family].credit)
        assert r.gross_gain - r.loss == pytest.approx(r.gain) and r.gain >= -1e-9
