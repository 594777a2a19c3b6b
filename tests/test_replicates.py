"""Shuffled line orders, dealt pages and histograms of round width, against plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import copying, units


def digest(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def spread(by_run):
    drawn = sorted(v for r, v in by_run.items() if r)
    at = lambda q: drawn[math.floor(q * (len(drawn) - 1) + 0.5)]
    return by_run[0], sum(drawn) / len(drawn), at(0.025), at(0.975), (1 + sum(v >= by_run[0] for v in drawn)) / (1 + len(drawn))


def test_order_control(spark):
    rng, runs = random.Random(6), 12
    rows = [(p, rng.choice("fg"), rng.choice(["u", "w"]), rng.random() < 0.4, rng.randrange(0, 40), i, "s" if p < 4 else None) for p in range(7) for i in range(25)]
    e = spark.createDataFrame(rows, "page long, family string, word string, new boolean, line long, idx int, stage string")
    got = {(r.stage, r.scope): r for r in copying.order_control(e, runs, "stage").collect()}
    counts = defaultdict(Counter)
    for run in range(runs + 1):
        moved = []
        for p in range(7):
            lines = sorted({r[4] for r in rows if r[0] == p})
            order = sorted(lines, key=lambda x: digest(run, p, x)) if run else lines  # noqa: B023
            to = dict(zip(order, lines, strict=True))
            moved += [(*r[:4], to[r[4]], *r[5:]) for r in rows if r[0] == p]
        for t in moved:
            gaps = [t[4] - s[4] for s in moved if s[0] == t[0] and s[1] == t[1] and s[3] != t[3] and s[4] < t[4]]
            for scope, most in (("page_donors", 999), ("local3", 3), ("local10", 10)):
                counts[t[6], scope][run] += any(g <= most for g in gaps)
    assert set(got) == set(counts)
    for key, by_run in counts.items():
        r = got[key]
        assert (r.observed, r.mean, r.low, r.high, r.p) == pytest.approx(spread({i: by_run[i] for i in range(runs + 1)}))
        assert r.targets == (100 if key[0] else 75)


def test_replicates(spark):
    rng = random.Random(7)
    rows = [(p, rng.choice([1, 2, 2, None]), rng.randrange(1, 9), rng.randrange(0, 2)) for p in range(50)]
    pages = spark.createDataFrame(rows, "page long, stage int, n long, k long").repartition(3)
    got = {(r.run, r.stage): (r.n, r.k) for r in copying.replicates(pages, 5).collect()}
    slots = [r[1] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]
    for run in range(6):
        order = sorted(rows, key=lambda r: digest(run, r[0])) if run else sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))  # noqa: B023
        want = defaultdict(lambda: [0, 0])
        for stage, (_, _, n, k) in zip(slots, order, strict=True):
            want[stage][0] += n
            want[stage][1] += k
        assert {s: tuple(v) for s, v in want.items()} == {s: v for (r, s), v in got.items() if r == run}
    assert got[0, 1] == tuple(sum(r[i] for r in rows if r[1] == 1) for i in (2, 3))
    assert copying.replicates(pages.limit(0), 2).count() == 0


def nice(raw):
    scale = 10.0 ** math.floor(math.log10(raw))
    return next(s * scale for s in (1, 2, 2.5, 5, 10) if raw <= s * scale * (1 + 1e-9))


def bins_of(values, want=None, whole=False, clip=True):
    nz = sorted(v for _, v in values if v > 0)
    at = lambda xs, q: xs[math.floor(q * (len(xs) - 1) + 0.5)]
    upper = nz[-1]
    if clip and len(nz) >= 20:
        upper = at(nz, 0.95)
    elif clip and len(nz) >= 5:
        upper = min(upper, at(nz, 0.75) + 3 * (at(nz, 0.75) - at(nz, 0.25)))
    held = [v for v in nz if v <= upper]
    fd = 2 * (at(held, 0.75) - at(held, 0.25)) / len(held) ** (1 / 3)
    k = want or min(48, max(6, math.floor((upper / fd if fd > 0 else math.log2(len(held)) + 1) + 0.5)))
    width = nice(upper / k)
    width = max(1, math.ceil(width)) if whole else width
    top = math.ceil((upper - 1e-12) / width) * width
    return Counter((g, 0 if v == 0 else -1 if v > top + 1e-12 else math.ceil((v - 1e-12) / width)) for g, v in values)


@pytest.mark.parametrize("n,kind", [(400, "whole"), (400, "real"), (12, "far"), (12, "near"), (3, "real"), (60, "same")])
def test_round_histogram(spark, n, kind):
    rng = random.Random(n)
    draw = {"whole": lambda: float(rng.choice([0, 0, 1, 2, 3, 5, 8, 90])), "real": lambda: rng.expovariate(0.01), "far": lambda: rng.uniform(4, 6), "near": lambda: rng.uniform(1, 9), "same": lambda: 2.5}[kind]
    values = [(rng.choice(["a", "b", None]), draw()) for _ in range(n)] + ([("a", 500.0)] if kind == "far" else [])
    frame = spark.createDataFrame([*values, ("a", None)], "g string, v double").repartition(3)
    for options in ({}, {"want": 9}, {"clip": False}, {"whole": True}):
        given = {("bins" if k == "want" else k): v for k, v in options.items()}
        out = units.round_histogram(frame, "v", "g", **given).collect()
        assert {(r.g, r.bin): r.n for r in out} == bins_of(values, **options), options
        assert all(r.hi > r.lo if r.bin else r.lo == r.hi == 0 for r in out)
    if kind == "far":
        assert any(r.bin == -1 and r.hi == 500.0 for r in units.round_histogram(frame, "v", "g").collect())


def test_statistics_and_ranks(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(1, 30), 3, rng.randrange(6)) for i in range(101)]
    frame = spark.createDataFrame(rows, "g string, unit long, tokens long, lines long, m long").repartition(3)
    got = {(r.is_total, r.g): r for r in units.statistics(frame, "g", "unit", "m").collect()}
    for key in [(0, "a"), (0, "b"), (0, None), (1, None)]:
        mine = [r for r in rows if key[0] or r[0] == key[1]]
        ms = sorted(r[4] for r in mine)
        r = got[key]
        assert r.median == (ms[(len(ms) - 1) // 2] + ms[len(ms) // 2]) / 2 and r.units == len(mine) and r.matches == sum(ms)
        assert r.best == max(mine, key=lambda x: (x[4], -x[1]))[1] and r.with_match == sum(m > 0 for m in ms) and r.tokens == sum(x[2] for x in mine)
        assert r.share == pytest.approx(sum(ms) / sum(x[4] for x in rows))
    ranks = {r.g: r.value for r in units.nearest_rank(frame, "m", 0.9, "g").collect()}
    for g in ("a", "b", None):
        ms = sorted(r[4] for r in rows if r[0] == g)
        assert ranks[g] == ms[math.floor(0.9 * (len(ms) - 1) + 0.5)]
    empty = frame.filter(F.lit(False))
    assert units.nearest_rank(empty, "m", 0.5, "g").count() == units.round_histogram(empty.withColumn("v", F.col("m") * 1.0), "v", "g").count() == 0


def test_order_control_shuffles_events_once(spark):
    """The runs are made after the shuffle by page: nothing is joined, so nothing of their number is broadcast."""
    e = spark.range(200).selectExpr("id % 9 as page", "'f' as family", "'w' as word", "id % 3 = 0 as new", "id % 20 as line", "0 as idx", "'s' as stage")
    plan = copying.order_control(e, 40, "stage")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan
