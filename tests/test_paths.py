"""Forks, schedules, ledgers on paths and lineage, against plain Python."""

import random
from collections import defaultdict

import pytest

from lexiflow.operators import paths
from tests.test_networks import largest

LINES = {0: ["c0", "c1", "c2", "c4"], 1: ["c0", "c1", "c3"]}
KNOWN = ["A", "B", "C.via", "D.1", "D.2", "E"]


def table(spark, lines=LINES):
    return spark.createDataFrame([(p, k, c) for p, cs in lines.items() for k, c in enumerate(cs)], "path int, place int, col string")


def all_steps(lines=LINES):
    return sorted({s for cs in lines.values() for s in zip(cs, cs[1:], strict=False)})


def brute_parts(label):
    base, via = label.split(" (via ")[0], " (via " in label
    out = []
    for p in [base] if via else base.split("+"):
        stem = p.split(".")[0]
        out += [p] if p in KNOWN else [p + ".via"] if p + ".via" in KNOWN else [p + ".1", p + ".2"] if p + ".1" in KNOWN else [stem] if stem in KNOWN else [p]
    return out


def brute_degree(labels, cells, step):
    best, clash = 0.0, False
    for label in labels:
        ds = [cells.get((p, *step), 0.0) for p in brute_parts(label)]
        v = 0.0 if not all(ds) or len({d > 0 for d in ds}) > 1 else (1 if ds[0] > 0 else -1) * min(map(abs, ds))
        if abs(v) > abs(best):
            best, clash = v, False
        elif v and abs(v) == abs(best) and v * best < 0:
            clash = True
    return 0.0 if clash else best


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(10)] + ["xdy", "ydy"]
    rate = {(c, w): rng.uniform(1, 9) for c in ("c0", "c1", "c2", "c3", "c4") for w in words if rng.random() < 0.6}
    labels = ["A", "B", "A+B", "C (via z)", "C", "D", "D.1", "E.2", "A+E", "nothing"]
    edges = {(a, b): sorted(rng.sample(labels, rng.randrange(1, 4))) for a in words for b in words if a != b and rng.random() < 0.3}
    cells = {(c, *s): rng.choice([-1.0, -0.5, 0.5, 0.5, 1.0]) for c in KNOWN for s in all_steps() if rng.random() < 0.85}
    return {
        "words": words, "rate": rate, "edges": edges, "cells": cells, "closed": all_steps()[0],
        "rates": spark.createDataFrame([(c, w, v) for (c, w), v in rate.items()], "col string, word string, rate double"),
        "edge_rows": spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "src string, dst string, codes array<string>"),
        "schedule": spark.createDataFrame([(*k, v) for k, v in cells.items()], "code string, i string, j string, degree double"),
    }


def brute_runs(world):
    runs = defaultdict(float)
    for step in all_steps():
        for (a, b), labels in world["edges"].items():
            v = brute_degree(labels, world["cells"], step)
            s, t = (a, b) if v > 0 else (b, a)
            if v and not (step == world["closed"] and "dy" in t and "dy" not in s):
                runs[(*step, s, t)] += abs(v)
    return runs


def test_schedule_turns_and_caps_edges(spark, world):
    closed = spark.createDataFrame([world["closed"]], "i string, j string")
    got = {(r.i, r.j, r.src, r.dst): r.factor for r in paths.scheduled(world["edge_rows"], world["schedule"], KNOWN, closed).collect()}
    want = brute_runs(world)
    assert got.keys() == want.keys() and len(want) > 30 and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_ledgers_on_a_fork(spark, world):
    line, rate, words = table(spark), world["rate"], world["words"]
    closed = spark.createDataFrame([world["closed"]], "i string, j string")
    runs = paths.scheduled(world["edge_rows"], world["schedule"], KNOWN, closed)
    rows, flows = paths.ledgers(paths.step_words(world["rates"], line), world["edge_rows"], runs)
    got = {(r.i, r.j): r for r in paths.totals(rows).collect()}
    want_runs = brute_runs(world)
    for i, j in all_steps():
        out, back = defaultdict(float), defaultdict(float)
        for cs in LINES.values():
            if (i, j) not in zip(cs, cs[1:], strict=False):
                continue
            for w in words:
                at = [k for k, c in enumerate(cs) if (c, w) in rate]
                for left, right in zip(at, at[1:], strict=False):
                    mass = min(rate[cs[left], w], rate[cs[right], w])
                    if right - left > 1 and cs[left] == i:
                        out[w] = max(out[w], mass)
                    if right - left > 1 and cs[right] == j:
                        back[w] = max(back[w], mass)
        a, b = ({w: rate.get((c, w), 0.0) for w in words} for c in (i, j))
        loss = {w: max(a[w] - b[w] - out[w], 0) for w in words}
        gain = {w: max(b[w] - a[w] - back[w], 0) for w in words}
        cap = defaultdict(float, {("S", "e" + w): v for w, v in loss.items()} | {("h" + w, "T"): v for w, v in gain.items()})
        for (x, y, s, t), f in want_runs.items():
            if (x, y) == (i, j):
                cap["e" + s, "h" + t] += f * min(loss[s], gain[t])
        r = got[i, j]
        assert r.routed == pytest.approx(largest(cap), abs=1e-6)
        assert r.kept == pytest.approx(sum(min(a[w], b[w]) for w in words)) and r.dormant_out == pytest.approx(sum(out.values())) and r.dormant_in == pytest.approx(sum(back.values()))
    assert rows.filter("abs(a - kept - sent - unplaced - dormant_out) > 1e-6 and unplaced > 0").isEmpty()
    real = [(r.i, r.j, r.src, r.dst) for r in flows.collect()]
    seeds = spark.createDataFrame([("w1",), ("w2",), ("nowhere",)], "word string")
    reached = defaultdict(set)
    for r in paths.lineage(flows, line, seeds).collect():
        reached[r.seed, r.path, r.direction].add(r.word)
    for seed in ("w1", "w2", "nowhere"):
        for p, cs in LINES.items():
            on = list(zip(cs, cs[1:], strict=False))
            for direction, order, x, y in (("forward", on, 2, 3), ("backward", on[::-1], 3, 2)):
                known = {seed}
                for step in order:
                    known |= {f[y] for f in real if f[:2] == step and f[x] in known}
                assert reached[seed, p, direction] == known


def test_orders_hidden_columns_and_spans(spark):
    cols = spark.createDataFrame([(f"c{k}", k, None if k < 2 else -k, None if k < 3 else k % 2) for k in range(6)], "col string, place int, alt int, arm int")
    as_lists = lambda df: {p: [r.col for r in sorted(df.collect(), key=lambda r: r.place) if r.path == p] for p in {r.path for r in df.collect()}}
    assert as_lists(paths.proposed(cols)) == {0: ["c0", "c1", "c2", "c3", "c4", "c5"]}
    assert as_lists(paths.alternate(cols)) == {0: ["c0", "c1", "c5", "c4", "c3", "c2"]}
    forked = paths.fork(cols)
    assert as_lists(forked) == {0: ["c0", "c1", "c2", "c4"], 1: ["c0", "c1", "c2", "c3", "c5"]}
    hidden = spark.createDataFrame([("c1",), ("c4",)], "col string")
    left = paths.without(forked, hidden)
    assert as_lists(left) == {1: ["c0", "c2", "c3", "c5"]}  # the other arm is gone, its path the beginning of this one
    bridged = {tuple(r) for r in paths.spans(forked, left).collect()}
    assert {(i, j) for i, j, _, _ in bridged} == {("c0", "c2"), ("c2", "c3"), ("c3", "c5")} and ("c0", "c2", "c1", "c2") in bridged
    cells = spark.createDataFrame([("R", "c0", "c1", 1.0), ("R", "c1", "c2", 0.5), ("S", "c0", "c1", 1.0), ("S", "c1", "c2", -0.5), ("S", "c0", "c2", -1.0)], "code string, i string, j string, degree double")
    got = {(r.code, r.i, r.j): r.degree for r in paths.spanned(cells, paths.spans(forked, left)).collect()}
    assert got["R", "c0", "c2"] == 1.0 and got["S", "c0", "c2"] == -1.0 and len(got) == 6
    pools = spark.createDataFrame([("g", x) for x in (9, 2, 2, 40, 7)] + [("h", 5)], "grp string, pos long")
    assert {r.grp: r.place for r in paths.middle_places(pools, "grp", "pos").collect()} == {"g": 9, "h": 5}
