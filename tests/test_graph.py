"""Paths and removals of rules in the word graph, against breadth-first search in plain Python."""

import random
from collections import defaultdict, deque

import pytest

from lexiflow.operators import graph


def near(edges):
    out = defaultdict(set)
    for a, b, *_ in edges:
        out[a].add(b)
        out[b].add(a)
    return out


def reach(edges, start):
    to, seen, queue = near(edges), {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in to[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                queue.append(y)
    return seen


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(12)
    words = [f"w{i:02d}" for i in range(40)]
    codes = [["A"], ["B"], ["A", "B"], ["C"], ["A+C"], ["B", "A+C.2"]]
    pairs = {tuple(rng.sample(words[:30], 2)) for _ in range(28)} | set(zip(words[30:], words[31:], strict=False))
    return [(a, b, rng.choice(codes)) for a, b in sorted(pairs)]


def test_shortest_paths_of_many_seeds(spark, edges):
    e = spark.createDataFrame(edges, "src string, dst string, codes array<string>")
    seeds = ["w01", "w05", "w30", "w01", "alone"]
    got = defaultdict(dict)
    for r in graph.distances(e, spark.createDataFrame([(s,) for s in seeds], "word string")).collect():
        assert r.word not in got[r.seed]
        got[r.seed][r.word] = r
    assert set(got) == set(seeds) and max(r.distance for r in got["w30"].values()) == 9
    labels = defaultdict(set)
    for a, b, c in edges:
        labels[a, b] |= set(c)
        labels[b, a] |= set(c)
    for s in set(seeds):
        want = reach(edges, s)
        assert {w: r.distance for w, r in got[s].items()} == want
        for w, r in got[s].items():
            if r.distance:
                assert r.parent == min(p for p in near(edges)[w] if want.get(p) == r.distance - 1)
                assert r.codes == "+".join(sorted(labels[r.parent, w]))
    assert graph.distances(e.limit(0), spark.createDataFrame([], "word string")).count() == 0


def test_removal_of_rules_and_groups(spark, edges):
    groups = {"A": ["A"], "B": ["B"], "both": ["A", "B"], "all": ["A", "B", "C"], "other": ["X"]}
    e = spark.createDataFrame(edges, "src string, dst string, codes array<string>")
    got = {(r.removed, r.word): (r.members, r.remaining, r.detached, r.links) for r in graph.word_impact(e, groups).collect()}
    words = {w for a, b, _ in edges for w in (a, b)}
    assert len(got) == len(groups) * len(words)
    total = {r.removed: (r.isolated, r.split) for r in graph.removal_impact(e, groups).collect()}
    count = lambda es: len({min(reach(es, w)) for x in es for w in x[:2]})
    for name, out in groups.items():
        left = [(a, b, [c for c in cs if not {p.split(".")[0] for p in c.split("+")} & set(out)]) for a, b, cs in edges]
        kept = [x for x in left if x[2]]
        held = {w for x in kept for w in x[:2]}
        assert total[name] == (len(words - held), count(kept) - count(edges) + len(words - held))
        for w in words:
            whole, rest = reach(edges, w), reach(kept, w)
            links = sum(len(x[2]) - len(y[2]) for x, y in zip(edges, left, strict=True) if x[0] in whole)
            assert got[name, w] == (len(whole), len(rest), len(whole) - len(rest), links)
