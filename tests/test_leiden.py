"""Communities held against a plain Louvain, by modularity, and for hanging together."""

import collections
import itertools
import random

import pytest

from cellspark.operators import leiden


def plain_modularity(weights, label, resolution):
    """``weights``: weight by pair of nodes, both directions."""
    total, held, inside = sum(weights.values()), collections.Counter(), 0.0
    for (a, b), w in weights.items():
        held[label[a]] += w
        inside += w * (label[a] == label[b])
    return inside / total - resolution * sum(x * x for x in held.values()) / total**2


def plain_louvain(weights, resolution):
    """Sequential Louvain: nodes in order, levels until nothing moves."""
    of, graph = None, dict(weights)
    total = sum(graph.values())
    while True:
        near = collections.defaultdict(dict)
        for (a, b), w in graph.items():
            near[a][b] = near[a].get(b, 0) + w
        k = {a: sum(x.values()) for a, x in near.items()}
        label, held, moved = {a: a for a in near}, dict(k), True
        any_moved = False
        while moved:
            moved = False
            for a in sorted(near):
                votes = collections.Counter({label[a]: 0.0})
                for b, w in near[a].items():
                    if b != a:
                        votes[label[b]] += w
                held[label[a]] -= k[a]
                best = max(votes, key=lambda c: (votes[c] - resolution * k[a] * held[c] / total, -c))
                if votes[best] - resolution * k[a] * held[best] / total > votes[label[a]] - resolution * k[a] * held[label[a]] / total + 1e-9:
                    label[a], moved, any_moved = best, True, True
                held[label[a]] += k[a]
        of = label if of is None else {n: label[c] for n, c in of.items()}
        if not any_moved:
            return of
        merged = collections.Counter()
        for (a, b), w in graph.items():
            merged[label[a], label[b]] += w
        graph = dict(merged)


def both_ways(pairs):
    out = collections.Counter()
    for a, b in pairs:
        if a != b:
            out[a, b] += 1.0
            out[b, a] += 1.0
    return dict(out)


def connected(weights, members):
    """Whether nodes hang together by edges among them."""
    members, seen = set(members), set()
    todo = [next(iter(members))]
    near = collections.defaultdict(list)
    for a, b in weights:
        near[a].append(b)
    while todo:
        x = todo.pop()
        if x in members and x not in seen:
            seen.add(x)
            todo += near[x]
    return seen == members


def planted(groups, size, inside, across, seed):
    rng = random.Random(seed)
    n = groups * size
    return [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < (inside if a // size == b // size else across)]


def check(spark, pairs, resolution, least):
    weights = both_ways(pairs)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.src: r.label for r in leiden.leiden(edges, resolution).collect()}
    assert set(got) == {a for a, _ in weights}
    members = collections.defaultdict(list)
    for a, c in got.items():
        members[c].append(a)
    assert all(connected(weights, m) for m in members.values())
    q, plain = plain_modularity(weights, got, resolution), plain_modularity(weights, plain_louvain(weights, resolution), resolution)
    assert q >= least * plain, (q, plain)
    labels = spark.createDataFrame(list(got.items()), "node long, label long")
    assert leiden.modularity(leiden.undirected(edges), labels, resolution) == pytest.approx(q, abs=1e-9)
    return members


def test_planted_groups_are_found(spark):
    members = check(spark, planted(4, 12, 0.8, 0.02, 1), 1.0, 1.0)
    assert sorted(map(sorted, members.values())) == [list(range(i, i + 12)) for i in range(0, 48, 12)]


def test_cliques_in_a_ring_and_odd_edges(spark):
    """Loops are left out, repeated edges add up, no edges give no rows."""
    ring = [(c * 4 + i, c * 4 + j) for c in range(5) for i, j in itertools.combinations(range(4), 2)] + [(c * 4, (c * 4 + 4) % 20) for c in range(5)]
    members = check(spark, [*ring, (3, 3), *ring[:6]], 2.0, 0.99)
    assert all(len({x // 4 for x in m}) * 4 == len(m) for m in members.values())
    assert leiden.leiden(spark.createDataFrame([(1, 1)], "src long, dst long")).collect() == []
