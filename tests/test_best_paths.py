"""The best paths without listing all are those of listing all."""

import random

import pytest

from lakewarden.operators import graph


def listed(edges, starts, targets, risk, depth, k):
    out = set()
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    for s in starts:
        at, all_ = [(s,)], []
        for _ in range(depth):
            at = [(*p, b) for p in at for b in to.get(p[-1], ()) if b not in p]
            all_ += at
        for t in targets:
            ways = sorted((-max(risk.get(n, 0.0) for n in p), len(p), p) for p in all_ if p[-1] == t)
            out |= {(s, t, p, -r) for r, _, p in ways[:k]}
    return out


def got(spark, edges, starts, targets, risk, depth, k, width=1):
    one = lambda rows: spark.createDataFrame([(x,) for x in rows], "node long")
    e = spark.createDataFrame(list(edges), "src long, dst long")
    r = spark.createDataFrame(list(risk.items()), "node long, risk double")
    rows = graph.best_paths(e, one(starts), one(targets), r, depth, k, width).collect()
    assert len(rows) == len({(x.start, x.node, tuple(x.path)) for x in rows})
    return {(x.start, x.node, tuple(x.path), x.risk) for x in rows}


@pytest.mark.parametrize("seed", range(4))
def test_equals_listing(spark, seed):
    """Random graphs with cycles, loops, ties of risks, nodes without one, repeated rows and nulls."""
    rnd = random.Random(seed)
    n = 9
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.choice((15, 30)))]
    risk = {i: float(rnd.randrange(3)) for i in range(n) if i % 4}
    starts, targets = [0, 1, 1], [1, 7, 8, 42]
    have = got(spark, [*edges, edges[0], (None, 1), (1, None)], [*starts, None], [*targets, None], risk, 5, 2)
    assert have == listed(set(edges), {0, 1}, set(targets), risk, 5, 2)


def test_the_riskiest_way_only_leads_back(spark):
    """A node of high risk that can be met only by coming back: its bound is never reached, and the next best paths are kept."""
    edges, risk = [(0, 1), (1, 2), (2, 1), (1, 3), (2, 4), (4, 3)], {2: 1.0, 9: 5.0}
    edges += [(1, 9), (9, 1), (4, 9), (9, 4)]
    assert got(spark, edges, [0], [3], risk, 6, 3) == listed(set(edges), {0}, {3}, risk, 6, 3)


def test_many_ways_few_rows(spark):
    """Twelve layers of five nodes have 5^12 ways; the best three come in some rounds."""
    layer = lambda i: [10 * i + j for j in range(1 if i in (0, 13) else 5)]
    edges = [(a, b) for i in range(13) for a in layer(i) for b in layer(i + 1)]
    rows = got(spark, edges, [0], [130], {64: 3.0, 12: 2.0}, 13, 3)
    assert {(len(p), r) for _, _, p, r in rows} == {(14, 3.0)} and len(rows) == 3
    low = [0, *(10 * i for i in range(1, 13)), 130]
    assert {p for _, _, p, _ in rows} == {tuple(low[:6] + [64] + low[7:]), tuple(low[:6] + [64] + low[7:12] + [121, 130]), tuple(low[:6] + [64] + low[7:12] + [122, 130])}


def test_no_way(spark):
    assert got(spark, [(1, 2)], [2], [1], {}, 3, 2) == set()
    assert got(spark, [], [1], [1], {}, 3, 2) == set()
    assert got(spark, [(1, 1)], [1], [1], {1: 1.0}, 3, 2) == set()
