import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lakewarden.llm import queries as Q
from lakewarden.llm import simhash as S
from lakewarden.llm.common import Workspace, components, table
from lakewarden.llm.embeddings import near_vectors
from lakewarden.llm.simhash import near_duplicates, near_edges


def brute_fp(text):
    w = [x.lower() for x in (text or "").encode().split()]
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_simhash(docs):
    fps = [brute_fp(t) for _, t in docs]
    link = [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = groups(len(docs), link)
    low = {}
    for r, (d, _) in zip(root, docs, strict=True):
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return Counter((d, f"{f:016x}", low[r]) for (d, _), f, r in zip(docs, fps, root, strict=True))


def test_simhash_equals_brute_force(spark, sf, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    want = brute_simhash(docs)
    assert any(d != c for d, _, c in want)
    assert Counter(map(tuple, Q.op5_simhash_near_dedup(spark, sf).collect())) == want
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = near_duplicates(odd_docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert Counter(map(tuple, got.collect())) == brute_simhash(docs)
    assert near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("bucket_rows,n", [(32768, 0), (40, 0), (32768, 1 << 40), (40, 1 << 24)])
def test_all_links_are_found_whatever_the_tables(spark, bucket_rows, n, monkeypatch):
    """A dense cloud around a centre, lone pairs at distances 4 and 5, and noise."""
    g = random.Random(3)
    flip = lambda x, k: x ^ sum(1 << b for b in g.sample(range(64), k))
    centre, fps = g.getrandbits(64), set()
    fps |= {flip(centre, g.randint(0, 3)) for _ in range(300)}
    for k in (4, 4, 4, 5, 5):
        for _ in range(20):
            x = g.getrandbits(64)
            fps |= {x, flip(x, k)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    link = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 4]
    root = groups(len(fps), link)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    if n:
        monkeypatch.setattr(S, "masks", lambda _, r, f=S.masks: f(n, r))
    edges = near_edges(df, len(fps), 4, bucket_rows)
    got = {r.node: r.root for r in components(Workspace(spark), edges).collect()}
    assert [got.get(x, x) for x in fps] == [fps[r] for r in root]


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(Workspace(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 400)}


def brute_vectors(rows, cosine=0.93):
    def unit(v, label):
        if v is None or label is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        return x / np.linalg.norm(x)

    u = [unit(v, lab) for _, v, lab in rows]
    link = [(i, j) for i in range(len(rows)) for j in range(i) if u[i] is not None and u[j] is not None and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine]
    n = Counter(x for p in link for x in p)
    root = groups(len(rows), link)
    low = {}
    for r, row in zip(root, rows, strict=True):
        low[r] = min((x for x in (low.get(r), row[0]) if x is not None), default=None)
    return Counter((row[0], n[i], low[root[i]], row[0] == low[root[i]]) for i, row in enumerate(rows))


def test_vectors_equal_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, sf, "embeddings").collect()]
    want = brute_vectors(rows)
    assert Counter(map(tuple, Q.op1_embedding_near_dedup(spark, sf).collect())) == want


@pytest.mark.parametrize("cell_rows,group_rows,blocks", [(2000, 16384, 8), (5, 16384, 8), (5, 20, 3), (1000, 30, 1), (1, 10, 64)])
def test_odd_vectors(spark, cell_rows, group_rows, blocks):
    g = np.random.default_rng(5)
    near = lambda v, s: (v + g.normal(0, s, len(v))).astype(np.float32).tolist()
    rows, c = [], g.standard_normal(12)
    for _ in range(120):
        rows.append((len(rows), near(c, 0.25), int(g.integers(2))))
    for _ in range(60):
        rows.append((len(rows), near(np.zeros(12), 1), 0))
    rows += [(500 + i, v, 0) for i, v in enumerate([None, [], [0.0] * 12, [None] + [1.0] * 11, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [1.0, 0.0], [2.0, 0.0], rows[0][1], rows[0][1], [3.0]])]
    rows += [(None, rows[0][1], 0), (0, rows[0][1], 0), (700, rows[0][1], None), (701, (np.array(rows[0][1]) * 2).tolist(), rows[0][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, cid string, n int")
    got = near_vectors(df, cell_rows=cell_rows, group_rows=group_rows, blocks=blocks)
    assert Counter(map(tuple, got.collect())) == brute_vectors([(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b], k) for a, b, k in rows])
    assert near_vectors(df.limit(0)).collect() == []
