import glob
import os
import random
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest

from lakewarden.llm import queries as Q
from lakewarden.llm.prefix_trie import borrowed_heads, checksums, prefix_trie, turns

CONV = "conv_id long, turn long, role string, text string, key string, seq string, words string, cut string"


def words(text):
    return len([w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w])


def brute(rebuilt):
    """``rebuilt``: conv_id -> list of (role, text)."""
    members, ends = defaultdict(set), defaultdict(set)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].add(c)
        ends[tuple(t)].add(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, own in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(own) - 1) * words(k[-1][1]) if k else 0
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def rebuilt(rows):
    own = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            own[r["conv_id"]].append(((r["turn"] is not None, r["turn"] or 0), (r["role"] or "", r["text"] or "")))
    own = {c: [x for _, x in sorted(t, key=lambda x: x[0])] for c, t in own.items()}
    return {c: own.get(c - c % 20, [])[: crc32(str(c).encode()) % 4] + t[crc32(str(c).encode()) % 4 :] for c, t in own.items()}


def conversations(spark, seed, n, turns_of):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c == 20:
            continue  # a family without its first conversation
        for turn in range(turns_of(rng)):
            text = rng.choice(["Hello  there", "", None, "a b\tc", "naïve Ünï 日本", "x" * 50])
            rows.append((c, turn if turn or rng.random() < 0.7 else None, rng.choice(["user", None, "assistant"]), text, "k", "s", "w", "c"))
    return spark.createDataFrame([*rows, (None, 0, "user", "nobody's", "k", "s", "w", "c")], CONV)


@pytest.mark.parametrize(("seed", "limit"), [(1, 5000), (2, 40), (3, 3)])
def test_brute_force(spark, seed, limit):
    df = conversations(spark, seed, 120, lambda rng: rng.choice([1, 1, 2, 3, 5, 8]))
    got = prefix_trie(borrowed_heads(turns(df)), limit=limit)
    assert Counter(map(tuple, got.collect())) == brute(rebuilt([r.asDict() for r in df.collect()]))


@pytest.mark.parametrize("limit", [5000, 20])
def test_copies_and_long_shared_starts(spark, limit):
    """A group of copies, a long common start that parts late, and prefixes of one another: rounds and spine nodes."""
    long = [("user", f"turn {i}") for i in range(40)]
    convs = {i: long for i in range(30)} | {100 + i: [*long[:30], ("user", f"own {i % 3}"), ("user", "end")] for i in range(20)} | {200 + i: long[: i * 3] for i in range(1, 10)} | {300: [("a", "b")], 301: []}
    df = spark.createDataFrame([(c, [(f"{r}:{t}".encode().hex().ljust(32, "0")[:32], words(t)) for r, t in own]) for c, own in convs.items()], "conv_id long, turns array<struct<digest: string, words: int>>")
    assert Counter(map(tuple, prefix_trie(df, limit=limit).collect())) == brute(convs)


def test_equals_sql(spark, sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = c.sql(Q.OP12_SQL)
    got = Q.op12_prefix_trie(spark, sf)
    assert Counter(map(tuple, got.select(want.columns).collect())) == Counter(want.fetchall())


def test_checksums_stream_over_blocks(spark):
    ids = [*range(0, 20_000, 3), -5]
    df = spark.createDataFrame([("a", i) for i in ids] + [("b", 7)], "key string, conv_id long").repartition(5)
    got = {r.key: r.sha for r in checksums(df).collect()}
    assert got == {"a": sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), "b": sha256(b"7").hexdigest()}


def test_no_rows(spark):
    none = spark.createDataFrame([], CONV)
    assert prefix_trie(borrowed_heads(turns(none))).collect() == []
    only = spark.createDataFrame([(None, 1, "user", "x", "", "", "", "")], CONV)
    assert prefix_trie(borrowed_heads(turns(only))).collect() == []


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(21, 40) if crc32(str(c).encode()) % 4 == 3)
    df = spark.createDataFrame([(c, 0, "user", "gone", "", "", "", "")], CONV)
    got = prefix_trie(borrowed_heads(turns(df))).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, sha256(str(c).encode()).hexdigest())]
