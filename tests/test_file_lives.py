"""Files through renames and the times of secrets, against a plain replay of the history."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import file_lives as L

CHANGES = "n long, change string, path string, old_path string"
SEEN = "fingerprint string, path string, n long, commit string, ts timestamp, added boolean"
DAY = dt.datetime(2024, 1, 1)


def replay(changes, seen):
    """Commit by commit: what stands on each path, then where each secret is."""
    lives, on, places, times = {}, {}, {}, []
    for n in sorted({c[0] for c in changes} | {s[2] for s in seen}):
        old_on = dict(on)
        here = [c for c in changes if c[0] == n]
        for _, kind, path, old in here:
            if kind in "DR":
                on.pop(path if kind == "D" else old, None)
        begun = {}
        for _, kind, path, old in here:
            if kind in "AR":
                begun.setdefault(path, []).append(old if kind == "R" else None)
        for path, olds in begun.items():
            old = max((o for o in olds if o is not None), default=None)
            root, moves = old_on.get(old, (None, 0)) if old is not None else (None, 0)
            on[path] = (root, moves + 1) if root else ((path, n), 0)
            lives[(path, n)] = (*on[path][0], on[path][1])
        before = {f: bool(p) for f, p in places.items()}
        has = {}
        for f, path, m, _, _, added in seen:
            if m == n:
                at = (on if added else old_on).get(path)
                k = (f, at[0] if at else (path, -1))
                has[k] = has.get(k, False) or added
        for (f, file), yes in has.items():
            (places.setdefault(f, set()).add if yes else places.setdefault(f, set()).discard)(file)
        for f, p in places.items():
            if bool(p) != before.get(f, False):
                times.append((f, n, bool(p)))
    out, start = set(), {}
    for f, n, starts in times:
        if starts:
            start[f] = n
        else:
            out.add((f, start.pop(f), n))
    return lives, out | {(f, n, None) for f, n in start.items()}


def check(spark, changes, seen, width):
    c = spark.createDataFrame(changes, CHANGES)
    s = spark.createDataFrame([(f, p, n, f"c{n}", DAY + dt.timedelta(days=n), a) for f, p, n, _, _, a in seen], SEEN)
    lives, times = replay(changes, seen)
    got = L.file_lives(c, width).collect()
    assert {(r.path, r.n): (r.first_path, r.first_n, r.moves) for r in got} == lives and len(got) == len(lives)
    rows = L.secret_intervals(s, c, width).collect()
    assert {(r.fingerprint, r.from_n, r.to_n) for r in rows} == times and len(rows) == len(times)
    assert all(r.from_commit == f"c{r.from_n}" and (r.to_commit is None if r.to_n is None else r.to_ts == DAY + dt.timedelta(days=r.to_n)) for r in rows)


def test_moved_twice_removed_and_added_again(spark):
    changes = [(1, "A", "a", None), (3, "R", "b", "a"), (5, "R", "c", "b"), (9, "M", "c", None), (12, "A", "a", None)]
    seen = [("s", "a", 1, 0, 0, True), ("s", "a", 3, 0, 0, False), ("s", "b", 3, 0, 0, True), ("s", "c", 7, 0, 0, False), ("s", "c", 9, 0, 0, True), ("t", "a", 12, 0, 0, True), ("t", "c", 12, 0, 0, False)]
    check(spark, changes, seen, 2)
    s = spark.createDataFrame([(f, p, n, f"c{n}", DAY + dt.timedelta(days=n), a) for f, p, n, _, _, a in seen], SEEN)
    times = L.secret_intervals(s, spark.createDataFrame(changes, CHANGES))
    head = spark.createDataFrame([("s",), (None,)], "fingerprint string")
    got = {tuple(r) for r in L.exposures(times, head, F.lit(DAY + dt.timedelta(days=20))).collect()}
    assert got == {("s", 2, 6 + 11, True, True), ("t", 1, 8, False, False)}


@pytest.mark.parametrize("seed", range(3))
def test_equals_replay(spark, seed):
    """Random histories: paths taken anew, renames of what isn't there, several changes a commit, slices of many widths."""
    rnd = random.Random(seed)
    paths = "abcde"
    changes = [(rnd.randrange(40), k, rnd.choice(paths), None) if (k := rnd.choice("AMDRR")) != "R" else (rnd.randrange(40), "R", rnd.choice(paths), rnd.choice(paths)) for _ in range(60)]
    seen = [(rnd.choice("st"), rnd.choice(paths), rnd.randrange(40), 0, 0, rnd.random() < 0.5) for _ in range(60)]
    check(spark, changes + changes[:2], seen + seen[:2], (3, 17, L.WIDTH)[seed])


def test_long_chain_and_nothing(spark):
    changes = [(0, "A", "p0", None), *((i, "R", f"p{i}", f"p{i - 1}") for i in range(1, 200))]
    got = {r.path: (r.first_path, r.moves) for r in L.file_lives(spark.createDataFrame(changes, CHANGES)).collect()}
    assert got == {f"p{i}": ("p0", i) for i in range(200)}
    none = spark.createDataFrame([(None, "A", "a", None), (1, "A", None, None), (1, None, "a", None)], CHANGES)
    assert L.file_lives(none).collect() == [] and L.secret_intervals(spark.createDataFrame([], SEEN), none).collect() == []
