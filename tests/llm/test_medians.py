import datetime as dt
import glob
import math
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lakewarden.llm import queries as Q
from lakewarden.llm.medians import COARSE, FINE, Trie, Window, cover, rolling_medians, slide

CLICK = "click_id long, ts timestamp_ntz, kind string, value double, series string, us string, part string, n string"
T0 = dt.datetime(2024, 3, 31, 1, 30)


def brute(rows, minutes=60):
    once = {}
    for r in rows:
        c = None if r["value"] is None or not abs(r["value"]) <= 2**53 / 100 else math.floor(r["value"] * 100 + 0.5)
        none = lambda x: (x is not None, x)
        key = (r["ts"] is None, r["ts"] or T0, none(r["kind"]), none(c))
        if r["click_id"] not in once or key < once[r["click_id"]][0]:
            once[r["click_id"]] = key, (r["ts"], r["kind"], c)
    series = defaultdict(list)
    for i, (_, (ts, kind, c)) in once.items():
        if ts is not None:
            series[kind].append((ts, c, i))
    out = Counter()
    for kind, own in series.items():
        for ts, c, i in own:
            s = sorted(x for t, x, _ in own if x is not None and ts - dt.timedelta(minutes=minutes) <= t <= ts)
            n, m, a, far = len(s), None, None, None
            if n > 1:
                m = s[(n - 1) // 2] + s[n // 2]
                d = sorted(abs(2 * x - m) for x in s)
                a = d[(n - 1) // 2] + d[n // 2]
                far = None if c is None else 2 * abs(2 * c - m) > 3 * a
            out[(i, kind, n, m, a, far)] += 1
    return out


def clicks(spark, seed, n, span_s, kinds=("view", None, "")):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        ts = None if i % 17 == 5 else T0 + dt.timedelta(microseconds=int(rng.integers(0, span_s * 1_000_000)))
        value = None if i % 13 == 3 else [float("nan"), float("inf"), 1e300][i % 3] if i % 41 == 7 else round(float(np.exp(rng.normal(2, 2))) * (-1) ** (i % 5 == 0), 3)
        rows.append((i, ts, kinds[int(rng.integers(0, len(kinds)))], value, "a", "b", "c", "d"))
    rows += rows[:: 7] + [(3, T0, "other", 1.0, "a", "b", "c", "d"), (None, T0, "view", 2.0, "a", "b", "c", "d"), (None, T0, "view", 3.0, "a", "b", "c", "d")]
    rows += [(1000 + i, T0, "view", 5.0 + i % 3, "a", "b", "c", "d") for i in range(40)]  # ties
    return spark.createDataFrame(rows, CLICK)


@pytest.mark.parametrize(("span", "limit", "minutes", "zone"), [(20 * 3600, 32_768, 60, "UTC"), (20 * 3600, 25, 60, "Europe/Berlin"), (1800, 9, 60, "UTC"), (5, 4, 60, "UTC"), (40_000, 50, 7, "UTC")])
def test_brute_force(spark, span, limit, minutes, zone):
    df = clicks(spark, span, 400, span)
    want = brute([r.asDict() for r in df.collect()], minutes)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = Counter(map(tuple, rolling_medians(df, minutes=minutes, rows=limit).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want


def test_equals_sql(spark, sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = c.sql(Q.OP13_SQL)
    got = Q.op13_rolling_medians(spark, sf)
    assert Counter(map(tuple, got.select(want.columns).collect())) == Counter(want.fetchall())


def test_no_rows_and_no_values(spark):
    assert rolling_medians(spark.createDataFrame([], CLICK)).collect() == []
    df = spark.createDataFrame([(1, T0, "a", None, "", "", "", ""), (2, None, "a", 1.0, "", "", "", "")], CLICK)
    assert [tuple(r) for r in rolling_medians(df).collect()] == [(1, "a", 0, None, None, None)]


def test_zoned_times_and_text_ids(spark):
    df = spark.createDataFrame([("x", T0, "a", 1.0), ("y", T0, "a", 2.0)], "click_id string, ts timestamp, kind string, value double")
    assert {tuple(r) for r in rolling_medians(df).collect()} == {("x", "a", 2, 300, 200, False), ("y", "a", 2, 300, 200, False)}


@pytest.mark.parametrize("seed", range(12))
def test_slide(seed):
    rng = np.random.default_rng(seed)
    n, top, width = int(rng.integers(1, 300)), [60, 100_000, 1 << 52][seed % 3], [0, 50, 300][seed % 3]
    us, v = np.sort(rng.integers(0, 1000, n)), rng.integers(-50, top, n)
    w = rng.integers(1, 4, n)
    asked = np.unique(rng.integers(0, 1000, 200))
    got = slide(asked, us, v, w, width)
    for i, q in enumerate(asked):
        k = (us >= q - width) & (us <= q)
        s = np.sort(np.repeat(v[k], w[k]))
        assert got[0][i] == len(s)
        if len(s) > 1:
            m = s[(len(s) - 1) // 2] + s[len(s) // 2]
            d = np.sort(abs(2 * s - m))
            assert (got[1][i], got[2][i]) == (m, d[(len(s) - 1) // 2] + d[len(s) // 2])


def test_trie_counts_and_descent():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 60, 500))
    w = Window(Trie(values), 2)
    lane, leaf = np.array([1] * 500), np.arange(500)
    w.add(lane, leaf, np.ones(500, np.int64))
    w.add(lane[::2], leaf[::2], -np.ones(250, np.int64))
    left = values[1::2]
    assert w.select(np.array([1] * 250), np.arange(250)).tolist() == left.tolist()
    x = np.random.default_rng(2).integers(-5, 1 << 61, 100)
    assert w.before(np.array([1] * 100), x).tolist() == np.searchsorted(left, x).tolist()
    assert w.before(np.array([0] * 100), x).tolist() == [0] * 100


@pytest.mark.parametrize("limit", [1, 3, 50, 10_000])
def test_slices_cover_all_rows_once(limit):
    rng = np.random.default_rng(limit)
    at = np.unique(rng.integers(-3, 1 << (COARSE - FINE), 300))
    total = rng.integers(1, 9, len(at))
    number, bits, n = cover(at, total, np.ones(len(at), bool), FINE, COARSE, limit)
    spans = sorted(zip((number << bits).tolist(), ((number + 1) << bits).tolist(), n.tolist(), bits.tolist(), strict=True))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert all(k <= limit or b == FINE for _, _, k, b in spans)
    for lo, hi, k, _ in spans:
        assert total[(at << FINE >= lo) & (at << FINE < hi)].sum() == k
    assert n.sum() == total.sum()
