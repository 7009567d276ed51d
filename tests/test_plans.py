"""Every query with SQL gives the rows that DuckDB gives for it."""

import math
import os

import duckdb
import pytest

from lakewarden import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    cell = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    want = db.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_every_query_is_registered():
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries()) and set(plans.SQL) <= set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns


def test_part_graphs_equal_brute_force(spark, tmp_path):
    """Keys over 40 stay apart."""
    orders = [(1, 2, 45), (5, 45, 1), (45, 85, 125), (85, 3, 85), (125, 6), (6, 7, 125), (7, 47), (3, 9)]
    lines = [(o, n, p) for o, ps in enumerate(orders) for n, p in enumerate(ps, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    e = {(a, b) for ps in orders for a, b in zip(ps, ps[1:], strict=False)}
    got = lambda name: {tuple(r) for r in plans.QUERIES[name](spark, str(tmp_path)).collect()}

    def paths(start, most, e):
        out, at = [], [(start,)]
        for _ in range(most):
            at = [(*p, b) for p in at for a, b in e if a == p[-1] and b not in p]
            out += at
        return out

    def reach(e, most):
        return {(s, s, 0) for s in (1, 5)} | {(s, n, min(len(p) - 1 for p in paths(s, most, e) if p[-1] == n)) for s in (1, 5) for n in {p[-1] for p in paths(s, most, e)}}

    assert got("part_paths") == {(p[0], p[-1], ">".join(map(str, p)), len(p) - 1) for s in (1, 5) for p in paths(s, 3, e)}
    assert got("part_depth") == reach(e, 10)
    assert got("part_what_if") == reach({x for x in e if not {2, 3} & set(x)}, 6)
    first = {(s, n): min((len(p), p) for p in paths(s, 4, e) if p[-1] == n)[1] for s in (1, 5) for n in {p[-1] for p in paths(s, 4, e)}}
    assert got("part_reachability") == {(s, n, len(p) - 1, ">".join(map(str, p))) for (s, n), p in first.items()}
    nodes = {x for p in e for x in p}
    assert got("part_spof") == {(n, k) for n in nodes if (k := len({a for a, b in e if b == n})) > 1}
    to = {n: {p[-1] for p in paths(n, 20, e)} for n in nodes}
    groups = {n: {m for m in to[n] if n in to[m]} | {n} for n in nodes}
    assert got("part_cycles") == {(n, min(g)) for n, g in groups.items() if len(g) > 1 or (n, n) in e}
