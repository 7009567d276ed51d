"""What is broadcast is bounded by its rows, not by the packed size of the files that they are read from."""

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import code_rules as C
from lakewarden.operators import graph as G
from lakewarden.operators import symbols
from lakewarden.operators.dataflow import labelled_paths
from lakewarden.operators.dominance import feasible_flows
from lakewarden.operators.nesting import outline
from lakewarden.sources.control_flow import control_flow
from lakewarden.sources.def_use import def_use
from lakewarden.sources.python_facts import python_facts


def last_plan(spark):
    """The plan, as it was at last, of the session's latest query."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription().split("Initial Plan")[0]


def named(spark, n, text):
    """Some 130 bytes a row, of which files take some ten."""
    return G._cut(spark.range(n).select(F.concat(F.lit("node"), "id").alias("k"), F.repeat(F.lit("x"), F.lit(100)).alias(text)))


def test_many_rows_in_small_files_are_not_broadcast(spark):
    a, b, few = named(spark, 200_000, "a"), named(spark, 200_000, "b"), named(spark, 10, "c")
    assert "BroadcastHashJoin" in a.join(b, "k")._jdf.queryExecution().executedPlan().toString()  # by the files' size alone
    G._cut(a.join(b, "k"))
    assert "SortMergeJoin" in (plan := last_plan(spark)) and "Broadcast" not in plan
    G._cut(a.join(few, "k"))
    assert "BroadcastHashJoin" in last_plan(spark)


def test_counts_of_names_handed_on_broadcast_no_table_of_size(spark):
    i = F.col("id").cast("string")
    bind = G._cut(spark.range(300_000).select(F.concat(F.lit("module"), i, F.lit(".some_name")).alias("name"), F.concat(F.lit("library.part_of_it.target"), i).alias("target")))
    assert "BroadcastHashJoin" in bind.join(bind.select(F.col("name").alias("target")), "target", "left_semi")._jdf.queryExecution().executedPlan().toString()
    seen, counted = [], G._count
    with pytest.MonkeyPatch.context() as m:
        m.setattr(symbols, "_count", lambda df: (counted(df), seen.append(last_plan(spark)))[0])
        links = symbols.final_bindings(bind, bind.select("name").limit(0))
    assert links.count() == 300_000 and len(seen) == 1 and "Broadcast" not in seen[0]


@pytest.mark.parametrize(("files", "rows"), [(None, None), ("20m", None), ("20m", "1m"), ("-1", None), ("64k", "5m")])
def test_the_session_keeps_its_thresholds(spark, files, rows):
    old = spark.conf.get(G._BY_FILES)
    try:
        if files:
            spark.conf.set(G._BY_FILES, files)
        if rows:
            spark.conf.set(G._BY_ROWS, rows)
        before = spark.conf.get(G._BY_FILES), spark.conf.get(G._BY_ROWS, None)
        with pytest.raises(ValueError), G._measured(spark):
            assert G._bytes(spark.conf.get(G._BY_FILES)) == min(G.SMALL, G._bytes(before[0]))
            assert spark.conf.get(G._BY_ROWS, None) == (rows if rows or files in ("-1", "64k") else before[0])
            raise ValueError
        assert (spark.conf.get(G._BY_FILES), spark.conf.get(G._BY_ROWS, None)) == before
    finally:
        spark.conf.set(G._BY_FILES, old)
        spark.conf.unset(G._BY_ROWS)


def test_judged_flows_leave_no_join_to_the_caller(spark):
    files = spark.createDataFrame([("a.py", "import os\nfrom flask import request\nif ok:\n    os.system(request.args['a'])\n")], "path string, content string")
    out = feasible_flows(labelled_paths(def_use(files)), control_flow(files))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.sink_line, r.conditions, r.verdict) for r in out.collect()] == [(4, ["ok"], "CONDITIONAL")]


def test_call_edges_leave_no_join_to_the_caller(spark):
    files = spark.createDataFrame([("a.py", "from b import g\ndef f():\n    g()\n    h()\n"), ("b.py", "def g():\n    pass\ndef h():\n    g()\n")], "path string, content string")
    out = C.call_edges(python_facts(files))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("a.py:f", "b.py:g", 2), ("a.py:f", "b.py:h", 3), ("b.py:h", "b.py:g", 1)]


def test_outlines_leave_no_join_to_the_caller(spark):
    out = outline(spark.createDataFrame([("a.js", 1, "class A {"), ("a.js", 2, "  run() {}"), ("a.js", 3, "}")], "path string, line_no int, text string"))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("a.js", "A", "class", 1, 3, None, 0), ("a.js", "run", "method", 2, 2, "A", 1)]
