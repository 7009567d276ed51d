"""Files are parsed once, however often the plan of an operator reads their facts."""

import pytest
import small_corpus as small

from lakewarden.operators import behaviour as B
from lakewarden.operators import code_rules as C
from lakewarden.operators import relations as L
from lakewarden.operators import sca
from lakewarden.sources.python_facts import facts_of, python_facts


def _public(facts):
    nodes, edges = L.knowledge_graph(facts)
    return L.public_edges(edges, nodes.withColumn("is_entry", nodes["name"] == "run"))


def _scanned(facts):
    spark = facts.sparkSession
    deps = spark.createDataFrame([("r.txt", "a", "1.0")], "path string, name string, version string")
    ranges = spark.createDataFrame([("X", "a", "0", None, None)], "id string, package string, introduced string, until string, inclusive boolean")
    vulnerable = spark.createDataFrame([("a", "X", ["os.system"])], "name string, id string, functions array<string>")
    calls = facts.where("kind = 'call'").selectExpr("fn", "resolved as callee", "false as endpoint")
    return sca.scan(deps, ranges, spark.createDataFrame([("a", "2.0")], "name string, fix string"), vulnerable, calls)


ONCE = {
    "framework_findings": B.framework_findings,
    "public_edges": _public,
    "knowledge_edges": lambda f: L.knowledge_graph(f)[1],
    "knowledge_nodes": lambda f: L.knowledge_graph(f)[0],
    "framework_routes": B.framework_routes,
    "call_edges": C.call_edges,
    "dynamic_events": C.dynamic_events,
    "dynamic_summary": lambda f: B.summary(C.dynamic_events(f, conservative=True), "event"),
    "sca_scan": _scanned,
    "web_summary": lambda f: C.routes(f).groupBy("path").count(),
    "callback_edges": C.callback_edges,
    "web_rules": lambda f: C.web_findings(C.routes(f)),
    "lock_cycles": lambda f: C.lock_cycles(C.lock_edges(f)),
}


@pytest.mark.parametrize("name", ONCE)
def test_files_are_parsed_once(spark, name):
    files = small.files(spark).where("path like '%.py'")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    ONCE[name](python_facts(files.select("path", "content").mapInArrow(counted, "path string, content string"))).collect()
    assert seen.value == files.count()


def test_control_flow_is_found_once(spark):
    from lakewarden.operators.dataflow import labelled_paths
    from lakewarden.operators.dominance import feasible_flows
    from lakewarden.sources.control_flow import control_flow
    from lakewarden.sources.def_use import def_use

    files = small.files(spark).where("path like '%.py'")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    flows = labelled_paths(def_use(files))
    assert feasible_flows(flows, control_flow(files.select("path", "content").mapInArrow(counted, "path string, content string"))).count() == flows.count()
    assert seen.value == files.count()


def test_kinds_and_texts_that_are_asked_for():
    code = "import os\ndef f(a):\n    x = 'text'\n    os.system(a)\n    with p:\n        with q:\n            pass\n"
    whole = facts_of("a.py", code)
    for kinds in ((), ("call",), ("function", "lock"), ("constant", "assign", "import")):
        some = facts_of("a.py", code, frozenset(kinds), frozenset(("constant",)))
        assert some == [(*r[:11], r[11] if r[1] == "constant" else None, *r[12:]) for r in whole if r[1] in kinds]
    assert facts_of("a.py", "def (", frozenset(("call",))) == []


def test_rows_leave_a_worker_in_small_batches(spark):
    """A file's facts go on as soon as their texts fill a batch, and few files come at once."""
    files = spark.range(40, numPartitions=1).selectExpr("concat('f', id, '.py') as path", "concat('x = \"', repeat('a', 500000), '\"') as content")

    def sizes_of(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32())], ["n"])

    sizes = python_facts(files).mapInArrow(sizes_of, "n int").collect()
    assert sum(r.n for r in sizes) == 80 and len(sizes) >= 6


def test_repeated_constraints_are_judged_once(spark):
    """Rows and nulls stay; what comes again joins the verdict of its likes."""
    rows = [(i, f, s, a, b) for i, (f, s, a, b) in enumerate([(">=1,<2", "==3", "1.5", "2"), ("<1", None, None, "0.5"), (">=1,<2", ">1.2", "1", "1.1"), ("==1.*", "~=1.2", "3", None)] * 5)]
    got = L.constraint_algebra(spark.createDataFrame(rows, "i int, first string, second string, introduced string, until string"))
    assert "spec_ranges" not in got.columns and not [x for x in ("aggregate(", "transform(") if x in got._jdf.queryExecution().optimizedPlan().toString()]
    want = [(True, True, 1), (False, True, 1), (False, True, 1), (False, False, 1)]
    assert [tuple(r)[5:] for r in got.orderBy("i").select("i", "first", "second", "introduced", "until", "conflict", "exposed", "safe_ranges").collect()] == want * 5
