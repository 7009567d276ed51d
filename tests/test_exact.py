"""Results without depth limits, ranges without samples, rows by identity: each against brute force or a case once wrong."""

import random
from itertools import product

import pytest

from lakewarden.functions import pep440
from lakewarden.operators import behaviour, relations
from lakewarden.operators import code_rules as C
from lakewarden.operators.sca import graph_summary
from lakewarden.sources.python_facts import python_facts

VERSIONS = ["0.9", "1", "1.0.dev1", "1.0a1", "1.0a1.dev2", "1.0rc9", "1.0rc10", "1.0.post1", "1.0.1", "1.1", "1.10", "1.5.0", "1.5.5", "2.0a1", "2.0", "2.0.post2", "2.0.1", "2.5.0", "3.0.dev0", "3.0", "3.0.0.0.1", "10.0", "1!0.5"]
SPECS = ["", "==1.0", "==1.*", "!=1.*", ">=1.0", ">=1.0,<2", "~=1.0", "~=1.0.0", "<1.0", "<=1.0", ">1.0", "===1.0", ">=1.0a1", "==1.0rc9", "!=1.0.1,>=0.9", "<2.0", "<2.0a1", ">1.0.post1", ">=1!0", "~=1.0rc1", "==2.5.0", ">1.5,<1.6", ">1.4,<1.7", "!=2.0,!=1.*,<3", "==2.0.*,!=2.0", "bad", ">=x", "~=1", ">2,<1"]


@pytest.fixture(scope="module")
def ranged(spark):
    df = spark.createDataFrame([(s,) for s in SPECS], "s string").withColumn("r", pep440.spec_ranges(pep440.F.col("s")))
    df.write.mode("overwrite").saveAsTable("spec_ranges_of_tests")
    yield spark.table("spec_ranges_of_tests")
    spark.sql("drop table spec_ranges_of_tests")


def test_ranges_hold_what_the_packaging_library_says(spark, ranged):
    packaging = pytest.importorskip("packaging.specifiers")
    v = spark.createDataFrame([(v,) for v in VERSIONS], "v string")
    got = {(r.v, r.s): r.fits for r in ranged.join(v).select("v", "s", pep440.in_ranges(pep440.F.col("v"), pep440.F.col("r")).alias("fits")).collect()}
    bad = ("bad", ">=x", "~=1")
    want = {(v, s): s not in bad and packaging.SpecifierSet(s).contains(v, prereleases=True) for v, s in got}
    assert {k: got[k] for k in got if got[k] != want[k] and k[1] != "===1.0"} == {}  # "===" compares spellings, ranges don't


def test_ranges_are_sorted_and_disjoint_and_complements_are_what_is_left(spark, ranged):
    for r in ranged.select("s", "r", pep440.intersect(pep440.F.col("r"), pep440.complement(pep440.F.col("r"))).alias("none"), pep440.complement(pep440.complement(pep440.F.col("r"))).alias("again")).collect():
        assert r.none == [] and r.again == r.r
        cuts = [(c.end, tuple(map(str, c.key or ())), c.side) for x in r.r for c in (x.lo, x.hi)]
        assert len(set(cuts)) == len(cuts)


def test_emptiness_decides(spark, ranged):
    a = ranged.withColumnsRenamed({"s": "a", "r": "x"})
    b = ranged.withColumnsRenamed({"s": "b", "r": "y"})
    got = {(r.a, r.b): r.n == 0 for r in a.join(b).select("a", "b", pep440.F.size(pep440.intersect(pep440.F.col("x"), pep440.F.col("y"))).alias("n")).collect()}
    v = spark.createDataFrame([(v,) for v in [*VERSIONS, "1.55", "0.1", "99"]], "v string")
    fits = {(r.v, r.s): r.fits for r in ranged.join(v).select("v", "s", pep440.in_ranges(pep440.F.col("v"), pep440.F.col("r")).alias("fits")).collect()}
    for a, b in product(SPECS, SPECS):
        common = any(fits[v, a] and fits[v, b] for v in [*VERSIONS, "1.55", "0.1", "99"])
        assert not (common and got[a, b])
    assert not got[">1.5,<1.6", ">1.4,<1.7"] and got["==1.0", ">1.0"] and got["<1.0", ">=1.0"] and got["<2.0", "==2.0.*,!=2.0"]
    assert got["~=1.0", "==2.5.0"] and not got["~=1.0.0", "==1.*"] and got["bad", ""]


def test_a_pin_inside_an_interval_overlaps_it(spark):
    deps = spark.createDataFrame([("a", "==2.5.0"), ("a", "==3.0"), ("a", "<2"), ("a", ">1.5,<1.6")], "name string, spec string")
    r = spark.createDataFrame([("X", "a", "2.0", "3.0", False), ("Y", "a", "2.0", "3.0", True), ("Z", "a", "0", None, False)], "id string, package string, introduced string, until string, inclusive boolean")
    got = {(x.spec, x.id): x.ends for x in relations.constraint_overlaps(deps, r).collect()}
    assert got == {("==2.5.0", "X"): False, ("==2.5.0", "Y"): False, ("==3.0", "Y"): True, ("==2.5.0", "Z"): False, ("==3.0", "Z"): False, ("<2", "Z"): True, (">1.5,<1.6", "Z"): False}
    pairs = {(x.first, x.second): (x.empty, x.sampled) for x in relations.conflicting_constraints(spark.createDataFrame([("a", ">1.5,<1.6"), ("a", ">1.4,<1.7"), ("a", "==2")], "name string, spec string")).collect()}
    assert pairs == {("==2", ">1.4,<1.7"): (True, True), ("==2", ">1.5,<1.6"): (True, True), (">1.4,<1.7", ">1.5,<1.6"): (False, True)}


def lock_facts(spark, edges):
    return spark.createDataFrame(edges, "path string, src string, dst string")


def test_lock_cycles_of_any_length(spark):
    ring = [("a", f"l{i:02}", f"l{(i + 1) % 14:02}") for i in range(14)]
    more = [("b", "x", "y"), ("b", "y", "x"), ("b", "y", "z"), ("c", "x", "y"), ("c", "y", "z"), ("d", "s", "s")]
    got = {(r.path, tuple(r.cycle)) for r in C.lock_cycles(lock_facts(spark, ring + more)).collect()}
    assert got == {("a", tuple(f"l{i:02}" for i in range(14))), ("b", ("x", "y")), ("d", ("s",))}


def test_lock_cycles_equal_brute_force(spark):
    rng, rows, want = random.Random(5), [], set()
    for k in range(12):
        e = {(f"n{rng.randrange(6)}", f"n{rng.randrange(6)}") for _ in range(rng.randint(1, 12))}
        rows += [(f"f{k}", a, b) for a, b in e]
        for a, b in e:
            best, at = [], [(a, b)] if a != b else []
            if a == b:
                best = [(a,)]
            while at and not best:
                best = [p for p in at if (p[-1], a) in e]
                at = [(*p, y) for p in at for x, y in e if x == p[-1] and y not in p]
            if best:
                c = min(best)
                i = c.index(min(c))
                want.add((f"f{k}", len(c), (a, b)))
    got = {(r.path, tuple(r.cycle)) for r in C.lock_cycles(lock_facts(spark, rows)).collect()}
    for path, n, (a, b) in want:  # each edge on a cycle is on one of the shortest length that it can have
        assert any(p == path and len(c) == n and (a, b) in zip(c, (*c[1:], c[0]), strict=True) for p, c in got)
    assert all(any(w[0] == p and w[1] == len(c) for w in want) for p, c in got)


def test_graph_summary_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long")
    r = graph_summary(e, spark.createDataFrame([(0,)], "node long")).first()
    assert (r.direct, r.transitive, r.max_depth) == (1, 19, 20)
    assert graph_summary(e, spark.createDataFrame([(0,)], "node long"), 10).first().max_depth == 10


CODE = """from flask import Flask, Blueprint
from fastapi import FastAPI
import multiprocessing
web, api = None, None
web = Flask(__name__)
api = FastAPI()
pool = multiprocessing.Pool()
class A:
    @web.get('/admin/a')
    def h(self, user_id):
        return open_all()
class B:
    @api.get('/admin/b')
    def h(self, user_id):
        check(current_user.id)
pool.run(debug=True)
web.run(debug=True)
"""


def test_rows_by_the_function_that_they_stand_at(spark):
    f = python_facts(spark.createDataFrame([("m.py", CODE)], "path string, content string")).cache()
    assert {(r.line, r.route, r.authenticated) for r in C.routes(f).collect()} == {(9, "/admin/a", False), (13, "/admin/b", True)}
    assert sorted((r.line, r.framework) for r in behaviour.framework_routes(f).collect()) == [(9, "Flask"), (13, "FastAPI")]
    assert {(r.line, r.rule_id) for r in behaviour.framework_findings(f).collect()} == {(17, "FLASK-DEBUG")}
    nodes, _ = relations.knowledge_graph(f)
    assert {"fn:m.py:A.h", "fn:m.py:B.h"} <= {r.id for r in nodes.collect()}


def test_the_latest_version_by_value(spark):
    locked = spark.createDataFrame([("a", "9.0"), ("a", "10.0"), ("a", "10.0-rc1")], "name string, version string")
    assert relations.locked_versions(locked.limit(0), locked).first().version == "10.0"


def test_letters_that_grow_in_lower_case(spark):
    t, n = spark.createDataFrame([("İİİabc",)], "t string"), spark.createDataFrame([("abc",)], "n string")
    assert relations.contains_join(t, "t", n, "n").count() == 1
