"""Packages that are equal but for their name are analysed once, and each gets its own flows."""

import pytest

from lakewarden.operators import dataflow
from lakewarden.operators.dataflow import _open_roots, labelled_paths, shared_paths
from lakewarden.operators.graph import _cut
from lakewarden.plans import flows as P
from lakewarden.sources.def_use import def_use, file_facts, file_of

CALLS = "from flask import request\nfrom {0}.deep.core import run\nimport os, {0}.deep.core\nrun(request.args['a'])\nos.system({0}.request.args)\n{0}.cursor.execute({0}.request.form)\n"
CORE = "import os\ndef run(v):\n    os.system(v)\n"


def package(name, calls=CALLS, core=CORE):
    return [(f"{name}/__init__.py", "from .deep import *\n"), (f"{name}/deep/__init__.py", "from .core import run\n"), (f"{name}/deep/core.py", core), (f"{name}/views.py", calls.format(name))]


#: Packages that differ in names, in code, in paths or in the order of two targets, that use each other, that come twice.
MIXED = [
    *(f for n in ("abc", "pkg1", "pkg22", "zebra", "twice", "twice") for f in package(n)),
    *package("differs", core="import os\n\ndef run(v):\n    os.system(v)\n"),
    *package("lacks")[:3],
    *package("used"),
    *package("uses"),
    ("uses/more.py", "from used.views import request as r\nfrom used import run as again\nagain(r.args)\n"),
    *((f"/{p}", c) for p, c in package("led")),
    *((p, CORE + "run(input())\n") for p in ("a4.py", "a5.py", "a-7.py", "pkg22.py")),
    *(("", CORE), ("abc/bad.py", "def ("), ("pkg1/none.py", None)),
    # the smaller target stands: the package's own in the first two, the other in the last
    *((f"{n}/{p}", c) for n in ("b1", "b2", "z1") for p, c in (("__init__.py", "from m import run\nfrom .core import run\n"), ("core.py", CORE), ("views.py", f"from {n} import run\nrun(input())\n"))),
]
#: Each list is a set of files by itself.
CASES = {
    "mixed": MIXED,
    "packages with configured names": [*package("a1"), *package("request"), *package("os"), *package("flask")],
    "names at the top": [*package("a1"), *package("a2"), ("__init__.py", "from a1 import *\n"), ("a3/x.py", "import run\nrun(input())\n"), ("a4/x.py", "import run\nrun(input())\n")],
}


def rows(flows):
    return sorted((*r[:-1], tuple(r.via)) for r in flows.collect())


@pytest.mark.parametrize("case", CASES)
def test_shared_paths_equal_those_of_all_files(spark, case):
    files = spark.createDataFrame(CASES[case], "path string, content string").repartition(3)
    want = rows(labelled_paths(def_use(files)))
    assert want and rows(shared_paths(files)) == want
    if case == "mixed":  # what is seen on its own, and what isn't
        table = _cut(file_facts(files))
        seen = {r.root for r in _open_roots(table, dataflow.TaintConfig()).collect()}
        assert {"used", "uses", "led", "a-7", "run"} <= seen and not seen & {"abc", "pkg1", "pkg22", "zebra", "twice", "b1", "z1", "a4"}


def test_facts_of_equal_packages_are_joined_once(spark, tmp_path, monkeypatch):
    """Facts that go into joins don't grow with copies, and each copy has its flows."""
    sizes, made = [], dataflow.Program.__init__

    def counted(self, facts, config):
        sizes.append(facts.count())
        made(self, facts, config)

    monkeypatch.setattr(dataflow.Program, "__init__", counted)
    for n in (1, 4):
        docs = spark.range(n * len(P.VIEWS)).selectExpr("id as doc_id", "concat('text ', id) as text")
        docs.write.parquet(f"{tmp_path}/{n}/documents.parquet")
        assert P.taint_paths(spark, f"{tmp_path}/{n}").count() == n * sum(len(f) for _, f in P.VIEWS)
    assert sizes[0] == sizes[1]


def test_files_are_parsed_once(spark):
    files = spark.createDataFrame(CASES["names at the top"], "path string, content string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    shared_paths(files.mapInArrow(counted, "path string, content string")).collect()
    assert seen.value == len(CASES["names at the top"])


def test_digests():
    one, two = (file_of(f"{n}/views.py", CALLS.format(n)) for n in ("one", "two"))
    assert one[1] == "one" and one[2:4] == two[2:4] and one[4:] == two[4:] and one[5] == ["flask", "os"]
    assert file_of("one/views.py", CALLS.format("two"))[2:4] != one[2:4]
    assert file_of("one/views2.py", CALLS.format("one"))[2:4] != one[2:4]
    assert file_of("abc/views.py", CALLS.format("abc"))[2:4] != one[2:4]  # flask comes after it, not before
    assert file_of("a.py", None) is None and file_of("/abc/views.py", CORE)[1] == ""
