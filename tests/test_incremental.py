"""Snapshots: equal to a full run after every kind of change, and no more read or followed than the change touches."""

import pytest

from lakewarden.operators.dataflow import labelled_paths
from lakewarden.operators.incremental import module_links, read_snapshot, snapshot
from lakewarden.plans import flows as P
from lakewarden.sources.def_use import def_use

SCHEMA = "path string, content string"


def package(i):
    view = (P._HEAD + P.VIEWS[i % len(P.VIEWS)][0]).replace("{}", str(i))
    return {f"pkg{i}/__init__.py": P.INIT, f"pkg{i}/api.py": P.API, f"pkg{i}/core.py": P.CORE, f"pkg{i}/views.py": view}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    files = {p: c for i in range(8) for p, c in package(i).items()} | {"alone.py": "import os\nos.system(request.args)\n", "big.py": "x = 1\n" * 900, "none.py": None}
    folder = str(tmp_path_factory.mktemp("snap"))
    snapshot(spark.createDataFrame(list(files.items()), SCHEMA), "1", budget=5000).write(folder)
    return files, read_snapshot(spark, folder)


def rows(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


def paths(df):
    return {r.path for r in df.collect()}


#: A helper becomes safe, two packages get linked, a file goes (...), one comes, one can't be read any more.
CHANGES = {
    "pkg0/core.py": P.CORE.replace("os.system(cmd)", "os.system(shlex.quote(cmd))"),
    "pkg1/views.py": "from pkg2.core import Runner\nRunner().run(request.form)\n",
    "pkg3/core.py": ...,
    "pkg4/more.py": "from pkg4 import fetch\neval(fetch())\n",
    "pkg5/views.py": "def (",
}


def test_equals_a_full_run(spark, base):
    files, old = base
    new = {p: c for p, c in (files | CHANGES).items() if c is not ...}
    df = spark.createDataFrame(list(new.items()), SCHEMA)
    got = snapshot(df, "1", old, budget=5000)
    assert rows(got.flows) == rows(labelled_paths(def_use(df.where("content is null or length(content) <= 5000"))))
    assert paths(got.parsed) == {p for p, c in CHANGES.items() if c is not ...}
    assert paths(got.followed) == {p for p in new if p.split("/")[0] in ("pkg0", "pkg1", "pkg2", "pkg3", "pkg4", "pkg5")}
    one = {p: c for p, c in new.items() if p != "pkg5/views.py"} | {"pkg5/views.py": files["pkg5/views.py"]}
    back = snapshot(spark.createDataFrame(list(one.items()), SCHEMA), "1", got, budget=5000)
    assert paths(back.parsed) == {"pkg5/views.py"} and paths(back.followed) == {p for p in one if p.startswith("pkg5/")}


def test_nothing_changed_and_new_rules(spark, base):
    files, old = base
    df = spark.createDataFrame(list(files.items()), SCHEMA)
    same = snapshot(df, "1", old, budget=5000)
    assert paths(same.parsed) == paths(same.followed) == set() and rows(same.flows) == rows(old.flows)
    other = snapshot(df, "2", old, budget=5000)
    assert paths(other.parsed) == set(files) and rows(other.flows) == rows(old.flows)
    assert {(r.path, r.limit) for r in other.limits.collect()} == {("big.py", "LIMIT")}


def test_links(spark, base):
    got = {(r.src, r.dst) for r in module_links(base[1].facts).collect()}
    assert ("pkg0/views.py", "pkg0/__init__.py") in got and ("pkg0/core.py", "pkg0/api.py") in got
    assert all((b, a) in got for a, b in got) and not any(a.split("/")[0] != b.split("/")[0] for a, b in got)
