import json

from pyspark.sql import functions as F

from lakewarden.operators import project as P
from lakewarden.operators import sca
from lakewarden.plans.base import findings
from lakewarden.sources import advisories as A


def test_advisories(spark, tmp_path):
    rec = {"id": "A-1", "details": "first\nsecond", "severity": [{"type": "CVSS_V3", "score": "CVSS:3.1/AV:L"}], "published": "2024-01-01T00:00:00Z", "affected": [{"package": {"name": "p"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "1.0.0"}, {"fixed": "2.0.0"}, {"introduced": "3.0.0"}, {"last_affected": "3.1.0"}]}]}]}
    r = A.parse_records(spark.createDataFrame([(json.dumps(rec),), ("{",)], "json string"))
    row = r.first()
    assert r.count() == 1 and (row.summary, row.cvss, row.withdrawn) == ("first", 7.5, None)
    assert A.fixed_versions(r).first().fixed == ["2.0.0"]
    deps = spark.createDataFrame([("p", v) for v in ("0.9.0", "1.5.0", "2.0.0", "3.1.0", "3.1.1")], "name string, version string")
    hit = sca.affected(deps, sca.intervals(A.interval_events(r)))
    assert sorted(x.version for x in hit.collect()) == ["1.5.0", "3.1.0"]
    folder = str(tmp_path / "db")
    A.publish(r.select("id"), folder)
    A.publish(r.select(F.lit("A-2").alias("id")), folder)
    assert A.current(spark, folder).first().id == "A-2"
    A.rollback(spark, folder)
    assert A.current(spark, folder).first().id == "A-1"


def test_projects(spark):
    rows = [("src/app.py", 10, "py", "from flask import Flask"), ("pyproject.toml", 5, "toml", ""), ("web/package.json", 7, "json", "{}"), ("logs/x.log", 1, "log", ""), ("a/b/c.tmp", 1, "tmp", None)]
    files = spark.createDataFrame(rows, "path string, size long, ext string, content string")
    s = P.project_stats(files).first()
    assert (s.files, s.bytes, s.python, s.config, s.languages, s.type, s.layout) == (5, 24, 1, 2, ["JAVASCRIPT", "PYTHON"], "FLASK", "SRC")
    kept = P.ignored(files, spark.createDataFrame([("*.tmp", 1), ("logs", 2)], "glob string, tier int"))
    assert {r.path for r in kept.collect()} == {"src/app.py", "pyproject.toml", "web/package.json"}


def test_pull_requests(spark):
    f = spark.createDataFrame([(1, "base", "a", "HIGH"), (1, "head", "b", "CRITICAL"), (1, "head", "b", "CRITICAL"), (2, "base", "a", "LOW"), (2, "head", "a", "LOW")], "pr int, side string, fingerprint string, severity string")
    c = spark.createDataFrame([(1, "x/poetry.lock"), (2, "a.py")], "pr int, path string")
    got = {r.pr: (r.introduced, r.resolved, r.worst, r.touches_dependencies, r.risk_class) for r in P.pull_request_summary(c, f).collect()}
    assert got == {1: (1, 1, "CRITICAL", True, "CRITICAL"), 2: (0, 0, None, False, "NONE")}


def test_correlation(spark, sf):
    f = findings(spark, sf)
    e = P.exposure(f, spark.createDataFrame([("web/mod1.py",)], "path string"))
    assert {(r.file_path == "web/mod1.py") == (r.exposure == "INTERNET_FACING") for r in e.collect()} == {True}
    p = P.two_step_paths(f)
    assert p.count() == f.where("source is not null and sink is not null").count() and {r.kind for r in p.collect()} == {"COMMAND_INJECTION"}
    d = spark.createDataFrame([("9.1.0", "10.0.1"), ("9.1.0", "9.2.0"), ("9.1.0", None)], "v string, p string")
    got = [tuple(r.x) for r in d.select(P.remediation(F.col("v"), F.col("p")).alias("x")).collect()]
    assert got == [("UPGRADE", "HIGH", "10.0.1"), ("UPGRADE", "LOW", "9.2.0"), ("MITIGATE", "NONE", "9.1.0")]
