"""Reports written by many tasks: all findings are in valid files, a failed job leaves what was there."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lakewarden.plans.base import findings
from lakewarden.sources.report_sink import FORMATS, write_report

SF = "/root/testdata/sf0.001"


def load(path):
    assert os.path.exists(f"{path}/_SUCCESS") and not os.path.exists(f"{path}/_staging")
    index = json.load(open(f"{path}/index.json"))["files"]
    assert {f["file"] for f in index} | {"index.json", "_SUCCESS"} == set(os.listdir(path))
    return index


def test_every_finding_is_in_one_valid_file(spark, tmp_path):
    f = findings(spark, SF)
    path = str(tmp_path / "sarif")
    write_report(f, path, "sarif", parts=5)
    got = []
    for e in load(path):
        run = json.load(open(f"{path}/{e['file']}"))["runs"][0]
        assert {r["ruleId"] for r in run["results"]} == {r["id"] for r in run["tool"]["driver"]["rules"]}
        assert len(run["results"]) == e["findings"]
        got += [(e["project"], r["partialFingerprints"]["primary"], r["level"]) for r in run["results"]]
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    assert sorted(got) == sorted(map(tuple, f.select(F.col("project").cast("string"), "fingerprint", level).collect()))


def test_html_and_json_hold_all_rows(spark, tmp_path):
    f = findings(spark, SF).withColumn("title", F.lit('<script>"x" & y'))
    n = f.count()
    for kind in ("html", "json"):
        path = str(tmp_path / kind)
        write_report(f, path, kind, parts=3)
        texts = [open(f"{path}/{e['file']}").read() for e in load(path)]
        if kind == "html":
            assert sum(t.count("<tr>") for t in texts) == n and not any("<script>" in t for t in texts)
        else:
            assert sum(json.loads(t)["total"] for t in texts) == n == sum(len(json.loads(t)["findings"]) for t in texts)
    with pytest.raises(Exception, match="unknown format"):
        write_report(f, str(tmp_path / "x"), "pdf")
    assert set(FORMATS) == {"sarif", "json", "html"}


def test_a_failed_job_changes_nothing_and_a_rerun_replaces(spark, tmp_path):
    f, path = findings(spark, SF), str(tmp_path / "r")
    write_report(f, path, "json", parts=4)
    before = {e["file"] for e in load(path)}
    bad = f.withColumn("title", F.when(F.col("ordinal") == f.agg(F.max("ordinal")).first()[0], F.raise_error(F.lit("broken"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="broken"):
        write_report(bad, path, "json", parts=4)
    assert {e["file"] for e in load(path)} == before
    write_report(f.where("project = 3"), path, "json", parts=4)
    now = load(path)
    assert not before & {e["file"] for e in now} and {e["project"] for e in now} == {"3"}
    write_report(f.where("project = 4"), path, "json", parts=2, overwrite=False)
    assert {e["project"] for e in load(path)} == {"3", "4"}


def test_a_project_of_half_a_million_findings_is_written_by_many_tasks(spark, tmp_path):
    one = findings(spark, SF).limit(1).drop("ordinal", "project")
    many = spark.range(500_000).select(F.lit(7).alias("project"), F.col("id").alias("ordinal")).join(F.broadcast(one))
    path = str(tmp_path / "big")
    write_report(many, path, "sarif", parts=8)
    index = load(path)
    assert len(index) == 8 and sum(e["findings"] for e in index) == 500_000 and max(e["findings"] for e in index) < 120_000
    json.load(open(f"{path}/{index[0]['file']}"))


def test_no_findings(spark, tmp_path):
    write_report(findings(spark, SF).limit(0), str(tmp_path / "none"))
    assert load(str(tmp_path / "none")) == []
