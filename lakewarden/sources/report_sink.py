"""Reports as files, written by many tasks and committed at once: SARIF, JSON and HTML with every finding.

A task streams its rows into files of its own under ``_staging``, one for each project that it meets; no project is gathered
anywhere. Each file is a whole report. Only when all tasks are done the driver moves the files of those that count into place
(a task that ran twice leaves one staged file that nobody names), writes ``index.json`` and then ``_SUCCESS``. If the job fails
nothing is in place. The folder must be one that the driver and all executors see.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
import zlib
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import ship

STAGING, DONE = "_staging", "_SUCCESS"
SCHEMA = "project string, ordinal long, rule_id string, body string"
#: What stands before, between and after the rows of a file; the end may name the rules and the number of rows.
FORMATS = {
    "sarif": ('{"version":"2.1.0","runs":[{"results":[', ",\n", lambda rules, n, tool: f'],"tool":{{"driver":{{"name":{json.dumps(tool)},"rules":{json.dumps([{"id": r} for r in rules])}}}}}}}]}}'),
    "json": ('{"schema_version":"1.0","findings":[', ",\n", lambda rules, n, tool: f'],"total":{n},"rules":{json.dumps(rules)}}}'),
    "html": ("<!doctype html><html><head><meta charset='utf-8'><title>Findings</title></head><body><table>\n", "\n", lambda rules, n, tool: f"\n</table><p>{n} findings</p></body></html>\n"),
}


def file_name(project: str | None, job: str, task: int, ending: str) -> str:
    text = project or ""
    return f"{re.sub(r'[^A-Za-z0-9_.-]', '_', text)[:80]}-{zlib.crc32(text.encode()):08x}-{job[:8]}-{task:05}.{ending}"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, str | None, int]]  # staged, final, project, rows


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.format, self.tool, self.overwrite, self.job = options["path"], options.get("format", "sarif"), options.get("tool", "lakewarden"), overwrite, uuid.uuid4().hex
        if self.format not in FORMATS:
            raise ValueError(f"unknown format {self.format!r}; there are {', '.join(FORMATS)}")

    def write(self, iterator) -> Written:
        head, between, tail = FORMATS[self.format]
        folder, task = os.path.join(self.path, STAGING), TaskContext.get().partitionId()
        os.makedirs(folder, exist_ok=True)
        files, out, now = [], None, None

        def close():
            if out:
                out.write(tail(sorted(rules), n, self.tool))
                out.close()
                files.append((out.name, file_name(now, self.job, task, self.format), now, n))

        for row in iterator:
            if out is None or row.project != now:
                close()
                now, rules, n = row.project, set(), 0
                out = open(os.path.join(folder, f"{uuid.uuid4().hex}.{self.format}"), "w", encoding="utf-8")  # noqa: SIM115
                out.write(head)
            out.write((between if n else "") + row.body)
            rules.add(row.rule_id or "")
            n += 1
        close()
        return Written(files)

    def commit(self, messages) -> None:
        os.makedirs(self.path, exist_ok=True)
        old = [f for f in os.listdir(self.path) if f != STAGING] if self.overwrite else []
        if DONE in old:
            os.remove(os.path.join(self.path, DONE))  # from here on until the end the folder isn't whole
        files = [f for m in messages if m is not None for f in m.files]
        for staged, final, _, _ in files:
            os.replace(staged, os.path.join(self.path, final))
        for f in set(old) - {DONE, *(f[1] for f in files)}:
            os.remove(os.path.join(self.path, f))
        index = os.path.join(self.path, "index.json")
        known = [] if self.overwrite or not os.path.exists(index) else json.load(open(index, encoding="utf-8"))["files"]
        with open(f"{index}.new", "w", encoding="utf-8") as f:
            json.dump({"files": known + [{"file": name, "project": p, "findings": n} for _, name, p, n in sorted(files, key=lambda x: x[1])]}, f)
        os.replace(f"{index}.new", index)
        shutil.rmtree(os.path.join(self.path, STAGING), ignore_errors=True)
        open(os.path.join(self.path, DONE), "w").close()

    def abort(self, messages) -> None:
        shutil.rmtree(os.path.join(self.path, STAGING), ignore_errors=True)


class ReportSource(DataSource):
    """``df.write.format("lakewarden_report").option("format", "sarif").save(path)``; rows as in SCHEMA, in order."""

    @classmethod
    def name(cls) -> str:
        return "lakewarden_report"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(dict(self.options), overwrite)


def report_rows(findings: DataFrame, kind: str) -> DataFrame:
    """project, ordinal, rule_id and the text of every finding in a report of some format."""
    if kind == "sarif":
        level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
        place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
        body = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.coalesce("title", F.lit("")).alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints")))
    elif kind == "html":
        safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
        cells = [F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in (F.col("risk_score"), F.col("severity"), F.col("rule_id"), F.concat_ws(":", "file_path", F.col("line").cast("string")), F.col("title"))]
        body = F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))
    else:
        body = F.to_json(F.struct("rule_id", "severity", "confidence", "file_path", "line", "title", "risk_score", "fingerprint"))
    return findings.select(F.col("project").cast("string").alias("project"), F.col("ordinal").cast("long").alias("ordinal"), "rule_id", body.alias("body"))


def write_report(findings: DataFrame, path: str, kind: str = "sarif", parts: int | None = None, overwrite: bool = True) -> None:
    """Whole reports of all findings: rows are dealt by ranges of project and ordinal, so a large project has several files."""
    spark = findings.sparkSession
    ship(spark)
    spark.dataSource.register(ReportSource)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = report_rows(findings, kind).repartitionByRange(n, "project", "ordinal").sortWithinPartitions("project", "ordinal")
    rows.write.format("lakewarden_report").option("format", kind).mode("overwrite" if overwrite else "append").save(path)
