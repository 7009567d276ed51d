"""Renderers of small aggregates on the driver, behind a registry; exit codes, artifacts, graphs as text, log lines."""

from __future__ import annotations

import html
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import SEVERITIES, SEVERITY_RANK
from . import report

REPORTERS: dict[str, Callable[[DataFrame], str]] = {}


def reporter(name: str):
    """Registers a renderer (findings -> text) under a name."""

    def register(f: Callable[[DataFrame], str]):
        REPORTERS[name] = f
        return f

    return register


def render(findings: DataFrame, name: str) -> str:
    if name not in REPORTERS:
        raise ValueError(f"unknown format {name!r}; there are {', '.join(sorted(REPORTERS))}")
    return REPORTERS[name](findings)


def _summary(findings: DataFrame, k: int = 20) -> tuple[dict[str, int], list]:
    """Counts by severity and the k riskiest rows: all that reaches the driver."""
    counts = {r.severity: r["count"] for r in findings.groupBy("severity").count().collect()}
    return counts, findings.orderBy(F.desc("risk_score"), "ordinal").limit(k).collect()


def _shown(counts: dict[str, int], top: list) -> str:
    return f"{len(top)} of {sum(counts.values())} findings, the riskiest first (write_report writes all)"


@reporter("terminal")
def terminal(findings: DataFrame) -> str:
    counts, top = _summary(findings)
    lines = ["  ".join(f"{s} {counts.get(s, 0)}" for s in SEVERITIES), _shown(counts, top)]
    return "\n".join([*lines, *(f"{r.risk_score:5.1f}  {r.severity:<8}  {r.rule_id:<12}  {r.file_path}:{r.line}  {r.title}" for r in top)]) + "\n"


@reporter("html")
def page(findings: DataFrame) -> str:
    counts, top = _summary(findings)
    cell = lambda v: f"<td>{html.escape(str(v))}</td>"
    head = "".join(f"<tr>{cell(s)}{cell(counts.get(s, 0))}</tr>" for s in SEVERITIES)
    rows = "".join(f"<tr>{cell(r.risk_score)}{cell(r.severity)}{cell(r.rule_id)}{cell(f'{r.file_path}:{r.line}')}{cell(r.title)}</tr>" for r in top)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Findings</title></head><body><h1>Findings</h1><table>{head}</table><p>{_shown(counts, top)}</p><table>{rows}</table></body></html>\n"


@reporter("markdown")
def _markdown(findings: DataFrame) -> str:
    return report.markdown(findings)


@reporter("json")
def as_json(findings: DataFrame) -> str:
    counts, top = _summary(findings)
    return json.dumps({"schema_version": "1.0", "severity": {s.lower(): counts.get(s, 0) for s in SEVERITIES}, "total": sum(counts.values()), "shown": len(top), "top": [{"rule": r.rule_id, "severity": r.severity, "file": r.file_path, "line": r.line, "risk": r.risk_score} for r in top]}, sort_keys=True)


def exit_code(findings: DataFrame, fail_on: str = "HIGH", failed: bool = False) -> int:
    """0, 1 where a finding is as severe as the threshold, 2 where the analysis itself failed."""
    if failed:
        return 2
    hit = [s for s, r in SEVERITY_RANK.items() if r >= SEVERITY_RANK[fail_on.upper()]]
    return int(not findings.where(F.col("severity").isin(hit) & (F.col("state") != "SUPPRESSED")).isEmpty())


def write_artifacts(findings: DataFrame, folder: str, fail_on: str = "HIGH") -> int:
    """SARIF and full JSON lines as Spark writes them, a Markdown summary beside; the exit code.

    The folder is any that Spark reaches; the summary goes there by Spark too, as one row of text.
    """
    report.sarif(findings).select("sarif").write.mode("overwrite").text(os.path.join(folder, "sarif"))
    findings.write.mode("overwrite").json(os.path.join(folder, "findings"))
    findings.sparkSession.createDataFrame([(report.markdown(findings),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(folder, "summary"))
    return exit_code(findings, fail_on)


def write_baseline(findings: DataFrame, path: str) -> None:
    """The fingerprints that a later run compares with, each once."""
    findings.select("fingerprint", "rule_id", "severity", "file_path").dropDuplicates(["fingerprint"]).write.mode("overwrite").json(path)


def upsert_comments(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Comments by key: a new body replaces the old one, others stay; ``action`` says which."""
    n = new.select(*keys, F.col("body").alias("_new"))
    j = old.select(*keys, "body").join(n, keys, "full_outer")
    action = F.when(F.col("body").isNull(), "CREATE").when(F.col("_new").isNull() | (F.col("_new") == F.col("body")), "KEEP").otherwise("UPDATE")
    return j.select(*keys, F.coalesce("_new", "body").alias("body"), action.alias("action"))


def dot(edges: DataFrame) -> DataFrame:
    """Lines of a DOT graph in order: a table, as a graph's size has no bound."""
    name = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    body = edges.select("src", "dst").distinct().select(F.lit(1).alias("part"), F.concat(F.lit("  "), name("src"), F.lit(" -> "), name("dst"), F.lit(";")).alias("line"))
    ends = edges.sparkSession.createDataFrame([(0, "digraph G {"), (2, "}")], "part int, line string")
    return ends.unionByName(body).orderBy("part", "line").select("line")


def tree(edges: DataFrame, root: str, depth: int = 10, most: int = 10_000) -> str:
    """A dependency tree as indented text; a package's second place is marked and not opened again.

    Levels below the root are found on the executors; a tree of more than ``most`` lines raises instead of being cut.
    """
    from .graph import levels

    starts = edges.sparkSession.createDataFrame([(root,)], "node string")
    near = levels(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")), starts, depth).select(F.col("node").alias("src"))
    rows = edges.join(near, "src", "left_semi").select("src", "dst").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the tree has more than {most} edges")
    below: dict[str, list[str]] = {}
    for r in sorted(rows):
        below.setdefault(str(r.src), []).append(str(r.dst))
    lines, seen = [root], {root}

    def show(node: str, level: int) -> None:
        for child in below.get(node, ()) if level < depth else ():
            lines.append("  " * (level + 1) + child + (" (*)" if child in seen else ""))
            if child not in seen:
                seen.add(child)
                show(child, level + 1)

    show(root, 0)
    return "\n".join(lines) + "\n"


class Redacting(logging.Filter):
    """Takes assigned secrets and known ones out of log records, on the driver and in workers alike."""

    def __init__(self, known: tuple[str, ...] = ()):
        super().__init__()
        import re

        from ..functions.redaction import LOG_PATTERNS, REPORT_PATTERNS

        self.known = [k for k in known if len(k) > 3]
        self.patterns = [(re.compile(p), shown.replace("$1", r"\1").replace("$2", r"\2")) for p, shown in (*REPORT_PATTERNS, *LOG_PATTERNS)]

    def clean(self, text: str) -> str:
        for k in self.known:
            text = text.replace(k, "[REDACTED_SECRET]")
        for p, shown in self.patterns:
            text = p.sub(shown, text)
        return text

    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = self.clean(record.getMessage()), ()
        return True


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"level": record.levelname, "logger": record.name, "message": record.getMessage(), **getattr(record, "fields", {})}, sort_keys=True)


def logger(name: str, known: tuple[str, ...] = ()) -> logging.Logger:
    """A logger of JSON lines that holds no secrets."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(JsonLines())
        handler.addFilter(Redacting(known))
        log.addHandler(handler)
    return log
