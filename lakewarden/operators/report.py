"""Sinks: SARIF and JSON reports as one aggregated row each, CSV, Markdown, an SBOM projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import SEVERITIES

CSV_COLUMNS = ("fingerprint", "rule_id", "severity", "confidence", "category", "title", "file_path", "line", "risk_score", "state", "evidence")


def sarif(findings: DataFrame, tool: str = "lakewarden") -> DataFrame:
    """One JSON row per project: results with levels, rules in order of id, partial fingerprints."""
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))
    rows = findings.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("ordinal", result.alias("r")))).alias("rs"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    run = F.struct(
        F.struct(F.struct(F.lit(tool).alias("name"), F.transform("rules", lambda r: F.struct(r.alias("id"))).alias("rules")).alias("driver")).alias("tool"),
        F.transform("rs", lambda x: x["r"].withField("ruleIndex", F.array_position("rules", x["r"]["ruleId"]) - 1)).alias("results"),
    )
    return rows.select("project", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def json_report(findings: DataFrame) -> DataFrame:
    counts = F.struct(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES))
    return findings.groupBy("project").agg(F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.count("*").alias("total"), counts.alias("severity"), F.max("risk_score").alias("max_risk"))).alias("report"))


def write_csv(findings: DataFrame, path: str) -> None:
    findings.select(*CSV_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def markdown(findings: DataFrame, k: int = 10) -> str:
    """A short summary; only the counts of severities and the k riskiest rows reach the driver."""
    counts = {r.severity: r["count"] for r in findings.groupBy("severity").count().collect()}
    top = findings.orderBy(F.desc("risk_score"), "ordinal").limit(k).collect()
    lines = ["# Findings", "", f"{len(top)} of {sum(counts.values())} findings, the riskiest first.", "", "| severity | count |", "|-|-|", *(f"| {s} | {counts.get(s, 0)} |" for s in SEVERITIES), "", "| risk | rule | place |", "|-|-|-|"]
    return "\n".join([*lines, *(f"| {r.risk_score} | {r.rule_id} | {r.file_path}:{r.line} |" for r in top)]) + "\n"


def annotations(findings: DataFrame, k: int = 50) -> DataFrame:
    """The k riskiest findings with messages of at most 1000 characters."""
    top = findings.orderBy(F.desc("risk_score"), "ordinal").limit(k)
    return top.select("ordinal", "file_path", "line", F.when(F.col("severity").isin("CRITICAL", "HIGH"), "failure").when(F.col("severity") == "MEDIUM", "warning").otherwise("notice").alias("level"), F.left(F.col("title"), F.lit(1000)).alias("message"))


def sbom(deps: DataFrame) -> DataFrame:
    """Components as package urls."""
    return deps.select(F.concat(F.lit("pkg:"), "ecosystem", F.lit("/"), F.lower("name"), F.coalesce(F.concat(F.lit("@"), "version"), F.lit(""))).alias("purl"), F.when(F.col("is_direct"), "direct").otherwise("transitive").alias("relation")).distinct()
