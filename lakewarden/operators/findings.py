"""Findings: fingerprints, duplicates, filters, clusters, remediation order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import CONFIDENCE_RANK, confidence_multiplier, is_flow, lookup, severity_rank, severity_weight


def fingerprint() -> Column:
    """Identity of a finding at its place."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.sha2(F.concat_ws(":", text("rule_id"), text("file_path"), text("line"), text("source"), text("sink"), text("title")), 256)


def stable_fingerprint() -> Column:
    """Identity that survives moved lines."""
    return F.sha2(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("rule_id", "file_path", "title", "evidence"))), 256)


def union_findings(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dedup_first(findings: DataFrame, key: Column, *order) -> DataFrame:
    """Of equal keys the first in the given order stays; partially aggregated, so a hot key is no task's."""
    cols = findings.columns
    first = findings.withColumn("_k", key).groupBy("_k").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return first.select("_r.*")


def dedup_best(findings: DataFrame, key: Column, ordinal: str) -> DataFrame:
    """Of equal keys the strongest stays (flows, then severity, then confidence; ties: the earliest).

    ``duplicates`` counts the merged others.
    """
    cols = findings.columns
    strength = F.struct(is_flow(F.col("category")).alias("flow"), severity_weight(F.col("severity")).alias("w"), confidence_multiplier(F.col("confidence")).alias("m"), (-F.col(ordinal)).alias("o"))
    best = findings.withColumn("_k", key).groupBy("_k").agg(F.max_by(F.struct(*cols), strength).alias("_r"), (F.count("*") - 1).alias("duplicates"))
    return best.select("_r.*", "duplicates")


def filter_findings(findings: DataFrame, severity=None, category=None, status=None, confidence=None, component=None, file=None, search=None) -> DataFrame:
    """Equality in upper case, substrings in lower case, all of them; search: any of title, rule, file."""
    out = findings
    for name, v in (("severity", severity), ("category", category), ("state", status), ("confidence", confidence)):
        if v:
            out = out.where(F.col(name) == v.upper())
    for col, v in ((component_of(F.col("file_path")), component), (F.col("file_path"), file)):
        if v:
            out = out.where(F.contains(F.lower(col), F.lit(v.lower())))
    if search:
        hit = F.lit(False)
        for c in ("title", "rule_id", "file_path"):
            hit = hit | F.contains(F.lower(F.col(c)), F.lit(search.lower()))
        out = out.where(hit)
    return out


def sort_findings(findings: DataFrame, by: str = "risk", ordinal: str = "ordinal") -> DataFrame:
    keys = {
        "risk": [F.desc("risk_score")],
        "severity": [severity_rank(F.col("severity")).desc()],
        "confidence": [lookup(F.col("confidence"), CONFIDENCE_RANK, 0).desc()],
        "file": [F.asc("file_path"), F.asc("line")],
    }
    return findings.orderBy(*keys[by], ordinal)


def component_of(path: Column) -> Column:
    """First path segment; ``root`` where there is one segment only, ``default`` where there is none."""
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("default")).when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit("root"))


def remediation_priorities(findings: DataFrame, k: int = 10, ordinal: str = "ordinal") -> DataFrame:
    """The k riskiest open findings, numbered from 1: a bounded sort, then numbers over k rows."""
    top = findings.where("state not in ('SUPPRESSED', 'RESOLVED')").orderBy(F.desc("risk_score"), ordinal).limit(k)
    return top.withColumn("priority", F.row_number().over(W.orderBy(F.desc("risk_score"), ordinal)))


def clusters(findings: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Findings at one place and of one rule, with their number and top severity."""
    return findings.groupBy("file_path", "line", "rule_id").agg(
        F.count("*").alias("members"),
        F.min_by("title", ordinal).alias("title"),
        F.max_by("severity", severity_rank(F.col("severity"))).alias("top_severity"),
    )


def root_cause(rule_id: Column) -> Column:
    """The role of a rule in a chain, by its id."""
    text = F.upper(rule_id)
    has = lambda *words: text.rlike("|".join(words))
    return F.when(has("SECRET"), F.lit("CREDENTIAL")).when(has("TAINT", "AST", "CODE"), F.lit("CODE")).when(has("VULN", "DEP", "SUPPLY"), F.lit("DEPENDENCY")).when(has("IAC", "DOCKER", "K8S"), F.lit("INFRASTRUCTURE")).otherwise(F.lit("OTHER"))
