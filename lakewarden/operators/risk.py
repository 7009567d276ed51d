"""Risk of findings, scans and projects; roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import CRITICAL_PATHS, EXPOSURE_BONUS, REACHABILITY_BONUS, SEVERITIES, SEVERITY_BASE, confidence_multiplier, is_flow, lookup, severity_weight
from .findings import component_of


def finding_risk() -> Column:
    """0 to 100: severity times confidence, plus reachability, exposure, flow and critical-path bonuses."""
    flow = is_flow(F.col("category")) | (F.col("source").isNotNull() & F.col("sink").isNotNull())
    total = (
        lookup(F.col("severity"), SEVERITY_BASE, 10.0) * confidence_multiplier(F.col("confidence"))
        + lookup(F.col("reachability"), REACHABILITY_BONUS, 0.0)
        + lookup(F.col("exposure"), EXPOSURE_BONUS, 0.0)
        + F.when(flow, 15.0).otherwise(0.0)
        + F.when(F.lower("file_path").rlike("|".join(CRITICAL_PATHS)), 10.0).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(total, 1)))


def grade(score: Column) -> Column:
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score >= 1, "LOW").otherwise("INFO")


def scan_risk(findings: DataFrame, *keys) -> DataFrame:
    """Saturating risk 10 (1 - e^(-sum/25)) and its grade per group."""
    w = F.sum(severity_weight(F.col("severity")) * confidence_multiplier(F.col("confidence")))
    out = findings.groupBy(*keys).agg(F.round(F.lit(10.0) * (1 - F.exp(-w / 25.0)), 2).alias("score"))
    return out.withColumn("grade", grade(F.col("score")))


def posture(findings: DataFrame, *keys) -> DataFrame:
    """Half the top risk and an eighth of each of the next four, at most 100, over unsuppressed findings.

    Counts are plain aggregates; only the five best of a group pass the window (a rank limit is pushed
    below its shuffle).
    """
    open_ = findings.where("state <> 'SUPPRESSED'")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("risk_score"), "ordinal"))
    top = open_.withColumn("r", rank).where("r <= 5").groupBy(*keys)
    top = top.agg(F.least(F.lit(100.0), F.round(F.sum(F.col("risk_score") * F.when(F.col("r") == 1, 0.5).otherwise(0.125)), 1)).alias("project_risk"))
    counts = findings.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES), F.count_if(F.col("state") == "SUPPRESSED").alias("suppressed"))
    return counts.join(top, list(keys), "left").withColumn("project_risk", F.coalesce("project_risk", F.lit(0.0)))


def security_score(findings: DataFrame, *keys) -> DataFrame:
    """100 less 15, 8, 3 and 1 for a critical, high, medium and low finding; at least 0."""
    off = F.sum(F.when(F.col("severity") == "CRITICAL", 15).when(F.col("severity") == "HIGH", 8).when(F.col("severity") == "MEDIUM", 3).when(F.col("severity") == "LOW", 1).otherwise(0))
    return findings.groupBy(*keys).agg(F.greatest(F.lit(0), 100 - off).cast("long").alias("security_score"), F.round(F.sum(F.coalesce("risk_score", F.lit(5.0))), 1).alias("total_risk"))


def severity_pivot(findings: DataFrame, *keys) -> DataFrame:
    return findings.groupBy(*keys).agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES))


def component_metrics(findings: DataFrame) -> DataFrame:
    return (
        findings.groupBy(component_of(F.col("file_path")).alias("component"))
        .agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"), F.round(F.max("risk_score"), 1).alias("max_risk"))
    )


def risk_metrics(findings: DataFrame) -> DataFrame:
    return findings.agg(F.max("risk_score").alias("max_risk"), F.round(F.avg("risk_score"), 1).alias("avg_risk"), F.countDistinct("file_path").alias("files"), F.countDistinct("rule_id").alias("rules"))


def language_profile(files: DataFrame, lang: str, size: str) -> DataFrame:
    """Files, size and share of files of each language; shares are taken over one row per language."""
    by = files.groupBy(F.coalesce(F.col(lang), F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"), F.sum(size).alias("size"))
    return by.withColumn("percent", F.round(100.0 * F.col("files") / F.sum("files").over(W.partitionBy()), 1))


def confidence_score(direct: Column, on_path: Column, sanitised: Column, endpoint: Column) -> tuple[Column, Column]:
    """0.5 with bonuses and a penalty, clamped to 0..1, and its level."""
    on = lambda c, v: F.when(c, v).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + on(direct, 0.3) + on(on_path, 0.2) + on(endpoint, 0.2) - on(sanitised, 0.3)))
    return score, F.when(score >= 0.8, "HIGH").when(score >= 0.5, "MEDIUM").otherwise("LOW")
