"""Policy: severity overrides, suppressions, gates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import SEVERITY_WEIGHT, severity_weight


@dataclass
class Policy:
    """A policy file: its size is that of a hand-written document, so it becomes expressions."""

    overrides: dict[str, str] = field(default_factory=dict)  # rule -> severity
    suppressions: list[dict] = field(default_factory=list)  # rule_id, fingerprint, file, expires_at, reason
    fail_on: str = "HIGH"
    max_critical: int = 0
    max_high: int = 5
    max_risk: float = 75.0


def apply_policy(findings: DataFrame, policy: Policy, today: str) -> DataFrame:
    """Overridden severities, suppressed states and the reason of the first suppression that fits."""
    sev = F.col("severity")
    for rule, s in policy.overrides.items():
        sev = F.when(F.col("rule_id") == rule, F.lit(s)).otherwise(sev)
    why = F.lit(None).cast("string")
    for s in reversed(policy.suppressions):  # the first that fits is the outermost
        if s.get("expires_at") and today > s["expires_at"]:
            continue
        fits = F.lit(True)
        if s.get("rule_id"):
            fits = fits & (F.col("rule_id") == s["rule_id"])
        if s.get("fingerprint"):
            fits = fits & (F.col("fingerprint") == s["fingerprint"])
        if s.get("file"):
            fits = fits & F.contains("file_path", F.lit(s["file"]))
        why = F.when(fits, F.lit(s.get("reason", "Policy Exception"))).otherwise(why)
    out = findings.withColumn("severity", sev).withColumn("suppressed_by", why)
    return out.withColumn("state", F.when(F.col("suppressed_by").isNotNull(), F.lit("SUPPRESSED")).otherwise(F.col("state")))


def gate(findings: DataFrame, policy: Policy, *keys) -> DataFrame:
    """Counts over unsuppressed findings, and whether the gate passes."""
    open_ = F.col("state") != "SUPPRESSED"
    out = findings.groupBy(*keys).agg(
        F.count_if(open_ & (severity_weight(F.col("severity")) >= SEVERITY_WEIGHT[policy.fail_on])).alias("over_threshold"),
        F.count_if(open_ & (F.col("severity") == "CRITICAL")).alias("critical"),
        F.count_if(open_ & (F.col("severity") == "HIGH")).alias("high"),
        F.max(F.when(open_, F.col("risk_score"))).alias("max_risk"),
    )
    fails = (F.col("over_threshold") > 0) | (F.col("critical") > policy.max_critical) | (F.col("high") > policy.max_high) | (F.coalesce("max_risk", F.lit(0.0)) > policy.max_risk)
    return out.withColumn("passed", ~fails)
