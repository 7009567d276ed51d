"""Queries over findings: duplicates, risk, policy, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff, policy, risk
from ..operators import findings as O
from .base import FINDINGS, findings, table

POLICY = policy.Policy(
    overrides={"R3": "LOW"},
    suppressions=[
        {"rule_id": "R1", "file": "web/", "reason": "accepted"},
        {"file": "core/auth", "expires_at": "2023-01-01", "reason": "expired"},
        {"rule_id": "R2", "expires_at": "2030-01-01", "reason": "until 2030"},
    ],
)
TODAY = "2024-06-01"
HALF = "ts < timestamp '2024-01-16'"


def finding_fingerprint(spark, sf):
    return findings(spark, sf).select("ordinal", "fingerprint", O.stable_fingerprint().alias("stable_fp"))


def finding_dedup_first(spark, sf):
    return O.dedup_first(findings(spark, sf), F.concat_ws(":", "rule_id", "file_path"), "ordinal").select("ordinal", "rule_id", "file_path", "severity")


def finding_dedup_best(spark, sf):
    return O.dedup_best(findings(spark, sf), F.concat_ws(":", "rule_id", "file_path"), "ordinal").select("ordinal", "rule_id", "file_path", "duplicates")


def filter_sort_limit(spark, sf):
    f = O.filter_findings(findings(spark, sf), severity="critical", component="API", search="R1")
    return O.sort_findings(f, "risk").limit(25).select("ordinal", "rule_id", "file_path", "risk_score")


def remediation_topk(spark, sf):
    return O.remediation_priorities(findings(spark, sf), 10).select("priority", "ordinal", "risk_score")


def finding_clusters(spark, sf):
    return O.clusters(findings(spark, sf))


def risk_score(spark, sf):
    return findings(spark, sf).select("ordinal", "risk_score")


def scan_risk_grade(spark, sf):
    return risk.scan_risk(findings(spark, sf), "file_path", "rule_id")


def posture_topk(spark, sf):
    return risk.posture(findings(spark, sf), "project")


def security_score(spark, sf):
    return risk.security_score(findings(spark, sf), "file_path", "rule_id")


def severity_pivot(spark, sf):
    return risk.severity_pivot(findings(spark, sf), "state")


def component_metrics(spark, sf):
    return risk.component_metrics(findings(spark, sf))


def risk_metrics(spark, sf):
    return risk.risk_metrics(findings(spark, sf))


def language_profile(spark, sf):
    return risk.language_profile(table(spark, sf, "documents"), "lang", "n_chars")


def suppression_apply(spark, sf):
    return policy.apply_policy(findings(spark, sf), POLICY, TODAY).select("ordinal", "severity", "state", "suppressed_by")


def policy_gate(spark, sf):
    return policy.gate(policy.apply_policy(findings(spark, sf), POLICY, TODAY), POLICY, "project")


def _halves(spark, sf):
    f = findings(spark, sf).withColumn("fingerprint", O.stable_fingerprint())
    return f.where(HALF), f.where(f"not ({HALF})")


def baseline_apply(spark, sf):
    old, new = _halves(spark, sf)
    out = diff.apply_baseline(new, old.where("state <> 'RESOLVED'"), old.where("state = 'RESOLVED'"))
    return out.select("ordinal", "fingerprint", "state")


def snapshot_diff(spark, sf):
    old, new = _halves(spark, sf)
    return diff.compare_snapshots(old, new, "fingerprint")


def pr_delta(spark, sf):
    old, new = _halves(spark, sf)
    d = diff.compare_snapshots(old, new, "fingerprint").groupBy("change").count()
    return d.select("change", F.col("count").alias("n"))


def trend_lag(spark, sf):
    daily = findings(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    scores = risk.security_score(daily, "file_path", "day").select("file_path", "day", "security_score")
    return diff.trend(scores, ["file_path"], "day", "security_score").select("file_path", "day", "security_score", F.col("delta").cast("double").alias("delta"), "trend")


QUERIES = {f.__name__: f for f in (finding_fingerprint, finding_dedup_first, finding_dedup_best, filter_sort_limit, remediation_topk, finding_clusters, risk_score, scan_risk_grade, posture_topk, security_score, severity_pivot, component_metrics, risk_metrics, language_profile, suppression_apply, policy_gate, baseline_apply, snapshot_diff, pr_delta, trend_lag)}

_STABLE = "sha256(concat_ws(':', rule_id, file_path, title, coalesce(evidence, '')))"
_SEV = "count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'INFO') AS info"
_SCORE = "greatest(0, 100 - sum(CASE severity WHEN 'CRITICAL' THEN 15 WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 1 ELSE 0 END))::BIGINT"
_COMPONENT = "CASE WHEN coalesce(file_path, '') = '' THEN 'default' WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE 'root' END"
_POLICY = """, pol AS (
  SELECT * REPLACE (CASE WHEN rule_id = 'R3' THEN 'LOW' ELSE severity END AS severity),
    CASE WHEN rule_id = 'R1' AND contains(file_path, 'web/') THEN 'accepted' WHEN rule_id = 'R2' THEN 'until 2030' END AS suppressed_by FROM findings),
applied AS (SELECT * REPLACE (CASE WHEN suppressed_by IS NOT NULL THEN 'SUPPRESSED' ELSE state END AS state) FROM pol)
"""
_HALVES = f""", old AS (SELECT *, {_STABLE} AS fp FROM findings WHERE {HALF}), new AS (SELECT *, {_STABLE} AS fp FROM findings WHERE NOT ({HALF})),
j AS (SELECT coalesce(a.fp, b.fp) AS fingerprint, CASE WHEN a.fp IS NULL THEN 'NEW' WHEN b.fp IS NULL THEN 'FIXED' ELSE 'EXISTING' END AS change
  FROM (SELECT DISTINCT fp FROM old) a FULL JOIN (SELECT DISTINCT fp FROM new) b ON a.fp = b.fp)
"""

SQL = {
    "finding_fingerprint": f"{FINDINGS} SELECT ordinal, fingerprint, {_STABLE} AS stable_fp FROM findings",
    "finding_dedup_first": f"{FINDINGS} SELECT ordinal, rule_id, file_path, severity FROM findings QUALIFY row_number() OVER (PARTITION BY rule_id, file_path ORDER BY ordinal) = 1",
    "finding_dedup_best": f"{FINDINGS} SELECT ordinal, rule_id, file_path, count(*) OVER (PARTITION BY rule_id, file_path) - 1 AS duplicates FROM findings QUALIFY row_number() OVER (PARTITION BY rule_id, file_path ORDER BY flow DESC, weight DESC, mult DESC, ordinal) = 1",
    "filter_sort_limit": f"{FINDINGS} SELECT ordinal, rule_id, file_path, risk_score FROM findings WHERE severity = 'CRITICAL' AND contains(lower({_COMPONENT}), 'api') AND (contains(lower(title), 'r1') OR contains(lower(rule_id), 'r1') OR contains(lower(file_path), 'r1')) ORDER BY risk_score DESC, ordinal LIMIT 25",
    "remediation_topk": f"{FINDINGS} SELECT row_number() OVER (ORDER BY risk_score DESC, ordinal)::INT AS priority, ordinal, risk_score FROM findings WHERE state NOT IN ('SUPPRESSED', 'RESOLVED') ORDER BY risk_score DESC, ordinal LIMIT 10",
    "finding_clusters": f"{FINDINGS} SELECT file_path, line, rule_id, count(*) AS members, arg_min(title, ordinal) AS title, arg_max(severity, weight) AS top_severity FROM findings GROUP BY ALL",
    "risk_score": f"{FINDINGS} SELECT ordinal, risk_score FROM findings",
    "scan_risk_grade": f"{FINDINGS}, s AS (SELECT file_path, rule_id, round(10.0 * (1 - exp(-sum(weight * mult) / 25.0)), 2) AS score FROM findings GROUP BY ALL) SELECT file_path, rule_id, score, CASE WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' WHEN score >= 1 THEN 'LOW' ELSE 'INFO' END AS grade FROM s",
    "posture_topk": f"{FINDINGS}, top AS (SELECT project, least(100.0, round(sum(risk_score * CASE WHEN r = 1 THEN 0.5 ELSE 0.125 END), 1)) AS project_risk FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY risk_score DESC, ordinal) AS r FROM findings WHERE state <> 'SUPPRESSED') WHERE r <= 5 GROUP BY project) SELECT project, count(*) AS total, {_SEV}, count(*) FILTER (state = 'SUPPRESSED') AS suppressed, coalesce(any_value(project_risk), 0.0) AS project_risk FROM findings LEFT JOIN top USING (project) GROUP BY project",
    "security_score": f"{FINDINGS} SELECT file_path, rule_id, {_SCORE} AS security_score, round(sum(risk_score), 1) AS total_risk FROM findings GROUP BY ALL",
    "severity_pivot": f"{FINDINGS} SELECT state, {_SEV} FROM findings GROUP BY state",
    "component_metrics": f"{FINDINGS} SELECT {_COMPONENT} AS component, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, round(max(risk_score), 1) AS max_risk FROM findings GROUP BY 1",
    "risk_metrics": f"{FINDINGS} SELECT max(risk_score) AS max_risk, round(avg(risk_score), 1) AS avg_risk, count(DISTINCT file_path) AS files, count(DISTINCT rule_id) AS rules FROM findings",
    "language_profile": "SELECT coalesce(lang, 'unknown') AS language, count(*) AS files, sum(n_chars)::BIGINT AS size, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS percent FROM documents GROUP BY 1",
    "suppression_apply": f"{FINDINGS}{_POLICY} SELECT ordinal, severity, state, suppressed_by FROM applied",
    "policy_gate": f"{FINDINGS}{_POLICY}, g AS (SELECT project, count(*) FILTER (state <> 'SUPPRESSED' AND severity IN ('CRITICAL','HIGH')) AS over_threshold, count(*) FILTER (state <> 'SUPPRESSED' AND severity = 'CRITICAL') AS critical, count(*) FILTER (state <> 'SUPPRESSED' AND severity = 'HIGH') AS high, max(risk_score) FILTER (state <> 'SUPPRESSED') AS max_risk FROM applied GROUP BY project) SELECT *, NOT (over_threshold > 0 OR critical > 0 OR high > 5 OR coalesce(max_risk, 0) > 75) AS passed FROM g",
    "baseline_apply": f"{FINDINGS}{_HALVES} SELECT ordinal, fp AS fingerprint, CASE WHEN fp IN (SELECT fp FROM old WHERE state <> 'RESOLVED') THEN 'EXISTING' WHEN fp IN (SELECT fp FROM old WHERE state = 'RESOLVED') THEN 'REOPENED' ELSE 'NEW' END AS state FROM new",
    "snapshot_diff": f"{FINDINGS}{_HALVES} SELECT fingerprint, change FROM j",
    "pr_delta": f"{FINDINGS}{_HALVES} SELECT change, count(*) AS n FROM j GROUP BY change",
    "trend_lag": f"{FINDINGS}, d AS (SELECT file_path, strftime(ts, '%Y-%m-%d') AS day, {_SCORE} AS security_score FROM findings GROUP BY 1, 2), l AS (SELECT *, (security_score - lag(security_score) OVER (PARTITION BY file_path ORDER BY day))::DOUBLE AS delta FROM d) SELECT file_path, day, security_score, delta, CASE WHEN delta > 1 THEN 'improving' WHEN delta < -1 THEN 'degrading' ELSE 'stable' END AS trend FROM l",
}
