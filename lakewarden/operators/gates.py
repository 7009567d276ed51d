"""Gates and views over findings: profiles with exceptions, thresholds, categories, invariants, facade shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import SEVERITY_RANK, severity_rank

#: Policy, severity that it counts, least risk score.
PROFILE = (("POL-NO-CRITICAL", "CRITICAL", None), ("POL-NO-HIGH-RISK", None, 8.0), ("POL-NO-SECRETS", None, None))


def evaluate_profile(findings: DataFrame, keys: list[str], risk: Column, exceptions: list[tuple[str, str]], now: str, profile=PROFILE) -> DataFrame:
    """status, passed, failed, exit code and violations; ``exceptions`` (policy, expires at) excuse until they expire."""
    excused = {p for p, until in exceptions if until > now}
    g = findings.groupBy(*keys).agg(risk.alias("risk"), *(F.count_if(F.col("severity") == s).alias(f"_{p}") for p, s, _ in ((p.replace("-", "_"), s, r) for p, s, r in profile) if s))
    broken = {p: (F.col(f"_{p.replace('-', '_')}") >= 1) if s else (F.col("risk") >= r) if r is not None else F.lit(False) for p, s, r in profile}
    failed = sum((F.when(b & F.lit(p not in excused), 1).otherwise(0) for p, b in broken.items()), F.lit(0))
    out = g.withColumn("failed", failed.cast("int")).withColumn("violations", F.array_compact(F.array(*(F.when(b, p) for p, b in broken.items()))))
    return out.select(*keys, F.when(F.col("failed") > 0, "FAIL").otherwise("PASS").alias("status"), (F.lit(len(profile)) - F.col("failed")).alias("passed"), "failed", F.when(F.col("failed") > 0, 1).otherwise(0).alias("exit_code"), F.array_join("violations", ",").alias("violations"))


def threshold_gate(findings: DataFrame, keys: list[str], fail_on: str, project_risk: Column) -> DataFrame:
    """Exit code 1 where a finding is as severe as the threshold, or the project's risk is 80 and the threshold HIGH or less."""
    rank = SEVERITY_RANK.get(fail_on.upper(), SEVERITY_RANK["HIGH"])
    g = findings.groupBy(*keys).agg(F.max(severity_rank(F.col("severity"))).alias("worst"), project_risk.alias("risk"))
    return g.select(*keys, F.when((F.col("worst") >= rank) | ((F.col("risk") >= 80) & F.lit(rank <= SEVERITY_RANK["HIGH"])), 1).otherwise(0).alias("exit_code"))


#: Sink category, rule, severity, score, weakness.
CATEGORIES = (
    ("SQL", "SEM-SQLI-001", "CRITICAL", 9.5, "CWE-89"), ("SHELL_EXEC", "SEM-CMD-001", "HIGH", 8.9, "CWE-78"), ("HTTP_REQUEST", "SEM-SSRF-001", "HIGH", 8.2, "CWE-918"),
    ("FILESYSTEM", "SEM-PATH-001", "HIGH", 7.9, "CWE-22"), ("HTML_OUTPUT", "SEM-XSS-001", "HIGH", 7.5, "CWE-79"), ("DESERIALIZATION", "SEM-DESER-001", "CRITICAL", 9.6, "CWE-502"),
)


def category_view(evidence: DataFrame) -> DataFrame:
    """Findings of unsanitised evidence(ordinal, category, sanitised, certainty), by its category's rule."""
    hit = F.array_compact(F.array(*(F.when(F.col("category") == c, F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.lit(x).alias("risk_score"), F.lit(w).alias("cwe"))) for c, r, s, x, w in CATEGORIES)))
    out = evidence.where("not sanitised").withColumn("hit", F.explode(hit))
    return out.select("ordinal", "hit.*", F.when((F.col("category") != "SQL") | (F.col("certainty") > 0.8), "HIGH").otherwise("MEDIUM").alias("confidence"))


def invariant_violations(contexts: DataFrame) -> DataFrame:
    """contexts(ordinal, needs, role, authenticated, tenant): the first invariant that a context breaks.

    ``needs`` is ADMIN, AUTH or TENANT.
    """
    broken = (
        F.when((F.col("needs") == "ADMIN") & (F.col("role") != "ADMINISTRATOR"), "admin_endpoint_requires_admin_role")
        .when((F.col("needs") == "AUTH") & ~F.col("authenticated"), "sensitive_operation_requires_auth")
        .when((F.col("needs") == "TENANT") & (F.coalesce("tenant", F.lit("")) == ""), "tenant_isolation_required")
    )
    return contexts.select("ordinal", broken.alias("invariant")).where("invariant is not null")


def merged_flows(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Flows of two analyses: where both have a sink's category, the first's smallest flow takes the second's proof; the rest is appended.

    ``first(keys, ordinal)``, ``second(keys, proof)``.
    """
    proof = second.groupBy(*keys).agg(F.min("proof").alias("proof"))
    lead = first.groupBy(*keys).agg(F.min("ordinal").alias("ordinal"))
    kept = first.join(lead.join(proof, keys), [*keys, "ordinal"], "left")
    new = second.join(first.select(*keys).distinct(), keys, "left_anti").withColumn("ordinal", F.lit(None).cast("long"))
    return kept.select(*keys, "ordinal", "proof").unionByName(new.select(*keys, "ordinal", "proof"))


def queue_status(jobs: DataFrame, statuses=("QUEUED", "RUNNING", "DONE", "DEAD", "OBSOLETE")) -> DataFrame:
    """Counts of webhook jobs by status, one row a repository."""
    return jobs.groupBy("repo").agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in statuses))


def finding_page(findings: DataFrame, page: int, size: int, ordinal: str = "ordinal") -> DataFrame:
    """A facade's page of findings (from 0): the shape of an API answer, riskiest first; at most that many pages are sorted."""
    rows = findings.orderBy(F.desc("risk_score"), ordinal).limit((page + 1) * size).offset(page * size)
    return rows.select(F.col(ordinal).alias("id"), "title", "severity", "confidence", F.col("file_path").alias("file"), "line", "risk_score", "state")


#: Settings that a server enforces on what a repository asks for.
FLOOR = {"score_threshold": 60, "max_annotations": 100}


def effective_config(asked: dict, server: dict | None = None) -> dict:
    """A repository's settings with defaults, never below the server's threshold, with pull requests scanned where the server says so."""
    server = server or {}
    out = {"scan_profile": "strict", "policy_name": "default", "excluded_paths": ["vendor/", "node_modules/", "tests/"], "score_threshold": 70, "scan_on_push": True, "scan_on_pr": True, "scan_on_merge": True, "max_annotations": 50}
    out |= {k: v for k, v in asked.items() if k in out} | {k: v for k, v in asked.get("github", {}).items() if k in out}
    out["score_threshold"] = max(out["score_threshold"], server.get("min_score_threshold", FLOOR["score_threshold"]))
    out["max_annotations"] = min(out["max_annotations"], FLOOR["max_annotations"])
    out["scan_on_pr"] = out["scan_on_pr"] or server.get("force_pr_scans", True)
    return out
