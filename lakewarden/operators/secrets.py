"""Secret scan: a catalog of detectors over texts, as one projection and one aggregation.

Every detector is a row (id, kind, generic, severity, pattern with one group). A text passes all of them
in one scan, and a detector's pattern only where one of its literal anchors is in the text; candidates then lose placeholders and malformed values, get entropy, fingerprint and
redaction, and equal secrets of one text are merged, a provider's detector before a generic one. The raw
value exists only inside the projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import secrets as S

#: id, kind, generic, severity, pattern; in registration order.
DETECTORS = (
    ("SEC-006", "CLOUD_CREDENTIAL", False, "CRITICAL", r"\b(AKIA[0-9A-Z]{16})\b"),
    ("SEC-007", "ACCESS_TOKEN", False, "CRITICAL", r"\b((?:ghp|gho|ghu|ghs|ghr)_[a-zA-Z0-9]{36})\b"),
    ("SEC-011", "GCP_KEY", False, "CRITICAL", r"\b(AIzaSy[a-zA-Z0-9_\-]{30,35})"),
    ("SEC-012", "SLACK_WEBHOOK", False, "HIGH", r"(https://hooks\.slack\.com/services/T[a-zA-Z0-9_]+/B[a-zA-Z0-9_]+/[a-zA-Z0-9_]+)"),
    ("SEC-013", "STRIPE_KEY", False, "CRITICAL", r"\b((?:sk|pk)_(?:live|test)_[a-zA-Z0-9]{24,34})\b"),
    ("SEC-014", "PRIVATE_KEY", False, "CRITICAL", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)"),
    ("SEC-003", "PRIVATE_KEY", False, "CRITICAL", r"(-----BEGIN (?:RSA|DSA|EC|OPENSSH|ENCRYPTED) PRIVATE KEY-----)"),
    ("SEC-005", "DATABASE_URL", False, "HIGH", r"((?:mssql|mariadb|oracle|amqps?)://[^\s:@'\"]+:[^\s@'\"]+@[^\s'\"]+)"),
    ("SEC-015", "DATABASE_URL", False, "HIGH", r"((?:postgres|postgresql|mysql|mongodb|redis)://[^\s'\"]+)"),
    ("SEC-004", "JWT", False, "HIGH", r"\b(eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+)"),
    ("SEC-009", "DOTENV", False, "HIGH", r"(?m)^\s*(?:export )?[A-Z][A-Z0-9_]*(?:KEY|SECRET|TOKEN|PASSWORD|PASSWD|CREDENTIALS)=[\"']?([^\s\"'#]{12,})"),
    ("SEC-001", "API_KEY", True, "HIGH", r"(?i)\bapi[_-]?key\s*[=:]\s*[\"']([^\"'\s]{8,})[\"']"),
    ("SEC-002", "AUTH_TOKEN", True, "HIGH", r"(?i)\b(?:auth_?|access_?)?token\s*[=:]\s*[\"']([^\"'\s]{8,})[\"']"),
    ("SEC-008", "PASSWORD", True, "HIGH", r"(?i)\b(?:password|passwd|pwd)\s*[=:]\s*[\"']([^\"'\s]{8,})[\"']"),
    ("SEC-010", "HIGH_ENTROPY", True, "MEDIUM", r"[\"']([A-Za-z0-9+/=_-]{32,})[\"']"),
)
#: Per detector the literals without one of which (in lower case for generic ones) it can't hit.
ANCHORS = {
    "SEC-006": ("AKIA",), "SEC-007": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "SEC-011": ("AIzaSy",), "SEC-012": ("hooks.slack.com",), "SEC-013": ("k_live_", "k_test_"), "SEC-014": ("PRIVATE KEY",), "SEC-003": ("PRIVATE KEY",), "SEC-005": ("://",),
    "SEC-015": ("://",), "SEC-004": ("eyJ",), "SEC-009": ("=",), "SEC-001": ("key",), "SEC-002": ("token",), "SEC-008": ("password", "passwd", "pwd"), "SEC-010": ('"', "'"),
}
ENTROPY_LEAST = 3.0


def candidates(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``texts`` with one detector's hit each: detector, ord, kind, generic, severity, value."""
    text_col = F.coalesce(F.col(text), F.lit(""))

    def hits(i: int, detector: str, kind: str, generic: bool, severity: str, pattern: str):
        row = lambda v: F.struct(F.lit(detector).alias("detector"), F.lit(i).alias("ord"), F.lit(kind).alias("kind"), F.lit(generic).alias("generic"), F.lit(severity).alias("severity"), v.alias("value"))
        found = F.transform(F.array_distinct(F.regexp_extract_all(text_col, F.lit(pattern), 1)), row)
        where = F.lower(text_col) if generic else text_col
        return F.when(reduce(lambda a, w: a | F.contains(where, F.lit(w)), ANCHORS[detector], F.lit(False)), found).otherwise(none)

    none = F.array().cast("array<struct<detector:string,ord:int,kind:string,generic:boolean,severity:string,value:string>>")
    found = F.flatten(F.array(*(hits(i, *d) for i, d in enumerate(DETECTORS))))
    keep = [c for c in texts.columns if c != text]
    return texts.select(*keep, F.explode(found).alias("hit")).select(*keep, "hit.*")


def scan(texts: DataFrame, keys: list[str], path: str | None = None, text: str = "text", salt: str = "lakewarden") -> DataFrame:
    """One row per text and secret: detector, kind, severity, fingerprint, redacted, entropy.

    In test paths severity drops by a step (to MEDIUM from above, else to LOW).
    """
    c = candidates(texts.select(*keys, *([path] if path and path not in keys else []), text), text)
    c = c.where(~S.is_placeholder(F.col("value")) & S.is_well_formed(F.col("kind"), F.col("value")))
    c = c.withColumn("entropy", S.entropy(F.col("value"))).where((F.col("kind") != "HIGH_ENTROPY") | (F.col("entropy") >= ENTROPY_LEAST))
    severity = F.col("severity")
    if path:
        lower = F.when(severity.isin("CRITICAL", "HIGH"), F.lit("MEDIUM")).otherwise(F.lit("LOW"))
        severity = F.when(F.col(path).rlike(S.TEST_PATH), lower).otherwise(severity)
    c = c.select(*keys, "detector", "kind", severity.alias("severity"), "generic", "ord", S.fingerprint(F.col("value"), salt).alias("fingerprint"), S.redacted(F.col("value")).alias("redacted"), "entropy")
    row = F.struct("detector", "kind", "severity", "redacted", "entropy")
    best = c.groupBy(*keys, "fingerprint").agg(F.min_by(row, F.struct("generic", "ord")).alias("r"))
    return best.select(*keys, "fingerprint", "r.*")
