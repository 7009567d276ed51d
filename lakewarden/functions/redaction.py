"""Values taken out of texts before anyone reads them; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .secrets import redacted

#: What reports must not show, and what stands there instead.
REPORT_PATTERNS = (
    (r"AKIA[0-9A-Z]{16}", "AKIA****************"),
    (r"(aws_secret_access_key\s*=\s*)([A-Za-z0-9/+=]{40})", "$1[REDACTED_AWS_SECRET]"),
    (r"sk_live_[0-9a-zA-Z]{24,}", "sk_live_********************"),
    (r"ghp_[0-9a-zA-Z]{36}", "ghp_************************************"),
    (r"eyJ[A-Za-z0-9_=-]+\.eyJ[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+", "[REDACTED_JWT_TOKEN]"),
    (r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"(postgres(?:ql)?|mysql|mongodb)://([^:]+):([^@]+)@", "$1://$2:********@"),
)
#: Assignments in log lines.
LOG_PATTERNS = (
    (r"(?i)(api[_-]?key\s*[:=]\s*)['\"]?([a-zA-Z0-9_\-]{8,})['\"]?", "$1[REDACTED]"),
    (r"(?i)(password\s*[:=]\s*)['\"]?([^\s'\"]{4,})['\"]?", "$1[REDACTED]"),
    (r"(?i)(token\s*[:=]\s*)['\"]?([a-zA-Z0-9_\-]{8,})['\"]?", "$1[REDACTED]"),
    (r"(?i)(secret\s*[:=]\s*)['\"]?([a-zA-Z0-9_\-]{8,})['\"]?", "$1[REDACTED]"),
)
#: Fixed value: assignments in payloads of verification.
PAYLOAD = (r"(?i)(api[_-]?key|secret|password|token|auth)\s*=\s*['\"]([^'\"]+)['\"]", "$1='[REDACTED_VERIFICATION_PAYLOAD]'")


def _all(text: Column, patterns) -> Column:
    out = F.coalesce(text, F.lit(""))
    for pattern, shown in patterns:
        out = F.regexp_replace(out, pattern, shown)
    return out


def report_text(text: Column) -> Column:
    """A text for reports; null becomes empty."""
    return _all(text, REPORT_PATTERNS)


def log_text(text: Column, known: list[str] | None = None) -> Column:
    """A log line without known secrets (of more than three characters) and without assigned ones."""
    out = F.coalesce(text, F.lit(""))
    for s in known or ():
        if len(s) > 3:
            out = F.replace(out, F.lit(s), F.lit("[REDACTED_SECRET]"))
    return _all(out, LOG_PATTERNS)


def payload_text(text: Column) -> Column:
    return _all(text, [PAYLOAD])


def evidence_text(text: Column, secret: Column) -> Column:
    """A piece of evidence with every occurrence of the raw secret redacted."""
    return F.when(F.coalesce(secret, F.lit("")) == "", F.coalesce(text, F.lit(""))).otherwise(F.replace(F.coalesce(text, F.lit("")), secret, redacted(secret)))


def comment_value(v: Column) -> Column:
    """Three characters at each end; six or fewer vanish."""
    return F.when(F.coalesce(v, F.lit("")) == "", "").when(F.length(v) <= 6, "******").otherwise(F.concat(F.left(v, F.lit(3)), F.lit("****"), F.right(v, F.lit(3))))


def masked_token(v: Column) -> Column:
    """Four characters at each end of eight or more."""
    return F.when(F.length(F.coalesce(v, F.lit(""))) < 8, "********").otherwise(F.concat(F.left(v, F.lit(4)), F.lit("****"), F.right(v, F.lit(4))))
