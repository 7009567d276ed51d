"""Scalar functions on secret candidates; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a secret without being one.
PLACEHOLDERS = (
    "YOUR_API_KEY", "YOUR_SECRET_KEY", "YOUR_TOKEN", "YOUR_PASSWORD", "REPLACE_ME", "CHANGEME", "EXAMPLE", "SAMPLE", "DUMMY", "LOCALHOST",
    "PASSWORD", "SECRET", "TOKEN", "API_KEY", "TEST_KEY", "TEST_TOKEN", "INSERT_HERE", "ENTER_HERE", "MY_SECRET", "FOOBAR",
)
#: The patterns as one alternation.
PLACEHOLDER_PATTERN = r"^(?i:x{4,})$|^\*{4,}$|^0{4,}$|^12345678|^<.*>$|^\[.*\]$|(?i)your[_-]?api[_-]?key|replace[_-]?me|change[_-]?me"
#: Shapes of provider credentials.
STRUCTURES = {
    "CLOUD_CREDENTIAL": r"^AKIA[0-9A-Z]{16}$",
    "GCP_KEY": r"^AIzaSy[a-zA-Z0-9_\-]{30,35}$",
    "ACCESS_TOKEN": r"^(ghp|gho|ghu|ghs|ghr)_[a-zA-Z0-9]{36}$",
    "STRIPE_KEY": r"^(sk|pk)_(live|test)_[a-zA-Z0-9]{24,34}$",
    "JWT": r"^[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+$",
    "SLACK_WEBHOOK": r"^https://hooks\.slack\.com/services/T[a-zA-Z0-9_]+/B[a-zA-Z0-9_]+/[a-zA-Z0-9_]+$",
    "PRIVATE_KEY": r"-----BEGIN[^-]*PRIVATE KEY-----",
}
#: Fixed value: the least that any other credential looks like.
GENERIC_STRUCTURE = r"^[ -~]{12,}$"
#: The environment ladder, in order.
ENVIRONMENTS = (
    ("PRODUCTION", ("prod", "production", "live", "mainnet", "master")),
    ("STAGING", ("staging", "stage")),
    ("DEVELOPMENT", ("dev", "local")),
    ("TESTING", ("test", "mock", "dummy", "fake", "example", "sample", "sandbox", "placeholder", "demo")),
)
#: What a path of tests looks like.
TEST_PATH = r"(?i)[/\\]tests?[/\\]|[/\\]fixtures?[/\\]|[/\\]mocks?[/\\]|test_[a-z0-9_-]+\.|[a-z0-9_-]+\.(spec|test)\."


def entropy(v: Column) -> Column:
    """Shannon entropy of the characters in bits, to four places; 0 for null or empty.

    The value and its characters are bound once, as variables of one-element transforms; only they are read inside.
    """

    def of(chars: Column) -> Column:
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
        bits = F.transform(F.transform(F.array_distinct(chars), share), lambda p: -p * F.log2(p))
        return F.aggregate(bits, F.lit(0.0), lambda a, x: a + x)

    split = F.transform(F.array(v), lambda s: F.filter(F.split(s, ""), lambda c: c != ""))
    return F.coalesce(F.round(F.element_at(F.transform(split, of), 1), 4), F.lit(0.0))


def unquoted(v: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(v), r"""^['"]+|['"]+$""", ""))


def is_placeholder(v: Column) -> Column:
    clean = unquoted(v)
    return (clean == "") | F.upper(clean).isin(*PLACEHOLDERS) | clean.rlike(PLACEHOLDER_PATTERN)


def is_well_formed(kind: Column, v: Column) -> Column:
    clean = unquoted(v)
    out = None
    for k, pattern in STRUCTURES.items():
        out = F.when(kind == k, clean.rlike(pattern)) if out is None else out.when(kind == k, clean.rlike(pattern))
    return out.otherwise(clean.rlike(GENERIC_STRUCTURE))


def redacted(v: Column) -> Column:
    """Up to eight characters vanish; of longer values four stay at each end."""
    clean = F.trim(v)
    return F.when(F.length(clean) > 8, F.concat(F.left(clean, F.lit(4)), F.repeat(F.lit("*"), F.length(clean) - 8), F.right(clean, F.lit(4)))).otherwise(F.lit("[REDACTED]"))


def fingerprint(v: Column, salt: str) -> Column:
    return F.concat(F.lit("sec_fp_"), F.left(F.sha2(F.concat(F.lit(f"{salt}:"), F.trim(v)), 256), F.lit(32)))


def environment(context: Column) -> Column:
    text = F.lower(context)
    out = None
    for name, words in ENVIRONMENTS:
        hit = text.rlike("|".join(words))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("UNKNOWN"))
