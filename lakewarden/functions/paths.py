"""What a file's path, a key's name or an identifier tells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .secrets import ENVIRONMENTS, TEST_PATH

#: Fixed values.
DOC_PATH = r"(?i)[/\\]docs?[/\\]|\.md$|README"
CI_PATH = r"(?i)[/\\]\.github[/\\]workflows[/\\]|\.gitlab-ci\.yml$|Jenkinsfile|Dockerfile"
SECURITY_PATH = r"auth|security|login|token|session|middleware|permission|policy|route|api|config|docker|k8s|requirements|package\.json|poetry\.lock|yarn\.lock|pnpm-lock\.yaml"
SCANNED = ("py", "js", "ts", "jsx", "tsx", "java", "go", "rb", "php", "cs", "sh", "json", "yaml", "yml", "toml", "ini", "cfg", "env", "txt", "md", "xml", "conf", "pem", "key")
MAGIC = ("7F454C46", "4D5A", "89504E47", "FFD8FF", "504B0304", "1F8B08")
EXPLICIT_KEYS = r"api_key|secret|token|password|aws_secret_access_key|private_key"
IDENTIFIERS = ("CVE-", "GHSA-", "PYSEC-", "OSV-")


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_documentation(path: Column) -> Column:
    return path.rlike(DOC_PATH)


def is_pipeline(path: Column) -> Column:
    return path.rlike(CI_PATH)


def is_security_relevant(path: Column) -> Column:
    return F.lower(path).rlike(SECURITY_PATH)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(?<=[^/])\.([^./]+)$", 1))


def is_scanned(path: Column, header: Column | None = None) -> Column:
    """Files that a secret scan reads: by name or extension, and no binary by its first 512 bytes (``header`` binary)."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    always = F.startswith(base, F.lit(".env")) | base.isin("credentials", "secrets")
    ext = extension(path)
    text = (ext == "") | ext.isin(*SCANNED)
    if header is not None:
        hexed = F.hex(F.substring(header, 1, 512))
        binary = hexed.rlike("^(" + "|".join(MAGIC) + ")") | hexed.rlike("^(..)*00")
        text = text & ~F.coalesce(binary, F.lit(False))
    return always | text


def privilege(kind: Column, context: Column) -> Column:
    """The scope that a secret's kind and line suggest."""
    line = F.lower(F.coalesce(context, F.lit("")))
    admin = line.rlike("admin|root")
    return (
        F.when(kind.isin("DATABASE_CREDENTIAL", "DATABASE_URL"), "DATABASE")
        .when(kind == "CLOUD_CREDENTIAL", F.when(admin, "ADMINISTRATIVE").otherwise("CLOUD"))
        .when(kind.isin("SIGNING_KEY", "ENCRYPTION_KEY"), "SIGNING")
        .when(line.rlike("admin|master|root"), "ADMINISTRATIVE")
        .when(line.rlike("write|upload"), "WRITE")
        .when(line.rlike("read|fetch"), "READ")
        .otherwise("UNKNOWN")
    )


def context_confidence(value: Column, key: Column, path: Column) -> Column:
    """(confidence, test?) of a candidate by its key's name, its value and its file."""
    words = "|".join(dict(ENVIRONMENTS)["TESTING"])
    key, value = F.lower(F.coalesce(key, F.lit(""))), F.lower(F.coalesce(value, F.lit("")))
    mock = key.rlike(words) | value.rlike(words)
    level = F.when(mock, "LOW").when(is_test(path), "MEDIUM").when(key.rlike(EXPLICIT_KEYS), "HIGH").otherwise("MEDIUM")
    return F.struct(level.alias("confidence"), (mock | is_test(path)).alias("is_test"))


def host_verdict(host: Column, deny: tuple[str, ...], allow: tuple[str, ...]) -> Column:
    """DENY by the first list, else ALLOW by the second, else REVIEW; both are patterns."""
    return F.when(host.rlike("|".join(deny)), "DENY").when(host.rlike("|".join(allow)), "ALLOW").otherwise("REVIEW")


def identifier_type(raw: Column) -> Column:
    """The scheme of a vulnerability's identifier, by its prefix."""
    text, out = F.upper(F.trim(raw)), None
    for p in IDENTIFIERS:
        hit = F.startswith(text, F.lit(p))
        out = F.when(hit, p[:-1]) if out is None else out.when(hit, p[:-1])
    return out.otherwise("UNKNOWN")
