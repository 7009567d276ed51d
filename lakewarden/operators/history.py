"""Rules over git history and pull requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secrets import scan
from .supply import lookalikes

#: Fixed values.
SENSITIVE_NAMES = (".env", ".env.local", ".env.production", ".env.staging", ".env.dev", "credentials.json", "secrets.json", "id_rsa", "id_ed25519", "id_dsa")
SENSITIVE_ENDINGS = (".pem", ".key", ".p12", ".pfx", ".asc")
#: Fixed values.
PIPE_TO_SHELL = r"curl\s+.*\|\s*(bash|sh)|wget\s+.*\|\s*(bash|sh)|\beval\s+\$"
#: Fixed values.
RISKY_LINES = r"^\+\s*(DEBUG\s*=\s*True|verify\s*=\s*False|ssl_verify\s*=\s*False|CORS_ALLOW_ALL_ORIGINS\s*=\s*True|allow_origins\s*=\s*\[\s*[\"']\*[\"']\s*\])"
#: Fixed values.
HOOK_WORDS = ("curl", "wget", "eval", "nc ", "netcat", "/dev/tcp", "python -c", "bash -i")
#: Fixed values.
NPM_PATTERNS = (
    ("NETWORK", r"curl\s+|wget\s+|fetch\(|http\.request\(|axios\("),
    ("PROCESS", r"child_process|exec\(|execSync\(|spawn\(|bash\s+|sh\s+"),
    ("CREDENTIALS", r"/etc/passwd|\.ssh|\.env|process\.env"),
    ("OBFUSCATION", r"eval\(|String\.fromCharCode|Buffer\.from\(.*?'base64'\)"),
)


def basename(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def sensitive_files(changes: DataFrame) -> DataFrame:
    """Commits that add or change files that hold credentials by their name."""
    name = basename(F.col("path"))
    hit = name.isin(*SENSITIVE_NAMES)
    for e in SENSITIVE_ENDINGS:
        hit = hit | F.endswith(name, F.lit(e))
    return changes.where(hit & (F.col("change") != "D")).select("commit", "path", F.lit("GIT-002").alias("rule_id"), F.lit("HIGH").alias("severity"))


def missing_ignores(ignore_lines: DataFrame, recommended: DataFrame) -> DataFrame:
    """Recommended patterns that no line of .gitignore holds; both sides are a file's length."""
    lines = ignore_lines.select(F.trim("line").alias("line")).where("line <> '' and not startswith(line, '#')")
    return recommended.join(lines, F.contains("line", F.col("pattern")), "left_anti")


def workflow_lines(lines: DataFrame) -> DataFrame:
    """Workflow lines that pipe downloads to a shell, or use an action by a mutable name."""
    l = lines.where(F.col("path").rlike(r"^(\.github/workflows|\.gitlab-ci|\.circleci)"))
    ref = F.regexp_extract("line", r"uses:\s*([^\s#]+)", 1)
    hit = F.array_compact(
        F.array(
            F.when(F.col("line").rlike(PIPE_TO_SHELL), F.struct(F.lit("GIT-005").alias("rule_id"), F.lit("HIGH").alias("severity"))),
            F.when((ref != "") & ~F.startswith(ref, F.lit("./")) & ~ref.rlike("@[0-9a-f]{40}$"), F.struct(F.lit("GIT-006").alias("rule_id"), F.lit("LOW").alias("severity"))),
        )
    )
    return l.withColumn("hit", F.explode(hit)).select("path", "line_no", "hit.*")


def risky_diff_lines(diff_lines: DataFrame) -> DataFrame:
    return diff_lines.where(F.col("line").rlike(RISKY_LINES)).withColumn("rule_id", F.lit("GIT-008"))


def suspicious_hooks(hooks: DataFrame) -> DataFrame:
    hit = F.lit(False)
    for w in HOOK_WORDS:
        hit = hit | F.contains("content", F.lit(w))
    return hooks.where(hit & ~F.endswith("name", F.lit(".sample"))).select("name", F.lit("GIT-007").alias("rule_id"))


def lifecycle(seen: DataFrame, head: DataFrame) -> DataFrame:
    """When a secret came and went: ``seen(fingerprint, path, commit, ts, added)``, ``head(fingerprint)``.

    Introduced by the oldest commit that added it; removed by the newest that dropped it, unless it is
    still at the head; exposure in whole days (open ones up to the newest commit).
    """
    last = seen.agg(F.max("ts").alias("last_ts"))
    g = seen.groupBy("fingerprint").agg(
        F.min_by(F.when(F.col("added"), F.col("commit")), F.when(F.col("added"), F.col("ts"))).alias("introduced"),
        F.min(F.when(F.col("added"), F.col("ts"))).alias("from_ts"),
        F.max_by(F.when(~F.col("added"), F.col("commit")), F.when(~F.col("added"), F.col("ts"))).alias("dropped"),
        F.max(F.when(~F.col("added"), F.col("ts"))).alias("to_ts"),
    )
    g = g.join(head.select("fingerprint").distinct().withColumn("active", F.lit(True)), "fingerprint", "left").withColumn("active", F.coalesce("active", F.col("dropped").isNull()))
    out = g.crossJoin(F.broadcast(last))  # one row
    end = F.when(F.col("active"), F.col("last_ts")).otherwise(F.col("to_ts"))
    return out.select("fingerprint", "introduced", F.when(~F.col("active"), F.col("dropped")).alias("removed"), "active", F.datediff(end, "from_ts").alias("exposure_days"))


def npm_scripts(packages: DataFrame) -> DataFrame:
    """Lifecycle scripts of package.json files that look hostile."""
    scripts = packages.select("path", F.explode(F.from_json(F.get_json_object("content", "$.scripts"), "map<string,string>")).alias("script", "body"))
    scripts = scripts.where(F.col("script").isin("preinstall", "install", "postinstall", "prepare", "prepublish"))
    kinds = F.array_compact(F.array(*(F.when(F.col("body").rlike(p), F.lit(k)) for k, p in NPM_PATTERNS)))
    return scripts.withColumn("kind", F.explode(kinds)).select("path", "script", "kind")


def severity_of_cvss(score: Column) -> Column:
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score >= 0.1, "LOW").otherwise("INFO")


def javascript_calls(lines: DataFrame) -> DataFrame:
    """Function and call names of JavaScript lines, by pattern."""
    fn = F.coalesce(F.nullif(F.regexp_extract("line", r"function\s+([A-Za-z_$][\w$]*)\s*\(", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function|\([^)]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)", 1), F.lit(""))).alias("fn")
    calls = F.filter(F.regexp_extract_all("line", F.lit(r"([A-Za-z_$][\w$.]*)\s*\("), 1), lambda c: ~c.isin("if", "for", "while", "switch", "catch", "function", "return", "typeof"))
    return lines.select("path", "line_no", fn, calls.alias("calls"))


#: Names that hostile packages imitate.
POPULAR = ("react", "lodash", "express", "axios", "chalk", "commander", "moment", "webpack", "typescript")


def npm_typosquats(packages: DataFrame) -> DataFrame:
    """Package names one letter off a popular one; the popular names are nine."""
    return lookalikes(packages, packages.sparkSession.createDataFrame([(n,) for n in POPULAR], "known string"))


def history_secrets(added: DataFrame, salt: str = "lakewarden") -> DataFrame:
    """Secrets of added lines(commit, ord, path, line): each with the oldest commit that brought it.

    ``ord`` counts from the newest commit, so the oldest has the greatest.
    """
    found = scan(added.select("commit", F.col("ord").alias("age"), "path", F.expr("substr(line, 2)").alias("text")), ["commit", "age", "path"], path="path", salt=salt)
    first = found.groupBy("fingerprint").agg(F.max_by(F.struct("commit", "path", "detector", "severity", "redacted"), F.struct("age", "path")).alias("f"), F.countDistinct("commit").alias("commits"))
    return first.select("fingerprint", F.col("f.commit").alias("first_seen"), "f.path", "f.detector", "f.severity", "f.redacted", "commits")


def pull_request_secrets(base: DataFrame, head: DataFrame) -> DataFrame:
    """Secrets of the head with whether the base has them already."""
    b = base.select("fingerprint").distinct().withColumn("_b", F.lit(True))
    return head.join(b, "fingerprint", "left").withColumn("change", F.when(F.col("_b"), "EXISTING").otherwise("INTRODUCED")).drop("_b")


def external_validation(secrets: DataFrame) -> DataFrame:
    """What a check with the provider would say: it is switched off, so nothing is sent and nothing known."""
    return secrets.withColumn("validated", F.lit(False)).withColumn("validation", F.lit("DISABLED"))
