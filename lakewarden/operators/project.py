"""Projects: discovery statistics, pull requests, remediation, correlation of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import severity_weight
from ..functions.versions import version_key
from ..sources.repo import category

#: File names and the language that they tell of.
MANIFESTS = (("pyproject.toml", "PYTHON"), ("requirements.txt", "PYTHON"), ("setup.py", "PYTHON"), ("package.json", "JAVASCRIPT"), ("tsconfig.json", "TYPESCRIPT"), ("pom.xml", "JAVA"), ("build.gradle", "JAVA"), ("go.mod", "GO"))
DEPENDENCY_FILES = r"(^|/)(requirements[^/]*\.txt|pyproject\.toml|poetry\.lock|uv\.lock|Pipfile(\.lock)?|setup\.(py|cfg)|package(-lock)?\.json|go\.mod|Cargo\.(toml|lock)|Gemfile|composer\.json|pom\.xml|build\.gradle)$"


#: Tiers of ignore rules, in the order that they are asked.
TIERS = ("DEFAULT", "GITIGNORE", "CONFIG", "CLI")


def gitignore_patterns(content: str | None) -> list[tuple[str, str]]:
    """(glob, tier) of a .gitignore file: without comments, negations and slashes at the ends."""
    lines = [x.strip() for x in (content or "").splitlines()]
    return [(x.strip("/"), "GITIGNORE") for x in lines if x and x[0] not in "#!" and x.strip("/")]


def ignore_reasons(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """files with ``ignored_by`` (tier) and ``reason`` (glob) of the first rule that fits, null for none.

    ``patterns(glob, tier)`` is as long as hand-written lists; globs become one pattern each at plan time.
    """
    import fnmatch

    rules = sorted(patterns.select("tier", "glob").distinct().collect(), key=lambda r: (TIERS.index(r.tier) if r.tier in TIERS else len(TIERS), r.glob))
    hit = F.lit(None).cast("struct<tier:string,glob:string>")
    for r in reversed(rules):
        p = fnmatch.translate(r.glob).replace("(?s:", "(?s)(?:", 1).replace(r"\z", "").replace(r"\Z", "")
        hit = F.when(F.col("path").rlike(f"(^|/){p}($|/)"), F.struct(F.lit(str(r.tier)).alias("tier"), F.lit(r.glob).alias("glob"))).otherwise(hit)
    return files.withColumn("_hit", hit).select("*", F.col("_hit.tier").alias("ignored_by"), F.col("_hit.glob").alias("reason")).drop("_hit")


def ignored(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Files that no ignore pattern fits."""
    return ignore_reasons(files, patterns).where("ignored_by is null").drop("ignored_by", "reason")


def project_stats(files: DataFrame) -> DataFrame:
    """One row: counts by category, languages by manifest, project type."""
    name = F.element_at(F.split("path", "/"), -1)
    langs = F.array_compact(F.array(*(F.when(F.max(name == m), F.lit(lang)) for m, lang in MANIFESTS)))
    has = lambda pattern: F.max(F.coalesce(F.col("content"), F.lit("")).rlike(pattern))
    return files.agg(
        F.count("*").alias("files"),
        F.sum("size").alias("bytes"),
        *(F.count_if(category(F.col("ext")) == c).alias(c) for c in ("python", "script", "compiled", "config", "documentation", "other")),
        F.array_sort(F.array_distinct(langs)).alias("languages"),
        F.when(has(r"(?m)^\s*(from|import)\s+django\b"), "DJANGO").when(has(r"(?m)^\s*(from|import)\s+fastapi\b"), "FASTAPI").when(has(r"(?m)^\s*(from|import)\s+flask\b"), "FLASK").when(has(r"__main__"), "CLI").otherwise("LIBRARY").alias("type"),
        F.when(F.max(F.startswith("path", F.lit("src/"))), "SRC").otherwise("FLAT").alias("layout"),
    )


def pull_request_summary(changes: DataFrame, findings: DataFrame) -> DataFrame:
    """pr, introduced, resolved, worst severity, and a risk class; ``findings(pr, side, fingerprint, severity)``.

    Sides are made distinct before the full join; dependency regressions count only where a dependency
    file changed.
    """
    side = lambda s: findings.where(F.col("side") == s).select("pr", "fingerprint", "severity").dropDuplicates(["pr", "fingerprint"])
    j = side("base").withColumnRenamed("severity", "old").join(side("head").withColumnRenamed("severity", "new"), ["pr", "fingerprint"], "full_outer")
    new = F.col("old").isNull()
    g = j.groupBy("pr").agg(
        F.count_if(new).alias("introduced"), F.count_if(F.col("new").isNull()).alias("resolved"), F.max(F.when(new, severity_weight(F.col("new")))).alias("w"),
        F.max_by(F.when(new, F.col("new")), F.when(new, severity_weight(F.col("new")))).alias("worst"),
    )
    deps = changes.groupBy("pr").agg(F.max(F.col("path").rlike(DEPENDENCY_FILES)).alias("touches_dependencies"))
    w = F.coalesce("w", F.lit(0.0))
    cls = F.when(w >= 10, "CRITICAL").when(w >= 7.5, "HIGH").when(w >= 5, "MEDIUM").when(w > 0, "LOW").otherwise("NONE")
    return g.join(deps, "pr", "left").select("pr", "introduced", "resolved", "worst", F.coalesce("touches_dependencies", F.lit(False)).alias("touches_dependencies"), cls.alias("risk_class"))


def remediation(current: Column, patched: Column) -> Column:
    """UPGRADE with HIGH risk on a major bump, else LOW; MITIGATE where there is no patch."""
    none = F.coalesce(patched, F.lit("")) == ""
    risk = F.when(none, "NONE").when(version_key(patched)["major"] > version_key(F.coalesce(current, F.lit("0.0.0")))["major"], "HIGH").otherwise("LOW")
    return F.struct(F.when(none, "MITIGATE").otherwise("UPGRADE").alias("action"), risk.alias("risk"), F.when(none, current).otherwise(patched).alias("version"))


def exposure(findings: DataFrame, entry_points: DataFrame) -> DataFrame:
    """INTERNET_FACING for findings in files with an entry point, else INTERNAL."""
    e = entry_points.select(F.col("path").alias("file_path")).distinct().withColumn("_e", F.lit(True))
    return findings.drop("exposure").join(e, "file_path", "left").withColumn("exposure", F.when(F.col("_e"), "INTERNET_FACING").otherwise("INTERNAL")).drop("_e")


def two_step_paths(findings: DataFrame) -> DataFrame:
    """source -> sink of each flow, with its kind by keyword and risk min(100, 10 w + 20)."""
    text = F.lower(F.concat_ws(" ", "title", "sink"))
    kind = F.when(text.rlike("sql|execute"), "SQL_INJECTION").when(text.rlike("system|subprocess|command|popen"), "COMMAND_INJECTION").when(text.rlike("http|url|ssrf"), "SSRF").when(text.rlike("open|path|file"), "PATH_TRAVERSAL").otherwise("DATA_FLOW")
    f = findings.where("source is not null and sink is not null")
    return f.select("ordinal", F.concat_ws(" -> ", "source", "sink").alias("path"), kind.alias("kind"), F.least(F.lit(100.0), severity_weight(F.col("severity")) * 10 + 20).alias("risk"))


def passive_verdict(has_evidence: Column, sanitised: Column, reachable: Column) -> Column:
    """What can be said without sending anything."""
    return F.when(~has_evidence, "INCONCLUSIVE").when(sanitised, "NOT_EXPLOITABLE").when(reachable, "LIKELY").otherwise("POSSIBLE")
