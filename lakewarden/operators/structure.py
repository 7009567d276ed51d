"""Structure of any source file by its lines: language registry, outline, routes of web frameworks, project metadata."""

from __future__ import annotations

import re
import tomllib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Language, extensions, opener of a comment, how its files are read.
LANGUAGES = (
    ("PYTHON", ("py", "pyi"), "#", "syntax tree"), ("JAVASCRIPT", ("js", "jsx", "mjs"), "//", "patterns"), ("TYPESCRIPT", ("ts", "tsx"), "//", "patterns"), ("JAVA", ("java",), "//", "lines"), ("GO", ("go",), "//", "lines"),
    ("RUST", ("rs",), "//", "lines"), ("PHP", ("php",), "//", "lines"), ("RUBY", ("rb",), "#", "lines"), ("C", ("c", "h"), "//", "lines"), ("CPP", ("cpp", "cc", "hpp"), "//", "lines"),
)


def language(path: Column) -> Column:
    """The language of a file by its extension; UNKNOWN otherwise."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return reduce(lambda acc, x: acc.when(ext.isin(*x[1]), x[0]), LANGUAGES[1:], F.when(ext.isin(*LANGUAGES[0][1]), LANGUAGES[0][0])).otherwise("UNKNOWN")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, list(e), c, r) for n, e, c, r in LANGUAGES], "language string, extensions array<string>, comment string, reader string")


def rules_for(rules: DataFrame, category: str | None = None, enabled: bool | None = None, language: str | None = None) -> DataFrame:
    """Rows of a rule catalog (rule_id, category, enabled, language); rules of UNKNOWN language fit any."""
    out = rules
    if category:
        out = out.where(F.col("category") == category.upper())
    if enabled is not None:
        out = out.where(F.col("enabled") == enabled)
    return out.where(F.col("language").isin("UNKNOWN", language.upper())) if language else out


def outline(lines: DataFrame) -> DataFrame:
    """path, line_no, node, name of ``lines(path, line_no, line)``: classes, functions and imports by how a line begins."""
    l = F.ltrim("line")
    cls = F.regexp_extract(l, r"^(?:(?:public|private|protected|abstract|final|export|default|static)\s+)*(?:class|struct|interface|trait|enum)\s+([A-Za-z_]\w*)", 1)
    fn = F.regexp_extract(l, r"^(?:(?:public|private|protected|static|async|export|default|pub)\s+)*(?:def|func|function|fn|void)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", 1)
    imp = F.regexp_extract(l, r"^(?:import|from|use|require|include|#include)\b\s*[(<\"']?\s*([\w./:@-]+)", 1)
    hit = F.when(cls != "", F.struct(F.lit("CLASS").alias("node"), cls.alias("name"))).when(fn != "", F.struct(F.lit("FUNCTION").alias("node"), fn.alias("name"))).when(imp != "", F.struct(F.lit("IMPORT").alias("node"), imp.alias("name")))
    return lines.withColumn("hit", hit).where("hit is not null").select("path", "line_no", "hit.*")


def line_routes(lines: DataFrame) -> DataFrame:
    """Routes of Flask, FastAPI and Express by pattern, with a hint of authentication on the same line."""
    py = r"^\s*@(\w+)\.(route|get|post|put|delete|patch)\(\s*['\"]([^'\"]+)['\"]"
    js = r"\b(app|router)\.(get|post|put|delete|patch|use)\(\s*['\"]([^'\"]+)['\"]"
    p = lambda i: F.regexp_extract("line", py, i)
    j = lambda i: F.regexp_extract("line", js, i)
    is_py, is_js = (p(3) != "") & F.endswith("path", F.lit(".py")), (j(3) != "") & F.col("path").rlike(r"\.(js|ts)x?$")
    out = lines.where(is_py | is_js)
    return out.select("path", "line_no", F.when(is_js, "Express").when(p(2) == "route", "Flask").otherwise("FastAPI").alias("framework"), F.upper(F.when(is_js, j(2)).otherwise(p(2))).alias("method"), F.when(is_js, j(3)).otherwise(p(3)).alias("route"), F.lower("line").rlike("auth|login|depends|jwt|passport").alias("guarded"))


def metadata(files: DataFrame) -> DataFrame:
    """path, name, version, requires of pyproject.toml files; unreadable ones give none."""

    def own(batches):
        for b in batches:
            rows = []
            for path, text in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                try:
                    d = tomllib.loads(text or "")
                except tomllib.TOMLDecodeError:
                    continue
                p = d.get("project") if isinstance(d.get("project"), dict) else d.get("tool", {}).get("poetry", {})
                if isinstance(p, dict) and p.get("name"):
                    rows.append((path, str(p["name"]), None if p.get("version") is None else str(p["version"]), re.sub(r"\s", "", str(p.get("requires-python") or "")) or None))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["path", "name", "version", "requires"])

    ship(files.sparkSession)
    return files.where(F.col("path").rlike(r"(^|/)pyproject\.toml$")).select("path", "content").mapInArrow(own, "path string, name string, version string, requires string")


def cached(spark: SparkSession, folder: str, key: str, build):
    """A result by its key (a workspace hash with rule versions): built and written once, then read.

    A key's folder is complete once Spark's success mark is there; a broken one is built anew.
    """
    path = f"{folder}/{key}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
