"""Supply-chain rules over manifest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.versions import is_typosquat, normalised


def supply_findings(deps: DataFrame) -> DataFrame:
    """Unpinned, broad, mutable VCS, direct URL, missing hash."""
    registry = F.col("source_type") == "registry"
    spec, ref = F.coalesce("spec", F.lit("")), F.coalesce("vcs_ref", F.lit(""))
    locked = F.col("path").rlike(r"(\.lock|-lock\.json|shrinkwrap\.json)$")
    rules = (
        ("DEP-001", "LOW", registry & F.col("is_direct") & F.col("version").isNull() & spec.isin("", "*", "latest")),
        ("DEP-002", "LOW", registry & F.col("version").isNull() & (spec.rlike(r"^>=?[^,]*$") | (spec == "*"))),
        ("SUPPLY-001", "HIGH", (F.col("source_type") == "vcs") & ((ref == "") | ref.rlike("(?i)main|master|develop|trunk|head") | (F.length(ref) < 40))),
        ("SUPPLY-002", "MEDIUM", F.col("source_type") == "url"),
        ("SUPPLY-003", "LOW", (F.col("hashes") == 0) & (locked | ~registry)),
    )
    hits = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for i, s, c in rules)))
    return deps.withColumn("hit", F.explode(hits)).select("path", "name", "hit.*")


def shadowing(files: DataFrame, deps: DataFrame) -> DataFrame:
    """Local modules that bear a dependency's name."""
    stem = normalised(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.py$", ""))
    local = files.where(F.endswith("path", F.lit(".py"))).select("path", stem.alias("name"))
    return local.join(deps.select(normalised(F.col("name")).alias("name")).distinct(), "name")


def inventory(deps: DataFrame) -> DataFrame:
    return deps.groupBy("ecosystem").agg(
        F.count("*").alias("total"), F.count_if("is_direct").alias("direct"), F.count_if(~F.col("is_direct")).alias("transitive"), F.count_if("is_dev").alias("dev"), F.count_if(F.col("version").isNull()).alias("unpinned")
    )


def lookalikes(names: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of a name and a known one that ``is_typosquat`` takes for each other; ``names(name)``, ``known(known)``.

    Both sides spell out their beginnings with one place left open and meet on these, so neither must be small.
    """

    def opened(c):
        lengths = F.filter(F.array(F.length(c), F.length(c) - 1), lambda n: n > 0)
        each = F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.lit("\0"), F.substr(c, i + 1, n - i))))
        return F.explode(F.array_distinct(F.flatten(each)))

    n = names.select("name").where("name <> ''").distinct()
    k = known.select("known").where("known <> ''").distinct()
    pairs = n.select("name", opened(F.col("name")).alias("_k")).join(k.select("known", opened(F.col("known")).alias("_k")), "_k")
    return pairs.select("name", "known").distinct().where(is_typosquat(F.col("name"), F.col("known")))
