"""Dependencies: advisories by version ranges, conflicts, fixes, graph shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.versions import version_key
from .graph import _cut
from .relations import call_reachability


def intervals(events: DataFrame) -> DataFrame:
    """Half-open [introduced, fixed) intervals of ordered advisory events (id, package, ord, kind, version).

    ``last_affected`` closes an interval with its own version inside.
    """
    w = W.partitionBy("id", "package").orderBy("ord")
    nxt = events.withColumn("end_kind", F.lead("kind").over(w)).withColumn("end", F.lead("version").over(w))
    return nxt.where("kind = 'introduced'").select("id", "package", F.col("version").alias("introduced"), F.when(F.col("end_kind").isin("fixed", "last_affected"), F.col("end")).alias("until"), (F.col("end_kind") == "last_affected").alias("inclusive"))


def affected(deps: DataFrame, ranges: DataFrame) -> DataFrame:
    """deps(name, version) with the advisories whose interval holds the version.

    An equi-join on the package with the range as its residual; Spark broadcasts the ranges only where
    they are small, and splits hot packages otherwise.
    """
    v = version_key(F.col("version"))
    hi = version_key(F.col("until"))
    inside = (v >= version_key(F.col("introduced"))) & (F.col("until").isNull() | (v < hi) | (F.coalesce("inclusive", F.lit(False)) & (v == hi)))
    return deps.join(ranges.withColumnRenamed("package", "name"), "name").where(inside)


def advisory_status(deps: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """AFFECTED, NOT_AFFECTED or UNKNOWN (no version) of each dependency and advisory of its package."""
    hit = affected(deps.where("version is not null"), ranges).select(*keys, "id").distinct().withColumn("_hit", F.lit(True))
    pairs = deps.join(ranges.select(F.col("package").alias("name"), "id").distinct(), "name").join(hit, [*keys, "id"], "left")
    return pairs.withColumn("status", F.when(F.col("version").isNull(), "UNKNOWN").when(F.col("_hit"), "AFFECTED").otherwise("NOT_AFFECTED")).drop("_hit")


def version_conflicts(deps: DataFrame) -> DataFrame:
    """Names with more than one version."""
    g = deps.groupBy("name").agg(F.sort_array(F.collect_set("version")).alias("versions"))
    return g.where(F.size("versions") > 1)


def recommended_fix(deps: DataFrame, fixes: DataFrame, keys: list[str]) -> DataFrame:
    """The least fixed version above the installed one, else the greatest; HIGH if the major changes."""
    j = deps.join(fixes, "name")
    k, v = version_key(F.col("fix")), version_key(F.col("version"))
    out = j.groupBy(*keys, "name", "version").agg(F.coalesce(F.min_by(F.when(k > v, F.col("fix")), F.when(k > v, k)), F.max_by("fix", k)).alias("fix"))
    return out.withColumn("impact", F.when(version_key(F.col("fix"))["major"] != version_key(F.col("version"))["major"], "HIGH").otherwise("LOW"))


def undeclared(declared: DataFrame, locked: DataFrame) -> DataFrame:
    """Declared names that the lock file lacks."""
    return declared.join(locked.select("name").distinct(), "name", "left_anti")


def shared_parents(edges: DataFrame) -> DataFrame:
    """Packages that two or more parents need: single points of failure."""
    return edges.groupBy(F.col("dst").alias("name")).agg(F.countDistinct("src").alias("parents")).where("parents >= 2")


def graph_summary(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """One row, over all that the roots reach, or up to ``depth``: direct and transitive packages, their ratio, largest and mean depth, packages with two parents or more."""
    from .graph import levels

    at = levels(edges, roots, depth).groupBy("node").agg(F.min("level").alias("level")).where("level > 0")
    shape = at.agg(F.count_if(F.col("level") == 1).alias("direct"), F.count_if(F.col("level") > 1).alias("transitive"), F.max("level").alias("max_depth"), F.round(F.avg("level"), 4).alias("avg_depth"))
    shared = shared_parents(edges).agg(F.count("*").alias("shared"))
    return shape.crossJoin(shared).withColumn("bloat", F.round(F.col("transitive") / F.greatest("direct", F.lit(1)), 4))  # one row each


def scan(deps: DataFrame, ranges: DataFrame, fixes: DataFrame, vulnerable: DataFrame, calls: DataFrame) -> DataFrame:
    """Dependencies to findings: affected versions, reachability through calls, remediation.

    ``deps(path, name, version)``, ``ranges`` as of ``intervals``, ``fixes(name, fix)``, ``vulnerable(name, id,
    functions)``, ``calls(fn, callee, endpoint)``. Reachability is a property of package and advisory, found once; the calls
    are written once, since two joins read them.
    """
    calls = _cut(calls.select("fn", "callee", "endpoint"))
    hit = affected(deps.where("version is not null").select("path", "name", "version").distinct(), ranges).select("path", "name", "version", "id").distinct()
    reach = call_reachability(vulnerable, calls).select("name", "id", "reachable", "confidence", "callers")
    fix = recommended_fix(hit.select("name", "version").distinct(), fixes, []).select("name", "version", "fix", "impact")
    out = hit.join(reach, ["name", "id"], "left").join(fix, ["name", "version"], "left")
    return out.select("path", "name", "version", "id", F.coalesce("reachable", F.lit(False)).alias("reachable"), F.coalesce("confidence", F.lit("UNKNOWN")).alias("confidence"), F.coalesce("callers", F.lit(0)).alias("callers"), F.when(F.col("fix").isNull(), "MITIGATE").otherwise("UPGRADE").alias("action"), "fix", "impact")
