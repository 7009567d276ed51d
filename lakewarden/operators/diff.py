"""Comparisons of two states: baselines, snapshots, pull requests, dependencies, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def apply_baseline(findings: DataFrame, known: DataFrame, resolved: DataFrame) -> DataFrame:
    """EXISTING if the baseline has the fingerprint, REOPENED if it was resolved, else NEW."""
    out = findings.join(known.select("fingerprint").distinct().withColumn("_k", F.lit(True)), "fingerprint", "left")
    out = out.join(resolved.select("fingerprint").distinct().withColumn("_r", F.lit(True)), "fingerprint", "left")
    return out.withColumn("state", F.when(F.col("_k"), "EXISTING").when(F.col("_r"), "REOPENED").otherwise("NEW")).drop("_k", "_r")


def compare_snapshots(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Each key once, with NEW, FIXED or EXISTING; both sides are made distinct before the join."""
    a = before.select(key).distinct().withColumn("_a", F.lit(True))
    b = after.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_a").isNull(), "NEW").when(F.col("_b").isNull(), "FIXED").otherwise("EXISTING").alias("change"))


def dependency_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """name, old, new, change; of rows of one name the last (by ``ord``) counts."""
    last = lambda d, n: d.groupBy("name").agg(F.max_by("version", "ord").alias(n))
    j = last(base, "old").join(last(head, "new"), "name", "full_outer")
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.col("old") != F.col("new"), "CHANGED").otherwise("SAME")
    return j.withColumn("change", change).where("change <> 'SAME'")


def trend(scores: DataFrame, keys: list[str], at: str, score: str) -> DataFrame:
    """Score change against the previous snapshot: more than one point improves or degrades."""
    delta = F.col(score) - F.lag(score).over(W.partitionBy(*keys).orderBy(at))
    out = scores.withColumn("delta", F.round(delta, 4))
    return out.withColumn("trend", F.when(F.col("delta") > 1, "improving").when(F.col("delta") < -1, "degrading").otherwise("stable"))
