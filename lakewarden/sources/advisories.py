"""Advisory records in the OSV shape to interval events and a versioned table of advisories."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "id string, summary string, details string, aliases array<string>, published string, modified string, withdrawn string, references array<struct<url:string>>, severity array<struct<type:string,score:string>>, "
    "affected array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,events:array<map<string,string>>>>>>"
)
STALE_DAYS = 30


def parse_records(raw: DataFrame, column: str = "json") -> DataFrame:
    """One row per record: id, summary, aliases, times, cvss estimate, affected; unreadable records give none."""
    r = raw.select(F.from_json(column, RECORD).alias("r")).where("r.id is not null").select("r.*")
    vector = F.coalesce(F.get(F.col("severity"), F.lit(0))["score"], F.lit(""))
    score = F.when(F.contains(vector, F.lit("HIGH")) | F.contains(vector, F.lit("AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H")), 9.8).when(F.contains(vector, F.lit("CVSS:3")), 7.5).otherwise(5.0)
    first_line = F.split_part(F.coalesce("details", F.lit("")), F.lit("\n"), F.lit(1))
    return r.select(
        "id",
        F.coalesce("summary", F.nullif(first_line, F.lit("")), "id").alias("summary"),
        "aliases",
        *(F.to_timestamp(c).alias(c) for c in ("published", "modified", "withdrawn")),
        F.transform("references", lambda x: x["url"]).alias("references"),
        score.alias("cvss"),
        "affected",
    )


def interval_events(records: DataFrame) -> DataFrame:
    """id, package, ord, kind, version: the ordered events of every range, ready for ``sca.intervals``."""
    a = records.select("id", F.explode("affected").alias("a")).select("id", F.col("a.package.name").alias("package"), F.posexplode("a.ranges").alias("i", "r"))
    e = a.select("id", "package", "i", F.posexplode("r.events").alias("j", "e")).select("id", "package", F.struct("i", "j").alias("o"), F.posexplode(F.map_entries("e")).alias("k", "x"))
    return e.select("id", "package", F.struct("o.i", "o.j", "k").alias("ord"), F.col("x.key").alias("kind"), F.col("x.value").alias("version"))


def fixed_versions(records: DataFrame) -> DataFrame:
    """Each record's fixed versions, once each, in order."""
    e = interval_events(records).where("kind = 'fixed'").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "version"))).alias("v"))
    return e.select("id", F.array_distinct(F.transform("v", lambda x: x["version"])).alias("fixed"))


def publish(advisories: DataFrame, folder: str) -> str:
    """Write a new version beside the old ones, then point to it: readers see one or the other whole."""
    spark = advisories.sparkSession
    version = f"{folder}/v{time.time_ns()}"
    advisories.write.parquet(version)
    spark.createDataFrame([(version,)], "path string").coalesce(1).write.mode("append").json(f"{folder}/_current.log")
    return version


def current(spark: SparkSession, folder: str) -> DataFrame:
    newest = spark.read.schema("path string").json(f"{folder}/_current.log").agg(F.max("path")).first()[0]
    return spark.read.parquet(newest)


def rollback(spark: SparkSession, folder: str) -> str:
    """Publish the version before the current one anew."""
    versions = [r.path for r in spark.read.schema("path string").json(f"{folder}/_current.log").distinct().orderBy(F.desc("path")).limit(2).collect()]
    if len(versions) < 2:
        raise ValueError("there is no earlier version")
    return publish(spark.read.parquet(versions[1]), folder)


def is_stale(modified, now):
    return F.datediff(now, modified) > STALE_DAYS


def answered(keys: DataFrame, cache: DataFrame, now, ttl_days: int = 7) -> DataFrame:
    """Each asked key with its newest cached answer: HIT, STALE (older than the time to live) or MISS.

    ``keys(key)``, ``cache(key, fetched, json)``. What is a miss offline has no answer; nothing is fetched here.
    """
    newest = cache.groupBy("key").agg(F.max_by("json", "fetched").alias("json"), F.max("fetched").alias("fetched"))
    state = F.when(F.col("fetched").isNull(), "MISS").when(F.datediff(F.lit(now).cast("timestamp"), "fetched") > ttl_days, "STALE").otherwise("HIT")
    return keys.select("key").distinct().join(newest, "key", "left").select("key", state.alias("state"), F.when(state == "HIT", F.col("json")).alias("json"))


def yanked(deps: DataFrame, metadata: DataFrame) -> DataFrame:
    """deps(name, version) with ``yanked`` and ``why`` of ``metadata(name, version, yanked, reason)``; unknown releases aren't."""
    m = metadata.groupBy("name", "version").agg(F.max("yanked").alias("_y"), F.max("reason").alias("_r"))
    return deps.join(m, ["name", "version"], "left").withColumn("yanked", F.coalesce("_y", F.lit(False))).withColumn("why", F.when(F.col("yanked"), F.col("_r"))).drop("_y", "_r")
