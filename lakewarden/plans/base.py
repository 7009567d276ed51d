"""Tables of the driver as inputs: findings made of events, dependencies made of parts, graphs of order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import findings as O
from ..operators.risk import finding_risk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan whose rows go to Python next: dealt over all cores where it has fewer partitions, else as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(2 * cores) if scan.rdd.getNumPartitions() < cores else scan


def pick(n, *values):
    """The value of a number's remainder."""
    out = None
    for i, v in enumerate(values):
        hit = n % len(values) == i
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return out


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    cat = F.when(F.col("event_type") == "error", "INJECTION").when(F.col("event_type") == "click", "TAINT").when(F.col("event_type") == "view", "CONFIGURATION").when(F.col("event_type") == "signup", "SECRET_LEAK").otherwise("OTHER")
    out = e.select(
        i.alias("ordinal"),
        "ts",
        (u % 20).alias("project"),
        F.concat(F.lit("R"), (i % 7).cast("string")).alias("rule_id"),
        pick(i, "CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO").alias("severity"),
        pick(F.floor(i / 5), "HIGH", "MEDIUM", "LOW", "UNKNOWN").alias("confidence"),
        cat.alias("category"),
        F.concat(pick(u, "api/", "web/", "", "core/auth/"), F.lit("mod"), u.cast("string"), F.lit(".py")).alias("file_path"),
        (i % 40).alias("line"),
        F.when(i % 3 == 0, "request.args").alias("source"),
        F.when(i % 2 == 0, "os.system").alias("sink"),
        F.concat("event_type", F.lit(" finding")).alias("title"),
        F.col("props").alias("evidence"),
        pick(u, "REACHABLE", "STATIC_REACHABILITY", "UNREACHABLE", "UNKNOWN").alias("reachability"),
        pick(u, "INTERNET_FACING", "AUTHENTICATED", "INTERNAL", "UNKNOWN", "LOCAL").alias("exposure"),
        pick(F.floor(i / 7), "NEW", "EXISTING", "SUPPRESSED", "RESOLVED", "REOPENED").alias("state"),
    )
    return out.withColumn("fingerprint", O.fingerprint()).withColumn("risk_score", finding_risk())


FINDINGS = """
WITH base AS (
  SELECT event_id AS ordinal, ts, user_id % 20 AS project, 'R' || (event_id % 7) AS rule_id,
    ['CRITICAL','HIGH','MEDIUM','LOW','INFO'][event_id % 5 + 1] AS severity,
    ['HIGH','MEDIUM','LOW','UNKNOWN'][(event_id // 5) % 4 + 1] AS confidence,
    CASE event_type WHEN 'error' THEN 'INJECTION' WHEN 'click' THEN 'TAINT' WHEN 'view' THEN 'CONFIGURATION' WHEN 'signup' THEN 'SECRET_LEAK' ELSE 'OTHER' END AS category,
    ['api/','web/','','core/auth/'][user_id % 4 + 1] || 'mod' || user_id || '.py' AS file_path,
    event_id % 40 AS line, CASE WHEN event_id % 3 = 0 THEN 'request.args' END AS source, CASE WHEN event_id % 2 = 0 THEN 'os.system' END AS sink,
    event_type || ' finding' AS title, props AS evidence,
    ['REACHABLE','STATIC_REACHABILITY','UNREACHABLE','UNKNOWN'][user_id % 4 + 1] AS reachability,
    ['INTERNET_FACING','AUTHENTICATED','INTERNAL','UNKNOWN','LOCAL'][user_id % 5 + 1] AS exposure,
    ['NEW','EXISTING','SUPPRESSED','RESOLVED','REOPENED'][(event_id // 7) % 5 + 1] AS state
  FROM events),
scored AS (
  SELECT *, CASE severity WHEN 'CRITICAL' THEN 10.0 WHEN 'HIGH' THEN 7.5 WHEN 'MEDIUM' THEN 5.0 WHEN 'LOW' THEN 2.5 ELSE 0.5 END::DOUBLE AS weight,
    CASE confidence WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.8 WHEN 'LOW' THEN 0.5 ELSE 0.2 END::DOUBLE AS mult,
    category IN ('TAINT','INJECTION','CODE_INJECTION') AS flow,
    sha256(concat_ws(':', rule_id, file_path, line::VARCHAR, coalesce(source,''), coalesce(sink,''), title)) AS fingerprint
  FROM base),
findings AS (
  SELECT *, greatest(0.0, least(100.0, round(
    CASE severity WHEN 'CRITICAL' THEN 40.0 WHEN 'HIGH' THEN 30.0 WHEN 'MEDIUM' THEN 20.0 WHEN 'LOW' THEN 10.0 ELSE 2.0 END::DOUBLE * mult
    + CASE reachability WHEN 'REACHABLE' THEN 20.0 WHEN 'STATIC_REACHABILITY' THEN 15.0 WHEN 'UNREACHABLE' THEN -10.0 ELSE 0.0 END::DOUBLE
    + CASE exposure WHEN 'INTERNET_FACING' THEN 20.0 WHEN 'AUTHENTICATED' THEN 10.0 WHEN 'INTERNAL' THEN 5.0 ELSE 0.0 END::DOUBLE
    + CASE WHEN flow OR (source IS NOT NULL AND sink IS NOT NULL) THEN 15.0 ELSE 0.0 END::DOUBLE
    + CASE WHEN regexp_matches(lower(file_path), 'auth|security|payment|api|infra') THEN 10.0 ELSE 0.0 END::DOUBLE, 1))) AS risk_score
  FROM scored)
"""


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packages: a name with mixed separators and a version of price and size."""
    p = table(spark, sf_dir, "part")
    version = F.concat_ws(".", (F.col("p_size") % 6).cast("string"), (F.col("p_partkey") % 10).cast("string"), F.floor(F.col("p_retailprice") % 7).cast("string"))
    raw = F.concat(F.initcap("p_name"), F.lit("_"), F.lower("p_type"))
    return p.select(F.col("p_partkey").alias("ord"), F.regexp_replace(raw, " ", ".").alias("raw_name"), F.concat(version, F.when(F.col("p_partkey") % 9 == 0, "-rc1").otherwise("")).alias("version"))



def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier classes that order lines lead to one another: two ways out of each class."""
    li = table(spark, sf_dir, "lineitem")
    src = (F.col("l_suppkey") % 40).cast("long")
    return li.select(src.alias("src"), ((src * 3 + 1 + F.col("l_linenumber") % 2) % 37).cast("long").alias("dst")).distinct()


EDGES = """
edges AS (SELECT DISTINCT (l_suppkey % 40)::BIGINT AS src, (((l_suppkey % 40) * 3 + 1 + l_linenumber % 2) % 37)::BIGINT AS dst FROM lineitem)
"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part leads to the part of the next line of an order: real keys, none merged."""
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("src"), nxt.cast("long").alias("dst")).where("dst is not null").distinct()
