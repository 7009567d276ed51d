"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; a row's fractional rank is
(rank + u) / n, with n the source's rows and u a seeded shift of the source in [0, 1). In the order of
fractional ranks every source is spread evenly, so cutting that order into equal runs gives shards that
all hold the mixture, with row counts at most one apart.

Neither ranking ever brings a source into one task. The shuffle hash is uniform, so its top bits cut
each source into even buckets, more of them the more rows there are: bucket sizes summed before a bucket, plus the row's place in its bucket,
give the rank. Fractional ranks are uniform by construction, so the second ranking does the same.
Texts don't move: after one scan only ids, sizes and checksums do.

Groups: equal texts are rows like others here and may go to different shards; the law ``rows`` binds counts.

Defined results: null text has size 1 and the checksum of no bytes; null source is a source of its own;
null ids (told apart by their place in the table) and repeated rows are rows like others (equal rows share
a hash, and may take each other's place); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, small_frame

#: Rows that a bucket is to have about, and the bits of the hash that may cut buckets.
BUCKET_ROWS, LEAST_BITS, MOST_BITS = 20_000, 10, 20


def interleave(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``."""
    spark = docs.sparkSession
    ws = Workspace(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    stratum = F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), stratum.alias("stratum"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    rows = ws.stage(rows.withColumn("h", F.xxhash64(F.lit(seed), own, "text_crc32", "size")), "rows")
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, rows.count()) / BUCKET_ROWS))))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))

    of = W.partitionBy("stratum")
    sizes = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("k"))
    sizes = sizes.select("stratum", "bucket", F.sum("k").over(of).alias("n"), (F.sum("k").over(of.orderBy("bucket")) - F.col("k")).alias("before"))
    place = F.row_number().over(W.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "size")) - 1
    shift = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "stratum"), 11) / F.lit(float(1 << 53))
    ranked = rows.join(sizes, ["stratum", "bucket"]).withColumn("rank", F.col("before") + place)
    ranked = ranked.select("doc_id", "size", "text_crc32", "h", ((F.col("rank") + shift) / F.col("n")).alias("fraction"))
    ranked = ws.stage(ranked.withColumn("cut", F.least(F.floor(F.col("fraction") * (1 << bits)), F.lit((1 << bits) - 1)).cast("int")), "ranked")

    total, before = 0, []
    for cut, k in sorted((r[0], r[1]) for r in ranked.groupBy("cut").count().collect()):  # at most 2**bits rows
        before.append((cut, total))
        total += k
    base = F.broadcast(small_frame(spark, before, "cut int, base long"))
    at = F.row_number().over(W.partitionBy("cut").orderBy("fraction", "h", "doc_id", "size")) - 1
    n = F.lit(total)
    placed = ranked.join(base, "cut").withColumn("at", F.col("base") + at)
    placed = placed.withColumn("shard", F.expr(f"cast(at * {shards} div {max(total, 1)} as int)"))
    first = F.floor((F.col("shard") * n + (shards - 1)) / shards) if total < 1 << 45 else F.expr(f"(cast(shard as decimal(38,0)) * {total} + {shards - 1}) div {shards}")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("at") - first).cast("long").alias("slot"))
