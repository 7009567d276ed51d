"""Bounded samples of labelled rows, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, held_out, small_frame


def share(*cols, seed: int):
    """A uniform number in [0, 1) that the columns and the seed decide."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def labelled_sample(ws: Workspace, docs: DataFrame, labels: DataFrame, label: str, sample: int, seed: int, mod: int, rest: int, id_col: str, text_col: str) -> DataFrame:
    """text, y, fold (0 or 1), u in [0, 1), row of about ``sample`` labelled rows, at most 1.2 times as many ids.

    Held-out rows never take part, nor do ids whose label rows differ. Ids meet as text, of any type. The ids
    are what is broadcast. The sample is written once; whoever collects from it bounds the rows, smallest first.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), mod, rest))
    known = known.groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.min(F.col(label).cast("double")).alias("y"), F.max(F.col(label).cast("double")).alias("y1"))
    known = known.where("y = y1").select("id", "y")
    n = known.count()
    if n > sample:
        known = known.where(share("id", seed=seed) < sample / n)
    ids = known.orderBy(share("id", seed=seed), "id").limit(int(1.2 * sample)).collect()
    ids = small_frame(docs.sparkSession, sorted((r.id, r.y) for r in ids), "id string, y double")
    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    found = found.select("text", "y", (share("id", seed=seed + 1) < 0.5).cast("int").alias("fold"), share("id", seed=seed + 2).alias("u"))
    return ws.stage(found.withColumn("row", F.monotonically_increasing_id()), f"sample_{label}")
