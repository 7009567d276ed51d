"""The corpus pipeline: quality, toxicity, near-duplicates, benchmark leaks, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all that its predecessor kept. All but the
last return the columns of documents. Models learn from the stage's own input and the labels table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import quality, toxicity
from lakewarden.llm.common import Workspace, table
from lakewarden.llm.decontam import decontaminate
from lakewarden.llm.packing import pack
from lakewarden.llm.queries import byte_bpe
from lakewarden.llm.simhash import near_duplicates

#: Up to so many row numbers (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def keyed(ws: Workspace, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written once so that it holds, and the number's column."""
    key = "row_key"
    while key in map(str.lower, docs.columns):
        key += "_"
    return ws.stage(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def without(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key isn't among the distinct ``keys(key)``, without that column."""
    small = keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(keys) if small else keys, key, "left_anti").select(*(F.col(f"`{c}`") for c in rows.columns if c != key))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects (score below 0.3)."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.with_scores(docs, model).where("score >= 0.3").select("doc.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity classifier rejects (score of 0.5 or more)."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, model).where("score < 0.5").select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows the one with the smallest id stays, as one row.

    Rows are told apart by number, not by id: each text of a repeated id is decided for itself. A row without
    an id comes after all that have one; of equal ids (or none) the first row stays.
    """
    ws = Workspace(spark)
    rows, key = keyed(ws, docs)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col(key).alias("row"))
    near = near_duplicates(rows.select(place.alias("place"), "text"), id_col="place")
    copies = ws.stage(near.where("doc_id.row <> component_id.row").select(F.col("doc_id.row").alias(key)), "copies")
    return without(rows, key, copies)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold ten consecutive words of a benchmark item (or a whole shorter item), whatever their id."""
    ws = Workspace(spark)
    rows, key = keyed(ws, docs)
    found = decontaminate(rows.select(F.col(key).alias("row_key"), "text"), table(spark, sf_dir, "benchmark"), width=10, id_col="row_key")
    leaks = ws.stage(found.where("contaminated").select(F.col("doc_id").alias(key)), "leaks")
    return without(rows, key, leaks)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of sequences of at most 2048 tokens."""
    return pack(docs, byte_bpe(), size=2048, end_id=0)


STAGES = [
    ("quality_classifier", keep_good),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_copies),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack_sequences),
]

#: Trained models and token ids are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = table(spark, sf_dir, "documents"), Workspace(spark)
    for name, stage in STAGES:
        docs = ws.stage(stage(spark, docs, sf_dir), name)
    return docs
