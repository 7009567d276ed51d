"""What the operators share: tables, the shared folder, importability on executors."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed on them."""
    env = spark.sparkContext.environment
    have = (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH") or "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
    # rows go to Python in batches of so many bytes (or one longer row), not of 10,000 texts of any length
    now = spark.conf.get(BATCH_CONF)
    if not re.fullmatch(r"\d+b", now) or int(now[:-1]) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, f"{BATCH_BYTES}b")


class Workspace:
    """A folder under ``spark.checkpoint.dir`` for tables that cut lineage.

    All executors see that folder, so a written table survives the loss of any of them. Only where
    the setting is absent and the master is local (tests) a temporary folder takes its place.
    The folder is removed when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        sc = spark.sparkContext
        top = sc.getConf().get("spark.checkpoint.dir", None)
        if not top:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            top = f"file://{tempfile.gettempdir()}/checkpoints"
        self.path = f"{top}/lakewarden-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.release)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back."""
        self._n += 1
        path = f"{self.path}/{self._n}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        try:
            sc = self.spark.sparkContext
            if sc._jsc is None:
                return
            p = sc._jvm.org.apache.hadoop.fs.Path(self.path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may already be gone
            pass


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, equals ``rest``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


def small_frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def raws(col: pa.Array) -> list[bytes | None]:
    """The bytes of a string column, whatever they encode."""
    return col.cast(pa.binary()).to_pylist()


def strings(col: pa.Array) -> list[str | None]:
    """The texts of a string column; bytes that are no UTF-8 become the replacement character."""
    try:
        return col.to_pylist()
    except UnicodeDecodeError:
        return [None if t is None else t.decode("utf-8", "replace") for t in raws(col)]


def scored(of, kind: str):
    """A function of a text column from ``of()``, made once a partition, which maps a list of texts to an Arrow array.

    Only the text goes to Python and only the result comes back; the other columns wait in the JVM.
    Optimiser rules neither repeat nor move it.
    """

    def own(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = of()
        for c in columns:
            yield f(strings(c))

    return F.arrow_udf(own, kind).asNondeterministic()


def ragged(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row lengths and flat values of a list column (null rows: length 0)."""
    n = np.asarray(col.value_lengths().fill_null(0))
    return n.astype(np.int64), col.flatten()


# --- labels of local groups, shared by the two near-duplicate joins ---------------------------


def find(parent: np.ndarray) -> np.ndarray:
    """Point every node at its root, in place."""
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent[:] = up


def unite(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the sets of u[i] and v[i]; a root is the smallest node of its set."""
    while len(u):
        find(parent)
        a, b = parent[u], parent[v]
        keep = a != b
        u, v = np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])
        parent[v] = u


def components(ws: Workspace, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node -> root (smallest node) of every node of ``edges(a long, b long)``.

    Alternating large-star and small-star rounds: each is one aggregation and one join on edges. The
    aggregate is written before the join, so that neither side of the join is fixed to one task a key and
    Spark splits a hub's neighbours (or broadcasts the aggregate where it is small). Every round is written
    to the shared folder. It ends when the edges are stars: each node has one edge up, to a node without.
    Nodes without an edge don't appear.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = ws.stage(e, "edges")
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = ws.stage(large.distinct(), "large")
        low = ws.stage(e.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = ws.stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        heads = e.select(F.col("v").alias("u"), F.lit(True).alias("head")).distinct()
        if e.groupBy("u").agg(F.count("*").alias("n")).join(heads, "u", "left").where("n > 1 or head").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
