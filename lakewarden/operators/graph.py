"""Closures, paths and cycles over edge tables, level by level.

A step is a join of the frontier with the edges, less what is known; nothing is gathered on the driver.
Lineage is cut by a written table every few steps, in the shared folder that the session names.
"""

from __future__ import annotations

import atexit
import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_FOLDERS: dict[str, str] = {}


def _release(spark, folder: str) -> None:
    try:
        sc = spark.sparkContext
        if sc._jsc is not None:
            p = sc._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may already be gone
        pass


#: Up to which size of files a side of a join is broadcast outright: written tables are packed, rows take up to fifty times as much.
SMALL = 256 << 10
_BY_FILES, _BY_ROWS = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def _bytes(size: str) -> int:
    n, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", size.lower()).groups()
    return int(n) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def _measured(spark: SparkSession) -> Iterator[None]:
    """Joins are broadcast by the bytes of their rows, which are known at run time, up to the session's own threshold.

    By the size of files, before anything has run, only tables of at most ``SMALL`` are: a table of some MB of files is
    hundreds of MB as rows, and all of them would pass through the driver.
    """
    conf = spark.conf
    files, rows = conf.get(_BY_FILES), conf.get(_BY_ROWS, None)
    if _bytes(files) <= SMALL:
        yield
        return
    try:
        if rows is None:
            conf.set(_BY_ROWS, files)
        conf.set(_BY_FILES, f"{SMALL}b")
        yield
    finally:
        conf.set(_BY_FILES, files)
        if rows is None:
            conf.unset(_BY_ROWS)


def _cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written once in the session's shared folder (a temporary one in local tests), read again.

    Unlike a checkpoint it is computed once. What the driver broadcasts for it is bounded (``_measured``), so an operator whose
    last step joins written tables cuts its result as well. The folder goes when the driver ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.applicationId not in _FOLDERS:
        top = sc.getConf().get("spark.checkpoint.dir", None)
        if not top:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            top = f"file://{tempfile.gettempdir()}/checkpoints"
        _FOLDERS[sc.applicationId] = f"{top}/lakewarden-{uuid.uuid4().hex}"
        atexit.register(_release, spark, _FOLDERS[sc.applicationId])
    path = f"{_FOLDERS[sc.applicationId]}/{uuid.uuid4().hex}"
    with _measured(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _count(df: DataFrame) -> int:
    """The rows of joins of written tables, with the same bound on what is broadcast."""
    with _measured(df.sparkSession):
        return df.count()


def levels(edges: DataFrame, starts: DataFrame, depth: int | None) -> DataFrame:
    """(start, node, level): the least number of steps from each start, up to ``depth``, or as far as it goes (None)."""
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    known = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("level")).distinct()
    frontier = known
    for n in itertools.count(1) if depth is None else range(1, depth + 1):
        if n % 8 == 0:
            known = _cut(known)
        new = frontier.join(e, frontier.node == e.src).select("start", F.col("dst").alias("node")).distinct()
        frontier = _cut(new.join(known, ["start", "node"], "left_anti").withColumn("level", F.lit(n)))
        if frontier.isEmpty():
            break
        known = known.union(frontier)
    return known


def simple_paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, path) of all simple paths of 1 to ``depth`` steps."""
    e = edges.select("src", "dst").distinct()
    at = starts.select(F.col("node").alias("start"), "node", F.array("node").alias("path")).distinct()
    out = None
    for _ in range(depth):
        at = at.join(e, at.node == e.src).where("not array_contains(path, dst)").select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        at = _cut(at)
        if at.isEmpty():
            break
        out = at if out is None else out.union(at)
    return out if out is not None else at


def ranked_paths(paths: DataFrame, risk: DataFrame, per_pair: int = 10, most: int = 50) -> DataFrame:
    """A report's attack paths: riskiest first, at most ``per_pair`` of each start and target and ``most`` in all.

    ``risk(node, risk)``; a path's risk is that of its riskiest node. Ties go to the shorter, then the smaller path.
    """
    on = paths.withColumn("at", F.explode("path")).join(risk.select(F.col("node").alias("at"), "risk"), "at", "left")
    g = on.groupBy("start", "node", "path").agg(F.coalesce(F.max("risk"), F.lit(0.0)).alias("risk"))
    w = Window.partitionBy("start", "node").orderBy(F.desc("risk"), F.size("path"), "path")
    top = g.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_pair).drop("n")
    return top.orderBy(F.desc("risk"), F.size("path"), "path").limit(most)


def best_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, risk: DataFrame, depth: int, k: int = 10, width: int = 4) -> DataFrame:
    """(start, node, path, risk): the ``k`` best simple paths of 1 to ``depth`` steps of each start and target, without listing all.

    Better is riskier (a path's risk is that of its riskiest node, 0 where ``risk(node, risk)`` has none), then shorter, then the
    smaller path, as in ``ranked_paths``. Going back from the targets finds, for each node, target and number of steps left, the
    highest risk that any walk meets; so a beginning of a path has a bound that no end of it can beat. Each round goes on with the
    ``width * k`` beginnings of each pair that have the best bounds and keeps the others; a beginning is dropped only when ``k``
    whole paths beat its bound. The result is therefore that of listing all, and a pair's rows grow with its rounds, not with its
    paths. A node never comes twice; a start that is also a target has no path to itself. Nulls and repeated rows don't count.
    """
    e = _cut(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    r = _cut(risk.groupBy("node").agg(F.coalesce(F.max("risk"), F.lit(0.0)).cast("double").alias("r")))
    first = starts.select(F.col("node").alias("start")).where("start is not null").distinct()
    near = _cut(levels(e, first.withColumnRenamed("start", "node"), depth - 1).groupBy("node").agg(F.min("level").alias("near")))
    # walks back from the targets: ``steps`` to go, ``most`` the highest risk after the node itself
    back = targets.select(F.col("node").alias("target")).where("target is not null").distinct().join(r.withColumnRenamed("node", "target"), "target", "left")
    at = back.select("target", F.col("target").alias("node"), F.coalesce("r", F.lit(0.0)).alias("through"))
    ways = None
    for n in range(1, depth + 1):
        step = at.withColumnRenamed("node", "dst").join(e, "dst").where("src <> target").groupBy("target", F.col("src").alias("node")).agg(F.max("through").alias("most"))
        step = _cut(step.join(near, "node").where(F.col("near") + n <= depth).select("target", "node", F.lit(n).alias("steps"), "most"))
        if step.isEmpty():
            break
        ways = step if ways is None else ways.union(step)
        at = step.join(r, "node", "left").select("target", "node", F.greatest("most", F.coalesce("r", F.lit(0.0))).alias("through"))
    if ways is None:
        return _cut(back.select(F.col("target").alias("start"), F.col("target").alias("node"), F.array("target").alias("path"), F.lit(0.0).alias("risk")).limit(0))
    ways = _cut(ways.groupBy("target", "node").agg(F.collect_list(F.struct("steps", "most")).alias("ways")))  # at most ``depth`` of them

    def bounded(begun: DataFrame) -> DataFrame:
        """Beginnings with the least (-risk, steps) that an end of theirs can give; those without an end go."""
        gone = F.size("path") - 1
        open_ = F.filter("ways", lambda w: w["steps"] + gone <= depth)
        bound = F.array_min(F.transform(open_, lambda w: F.struct((-F.greatest(F.col("risk"), w["most"])).alias("less"), (w["steps"] + gone).alias("steps"))))
        return begun.join(ways, ["target", "node"]).withColumn("bound", bound).where("bound is not null").select("start", "target", "node", "path", "risk", "bound")

    rank = Window.partitionBy("start", "target").orderBy("bound", "path")
    begun = first.join(r.withColumnRenamed("node", "start"), "start", "left").select("start", F.col("start").alias("node"), F.array("start").alias("path"), F.coalesce("r", F.lit(0.0)).alias("risk"))
    begun = _cut(bounded(begun.join(ways.select("node", "target"), "node").where("start <> target")))
    found = None
    while not begun.isEmpty():
        now = _cut(begun.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= width * k).drop("n"))
        later = begun.join(now.select("start", "target", "path"), ["start", "target", "path"], "left_anti").select(*begun.columns)
        on = now.join(e, now.node == e.src).where("not array_contains(path, dst)").join(r.withColumnRenamed("node", "dst"), "dst", "left")
        on = _cut(on.select("start", "target", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.greatest("risk", F.coalesce("r", F.lit(0.0))).alias("risk")))
        whole = on.where("node = target").select("start", "target", "path", "risk", F.struct((-F.col("risk")).alias("less"), (F.size("path") - 1).alias("steps")).alias("bound"))
        whole = whole if found is None else found.union(whole)
        found = _cut(whole.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k).drop("n"))
        last = found.groupBy("start", "target").agg(F.count("*").alias("n"), F.max(F.struct("bound", "path")).alias("last")).where(F.col("n") == k).select("start", "target", "last")
        rest = later.union(bounded(on.where("node <> target"))).join(last, ["start", "target"], "left")
        beats = (F.col("bound") < F.col("last.bound")) | ((F.col("bound") == F.col("last.bound")) & (F.col("path") <= F.slice("last.path", 1, F.size("path"))))
        begun = _cut(rest.where(F.col("last").isNull() | beats).select(*begun.columns))
    if found is None:
        found = begun.select("start", "target", "path", "risk", "bound")
    return found.select("start", F.col("target").alias("node"), "path", "risk")


def shortest_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(start, node, hops, path) of the first shortest path to each target that a start reaches."""
    e = edges.select("src", "dst").distinct()
    best = starts.select(F.col("node").alias("start"), "node", F.array("node").alias("path")).distinct()
    frontier, found = best, best
    for _ in range(depth):
        step = frontier.join(e, frontier.node == e.src).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("start", "node").agg(F.min("path").alias("path"))
        frontier = _cut(step.join(found.select("start", "node"), ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        found = found.union(frontier)
    hit = found.join(targets.select("node").distinct(), "node", "left_semi")
    return hit.select("start", "node", (F.size("path") - 1).alias("hops"), "path").where("hops > 0")


def _trimmed(e: DataFrame) -> tuple[DataFrame, int]:
    """Edges less those of nodes without predecessors or successors, repeatedly: they are on no cycle."""
    n = e.count()
    while n:
        core = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        e = _cut(core.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if n == (n := e.count()):
            break
    return e, n


def strong_components(edges: DataFrame, steps: int = 8) -> DataFrame:
    """(node, component): nodes that reach each other share the smallest of them; lone nodes with a loop too.

    Each node takes the smallest node that reaches it as its colour. Those that reach a colour's own node within
    the colour are its component; they are taken out and the rest is coloured anew. There is no limit on a
    cycle's length; lineage is cut every ``steps`` steps (2 while many colours are new), and a step's tables have at most a row
    an edge.
    """
    e, n = _trimmed(_cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct()))
    loops = _cut(e.where("src = dst").select(F.col("src").alias("node")))
    out = None
    while n:
        colours = _cut(e.select(F.col("src").alias("node"), F.col("src").alias("colour")).distinct())
        fresh = colours
        while not fresh.isEmpty():
            # only colours that are new go on; what they reach is compared with what is known once a round
            at, reached = fresh, None
            for _ in range(2 if fresh.count() * 16 > n else steps):
                at = e.join(at.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("colour"))
                reached = at if reached is None else reached.union(at)
            reached = reached.groupBy("node").agg(F.min("colour").alias("colour"))
            old = colours.withColumnRenamed("colour", "old")
            now = _cut(old.join(reached, "node", "left").select("node", F.least("old", "colour").alias("colour"), (F.col("colour") < F.col("old")).alias("new")))
            colours, fresh = now.select("node", "colour"), now.where("new").select("node", "colour")
        own = e.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colours.select(F.col("node").alias("dst"), "colour"), "dst")
        own = own.where("c = colour").select("src", "dst", "colour")
        own = _cut(own.union(colours.select("node", "node", "colour")).distinct())
        found, m = _cut(colours.where("node = colour")), 0
        while m != (m := found.count()):
            for _ in range(steps):
                found = own.join(found.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct()
            found = _cut(found)
        out = found if out is None else out.union(found)
        e, n = _trimmed(_cut(without_nodes(e, found)))
    if out is None:
        return e.select(F.col("src").alias("node"), F.col("src").alias("component"))
    many = out.groupBy("colour").count().where("count > 1").select("colour")
    alone = out.join(many, "colour", "left_anti").join(loops, "node", "left_semi")
    return out.join(many, "colour", "left_semi").select("node", "colour").union(alone.select("node", "colour")).withColumnRenamed("colour", "component")


def without_nodes(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges that neither start nor end in a removed node (what-if)."""
    r = removed.select("node").distinct()
    out = edges.join(r.withColumnRenamed("node", "src"), "src", "left_anti")
    return out.join(r.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
