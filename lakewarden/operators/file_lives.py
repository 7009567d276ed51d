"""Files through their renames, and the times in which a secret was in them.

Commits have a place ``n`` (a long, growing with time). What was last so on a path is carried forward within slices of places and over
their borders, so a path or secret that every commit touches is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut

WIDTH = 1 << 18


def carried(rows: DataFrame, keys: list[str], order: str, value: Column, width: int = WIDTH) -> DataFrame:
    """``rows`` with ``before``: the last ``value`` that isn't null, of the same keys, at a lower ``order`` (a long, unique within the keys).

    Each slice of ``width`` places is a group of its own; what its first rows lack comes from the last values of the slices before, a
    row each. Keys that are null are a key.
    """
    r = rows.withColumn("_v", value).withColumn("_s", F.floor(F.col(order) / width).cast("long"))
    inside = Window.partitionBy(*keys, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = r.groupBy(*keys, "_s").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_e"))
    ends = ends.withColumn("_b", F.last("_e", True).over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_s").alias("_t"), "_b")
    on = F.col("_s") == F.col("_t")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    got = r.withColumn("_a", F.last("_v", True).over(inside)).join(ends, on, "left")
    return got.select(*rows.columns, F.coalesce("_a", "_b").alias("before"))


def _marks(changes: DataFrame) -> DataFrame:
    """(path, o, v): where a file begins on a path (v: its place) or ends (-1); ``o`` is four steps a place: look back, end, begin, look."""
    ended = changes.where("change in ('D', 'R')").select(F.when(F.col("change") == "D", F.col("path")).otherwise(F.col("old_path")).alias("path"), (F.col("n") * 4 + 1).alias("o"), F.lit(-1).cast("long").alias("v"))
    begun = changes.where("change in ('A', 'R')").select("path", (F.col("n") * 4 + 2).alias("o"), F.col("n").alias("v"))
    return ended.union(begun).where("path is not null and o is not null").distinct()


def _placed(marks: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """``asked(path, o, row)`` with ``v``: the place where the file that is on the path then began, null without one.

    Rows that ask the same are one, so that an order is unique on its path.
    """
    one = asked.select("path", "o").distinct().withColumn("ask", F.lit(True)).withColumn("v", F.lit(None).cast("long"))
    both = carried(marks.withColumn("ask", F.lit(False)).select("path", "o", "ask", "v").union(one.select("path", "o", "ask", "v")), ["path"], "o", F.col("v"), width)
    found = both.where("ask").select("path", "o", F.nullif("before", F.lit(-1).cast("long")).alias("v"))
    return asked.join(found, ["path", "o"])


def file_lives(changes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(path, n, first_path, first_n, moves): each stay of a file on a path, from place ``n`` on, with where the file began and its moves so far.

    ``changes(n, change, path, old_path)``: A, M, D or R (from ``old_path``). A stay begins with A or R and ends with D or a move away. A
    rename continues what was on its old path just before; where nothing was (before the history, after a removal) the file begins there.
    Chains of any length are followed by doubling. Of an addition and a rename to one path in one commit the rename counts, of two the
    greater old path. Rows without a place or path are dropped, repeated rows count once.
    """
    c = changes.select(F.col("n").cast("long").alias("n"), "change", "path", "old_path")
    begun = c.where("change in ('A', 'R') and path is not null and n is not null").groupBy("path", "n").agg(F.max(F.when(F.col("change") == "R", F.col("old_path"))).alias("old_path"))
    marks = _cut(_marks(c))
    asked = begun.where("old_path is not null").select(F.col("old_path").alias("path"), (F.col("n") * 4).alias("o"), F.col("path").alias("at"), "n")
    parents = _placed(marks, asked, width).where("v is not null").select(F.col("at").alias("path"), "n", F.col("path").alias("top"), F.col("v").alias("top_n"))
    stays = begun.select("path", "n").join(parents, ["path", "n"], "left")
    at_first = F.col("top").isNull()
    at = _cut(stays.select("path", "n", F.when(at_first, F.col("path")).otherwise(F.col("top")).alias("top"), F.when(at_first, F.col("n")).otherwise(F.col("top_n")).alias("top_n"), F.when(at_first, 0).otherwise(1).cast("long").alias("moves")))
    ended, moving = None, at.where("top <> path or top_n <> n")
    while True:
        # stays whose pointer stands still are first ones; the others take their pointer's pointer
        via = at.select(F.col("path").alias("top"), F.col("n").alias("top_n"), F.col("top").alias("far"), F.col("top_n").alias("far_n"), F.col("moves").alias("more"))
        step = _cut(moving.join(via, ["top", "top_n"]).select("path", "n", F.col("far").alias("top"), F.col("far_n").alias("top_n"), (F.col("moves") + F.col("more")).alias("moves"), (F.col("more") == 0).alias("there")))
        there = step.where("there").drop("there")
        ended = there if ended is None else ended.union(there)
        moving = step.where("not there").drop("there")
        if moving.isEmpty():
            break
        at = _cut(at.where("top = path and top_n = n").union(step.drop("there")).union(at.join(step, ["path", "n"], "left_anti").where("top <> path or top_n <> n")))
    out = at.where("top = path and top_n = n").union(ended)
    return out.select("path", "n", F.col("top").alias("first_path"), F.col("top_n").alias("first_n"), "moves")


def secret_intervals(seen: DataFrame, changes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(fingerprint, from_n, from_commit, from_ts, to_n, to_commit, to_ts): each time in which a secret was in any file; open ones end with nulls.

    ``seen(fingerprint, path, n, commit, ts, added)``: lines of commits that hold the secret, added or removed. A secret is in a file from the
    commit that adds it to the one that removes it and doesn't add it again, moves of the file aside; what is removed in one
    file and added in another by one commit goes on. A removal of what wasn't there counts as nothing. Rows without fingerprint, path or place are dropped.
    """
    s = seen.where("fingerprint is not null and path is not null and n is not null").select("fingerprint", "path", F.col("n").cast("long").alias("n"), "commit", "ts", F.coalesce("added", F.lit(False)).alias("added"))
    c = changes.select(F.col("n").cast("long").alias("n"), "change", "path", "old_path")
    asked = s.withColumn("o", F.col("n") * 4 + F.when(F.col("added"), 3).otherwise(0))
    placed = _placed(_marks(c), asked, width)
    lives = file_lives(c, width).select("path", F.col("n").alias("v"), "first_path", "first_n")
    held = placed.join(lives, ["path", "v"], "left").select("fingerprint", F.coalesce("first_path", "path").alias("file"), F.coalesce("first_n", F.lit(-1)).alias("file_n"), "n", "commit", "ts", "added")
    state = held.groupBy("fingerprint", "file", "file_n", "n").agg(F.max("added").alias("has"), F.min("commit").alias("commit"), F.min("ts").alias("ts"))
    state = carried(state, ["fingerprint", "file", "file_n"], "n", F.col("has"), width).withColumn("had", F.coalesce("before", F.lit(False))).where("has <> had")
    step = state.groupBy("fingerprint", "n").agg(F.sum(F.when(F.col("has"), 1).otherwise(-1)).alias("d"), F.min("commit").alias("commit"), F.min("ts").alias("ts")).where("d <> 0")
    # how many files hold it: sums within a slice and of the slices before
    step = _cut(step.withColumn("_s", F.floor(F.col("n") / width).cast("long")))
    sums = step.groupBy("fingerprint", "_s").agg(F.sum("d").alias("all"))
    sums = sums.select("fingerprint", "_s", F.coalesce(F.sum("all").over(Window.partitionBy("fingerprint").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    files = F.sum("d").over(Window.partitionBy("fingerprint", "_s").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    step = step.withColumn("inside", files).join(sums, ["fingerprint", "_s"]).withColumn("files", F.col("inside") + F.col("base"))
    edge = step.where("files = 0 or files = d").select("fingerprint", "n", "commit", "ts", (F.col("files") > 0).alias("starts"))
    edge = _cut(edge)
    begin = F.struct("n", "commit", "ts")
    shut = carried(edge, ["fingerprint"], "n", F.when(F.col("starts"), begin), width).where("not starts")
    shut = shut.select("fingerprint", F.col("before.n").alias("from_n"), F.col("before.commit").alias("from_commit"), F.col("before.ts").alias("from_ts"), F.col("n").alias("to_n"), F.col("commit").alias("to_commit"), F.col("ts").alias("to_ts"))
    last = edge.groupBy("fingerprint").agg(F.max_by(F.struct("n", "commit", "ts", "starts"), "n").alias("r")).where("r.starts")
    empty = lambda c: F.lit(None).cast(edge.schema[c].dataType)
    open_ = last.select("fingerprint", F.col("r.n").alias("from_n"), F.col("r.commit").alias("from_commit"), F.col("r.ts").alias("from_ts"), empty("n").alias("to_n"), empty("commit").alias("to_commit"), empty("ts").alias("to_ts"))
    return shut.union(open_)


def exposures(intervals: DataFrame, head: DataFrame, now: Column) -> DataFrame:
    """(fingerprint, intervals, exposure_days, active, agrees): whole days of all times together, open ones up to ``now``.

    ``active``: the head (``head(fingerprint)``) holds it; ``agrees``: the history says the same. What the head holds though the history says
    that it went has no open time, and no days for it.
    """
    days = F.datediff(F.coalesce("to_ts", now), F.col("from_ts")).cast("long")
    g = intervals.groupBy("fingerprint").agg(F.count("*").alias("intervals"), F.sum(days).alias("exposure_days"), F.max(F.col("to_n").isNull()).alias("open"))
    h = head.select("fingerprint").where("fingerprint is not null").distinct().withColumn("active", F.lit(True))
    out = g.join(h, "fingerprint", "left").withColumn("active", F.coalesce("active", F.lit(False)))
    return out.select("fingerprint", "intervals", "exposure_days", "active", (F.col("active") == F.col("open")).alias("agrees"))
