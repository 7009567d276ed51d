"""Flows of a workspace that changes: only what a change can touch is read and followed again.

A snapshot has three tables: files by path, hash of the content and rule version, their def-use rows, and their flows. The
next snapshot takes over the rows of files whose hash and version are the same, and parses the others. Flows never leave a group of files
that name each other's modules, so only groups with a changed, new or removed file are followed again; all other flows
are taken over by anti-join. The result is that of a run over all files.

A file over the budget isn't parsed; it is listed in ``limits`` and has no rows, so one file can't hold a task for long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.def_use import def_use
from .dataflow import TaintConfig, labelled_paths
from .graph import _cut, levels


@dataclass(frozen=True)
class Snapshot:
    files: DataFrame  # path, hash, version, skipped
    facts: DataFrame
    flows: DataFrame
    parsed: DataFrame  # path: files that were read in this run
    followed: DataFrame  # path: files whose flows were followed in this run

    @property
    def limits(self) -> DataFrame:
        """path, limit of files over the budget."""
        return self.files.where("skipped").select("path", F.lit("LIMIT").alias("limit"))

    def write(self, folder: str) -> None:
        for name in ("files", "facts", "flows"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def read_snapshot(spark, folder: str) -> Snapshot:
    files, facts, flows = (spark.read.parquet(f"{folder}/{name}") for name in ("files", "facts", "flows"))
    none = files.select("path").limit(0)
    return Snapshot(files, facts, flows, none, none)


def module_links(facts: DataFrame) -> DataFrame:
    """src, dst: files of which one names the other's module in an import or call, or a name below it; both ways."""
    modules = facts.where("kind = 'module' and name <> ''").select(F.col("name").alias("module"), F.col("path").alias("there"))
    named = facts.where("kind = 'bind'").select("path", F.explode(F.array("text", F.regexp_replace("name", r"\.?[^.]*$", ""))).alias("n")).union(facts.where("kind = 'target' and text is null").select("path", "name"))
    parts = F.split("n", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    one = named.distinct().select("path", F.explode(prefixes).alias("module")).distinct().join(modules, "module").where("path <> there").select(F.col("path").alias("src"), F.col("there").alias("dst"))
    return one.union(one.select("dst", "src")).distinct()


def snapshot(files: DataFrame, version: str, old: Snapshot | None = None, config: TaintConfig | None = None, budget: int = 2_000_000) -> Snapshot:
    """The snapshot of ``files(path, content)`` under rules of some version, from an older one where there is one."""
    content = F.coalesce("content", F.lit(""))
    now = files.select("path", "content", F.sha2(content.cast("binary"), 256).alias("hash"), F.lit(version).alias("version"), (F.length(content) > budget).alias("skipped"))
    state = _cut(now.drop("content"))
    if old is None:
        fresh, gone = state.select("path"), state.select("path").limit(0)
    else:
        fresh = state.join(old.files.select("path", "hash", "version", "skipped"), ["path", "hash", "version", "skipped"], "left_anti").select("path")
        gone = old.files.select("path").join(state.select("path"), "path", "left_anti")
    fresh, gone = _cut(fresh), _cut(gone)
    new_facts = def_use(now.where("not skipped").join(fresh, "path", "left_semi").select("path", "content"))
    kept = None if old is None else old.facts.join(fresh.union(gone), "path", "left_anti")
    facts = _cut(new_facts if kept is None else new_facts.unionByName(kept))
    if old is None:
        return Snapshot(state, facts, _cut(labelled_paths(facts, config)), fresh, fresh)
    # what was linked before counts too: a flow may end because a link did
    links = _cut(module_links(facts).union(module_links(old.facts)).distinct())
    # from one common start to every changed file, then on along links
    root = F.lit("\0changed")
    starts = fresh.union(gone).select(root.alias("src"), F.col("path").alias("dst"))
    touched = levels(links.union(starts), starts.select(F.col("src").alias("node")).distinct(), None).where("level > 0").select(F.col("node").alias("path")).distinct()
    touched = _cut(touched)
    flows = labelled_paths(facts.join(touched, "path", "left_semi"), config)
    stay = old.flows.join(touched, "path", "left_anti").join(touched.withColumnRenamed("path", "sink_path"), "sink_path", "left_anti")
    return Snapshot(state, facts, _cut(flows.unionByName(stay)), fresh, touched.join(state.select("path"), "path", "left_semi"))
