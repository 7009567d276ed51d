"""Git history as rows: Python data sources over a local repository.

``git_log``: a row for each changed file, one partition for each run of commits; the commits are listed once, so
a branch that moves meanwhile shifts nothing. ``git_blob``: files as they were at given commits. Added lines of a
history, hooks and remotes are tables of the same repository.
"""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

SCHEMA = "commit string, ord long, author string, ts string, subject string, parents array<string>, change string, path string, old_path string"
_FORMAT = "%x1e%H%x1f%an%x1f%aI%x1f%s%x1f%P"


def git(root: str, *args: str, timeout: int = 30) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=timeout, check=True)
    return done.stdout.decode("utf-8", "replace")


def parse_log(text: str, first: int = 0):
    """Rows of ``git log --name-status``: one per changed file, or one without a path for a commit without any."""
    for n, record in enumerate(text.split("\x1e")[1:]):
        head, *lines = record.strip("\n").split("\n")
        commit, author, ts, subject, parents = head.split("\x1f")
        base = (commit, first + n, author, ts, subject, parents.split())
        changes = [x.split("\t") for x in lines if "\t" in x]
        if not changes:
            yield (*base, None, None, None)
        for kind, *paths in changes:
            yield (*base, kind[0], paths[-1], paths[0] if len(paths) > 1 else None)


class _Range(InputPartition):
    def __init__(self, first: int, commits: list[str]):
        self.first, self.commits = first, commits


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.most, self.step = options["path"], int(options.get("maxCommits", 500)), int(options.get("step", 200))
        self.more = [f"--{k}={options[k]}" for k in ("since", "until") if options.get(k)]
        self.paths = ["--", *options["paths"].split(",")] if options.get("paths") else []

    def partitions(self):
        commits = git(self.root, "log", "--format=%H", f"-n{self.most}", *self.more, *self.paths).split()
        return [_Range(s, commits[s : s + self.step]) for s in range(0, len(commits), self.step)] or [_Range(0, [])]

    def read(self, partition):
        if partition.commits:
            out = git(self.root, "log", "--no-walk=unsorted", "--name-status", f"--format={_FORMAT}", *partition.commits, *self.paths)
            yield from parse_log(out, partition.first)


class GitLog(DataSource):
    """``spark.read.format("git_log").option("path", repository)``; newest first in ``ord``."""

    @classmethod
    def name(cls):
        return "git_log"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


class _Blobs(DataSourceReader):
    def __init__(self, options):
        self.root, self.commits, self.limit = options["path"], options["commits"].split(","), int(options.get("maxBytes", 1_000_000))

    def partitions(self):
        return [_Range(i, [c]) for i, c in enumerate(self.commits)]

    def read(self, partition):
        for commit in partition.commits:
            for line in git(self.root, "ls-tree", "-r", "-l", "-z", commit).split("\0"):
                head, _, path = line.partition("\t")
                if path and head.split()[1] == "blob":
                    size = int(head.split()[3])
                    yield commit, path, size, size > self.limit, git(self.root, "cat-file", "-p", head.split()[2])[: self.limit]


class GitBlob(DataSource):
    """``spark.read.format("git_blob").option("path", repository).option("commits", "a,b")``: files at commits."""

    @classmethod
    def name(cls):
        return "git_blob"

    def schema(self):
        return "commit string, path string, size long, truncated boolean, content string"

    def reader(self, schema):
        return _Blobs(self.options)


class _Diffs(_Reader):
    def read(self, partition):
        for n, commit in enumerate(partition.commits):
            path = None
            for line in git(self.root, "show", "--format=", "--unified=0", "--no-color", commit, *self.paths).split("\n"):
                if line.startswith("+++ "):
                    path = line[6:] if line.startswith("+++ b/") else None
                elif line.startswith("+") and path:
                    yield commit, partition.first + n, path, line


class GitDiff(DataSource):
    """``git_diff``: added lines (with their plus sign) of each commit, newest commit first in ``ord``."""

    @classmethod
    def name(cls):
        return "git_diff"

    def schema(self):
        return "commit string, ord long, path string, line string"

    def reader(self, schema):
        return _Diffs(self.options)


def read_git(spark: SparkSession, source: str, path: str, **options):
    """``git_log``, ``git_blob`` or ``git_diff`` of a repository."""
    ship(spark)
    for kind in (GitLog, GitBlob, GitDiff):
        spark.dataSource.register(kind)
    return spark.read.format(source).options(path=path, **options).load()


def hooks(spark: SparkSession, root: str):
    """name, content of a repository's hooks; as many as a person has put there."""
    folder = os.path.join(root, ".git", "hooks")
    rows = [(n, open(os.path.join(folder, n), errors="replace").read(1_000_000)) for n in sorted(os.listdir(folder))] if os.path.isdir(folder) else []
    return spark.createDataFrame(rows, "name string, content string")


def remotes(spark: SparkSession, root: str):
    """name, url; credentials in an url don't get out."""
    rows = {tuple(x.split()[:2]) for x in git(root, "remote", "-v").splitlines() if x.strip()}
    return spark.createDataFrame(sorted((n, re.sub(r"//[^/@]+@", "//", u)) for n, u in rows), "name string, url string")


def read_git_log(spark: SparkSession, path: str, **options):
    ship(spark)
    spark.dataSource.register(GitLog)
    return spark.read.format("git_log").options(path=path, **options).load()
