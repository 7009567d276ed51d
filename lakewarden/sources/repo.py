"""Source trees as rows: a Python data source that also reads hidden files.

Folders are dealt to partitions level by level until there are ``partitions`` of them (or no deeper folders), so
a single large top folder is many tasks.
"""

from __future__ import annotations

import fnmatch
import os
import stat
from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

SCHEMA = "path string, size long, ext string, is_python boolean, is_hidden boolean, truncated boolean, content string"
IGNORED = (".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache")
CATEGORIES = {
    "python": ("py", "pyi", "pyx"),
    "script": ("js", "jsx", "ts", "tsx", "rb", "php", "sh"),
    "compiled": ("java", "go", "rs", "c", "h", "cpp", "hpp", "cc", "cs"),
    "config": ("toml", "yaml", "yml", "json", "ini", "cfg", "lock", "env", "tf"),
    "documentation": ("md", "rst", "txt"),
}


class _Folder(InputPartition):
    def __init__(self, top: str, deep: bool):
        self.top, self.deep = top, deep


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.realpath(options["path"])
        self.depth = int(options.get("maxDepth", 20))
        self.limit = int(options.get("maxBytes", 1_000_000))
        self.most = int(options.get("partitions", 64))
        self.ignored = [*IGNORED, *filter(None, options.get("ignore", "").split(","))]

    def partitions(self):
        if os.path.isfile(self.root):
            return [_Folder(self.root, False)]
        shallow, deep = [self.root], self._below(self.root)
        for _ in range(self.depth - 2):
            if not deep or len(deep) >= self.most:
                break
            shallow += deep
            deep = [d for top in deep for d in self._below(top)]
        return [*(_Folder(t, False) for t in shallow), *(_Folder(t, True) for t in deep)]

    def _below(self, top: str) -> list[str]:
        return sorted(e.path for e in os.scandir(top) if e.is_dir(follow_symlinks=False) and not self._skip(os.path.relpath(e.path, self.root)))

    def _skip(self, rel: str) -> bool:
        return any(fnmatch.fnmatch(part, p) for part in rel.split(os.sep) for p in self.ignored) or any(fnmatch.fnmatch(rel, p) for p in self.ignored)

    def _files(self, top: str, deep: bool) -> Iterator[str]:
        if os.path.isfile(top):
            yield top
            return
        for folder, dirs, names in os.walk(top):  # links to folders aren't followed
            level = os.path.relpath(folder, self.root).count(os.sep) + 1
            dirs[:] = sorted(d for d in dirs if deep and level < self.depth and not self._skip(d) and not os.path.islink(os.path.join(folder, d)))
            for n in sorted(names):
                yield os.path.join(folder, n)

    def read(self, partition):
        base = self.root if os.path.isdir(self.root) else os.path.dirname(self.root)
        for f in self._files(partition.top, partition.deep):
            rel = os.path.relpath(f, base)
            try:
                s = os.lstat(f)
                if not stat.S_ISREG(s.st_mode) or self._skip(rel):
                    continue
                with open(f, "rb") as h:
                    raw = h.read(self.limit)
            except OSError:
                continue
            ext = os.path.splitext(f)[1].lstrip(".").lower()
            hidden = any(p.startswith(".") for p in rel.split(os.sep))
            yield rel, s.st_size, ext, ext in CATEGORIES["python"], hidden, s.st_size > self.limit, raw.decode("utf-8", "replace")


class RepoSource(DataSource):
    """``spark.read.format("repo").option("path", folder)``; options maxDepth, maxBytes, ignore."""

    @classmethod
    def name(cls):
        return "repo"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_repo(spark: SparkSession, path: str, **options):
    ship(spark)
    spark.dataSource.register(RepoSource)
    return spark.read.format("repo").options(path=path, **options).load()


def category(ext: Column) -> Column:
    out = None
    for name, exts in CATEGORIES.items():
        out = F.when(ext.isin(*exts), name) if out is None else out.when(ext.isin(*exts), name)
    return out.otherwise("other")
