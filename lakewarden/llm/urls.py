"""URL rules answered by a Bloom filter cascade.

Rules are (host, path, verdict). A rule fits its host and all subdomains where the url's path starts
with the rule's; the longest fitting rule wins (host and path together; on a tie the longer host).

A url can only be fitted by keys "host suffix + path prefix" whose shape (labels, path length) some
rule has; those keys of all urls are the universe. For each verdict a cascade answers membership in its
rule keys exactly: filter 1 holds the rule keys; filter 2 the universe's keys that pass filter 1 though
they are no rule; filter 3 the rule keys that pass filter 2; and so on until a level has no false
positive. A key's answer is the parity of the first filter that it doesn't pass. False positives are
found by passing the universe (written once) through the levels so far (no shuffle), and only the survivors
are made distinct. So urls are judged in one scan, without a join; what is broadcast are the filters, whose size
is checked against ``max_bytes``. A rule set whose filters would be larger is refused, before any work.

A url without a fitting rule is on no list: it is allowed.

Defined results: null url or one without ``://``: host and path empty, no rule, allowed; a null id and
repeated rows are judged like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, ragged, small_frame

Levels = list[tuple[int, int, np.ndarray]]  # bits, hashes, packed bits


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Keys of a url that a rule of one of the shapes could equal, with their hashes, longest first."""
    labels = F.size(F.split(host, r"\."))
    found = []
    for n, k in shapes:
        suffix = F.substring_index(host, ".", -n)
        key = F.concat(suffix, F.substring(path, 1, k))
        fits = (labels >= n) & (F.length(path) >= k) & (host != "")
        found.append(F.when(fits, F.struct((-F.length(key)).alias("order"), (-F.length(suffix)).alias("then"), key.alias("key"), F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit("~")).alias("h2"))))
    return F.array_sort(F.array_compact(F.array(*found)))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, k: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        a = (h1.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(29)
        b = h2.astype(np.uint64) | np.uint64(1)
        for i in range(k):
            x = (a + np.uint64(i) * b) * np.uint64(0x94D049BB133111EB)
            yield (x ^ (x >> np.uint64(31))) % np.uint64(bits)


def passes(level: int, spec: tuple[int, int, np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    bits, k, packed = spec
    ok = np.ones(len(h1), bool)
    for at in _places(h1, h2, level, bits, k):
        ok &= (packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def member(levels: Levels, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact for rule keys and keys of the universe."""
    yes, left = np.zeros(len(h1), bool), np.arange(len(h1))
    for i, spec in enumerate(levels):
        left = left[passes(i, spec, h1[left], h2[left])]
        yes[left] = i % 2 == 0
    return yes


def _spec(n: int, rate: float) -> tuple[int, int]:
    rate = min(max(rate, 1e-9), 0.5)
    return max(8, math.ceil(n * -math.log(rate) / math.log(2) ** 2)), max(1, round(-math.log2(rate)))


def _filled(keys: DataFrame, level: int, bits: int, k: int) -> np.ndarray:
    """The level's bits, set on executors in chunks of 64 kB and joined by or."""
    width = 1 << 19

    def own(batches):
        packed = np.zeros((bits + 7) // 8, np.uint8)
        for b in batches:
            for at in _places(b["h1"].to_numpy(), b["h2"].to_numpy(), level, bits, k):
                np.bitwise_or.at(packed, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for c in range(0, len(packed), width // 8):
            if (part := packed[c : c + width // 8]).any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["chunk", "bits"])

    def joined(t: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t["bits"].to_pylist()])
        return pa.table({"chunk": t["chunk"][:1], "bits": pa.array([out.tobytes()], pa.binary())})

    schema = "chunk long, bits binary"
    packed = np.zeros((bits + 7) // 8, np.uint8)
    for r in keys.mapInArrow(own, schema).groupBy("chunk").applyInArrow(joined, schema).toLocalIterator():
        packed[r.chunk : r.chunk + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return packed


def cascade(listed: DataFrame, universe: DataFrame, ws: Workspace, max_bytes: int) -> Levels:
    """Levels for ``listed(h1, h2)`` (distinct) within ``universe(h1, h2)``."""
    n = listed.count()
    if not n:
        return []
    others = max(1, universe.agg(F.approx_count_distinct("h1")).first()[0])
    if _spec(n, 0.5 * n / others)[0] // 8 > max_bytes:
        raise ValueError(f"the filters of {n} rules exceed max_bytes; split the rules by host and judge each part")
    levels: Levels = []
    inside, outside, kept = listed, universe, None
    while True:
        bits, k = _spec(n, 0.5 * n / others if not levels else 0.5)
        level = len(levels)
        levels.append((bits, k, _filled(inside, level, bits, k)))
        if level > 60:
            raise RuntimeError("two keys share both hashes")
        spec = levels[-1]

        def through(batches, level=level, spec=spec):
            for b in batches:
                yield b.filter(pa.array(passes(level, spec, b["h1"].to_numpy(), b["h2"].to_numpy())))

        found = outside.mapInArrow(through, "h1 long, h2 long")
        if not level:  # the universe still holds the rules themselves
            found = found.distinct().join(F.broadcast(listed) if n <= 100_000 else listed, ["h1", "h2"], "left_anti")
        kept = ws.stage(found, f"level{level}")
        inside, outside, n = kept, inside, kept.count()
        if not n:
            return levels


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", max_bytes: int = 1 << 28, default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict of every url; ``rules`` are (host, path, "allow" or "block")."""
    spark = pages.sparkSession
    ws = Workspace(spark)
    verdict_of = {f"{h}{p}": v for h, p, v in rules}
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
    host, path = host_path(F.col(url_col))
    cols = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    cols = cols.withColumn("keys", candidates(F.col("host"), F.col("path"), shapes) if shapes else F.array().cast("array<struct<key:string,h1:long,h2:long>>"))
    universe = ws.stage(cols.select(F.explode("keys").alias("k")).select("k.h1", "k.h2"), "universe")  # 16 bytes a key, read by every level
    lists = {}
    for v in sorted(set(verdict_of.values())):
        own = small_frame(spark, [(k,) for k, x in verdict_of.items() if x == v], "key string").distinct()
        lists[v] = cascade(own.select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit("~")).alias("h2")), universe, ws, max_bytes)
    sent = spark.sparkContext.broadcast(lists)

    def judged(batches):
        for b in batches:
            n, flat = ragged(b["keys"])
            h1, h2 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            row = np.repeat(np.arange(len(n)), n)
            at, verdict = np.full(len(n), -1), np.full(len(n), default, object)
            for v, levels in sent.value.items():
                hit = np.flatnonzero(member(levels, h1, h2))
                first = hit[np.unique(row[hit], return_index=True)[1]]  # a row's keys come longest first
                r = row[first]
                better = (at[r] < 0) | (first < at[r])
                at[r[better]], verdict[r[better]] = first[better], v
            rule = flat.field("key").take(pa.array(np.where(at < 0, None, at), pa.int64()))
            yield pa.RecordBatch.from_arrays([b["page_id"], b["host"], b["path"], rule, pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = cols.schema["page_id"].dataType.simpleString()
    slim = cols.select("page_id", "host", "path", F.transform("keys", lambda k: F.struct(k.key.alias("key"), k.h1.alias("h1"), k.h2.alias("h2"))).alias("keys"))
    return slim.mapInArrow(judged, f"page_id {kind}, host string, path string, rule string, verdict string")
