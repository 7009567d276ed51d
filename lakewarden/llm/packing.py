"""Best-fit packing with exact-complement hashing.

Documents become pieces of at most ``size`` tokens (only longer documents are cut: the first piece takes
the remainder, all others are full). Which piece goes where depends on lengths alone, so the plan is made
over the histogram of lengths, at most ``size`` numbers whatever the corpus:

 1. From the longest length down, the gap ``size - length`` is looked up among the sums of one, two and
    three available lengths; a combination that fills it exactly is consumed as often as the availability
    counts allow.
 2. What is left goes best-fit decreasing, again by counts.

A plan is a list of bin patterns with multiplicities. Pieces are ranked within their length (the rank in
the partition that cut them, plus the counts of the partitions before it, so no length is gathered in
one task), and a rank finds its sequence and offset in the plan.

Tokenisation runs once; its rows (no ids, only their checksum) are written to the shared folder.

Defined results: null or empty text is the single end token; every row is packed, repeated rows and null
ids too; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace
from .tokens import id_cache, texts_of

Pattern = tuple[tuple[tuple[int, int], ...], int]  # runs of (length, count), and how many such bins


def exact_complements(have: np.ndarray, size: int) -> list[Pattern]:
    """Consume combinations that fill a bin exactly; ``have[n]`` (changed in place) counts length n."""
    plan: list[Pattern] = []
    lengths = np.arange(size + 1)

    def take(parts: list[int]) -> bool:
        kinds = {n: parts.count(n) for n in parts}
        times = min(int(have[n]) // c for n, c in kinds.items())
        if times:
            for n, c in kinds.items():
                have[n] -= times * c
            plan.append((tuple(kinds.items()), times))
        return times > 0

    def enough(first: list[int], more: list[int]) -> bool:
        parts = first + more
        return all(have[n] >= parts.count(n) for n in more)

    def pair(first: list[int], total: int) -> list[int] | None:
        """Two available lengths of that sum, the most uneven first."""
        a = lengths[1 : total // 2 + 1]
        for x in a[(have[a] > 0) & (have[total - a] > 0)].tolist():
            if enough(first, [x, total - x]):
                return [x, total - x]
        return None

    for n in range(size, 0, -1):
        while have[n]:
            gap = size - n
            if gap == 0:
                take([n])
                continue
            if have[gap] and enough([n], [gap]) and take([n, gap]):
                continue
            if (two := pair([n], gap)) and take([n, *two]):
                continue
            present = (have > 0).astype(np.int64)
            sums = np.convolve(present[: gap + 1], present[: gap + 1])[: gap + 1] > 0  # sums of two
            third = lengths[1 : gap // 3 + 1]
            for x in third[(have[third] > 0) & sums[gap - third]].tolist():
                if (two := pair([n, x], gap - x)) and take([n, x, *two]):
                    break
            else:
                break
    return plan


def best_fit(have: np.ndarray, size: int) -> list[Pattern]:
    """Best-fit decreasing over counts."""
    bins: dict[int, list[list]] = {}  # gap -> [runs, count]
    done: list[Pattern] = []
    for n in range(size, 0, -1):
        left = int(have[n])
        for gap in sorted(g for g in bins if g >= n):
            each = gap // n
            for runs, count in bins.pop(gap):
                full = min(count, left // each)
                part = min(count - full, 1) if left - full * each > 0 else 0
                rest = left - full * each if part else 0
                if full:
                    bins.setdefault(gap - each * n, []).append([[*runs, (n, each)], full])
                if part:
                    bins.setdefault(gap - rest * n, []).append([[*runs, (n, rest)], 1])
                left -= full * each + rest
                if count - full - part:
                    bins.setdefault(gap, []).append([runs, count - full - part])
            if not left:
                break
        each = size // n
        if left >= each:
            bins.setdefault(size - each * n, []).append([[(n, each)], left // each])
        if left % each:
            bins.setdefault(size - left % each * n, []).append([[(n, left % each)], 1])
        have[n] = 0
        done += [(tuple(r), c) for r, c in bins.pop(0, [])]
    return done + [(tuple(r), c) for kept in bins.values() for r, c in kept]


def slots(counts: dict[int, int], size: int) -> dict[str, np.ndarray]:
    """For ranks from ``start`` of a length: first sequence, pieces per sequence, offset of the first."""
    have = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        have[n] = c
    used, base, rows = np.zeros(size + 1, np.int64), 0, []
    for runs, times in exact_complements(have, size) + best_fit(have, size):
        at = 0
        for n, c in runs:
            rows.append((n, used[n], base, c, at))
            used[n] += times * c
            at += n * c
        base += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (cols[:, 0] << 48) + cols[:, 1], "start": cols[:, 1], "base": cols[:, 2], "each": cols[:, 3], "offset": cols[:, 4]}


def cut_documents(docs: DataFrame, path: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's rank within its length and partition."""
    tail = np.uint32(end_id).tobytes()

    def own(batches):
        ranks, cache = np.zeros(size + 1, np.int64), id_cache(path)
        for part, texts in texts_of(batches, 2000):
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, ids in enumerate(cache.encode(texts)):
                ids += tail
                n = len(ids) // 4
                a, b = 0, n % size or min(n, size)
                while a < n:
                    row.append(i)
                    piece.append(piece[-1] + 1 if a else 0)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(memoryview(ids)[4 * a : 4 * b]))
                    rank.append(ranks[b - a])
                    ranks[b - a] += 1
                    a, b = b, b + size
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), part["part"].take(at), pa.array(rank, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(own, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    ws = Workspace(spark)
    pieces = ws.stage(cut_documents(docs, path, size, end_id, id_col, text_col), "pieces")
    own = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    own = own.select("part", "length", "n", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    own = ws.stage(own, "counts")
    plan = slots({r[0]: r[1] for r in own.groupBy("length").agg(F.sum("n")).collect()}, size)  # at most `size` rows
    sent = spark.sparkContext.broadcast(plan)

    def placed(batches):
        p = sent.value
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            i = np.searchsorted(p["key"], (length << 48) + rank, side="right") - 1
            k = rank - p["start"][i]
            seq, off = p["base"][i] + k // p["each"][i], p["offset"][i] + k % p["each"][i] * length
            yield pa.RecordBatch.from_arrays([*(b[c] for c in out), pa.array(seq), pa.array(off)], [*out, "sequence_id", "offset"])

    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # the counts grow with the corpus, so they are never broadcast
    ranked = pieces.join(own.hint("merge"), ["part", "length"]).select(*out, (F.col("before") + F.col("rank")).alias("rank"))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(placed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
