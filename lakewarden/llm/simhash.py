"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are made in one scan. Distinct ones are compared: two that differ in at most ``radius`` of 64
bits agree on some choice of blocks when the bits are cut into ``radius`` + j blocks (j of them then agree).
Each choice is a table; rows with equal key form a bucket. j grows with the number of fingerprints, so that
buckets stay small; every j finds all links.

A task holds its sorted rows as bit planes: word w of plane b has bit b of 64 fingerprints. All (row,
word) pairs that a bucket needs are compared at once: the plane is flipped where the row's bit is set, and
carry-save counters (ones, twos, fours, and a sticky "over") add up 64 distances per word. After every few
planes the pairs whose 64 distances all exceed the radius are dropped; so are pairs whose rows the task has
already found to be in one group.

Of a bucket's links a task returns a spanning forest, at most a row per fingerprint, never all pairs.
Buckets over ``bucket_rows`` are dealt in chunks: every two chunks meet in a task of their own.
Components are made of those edges on the executors (``common.components``).

Defined results: null and word-free texts have fingerprint zero, linked like any other; every row gives a
row, repeated rows and null ids too (a component whose ids are all null has component_id null); an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, raws, small_frame, unite

BITS = 64


def shingle_hashes(text: bytes | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of all word shingles; A-Z lower-cased, words parted by ASCII white space."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, seed)], np.uint64)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :])), np.uint64, len(words) - width + 1)  # noqa: B905


def fingerprint(hashes: np.ndarray) -> int:
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += part.sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def own(batches):
        for b in batches:
            fp = [fingerprint(shingle_hashes(t, width, seed)) for t in raws(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp, pa.int64())], ["doc_id", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(own, f"doc_id {kind}, fp long")


def masks(n: int, radius: int, per_bucket: int = 4096) -> list[int]:
    """Bits of each table's key: choices of blocks that must agree, enough for ``n`` fingerprints."""
    for j in range(1, 5):
        blocks = radius + j
        if n >> (BITS * j // blocks) <= per_bucket // 64 or j == 4:
            break
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    part = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in itertools.combinations(part, j)]


def links(fp: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int, step: int = 1 << 17) -> np.ndarray:
    """Groups of rows linked within ``radius``: each row's smallest row.

    Row i is compared with rows i+1 .. last[i]-1 (its bucket is first[i] .. last[i]-1).
    """
    n = len(fp)
    label = np.arange(n)
    words = -(-n // 64)
    bits = np.zeros((words * 64, 8), np.uint8)
    bits[:n] = fp.astype("<i8").view(np.uint8).reshape(n, 8)
    planes = np.packbits(np.unpackbits(bits, axis=1, bitorder="little").T.copy(), axis=1, bitorder="little").view("<u8")  # 64 x words
    own = fp.view(np.uint64)
    lo, hi = np.arange(n) // 64, (last - 1) // 64
    count = np.where(last - np.arange(n) > 1, hi - lo + 1, 0)
    before = np.concatenate([[0], np.cumsum(count)])
    full = np.uint64(2**64 - 1)
    for at in range(0, int(before[-1]), step):
        k = np.arange(at, min(at + step, before[-1]))
        row = np.searchsorted(before, k, side="right") - 1
        word = lo[row] + k - before[row]
        pad = np.concatenate([label, np.full(words * 64 - n, label[-1])]).reshape(words, 64)
        same = np.where((pad == pad[:, :1]).all(axis=1), pad[:, 0], -1)
        todo = same[word] != label[row]
        row, word = row[todo], word[todo]
        # columns of the word that are in the bucket and after the row
        a, z = np.maximum(row + 1 - word * 64, 0), np.minimum(last[row] - word * 64, 64)
        live = np.where(z > a, np.where(z >= 64, full, (np.uint64(1) << np.minimum(z, 63).astype(np.uint64)) - np.uint64(1)) & ~np.where(a >= 64, full, (np.uint64(1) << np.minimum(a, 63).astype(np.uint64)) - np.uint64(1)), np.uint64(0))
        ones, twos, fours = (np.zeros(len(row), np.uint64) for _ in range(3))
        over = ~live
        bits_of = own[row]
        for b in range(BITS):
            x = planes[b][word] ^ np.where((bits_of >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))
            c1 = ones & x
            ones ^= x
            c2 = twos & c1
            twos ^= c1
            over |= fours & c2
            fours ^= c2
            if b % 6 == 5 or b == BITS - 1:
                far = over | _above(ones, twos, fours, radius)
                keep = far != full
                if not keep.all():
                    row, word, ones, twos, fours, over, bits_of, far = (y[keep] for y in (row, word, ones, twos, fours, over, bits_of, far))
                if not len(row):
                    break
        if len(row):
            near = np.unpackbits((~far).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            p, q = np.nonzero(near)
            unite(label, row[p], word[p] * 64 + q)
            del near
    return label


def _above(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Bits whose counter (0 to 7) exceeds the radius."""
    out = np.zeros_like(ones)
    for n in range(radius + 1, 8):
        out |= (ones if n & 1 else ~ones) & (twos if n & 2 else ~twos) & (fours if n & 4 else ~fours)
    return out


def bucket_edges(keyed: DataFrame, radius: int, rows_at_once: int = 60_000) -> DataFrame:
    """Edges a > b of a spanning forest of each bucket's links; ``keyed`` is sorted by (bucket, fp)."""

    def own(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def compared(key: np.ndarray, fp: np.ndarray):
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
            size = np.diff(edge)
            first, last = np.repeat(edge[:-1], size), np.repeat(edge[1:], size)
            label = links(fp, first, last, radius)
            far = np.flatnonzero(label != np.arange(len(fp)))
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[label[far]])], ["a", "b"])

        def columns(b):
            return np.stack([b[c].to_numpy().astype(np.int64) for c in ("t", "key", "c1", "c2")], axis=1), b["fp"].to_numpy()

        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(columns(b))
            n += b.num_rows
            if n >= rows_at_once:
                key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                new = np.flatnonzero((key != key[-1]).any(axis=1))
                cut = int(new[-1]) + 1 if len(new) else 0  # the last bucket may go on
                if cut:
                    yield from compared(key[:cut], fp[:cut])
                held, n = [(key[cut:], fp[cut:])], len(key) - cut
        if held:
            yield from compared(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return keyed.mapInArrow(own, "a long, b long")


def near_edges(fps: DataFrame, n: int, radius: int, bucket_rows: int = 32_768) -> DataFrame:
    """Edges that connect all of the distinct ``fps(fp)`` that links connect."""
    spark = fps.sparkSession
    tables = masks(n, radius)
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(tables))))
    rows = fps.select("fp", keys.alias("k")).select("k.t", "k.key", "fp")
    limit = max(bucket_rows, n * len(tables) // 20_000)
    large = rows.groupBy("t", "key").count().where(F.col("count") > limit).collect()  # at most 20,000 rows
    chunks = F.broadcast(small_frame(spark, [(r[0], r[1], math.ceil(2 * r[2] / limit)) for r in large], "t int, key long, parts int"))
    rows = rows.join(chunks, ["t", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    rows = rows.select("t", "key", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"), "fp")
    rows = rows.repartition(F.col("t"), F.col("key"), F.col("c1"), F.col("c2")).sortWithinPartitions("t", "key", "c1", "c2", "fp")
    return bucket_edges(rows, radius)


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs``."""
    if not 0 <= radius <= 6:
        raise ValueError("radius must be 0 to 6")
    ws = Workspace(docs.sparkSession)
    own = ws.stage(fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    fps = ws.stage(own.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(ws, near_edges(fps.select("fp"), fps.count(), radius))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = ws.stage(named, "named")
    lows = ws.stage(named.groupBy("root").agg(F.min("low").alias("component_id")), "lows")  # written: a large component's join is then split
    of = ws.stage(named.join(lows, "root").select("fp", "component_id"), "components")
    return own.join(of, "fp").select("doc_id", "fp", "component_id")
