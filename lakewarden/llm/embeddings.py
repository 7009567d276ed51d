"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors are made unit length, so cosine >= c means a squared distance of at most r2 = 2 - 2c. A seeded
rotation spreads the distance evenly over all coordinates, which are then cut into blocks: if the whole
distance is within r2, some block of d of D coordinates is within r2 * d / D. So each block is
range-joined under its share, and the union of what the blocks find is verified with the exact cosine.

The range join of a block lays a grid over its first coordinates (as many as keep a cell's share of the
largest label near ``cell_rows``). A vector is a native of its cell and a visitor of each later cell that
its ball reaches; natives meet natives and visitors. What is joined are ids with the block's own few
coordinates; who has a partner within the block's share survives, and only survivors fetch their vectors, to
be verified in the same cells. A pair that several blocks find counts in the first of them, which every task
can tell on its own: nothing is made distinct.

Equal vectors of a label are one class. A task returns, for its cell, each class's number of linked
vectors and a spanning forest of its links, never the pairs. Cells with more than ``group_rows`` vectors
are dealt in chunks, of which every two meet in a task of their own, each pair once. Components are made
of the edges on the executors.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors with a
null label, link with nothing: n_links 0, component_id their own id. Vectors of unlike length don't link.
Every row gives a row; repeated rows are copies that link with each other; null ids are never a
component's smallest unless all are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, ragged, small_frame, unite


@functools.lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def units(col: pa.Array) -> np.ndarray:
    n, flat = ragged(col)
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(n), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def block_cuts(dim: int, blocks: int) -> list[int]:
    blocks = min(blocks, dim)
    return [dim * i // blocks for i in range(blocks + 1)]


def reached(y: np.ndarray, width: float, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the later cells that each row's ball reaches, by their coordinates."""
    home = np.floor(y / width).astype(np.int64)
    n, g = y.shape
    rows, cells, left = np.arange(n), np.empty((n, 0), np.int64), np.full(n, radius**2)
    reach = math.ceil(radius / width)
    for j in range(g):
        parts = []
        for step in range(-reach, reach + 1):
            c = home[rows, j] + step
            gap = np.maximum(np.maximum(c * width - y[rows, j], y[rows, j] - (c + 1) * width), 0)
            rest = left - gap * gap
            ok = rest >= 0
            parts.append((rows[ok], np.column_stack([cells[ok], c[ok]]), rest[ok]))
        rows, cells, left = (np.concatenate([p[i] for p in parts]) for i in range(3))
    later, equal = np.zeros(len(rows), bool), np.ones(len(rows), bool)
    for j in range(g):
        later |= equal & (cells[:, j] > home[rows, j])
        equal &= cells[:, j] == home[rows, j]
    return rows[later], cells[later]


def placed(classes: DataFrame, cosine: float, blocks: int, grid: int) -> DataFrame:
    """cid, label, dim, block, cell, visitor and the block's coordinates, a row for each cell that a class reaches."""
    r2 = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12

    def own(batches):
        for whole in batches:
            dims = whole["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                b = whole.filter(pa.array(dims == dim))
                y = units(b["embedding"]) @ rotation(dim)
                cuts = block_cuts(dim, blocks)
                for k in range(len(cuts) - 1):
                    radius = math.sqrt(r2 * (cuts[k + 1] - cuts[k]) / dim)
                    z = y[:, cuts[k] : min(cuts[k] + grid, cuts[k + 1])]
                    home = np.floor(z / (2 * radius)).astype(np.int64)
                    rows, cells = reached(z, 2 * radius, radius)
                    at = pa.array(np.concatenate([np.arange(b.num_rows), rows]))
                    cell = np.concatenate([home, cells]).astype(np.int32)
                    names = [c.tobytes() for c in cell] if cell.shape[1] else [b""] * len(at)
                    part = y[:, cuts[k] : cuts[k + 1]].astype(np.float32)[at.to_numpy()]
                    coords = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), part.shape[1]).cast(pa.list_(pa.float32()))
                    out = b.select(["cid", "label", "dim"]).take(at).append_column("block", pa.array(np.full(len(at), k, np.int32)))
                    yield out.append_column("cell", pa.array(names, pa.binary())).append_column("visitor", pa.array(np.arange(len(at)) >= b.num_rows)).append_column("coords", coords)

    return classes.mapInArrow(own, "cid long, label string, dim int, block int, cell binary, visitor boolean, coords array<float>")


def partnered(z: np.ndarray, most: float, visitor: np.ndarray, chunk: np.ndarray, one_chunk: bool, tile: int = 1024) -> np.ndarray:
    """Which rows have another row within ``most`` (squared) that this task may compare them with.

    Coordinates are rounded to single precision; the slack keeps every true pair.
    """
    n, found, sq = len(z), np.zeros(len(z), bool), (z * z).sum(axis=1)
    for a in range(0, n, tile):
        for c in range(a, n, tile):
            near = sq[a : a + tile, None] + sq[None, c : c + tile] - 2 * (z[a : a + tile] @ z[c : c + tile].T) <= most + 1e-5
            near &= ~(visitor[a : a + tile, None] & visitor[None, c : c + tile])
            if not one_chunk:
                near &= chunk[a : a + tile, None] != chunk[None, c : c + tile]
            if a == c:
                np.fill_diagonal(near, False)
            found[a : a + tile] |= near.any(axis=1)
            found[c : c + tile] |= near.any(axis=0)
    return found


def verified(cid: np.ndarray, size: np.ndarray, x: np.ndarray, block: int, visitor: np.ndarray, chunk: np.ndarray, one_chunk: bool, cosine: float, blocks: int, tile: int = 512):
    """Linked vectors per row, and each row's smallest linked row, for the pairs that are this task's."""
    n, dim = x.shape
    r2 = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
    cuts = block_cuts(dim, blocks)
    y = x @ rotation(dim)
    squares = [(y[:, a:b] ** 2).sum(axis=1) for a, b in zip(cuts, cuts[1:], strict=False)]

    def within(k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = y[i, cuts[k] : cuts[k + 1]] - y[j, cuts[k] : cuts[k + 1]]
        return (d * d).sum(axis=1) <= r2 * (cuts[k + 1] - cuts[k]) / dim

    found, label = np.zeros(n, np.int64), np.arange(n)
    z, sq = y[:, cuts[block] : cuts[block + 1]], squares[block]
    most = r2 * (cuts[block + 1] - cuts[block]) / dim + 1e-9  # the product form rounds; pairs are decided below
    for a in range(0, n, tile):
        for c in range(a, n, 8 * tile):
            e = min(c + 8 * tile, n)
            near = sq[a : a + tile, None] + sq[None, c:e] - 2 * (z[a : a + tile] @ z[c:e].T) <= most
            near &= ~(visitor[a : a + tile, None] & visitor[None, c:e])
            if not one_chunk:
                near &= chunk[a : a + tile, None] != chunk[None, c:e]
            i, j = np.nonzero(near)
            i, j = i + a, j + c
            up = i < j
            i, j = i[up], j[up]
            for part in range(0, len(i), 1 << 17):
                p, q = i[part : part + (1 << 17)], j[part : part + (1 << 17)]
                if len(p):  # a fixed order within a pair, so that every task computes the same numbers
                    swap = cid[p] > cid[q]
                    p, q = np.where(swap, q, p), np.where(swap, p, q)
                ok = within(block, p, q)
                for k in range(block):
                    ok[ok] = ~within(k, p[ok], q[ok])
                p, q = p[ok], q[ok]
                linked = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                p, q = p[linked], q[linked]
                np.add.at(found, p, size[q])
                np.add.at(found, q, size[p])
                unite(label, p, q)
    return found, label


def near_vectors(vectors: DataFrame, cosine: float = 0.93, blocks: int = 8, cell_rows: int = 2000, group_rows: int = 16_384, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``."""
    spark = vectors.sparkSession
    ws = Workspace(spark)
    e = F.col("embedding")
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast(kind).alias("embedding"))
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = rows.withColumn("valid", F.coalesce(F.col("label").isNotNull() & finite, F.lit(False)))
    valid = rows.where("valid")
    classes = valid.groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    classes = ws.stage(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "classes")
    most = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    grid = max(0, math.ceil(math.log(max(1, most / cell_rows)) / math.log(4)))  # a coordinate parts some four cells

    cells = ws.stage(placed(classes.select("cid", "label", "dim", "embedding"), cosine, blocks, grid), "cells")
    keys = ["label", "dim", "block", "cell"]
    limit = max(group_rows, cells.count() // 20_000)
    large = cells.groupBy(keys).count().where(F.col("count") > limit).collect()  # at most 20,000 rows
    parts = F.broadcast(small_frame(spark, [(*r[:4], math.ceil(2 * r[4] / limit)) for r in large], "label string, dim int, block int, cell binary, parts int"))
    dealt = cells.join(parts, keys, "left").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.coalesce("parts", F.lit(1))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    dealt = dealt.withColumn("c1", F.least("chunk", "other")).withColumn("c2", F.greatest("chunk", "other"))
    keys += ["c1", "c2"]
    dealt = dealt.select(*keys, "chunk", "visitor", "cid", "coords")
    r2 = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12

    def surviving(key: tuple, t: pa.Table) -> pa.Table:
        dim, block, c1, c2 = (key[i].as_py() for i in (1, 2, 4, 5))
        cuts = block_cuts(dim, blocks)
        b = t.combine_chunks().to_batches()[0]
        z = b["coords"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
        share = r2 * (cuts[block + 1] - cuts[block]) / dim
        return t.drop_columns(["coords"]).filter(pa.array(partnered(z, share, b["visitor"].to_numpy(zero_copy_only=False), b["chunk"].to_numpy(), c1 == c2)))

    survivors = dealt.groupBy(*keys).applyInArrow(surviving, dealt.drop("coords").schema)
    survivors = ws.stage(survivors, "survivors").join(classes.select("cid", "n", "embedding"), "cid")

    def compared(key: tuple, t: pa.Table) -> pa.Table:
        block, c1, c2 = (key[i].as_py() for i in (2, 4, 5))
        t = t.combine_chunks()
        b = t.to_batches()[0]
        cid = b["cid"].to_numpy()
        found, label = verified(cid, b["n"].to_numpy(), units(b["embedding"]), block, b["visitor"].to_numpy(zero_copy_only=False), b["chunk"].to_numpy(), c1 == c2, cosine, blocks)
        some = np.flatnonzero(found)
        return pa.table({"cid": cid[some], "links": found[some], "root": cid[label[some]]}, pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))

    found = ws.stage(survivors.groupBy(*keys).applyInArrow(compared, "cid long, links long, root long"), "found")
    roots = components(ws, found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "label", "embedding", "n", "low").join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    named = ws.stage(named.select("label", "embedding", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")), "named")
    lows = ws.stage(named.groupBy("root").agg(F.min("low").alias("component_id")), "lows")  # written: a large component's join is then split
    of = ws.stage(named.join(lows, "root").select("label", "embedding", "n_links", "component_id"), "of")
    linked = valid.join(of, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
