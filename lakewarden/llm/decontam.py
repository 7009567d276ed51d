"""Benchmark decontamination over a positional inverted index.

``build_index`` cuts the documents into segments of some hundred thousand words. A segment holds, per
term, the sorted positions of its words (a gap after each document keeps a match inside one), and is one
row of a table in the shared folder: the index is distributed by document, so building it moves nothing,
and it serves any number of benchmarks.

``matches`` sends the benchmark in blocks of bounded size to every segment. A window's terms are ordered
by their number of postings in the segment, rarest first; the rarest list gives start candidates, and each
further list, shifted by the term's offset, is intersected with them. A window with a term that the
segment lacks ends at once. With ``slop`` > 0 terms may stand up to that many words off their place.

Defined results: null and word-free texts have no words, no hits; an item without words has no window;
an item with a null id marks words but is no counted item; rows of an item id count as one item; every
document row gives a row, repeated rows and null ids too; empty tables give no rows or no hits; other
columns are not read.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, raws

#: Upper case to lower case; all but letters, digits and bytes of other characters to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text).translate(_FOLD).split() if text else []


def _segment(rows: list[tuple], found: list[list[bytes]], kind: pa.DataType) -> pa.RecordBatch:
    ids: defaultdict = defaultdict(itertools.count().__next__)
    n = np.fromiter(map(len, found), np.int64, len(found))
    term = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(found)), np.int32, int(n.sum()))
    place = np.arange(len(term)) + np.repeat(np.arange(len(n)), n)  # a gap of one after each document
    order = np.argsort(term, kind="stable")
    return pa.RecordBatch.from_arrays(
        [
            pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
            pa.array([[r[1] for r in rows]], pa.list_(kind)),
            pa.array([n.tolist()], pa.list_(pa.int64())),
            pa.array([b" ".join(ids)], pa.large_binary() if len(term) > 1 << 27 else pa.binary()),
            pa.array([np.bincount(term, minlength=len(ids)).astype(np.int32).tobytes()], pa.binary()),
            pa.array([place[order].astype(np.int32).tobytes()], pa.binary()),
        ],
        ["row", "doc_id", "n_words", "terms", "counts", "postings"],
    )


def build_index(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", segment_words: int = 250_000) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType

    def own(batches):
        ids, found, n, arrow = [], [], 0, None
        for b in batches:
            arrow = b.schema.field("doc_id").type
            for row, doc, text in zip(b["row"].to_pylist(), b["doc_id"].to_pylist(), raws(b["text"]), strict=True):
                w = words(text)
                ids.append((row, doc))
                found.append(w)
                n += len(w)
                if n >= segment_words or len(ids) >= segment_words:
                    yield _segment(ids, found, arrow)
                    ids, found, n = [], [], 0
        if ids:
            yield _segment(ids, found, arrow)

    schema = f"row array<long>, doc_id array<{kind.simpleString()}>, n_words array<long>, terms binary, counts binary, postings binary"
    return ws.stage(rows.mapInArrow(own, schema), "index")


class Block:
    """Windows of some items: per window its terms (numbers in ``terms``), padded with -1, and its item."""

    def __init__(self, width: int):
        self.width, self.terms, self.rows, self.item, self.names = width, {}, [], [], []

    def add(self, item, text: str | None) -> None:
        w = [self.terms.setdefault(x, len(self.terms)) for x in words(text)]
        if not w:
            return
        self.names.append(None if item is None else str(item))
        for at in range(max(1, len(w) - self.width + 1)):
            one = w[at : at + self.width]
            self.rows.append(one + [-1] * (self.width - len(one)))
            self.item.append(len(self.names) - 1)

    def packed(self) -> dict:
        """Equal windows are looked up once: ``which`` gives the window of each (window, item)."""
        rows = np.array(self.rows, np.int32).reshape(-1, self.width)
        wins, which = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.array(self.item)], axis=1), axis=0)
        return {"terms": list(self.terms), "wins": wins, "pairs": pairs, "names": self.names}


def blocks(items: DataFrame, width: int, block_words: int, id_col: str, text_col: str):
    """Items stream through the driver; at most ``block_words`` windows and one item are held."""
    b, some = Block(width), False
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        b.add(r.i, r.t)
        if len(b.rows) >= block_words:
            yield b.packed()
            b, some = Block(width), True
    if b.rows or not some:
        yield b.packed()


def _starts(block: dict, terms: list[bytes], counts: np.ndarray, postings: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all matches in a segment."""
    wins, local = block["wins"], dict(zip(terms, range(len(terms)), strict=True))
    here = np.array([local.get(t, -1) for t in block["terms"]] + [-2], np.int64)  # padding -1 reads -2
    w = here[wins]
    alive = np.flatnonzero((w != -1).all(axis=1))
    w = w[alive]
    if not len(w):
        return alive, alive
    freq = np.where(w == -2, np.iinfo(np.int64).max, counts[np.maximum(w, 0)])
    order = np.argsort(freq, axis=1, kind="stable")
    key = (np.repeat(np.arange(len(counts)), counts) << 32) + postings
    begin = np.cumsum(counts) - counts
    rarest = w[np.arange(len(w)), order[:, 0]]
    n = counts[rarest]
    win = np.repeat(np.arange(len(w)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[rarest], n)
    start = postings[at] - order[win, 0]
    if slop:
        win, start = np.repeat(win, 2 * slop + 1), np.repeat(start, 2 * slop + 1) + np.tile(np.arange(-slop, slop + 1), len(start))
    for j in range(0 if slop else 1, w.shape[1]):
        o = order[win, j]
        t = w[win, o]
        want = (t << 32) + start + o
        i = np.searchsorted(key, want - slop)
        ok = (t == -2) | ((i < len(key)) & (key[np.minimum(i, len(key) - 1)] <= want + slop))
        win, start = win[ok], start[ok]
        if not len(win):
            break
    return alive[win], start


def matches(index: DataFrame, items: DataFrame, width: int = 10, slop: int = 0, block_words: int = 1_000_000, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_words, spans of hit words (start, end) and occurring items of every document.

    The benchmark passes in blocks; what they find in a document is one row in the end.
    """
    spark = index.sparkSession
    kind = index.schema["doc_id"].dataType.elementType.simpleString()
    schema = f"row long, doc_id {kind}, n_words long, spans array<struct<s:long,e:long>>, items array<string>"
    parts = []
    for block in blocks(items, width, block_words, id_col, text_col):
        sent = spark.sparkContext.broadcast(block)

        def own(batches, sent=sent):
            block = sent.value
            size = (block["wins"] >= 0).sum(axis=1)
            by_win = np.searchsorted(block["pairs"][:, 0], np.arange(len(block["wins"]) + 1))
            for b in batches:
                for i in range(b.num_rows):
                    n = np.array(b["n_words"][i].as_py(), np.int64)
                    first = np.cumsum(n) - n + np.arange(len(n))
                    counts = np.frombuffer(b["counts"][i].as_py(), np.int32).astype(np.int64)
                    postings = np.frombuffer(b["postings"][i].as_py(), np.int32).astype(np.int64)
                    win, start = _starts(block, b["terms"][i].as_py().split(b" ") if len(counts) else [], counts, postings, slop)
                    spans: list = [[] for _ in n]
                    items: list = [set() for _ in n]
                    if len(win):
                        doc = np.searchsorted(first, start + slop, side="right") - 1
                        lo = np.maximum(start - slop - first[doc], 0)
                        hi = np.minimum(start + size[win] + slop - first[doc], n[doc])
                        for d, s, e in np.unique(np.stack([doc, lo, hi], axis=1), axis=0).tolist():
                            if spans[d] and spans[d][-1]["e"] >= s:
                                spans[d][-1]["e"] = max(spans[d][-1]["e"], e)
                            else:
                                spans[d].append({"s": s, "e": e})
                        for d, x in np.unique(np.stack([doc, win], axis=1), axis=0).tolist():
                            items[d].update(block["names"][k] for k in block["pairs"][by_win[x] : by_win[x + 1], 1])
                    yield pa.RecordBatch.from_arrays(
                        [b["row"][i].values, b["doc_id"][i].values, pa.array(n), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string()))],
                        ["row", "doc_id", "n_words", "spans", "items"],
                    )

        parts.append(index.mapInArrow(own, schema))
    if len(parts) == 1:
        return parts[0]
    # a document's rows, one for each block, are summed once; those without a hit are light
    return functools.reduce(DataFrame.union, parts).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, block_words: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, spans, items, n_items, items_sha256, contaminated of every document."""
    index = build_index(docs, Workspace(docs.sparkSession), id_col, text_col)
    m = matches(index, items, width, 0, block_words, item_col, item_text)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    step = lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.e - F.greatest(a.reach, x.s))).alias("n"), F.greatest(a.reach, x.e).alias("reach"))
    m = m.withColumn("spans", F.array_sort("spans")).withColumn("items", F.array_sort("items"))
    return m.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", zero, step, lambda a: a.n).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
        "items",
    )
