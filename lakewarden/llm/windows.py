"""Bounded-space online packing into windows of a fixed size.

Each partition reads its documents once and in order and keeps at most ``keep`` windows open:

 1. What is left of a document goes whole into the open window that it fills best. Where none has room and fewer than
    ``keep`` are open, another is opened.
 2. Where none fits, the fullest is emitted. Since documents may be cut, the document's next tokens fill its gap first,
    so no emitted window has padding; a document longer than a window fills windows of its own from its start.
 3. At a partition's end its open windows are merged into one run, cut into full windows, and less than a window is left.
    These leftovers, ids and all, are merged by groups of partitions in the same way; what a group has left, again less
    than a window, is cut into sequences of powers of two, which need no padding.

Space: ``keep`` windows a partition, ``GROUP`` leftovers in a task. Only leftovers are shuffled.

Ids come from a cache of chunks, runs without ASCII white space. The tokenizer must drop white space before it splits, so
that chunks can be encoded on their own; others raise.

Defined results: null or empty text, or one of white space, is the single end token; every row is packed, repeated rows
and null ids too; an empty table gives no rows; other columns are not read. A special string inside a text is its special
token, as is the library's default.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, strings

#: Windows that a partition keeps open, and partitions whose leftovers meet in a task.
KEEP, GROUP = 32, 512


class ChunkIds:
    """Little-endian 32-bit ids of texts, by chunks, in two generations of ``limit`` of them or ``room`` bytes of theirs.

    A full generation becomes the old one, from which what is met again moves on. Words, ``words`` of them at most, are
    known by themselves. A worker keeps one for all its partitions: it is a cache of bounded size and nothing else.
    """

    def __init__(self, path: str, limit: int = 300_000, room: int = 18 << 20, words: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            has = json.load(f)
        self._serves(has)
        suffix, vocabulary = has["model"].get("end_of_word_suffix"), self.lib.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.limit, self.room, self.held, self.most_words = limit, room, 0, words
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _serves(has: dict) -> None:
        """Whether a text's ids are those of its chunks, one after another."""
        steps = lambda part, many: (has[part] or {}).get(many, [has[part]] if has[part] else [])
        cuts = [s for s in steps("pre_tokenizer", "pretokenizers") if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
        own = [s["pattern"].get("Regex", "") for s in cuts[:1]]
        if not own or not own[0].endswith(r"[^\s\p{L}\p{N}]+") or re.search(r"\\s|\\S|\.|(?<!\[)\^| ", own[0].removesuffix(r"[^\s\p{L}\p{N}]+")):
            raise ValueError("only tokenizers that drop white space are served")
        if any(s["type"] not in ("NFC", "Replace", "Lowercase") or s["type"] == "Replace" and s["pattern"] != {"Regex": r"\s+"} for s in steps("normalizer", "normalizers")):
            raise ValueError("only normalisers that leave white space apart are served")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in has["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not served")

    def fresh(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that aren't known.

        Those of plain characters are put together from their words, known by themselves. New words go to the library as
        one text: each ends with a piece that ends a word. Chunks of other characters go one by one.
        """
        if len(self.words) > self.most_words:
            self.words.clear()
        parts = [None if _ODD.search(c) else _PART(c.lower()) for c in chunks]
        new = list(set().union(*filter(None, parts)).difference(self.words))
        ids = np.array(self.lib.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids if new else [], "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) == len(new):
            raw = ids.tobytes()
            self.words.update(zip(new, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        else:  # not a vocabulary whose words end with pieces of their own
            self.words.update(zip(new, self.each(new), strict=True))
        odd = [c for c, p in zip(chunks, parts, strict=True) if p is None]
        found, get = dict(zip(odd, self.each(odd), strict=True)), self.words.__getitem__
        return [found[c] if p is None else get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for c, p in zip(chunks, parts, strict=True)]

    def each(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def of(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        if len(self.known) > self.limit or self.held > self.room:
            self.old, self.known, self.held = self.known, {}, 0
        found = list(map(self.known.get, chunks))
        missing = [c for c, i in zip(chunks, found, strict=True) if i is None]
        again = self.old.keys() & missing
        self.known.update(zip(again, map(self.old.__getitem__, again), strict=True))
        new = [c for c in missing if c not in again] if again else missing
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.known.update(zip(some, self.fresh(some), strict=True))
        self.held += sum(map(len, missing)) * 2
        out = [self.known[c] if i is None else i for c, i in zip(chunks, found, strict=True)]
        for c in new:
            if len(c) > 256:
                self.held -= 2 * len(c)
                del self.known[c]
        return out

    def encode(self, texts: pa.Array, tail: int | None = None) -> tuple[bytes, np.ndarray]:
        """All ids of some texts (null: none), each text's followed by ``tail``, and where each text's begin, in tokens.

        Texts are cut and their chunks made distinct by Arrow, so Python sees a chunk once a batch.
        """
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            texts = pa.array(strings(texts), pa.string())
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends, flat = np.cumsum(cut.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64), cut.flatten().dictionary_encode()
        ids = self.of(flat.dictionary.to_pylist())
        codes = flat.indices.to_numpy()
        if tail is not None:
            codes, ends = np.insert(codes, ends, len(ids)), ends + np.arange(1, len(ends) + 1)
            ids = [*ids, array("I", [tail]).tobytes()]
        pool, width = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, n = np.cumsum(width) - width, width[codes]
        at = np.concatenate([[0], np.cumsum(n)])
        return pool[np.repeat(first[codes] - at[:-1], n) + np.arange(at[-1])].tobytes(), at[np.concatenate([[0], ends])]


#: What isn't plain here: other characters than ASCII and Latin letters, and what may hold an added token.
_ODD = re.compile(r"[^\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]|<\|")
_LETTER = r"a-z\xdf-\xf6\xf8-\xff"
_PART = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+").findall


@functools.lru_cache(maxsize=1)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


class Open:
    """Open windows of one partition, by the tokens that they hold."""

    def __init__(self, size: int, keep: int):
        self.size, self.keep, self.order, self.content = size, keep, [], {}
        self.made = 0

    def put(self, n: int, piece: tuple) -> bool:
        """Whether a piece of ``n`` tokens found its place whole, in the fullest window with room for it or a new one."""
        at = bisect_left(self.order, (self.size - n + 1,)) - 1
        if at >= 0:
            held, window = self.order.pop(at)
        elif len(self.order) < self.keep:
            held, window = 0, self.made
            self.made += 1
            self.content[window] = []
        else:
            return False
        self.content[window].append(piece)
        insort(self.order, (held + n, window))
        return True

    def gap(self) -> int:
        """Room in the fullest window."""
        return self.size - self.order[-1][0]

    def emit(self) -> list[tuple]:
        return self.content.pop(self.order.pop()[1])

    def rest(self) -> Iterator[tuple]:
        """All that is still open, the oldest window first."""
        for _, window in sorted(self.order, key=lambda o: o[1]):
            yield from self.content[window]


Piece = tuple[object, int, bytes, int]  # id of the document, first token, ids, tokens of the whole document


def online(pieces: Iterator[Piece], size: int, keep: int) -> Iterator[tuple[bool, list[Piece]]]:
    """(whether it is full, the pieces of a window), as windows are emitted; the last one may be less than full."""
    windows = Open(size, keep)
    for doc, start, ids, total in pieces:
        n = len(ids) // 4
        while n >= size:
            yield True, [(doc, start, ids[: 4 * size], total)]
            start, ids, n = start + size, ids[4 * size :], n - size
        while n and not windows.put(n, (doc, start, ids, total)):
            gap = windows.gap()
            head = [(doc, start, ids[: 4 * gap], total)] if gap else []
            yield True, windows.emit() + head
            start, ids, n = start + gap, ids[4 * gap :], n - gap
    yield from filled(windows.rest(), size)


def filled(pieces: Iterator[Piece], size: int) -> Iterator[tuple[bool, list[Piece]]]:
    """Full windows of a run of pieces, cut where one is full, and what is left at its end."""
    window, room = [], size
    for doc, start, ids, total in pieces:
        while ids:
            take = min(room, len(ids) // 4)
            window.append((doc, start, ids[: 4 * take], total))
            start, ids, room = start + take, ids[4 * take :], room - take
            if not room:
                yield True, window
                window, room = [], size
    if window:
        yield False, window


def powers(window: list[Piece]) -> Iterator[list[Piece]]:
    """A window's pieces as sequences of powers of two, the longest first."""
    n = sum(len(p[2]) for p in window) // 4
    while n:
        most = 1 << (n.bit_length() - 1)
        parts = filled(iter(window), most)
        yield next(parts)[1]
        window, n = [p for _, w in parts for p in w], n - most


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def rows(windows: list[list[Piece]], first: int, kind: pa.DataType) -> list[pa.Array]:
    """Columns of the pieces of some windows, numbered from ``first``."""
    out: list[list] = [[] for _ in range(7)]
    for number, window in enumerate(windows, first):
        at = 0
        for doc, start, ids, total in window:
            n = len(ids) // 4
            for col, x in zip(out, (doc, start, n, zlib.crc32(ids), total, number, at), strict=True):
                col.append(x)
            at += n
    return [pa.array(out[0], kind), *(pa.array(c, pa.int64()) for c in out[1:])]


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_online(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, keep: int = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id: a partition's number and a count within it; those of merged leftovers are negative.
    """
    ws = Workspace(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def own(batches):
        cache, seen = chunk_ids(path), {}

        def pieces():
            for part in batches:
                if part.num_rows:
                    seen["type"], seen["part"] = part.schema.field("doc_id").type, part["part"][0].as_py()
                    ids, at = cache.encode(part["text"], end_id)
                    at = at.tolist()
                    for doc, a, b in zip(part["doc_id"].to_pylist(), at, at[1:], strict=False):
                        yield doc, 0, ids[4 * a : 4 * b], b - a

        def batch(windows, ids=None):
            cols = rows(windows, (seen["part"] << 36) + made, seen["type"])
            return pa.RecordBatch.from_arrays([*cols, pa.array(ids or [None] * len(cols[0]), pa.binary()), pa.array([seen["part"]] * len(cols[0]), pa.int32())], [*NAMES, "ids", "part"])

        made, held, left = 0, [], None
        for full, window in online(pieces(), size, keep):
            if not full:
                left = window
                continue
            held.append(window)
            if len(held) == 256:
                yield batch(held)
                made, held = made + len(held), []
        if held:
            yield batch(held)
        if left:
            yield batch([left], [p[2] for p in left])

    first = ws.stage(source.mapInArrow(own, f"doc_id {kind}, {COLUMNS}, ids binary, part int"), "windows")

    def merged(key, batches):
        def pieces():
            for b in batches:
                seen["type"] = b.schema.field("doc_id").type
                for doc, start, ids, total in zip(*(b[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                    yield doc, start, ids, total

        seen, made, group = {}, 0, key[0].as_py()
        for full, window in filled(pieces(), size):
            windows = [window] if full else list(powers(window))
            cols = rows(windows, 0, seen["type"])
            cols[5] = pa.array([-((group << 36) + made + n + 1) for n in cols[5].to_pylist()], pa.int64())
            made += len(windows)
            yield pa.RecordBatch.from_arrays(cols, NAMES)

    left = first.where("ids is not null").withColumn("meet", F.floor(F.col("part") / GROUP))
    again = left.groupBy("meet").applyInArrow(lambda key, t: pa.Table.from_batches(merged(key, t.sort_by([("part", "ascending"), ("offset", "ascending")]).to_batches())), f"doc_id {kind}, {COLUMNS}")
    return first.where("ids is null").select(*NAMES).unionByName(again)
