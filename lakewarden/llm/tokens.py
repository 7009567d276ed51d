"""Token counts and ids of whole texts, by pre-token.

A byte-level BPE never merges across the pre-tokens of its own pattern, so a pre-token's pieces are the
same wherever it stands. ``count_tokens`` counts the pieces of each distinct pre-token once and sums
over a document's pre-token frequencies; no ids are made.

 1. Every text is cut once. A partition's documents form segments; a segment is one row of a written table:
    its distinct pre-tokens, and for each document the numbers of its pre-tokens there, with frequencies.
 2. The distinct pre-tokens of all segments are the vocabulary; one library call each gives the pieces.
 3. Each segment's pre-tokens are joined with the vocabulary by a shuffle. A pre-token has at most one row
    a segment, however often it occurs, so the hottest have as many as there are segments, and Spark splits
    a join's large partitions. A document's count is the sum of frequency times pieces.

Only tokenizers with ByteLevel pre-tokenisation and plain added tokens are served; others raise.

Defined results: null text counts as empty (0 bytes, 0 tokens); every row gives a row, repeated rows and
null ids too; an empty table gives no rows; other columns are not read. A special string inside a text
is its special token, as is the library's default.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, strings

#: Texts of these characters only are cut by Python's re; all others by the library's own pre-tokeniser.
_ODD = re.compile(r"[^\x01-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]")
_RUN = re.compile(r"\s\s")
_LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_CUT = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")

class PreTokens:
    """The pre-tokens of one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        if not path.endswith(".json"):
            raise ValueError("only tokenizer .json files are served")
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        kind = self.lib.pre_tokenizer.__getstate__() if self.lib.pre_tokenizer else b""
        if not re.match(rb'{"type":"ByteLevel"', kind) or b'"add_prefix_space":true' in kind or self.lib.normalizer is not None:
            raise ValueError("only plain ByteLevel tokenizers are served")
        added = self.lib.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that take in their surroundings are not served")
        # of strings that are pre-tokens already, the pattern would find nothing to cut
        self.pre = self.lib.pre_tokenizer
        self.lib.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = re.compile("|".join(sorted((re.escape(t.content) for t in added), key=len, reverse=True)) or r"(?!)")

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if _ODD.search(text):
            return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]
        return _CUT.findall(text)

    def parts(self, text: str, cut) -> list[str]:
        """``cut`` of the stretches between special strings, which stand alone."""
        out, at = [], 0
        for m in self.special.finditer(text):
            out += cut(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + cut(text[at:]) if at else cut(text)

    def tokens(self, text: str) -> list[str]:
        return self.parts(text, self.cut)

    def chunks(self, text: str) -> list[str]:
        """Strings whose pre-tokens, one after another, are the text's; special strings stand alone.

        Where no two white-space characters meet, a text falls apart before each space: cheaper than
        the pattern, and most chunks repeat.
        """
        return self.parts(text, self._chunks)

    def _chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if _ODD.search(text) or _RUN.search(text):
            return self.cut(text)
        found = text.replace(" ", "\0 ").split("\0")
        return found if found[0] else found[1:]

    def pieces(self, chunk: str) -> list[str]:
        return [chunk] if self.special.fullmatch(chunk) else self.cut(chunk)

    def encode(self, tokens: list[str]) -> list[list[int]]:
        """Ids of pre-tokens."""
        return [e.ids for e in self.lib.encode_batch_fast(tokens, add_special_tokens=False)]

    def counts(self, tokens: list[str]) -> list[int]:
        return [len(e) for e in self.lib.encode_batch_fast(tokens, add_special_tokens=False)]


@functools.lru_cache(maxsize=4)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def texts_of(batches: Iterable[pa.RecordBatch], rows: int = 500):
    """(slice of the batch, its texts with null as empty), in small steps."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part, [t or "" for t in strings(part["text"])]


#: A segment ends beyond so many distinct chunks, pairs of document and chunk, or bytes of text.
SEGMENT = (600_000, 2_500_000, 48 << 20)


class Segment:
    """Pre-token frequencies of some documents, by numbers of the segment's own list of pre-tokens.

    While documents come, chunks are counted (most repeat); their pre-tokens are laid out at the end.
    """

    def __init__(self, cut: PreTokens):
        self.cut, self.doc_id, self.n_bytes, self.size = cut, [], [], 0
        self.chunk: defaultdict = defaultdict(itertools.count().__next__)
        self.n, self.chunks, self.times = [], [], []

    def add(self, doc_id, n_bytes: int, text: str) -> bool:
        """Whether the segment is full."""
        counts = Counter(self.cut.chunks(text))
        self.doc_id.append(doc_id)
        self.n_bytes.append(n_bytes)
        self.n.append(len(counts))
        self.chunks += map(self.chunk.__getitem__, counts)
        self.times += counts.values()
        self.size += n_bytes
        return len(self.chunk) > SEGMENT[0] or len(self.chunks) > SEGMENT[1] or self.size > SEGMENT[2] or len(self.n) >= 100_000

    def row(self, number: int, kind: pa.DataType, block: int = 200_000) -> pa.RecordBatch:
        token: defaultdict = defaultdict(itertools.count().__next__)
        parts = [list(map(token.__getitem__, self.cut.pieces(c))) for c in self.chunk]
        width = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter(itertools.chain.from_iterable(parts), np.int64, int(width.sum()))
        first = np.cumsum(width) - width
        # frequent pre-tokens get small numbers, which pack well
        chunk, times = np.array(self.chunks, np.int32), np.array(self.times, np.int64)
        use = np.bincount(chunk, minlength=len(width))
        rank = np.empty(len(token), np.int64)
        rank[np.argsort(-np.bincount(flat, np.repeat(use, width), len(token)), kind="stable")] = np.arange(len(token))
        flat, names = rank[flat], np.array(list(token), object)
        names[rank] = names.copy()
        n = np.array(self.n, np.int64)
        ends = np.cumsum(n)
        which, freq, each, lo = [], [], [], 0
        while lo < len(n):  # some documents at once, so that memory is that of a block
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + block)))
            a, z = int(ends[lo - 1] if lo else 0), int(ends[hi - 1])
            c, w = chunk[a:z], width[chunk[a:z]]
            at = np.arange(w.sum()) + np.repeat(first[c] - (np.cumsum(w) - w), w)
            doc = np.repeat(np.repeat(np.arange(hi - lo), n[lo:hi]), w)
            pair, inverse = np.unique(doc * max(1, len(token)) + flat[at], return_inverse=True)
            doc, ids = pair // max(1, len(token)), pair % max(1, len(token))
            step = np.diff(ids, prepend=0)
            new = np.flatnonzero(np.diff(doc, prepend=-1))
            step[new] = ids[new]
            which.append(step.astype(np.uint32))
            freq.append(np.bincount(inverse, np.repeat(times[a:z], w), len(pair)).astype(np.uint32))
            each.append(np.bincount(doc, minlength=hi - lo))
            lo = hi
        cols = [number, names.tolist(), self.doc_id, self.n_bytes, np.concatenate(each).tolist() if each else [], packed(which), packed(freq)]
        types = [pa.int64(), pa.list_(pa.string()), pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types, strict=True)], ["segment", "tokens", "doc_id", "n_bytes", "n_pairs", "which", "freq"])


def packed(parts: list[np.ndarray]) -> bytes:
    """Numbers of 32 bits as four planes of bytes, compressed; most numbers are small."""
    x = np.concatenate(parts).astype("<u4") if parts else np.empty(0, "<u4")
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpacked(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.int64)
    planes = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def frequencies(docs: DataFrame, path: str, ws: Workspace, id_col: str, text_col: str) -> DataFrame:
    """The per-document pre-token frequencies, a row for each segment; every text is cut once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def own(batches):
        cut, part, arrow, numbers = pre_tokens(path), None, None, itertools.count(TaskContext.get().partitionId() << 32)
        for b in batches:
            arrow = b.schema.field("doc_id").type
            for doc_id, n, text in zip(b["doc_id"].to_pylist(), pc.binary_length(b["text"]).fill_null(0).to_pylist(), strings(b["text"]), strict=True):
                part = part or Segment(cut)
                if part.add(doc_id, n, text or ""):
                    yield part.row(next(numbers), arrow)
                    part = None
        if part:
            yield part.row(next(numbers), arrow)

    schema = f"segment long, tokens array<string>, doc_id array<{kind}>, n_bytes array<long>, n_pairs array<long>, which binary, freq binary"
    return ws.stage(rows.mapInArrow(own, schema), "frequencies")


def vocabulary(segments: DataFrame, path: str, ws: Workspace) -> DataFrame:
    """token, pieces: one library call for each distinct pre-token."""

    def counted(batches):
        cut = pre_tokens(path)
        for b in batches:
            yield b.append_column("pieces", pa.array(cut.counts(b["token"].to_pylist()), pa.int64()))

    distinct = segments.select(F.explode("tokens").alias("token")).distinct()
    return ws.stage(distinct.mapInArrow(counted, "token string, pieces long"), "vocabulary")


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    ws = Workspace(docs.sparkSession)
    segments = frequencies(docs, path, ws, id_col, text_col)
    vocab = vocabulary(segments, path, ws)
    pairs = segments.select("segment", F.posexplode("tokens").alias("at", "token")).join(vocab, "token")
    pairs = pairs.select("segment", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("pieces")).alias("p"))  # both in one number, in the order of ``at``
    pieces = pairs.groupBy("segment").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.bitwiseAND(F.lit((1 << 32) - 1))).alias("pieces"))

    def summed(batches):
        for b in batches:
            for i in range(b.num_rows):
                pieces = np.array(b["pieces"][i].values if b["pieces"][i].is_valid else [], np.int64)
                n = np.array(b["n_pairs"][i].values, np.int64)
                step, freq = (unpacked(b[c][i].as_py(), int(n.sum())) for c in ("which", "freq"))
                before = np.concatenate([[0], np.cumsum(step)])  # steps up, begun anew with each document
                which = before[1:] - np.repeat(before[np.cumsum(n) - n], n)
                total = np.bincount(np.repeat(np.arange(len(n)), n), pieces[which] * freq, len(n)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b["doc_id"][i].values, b["n_bytes"][i].values, pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = segments.drop("tokens").join(pieces, "segment", "left").drop("segment").mapInArrow(summed, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


class IdCache:
    """Little-endian 32-bit ids of texts, by chunks, in two generations of ``limit`` of them or ``room`` bytes of theirs.

    A full generation becomes the old one, from which what is met again moves on; the one before it goes. Pre-tokens,
    ``words`` of them at most, are known by themselves, since most new chunks are made of known ones; what is over 256
    characters isn't kept. A worker keeps one for all its partitions: it is a cache of bounded size and nothing else.
    """

    def __init__(self, path: str, limit: int = 300_000, room: int = 18 << 20, words: int = 800_000):
        self.cut, self.limit, self.room, self.held, self.most_words = pre_tokens(path), limit, room, 0, words
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def fresh(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that aren't known, put together from their pre-tokens."""
        if len(self.words) > self.most_words:
            self.words.clear()
        parts = list(map(self.cut.pieces, chunks))
        new = list(set().union(*parts).difference(self.words))
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            self.words.update(zip(some, (array("I", x).tobytes() for x in self.cut.encode(some)), strict=True))
        get = self.words.__getitem__
        out = [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in parts]
        for w in new:
            if len(w) > 256:
                del self.words[w]
        return out

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

    def joined(self, cut: pa.ListArray) -> list[bytes]:
        """Ids of texts that are cut to chunks; Arrow makes the chunks distinct, so Python sees one once a batch."""
        ends, flat = np.cumsum(cut.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64), cut.flatten().dictionary_encode()
        ids, codes = self.of(flat.dictionary.to_pylist()), flat.indices.to_numpy()
        pool, width = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, n = np.cumsum(width) - width, width[codes]
        at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        raw = pool[np.repeat(first[codes] - at[:-1], n) + np.arange(at[-1])].tobytes()
        ends = (4 * at[ends]).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not (_ODD.search(t) or _RUN.search(t) or self.cut.special.search(t)) for t in texts]
        # plain texts fall apart before each space, as in ``chunks``
        some = pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.string())
        easy = iter(self.joined(pc.split_pattern(pc.replace_substring(some, " ", "\0 "), "\0")))
        rest = iter(self.joined(pa.array([self.cut.chunks(t) for t, p in zip(texts, plain, strict=True) if not p], pa.list_(pa.string()))))
        return [next(easy if p else rest) for p in plain]


@functools.lru_cache(maxsize=1)
def id_cache(path: str) -> IdCache:
    return IdCache(path)
