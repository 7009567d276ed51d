"""Language identification of code-switched text by a linear-chain conditional random field.

Each word is a position; its features are the word's affixes (first and last one to four letters), its
letter n-grams (two and three, with word ends) and the lexicons that list it, all of the whole word,
however long: a text in a script without spaces has few, long words. Features are hashed to rows
of a weight table; a table of learned transitions ties neighbouring words. Forward-backward gives each
word's distribution over languages, and a document's languages are the means over its words: the largest
is the prediction, its mean the score.

Training takes a bounded sample, ``per_lang`` documents of a language (about), of each a few spans of
``span`` words at seeded places. Words carry their document's language; some training sequences join spans
of two languages, so that transitions are learned from switches. All documents are then labelled whole.

Defined results: null text, or text without a letter, is ``und`` with score 0 (as is everything if nothing
could be learned); null ids are not held out from scoring and not learned from; every row gives a row;
an empty table gives no rows; columns other than id, text and lang are never read.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, ship, strings
from .labelled import share

WORD = re.compile(r"[^\W\d_]+")
#: The same over texts that hold no other letters than these.
_LATIN_WORD = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")
_OTHER = re.compile(r"[^\x00-\x7f\xdf-\xf6\xf8-\xff]")
UND = "und"
BUCKETS = 1 << 16
#: Letters whose features are made at once.
LETTERS = 1 << 18


def words(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    if not _OTHER.search(text):
        return _LATIN_WORD.findall(text)
    return [w for w in WORD.findall(text) if w.isalpha() or any(map(str.isalpha, w))]  # a fraction or a Roman numeral is no letter


def features(found: list[str], lexicon: dict[str, list[int]], most: int = LETTERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Weight rows of many words, and the word that each row is of; in parts of about ``most`` letters.

    Affixes and n-grams are hashed from code points of the whole word; lexicon rows stand above the buckets.
    A word of more letters than a part has goes over several parts.
    """
    for lo, hi in groups(found, most):
        marked = [f"<{w}>" for w in found[lo:hi]]
        n = np.fromiter(map(len, marked), np.int64, len(marked))
        c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        word, first = np.repeat(np.arange(lo, hi), n), np.cumsum(n) - n
        rows, owner = [], []

        def add(start: np.ndarray, k: int, tag: int, c=c, word=word, rows=rows, owner=owner) -> None:
            h = np.full(len(start), tag, np.uint64)
            for i in range(k):
                h = (h ^ c[start + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            rows.append((h % np.uint64(BUCKETS)).astype(np.int64))
            owner.append(word[start])

        size = len(c) if len(c) <= 4 * most else most
        for at in range(0, len(c), size):
            for k in (2, 3):
                start = np.arange(at, min(at + size, len(c) - k + 1))
                add(start[word[start] == word[start + k - 1]], k, k)
            if at + size < len(c):
                yield np.concatenate(rows), np.concatenate(owner)
                rows.clear()
                owner.clear()
        for k in (1, 2, 3, 4):
            long = n - 2 >= k
            add(first[long] + 1, k, 10 + k)
            add((first + n)[long] - 1 - k, k, 20 + k)
        listed = [(BUCKETS + k, i) for i in range(lo, hi) for k in lexicon.get(found[i], ())]
        extra = np.array(listed, np.int64).reshape(-1, 2)
        yield np.concatenate([*rows, extra[:, 0]]), np.concatenate([*owner, extra[:, 1]])


def summed(parts: Iterable[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n: int) -> np.ndarray:
    """The sums of the weight rows of n words."""
    out = np.zeros((n, weights.shape[1]))
    for rows, owner in parts:
        for k in range(weights.shape[1]):
            out[:, k] += np.bincount(owner, weights[rows, k], n)
    return out


@dataclass
class Crf:
    langs: list[str]
    lexicon: dict[str, list[int]]
    weights: np.ndarray  # (BUCKETS + languages) x languages
    moves: np.ndarray  # languages x languages
    start: np.ndarray

    def emissions(self, found: list[str]) -> np.ndarray:
        return summed(features(found, self.lexicon), self.weights, len(found))


class Emissions:
    """Rows of exp(emission) of words, made once a word; starts anew beyond ``limit`` words or ``letters`` letters."""

    def __init__(self, model: Crf, limit: int = 200_000, letters: int = 4_000_000):
        self.model, self.limit, self.letters, self.ids, self.held = model, limit, letters, {}, 0
        self.table = np.empty((1024, len(model.langs)), np.float32)

    def rows(self, docs: list[list[str]]) -> np.ndarray:
        """Row numbers of all words, one document after another."""
        if len(self.ids) > self.limit or self.held > self.letters:
            self.ids.clear()
            self.held = 0
        new = list(set(itertools.chain.from_iterable(docs)) - self.ids.keys())
        for at in range(0, len(new), 4000):
            some = new[at : at + 4000]
            k = len(self.ids)
            while k + len(some) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            e = self.model.emissions(some)
            self.table[k : k + len(some)] = np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -30))
            self.ids.update(zip(some, range(k, k + len(some)), strict=True))
            self.held += sum(map(len, some))
        return np.fromiter(map(self.ids.__getitem__, itertools.chain.from_iterable(docs)), np.int64)


def posteriors(model: Crf, table: np.ndarray, rows: np.ndarray, n: np.ndarray, block: int = 32) -> np.ndarray:
    """Mean word posteriors of documents with n words each (n > 0), by forward-backward.

    Documents are cut into blocks. The product of a block's steps is a matrix; messages pass from block to
    block by these, and then all blocks run at once from the messages that enter them. The result is that
    of running word by word, which many languages (whose matrices would be large) do instead.
    """
    k = len(model.langs)
    if k > 12:
        return posteriors_by_word(model, table, rows, n)
    number = -(-n // block)
    order = np.argsort(-number, kind="stable")
    size = number[order]
    steps = int(size[0])
    active = len(size) - np.searchsorted(size[::-1], np.arange(steps), side="right")
    at = np.concatenate([[0], np.cumsum(active)])  # block j of all documents stands at at[j]..at[j + 1]
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n))
    t = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    slot, col = at[t // block] + np.repeat(rank, n), t % block
    e = np.ones((block, at[-1], k))
    valid = np.zeros((block, at[-1], 1), bool)
    e[col, slot], valid[col, slot] = table[rows], True
    moves = np.exp(model.moves)
    heads = at[1]  # first blocks: their first word has no step before it

    def stepped(x: np.ndarray, c: int) -> np.ndarray:
        y = x @ moves
        if c == 0:
            y[:heads] = x[:heads]
        return y

    m = np.broadcast_to(np.eye(k), (at[-1], k, k)).copy()
    for c in range(block):
        m = np.where(valid[c][:, :, None], stepped(m, c) * e[c][:, None, :], m)
        if c % 4 == 3:
            m /= m.max(axis=(1, 2), keepdims=True)
    into, after = np.empty((at[-1], k)), np.ones((at[-1], k))
    into[:heads] = np.exp(model.start)
    for s in range(1, steps):
        a, b, q = at[s - 1], at[s], active[s]
        x = np.einsum("ni,nij->nj", into[a : a + q], m[a : a + q])
        into[b : b + q] = x / x.sum(axis=1, keepdims=True)
    for s in range(steps - 2, -1, -1):
        a, b, q = at[s], at[s + 1], active[s + 1]
        x = np.einsum("nij,nj->ni", m[b : b + q], after[b : b + q])
        after[a : a + q] = x / x.sum(axis=1, keepdims=True)
    alpha = np.empty_like(e)
    for c in range(block):
        x = stepped(into, c) * e[c]
        into = alpha[c] = np.where(valid[c], x / x.sum(axis=1, keepdims=True), into)
    total = np.zeros((at[-1], k))
    for c in range(block - 1, -1, -1):
        g = alpha[c] * after
        total += np.where(valid[c], g / g.sum(axis=1, keepdims=True), 0)
        if c:
            x = (after * e[c]) @ moves.T
            after = np.where(valid[c], x / x.sum(axis=1, keepdims=True), after)
    doc = np.concatenate([np.arange(q) for q in active])
    sums = np.stack([np.bincount(doc, total[:, i], len(n)) for i in range(k)], axis=1)
    return sums[rank] / n[:, None]


def posteriors_by_word(model: Crf, table: np.ndarray, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """As ``posteriors``, word by word.

    Documents advance together, longest first, so that step t works on the leading ones that have a word t.
    """
    order = np.argsort(-n, kind="stable")
    size = n[order]
    steps = int(size[0])
    active = len(size) - np.searchsorted(size[::-1], np.arange(steps), side="right")
    at = np.concatenate([[0], np.cumsum(active)])
    first = (np.cumsum(n) - n)[order]
    doc = np.repeat(np.arange(len(size)), size)
    t = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    laid = np.empty(len(rows), np.int64)
    laid[at[t] + doc] = rows[first[doc] + t]
    e = table[laid]
    moves = np.exp(model.moves).astype(np.float32)
    alpha = np.empty_like(e)
    for s in range(steps):
        a, b = at[s], at[s + 1]
        x = e[a:b] * (np.exp(model.start).astype(np.float32) if s == 0 else alpha[at[s - 1] : at[s - 1] + b - a] @ moves)
        alpha[a:b] = x / x.sum(axis=1, keepdims=True)
    beta = np.ones((len(size), e.shape[1]), np.float32)
    total = np.zeros((len(size), e.shape[1]))
    back = np.ascontiguousarray(moves.T)
    for s in range(steps - 1, -1, -1):
        a, b = at[s], at[s + 1]
        k = b - a
        if s + 1 < steps:
            m = at[s + 2] - at[s + 1]
            x = (beta[:m] * e[b : b + m]) @ back
            beta[:m] = x / x.sum(axis=1, keepdims=True)
        g = alpha[a:b] * beta[:k]
        total[:k] += g / g.sum(axis=1, keepdims=True)
    out = np.empty_like(total)
    out[order] = total / size[:, None]
    return out


def fit(sequences: list[tuple[list[str], list[int]]], langs: list[str], lexicon: dict[str, list[int]], epochs: int = 3, batch: int = 64, rate: float = 0.15, l2: float = 1e-6, seed: int = 3) -> Crf:
    """Adagrad on the conditional log likelihood; gradients by forward-backward over padded batches."""
    k = len(langs)
    g = np.random.default_rng(seed)
    weights, moves, start = np.zeros((BUCKETS + k, k)), np.zeros((k, k)), np.zeros(k)
    square = [np.full_like(x, 1e-8) for x in (weights, moves, start)]
    for _ in range(epochs):
        for at in range(0, len(sequences), batch):
            if at == 0:
                order = g.permutation(len(sequences))
            some = [sequences[i] for i in order[at : at + batch]]
            b, steps = len(some), max(len(w) for w, _ in some)
            gold, mask = np.zeros((b, steps), np.int64), np.zeros((b, steps), bool)
            for i, (w, y) in enumerate(some):
                mask[i, : len(w)], gold[i, : len(w)] = True, y
            flat, place = [x for w, _ in some for x in w], np.flatnonzero(mask.ravel())
            parts = list(features(flat, lexicon)) if sum(map(len, flat)) <= 8 * LETTERS else None
            e = np.zeros((b * steps, k))
            e[place] = summed(parts or features(flat, lexicon), weights, len(flat))
            e = e.reshape(b, steps, k)
            e = np.exp(np.maximum(e - e.max(axis=2, keepdims=True), -30))
            m, s0 = np.exp(moves), np.exp(start)
            alpha, beta = np.empty_like(e), np.ones_like(e)
            for t in range(steps):
                x = e[:, t] * (s0 if t == 0 else alpha[:, t - 1] @ m)
                alpha[:, t] = x / x.sum(axis=1, keepdims=True)
            for t in range(steps - 2, -1, -1):
                x = (beta[:, t + 1] * e[:, t + 1]) @ m.T
                x /= x.sum(axis=1, keepdims=True)
                beta[:, t] = np.where(mask[:, t + 1, None], x, 1.0)
            p = alpha * beta
            p /= p.sum(axis=2, keepdims=True)
            y = np.eye(k)[gold]
            diff = ((p - y) * mask[:, :, None]).reshape(-1, k)
            pairs = alpha[:, :-1, :, None] * m * (beta[:, 1:] * e[:, 1:])[:, :, None, :]
            pairs /= pairs.sum(axis=(2, 3), keepdims=True)
            both = mask[:, 1:]
            d_moves = pairs[both].sum(axis=0) - np.einsum("ni,nj->ij", y[:, :-1][both], y[:, 1:][both])
            rows, d_rows = np.zeros(0, np.int64), np.zeros((0, k))
            for feats, word in parts or features(flat, lexicon):
                new, inverse = np.unique(feats, return_inverse=True)
                d_new = np.stack([np.bincount(inverse, diff[place[word], c], len(new)) for c in range(k)], axis=1)
                rows, inverse = np.unique(np.concatenate([rows, new]), return_inverse=True)
                d_all = np.concatenate([d_rows, d_new])
                d_rows = np.stack([np.bincount(inverse, d_all[:, c], len(rows)) for c in range(k)], axis=1)
            d_rows = d_rows / b + l2 * weights[rows]
            square[0][rows] += d_rows**2
            weights[rows] -= rate * d_rows / np.sqrt(square[0][rows])
            for x, d, q in ((moves, d_moves / b, square[1]), (start, (p - y)[:, 0].sum(axis=0) / b, square[2])):
                q += d**2
                x -= rate * d / np.sqrt(q)
    return Crf(langs, lexicon, weights.astype(np.float32), moves, start)


def learn(docs: DataFrame, per_lang: int = 800, span: int = 60, spans: int = 2, seed: int = 13, mod: int = 4, rest: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf:
    """The model of a bounded sample: of every language some ``per_lang`` documents, spans * span words each."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(F.col(id_col), mod, rest).alias("out"))
    rows = rows.where("id is not null and lang is not null and text is not null and not out").drop("out")
    counts = rows.groupBy("lang").count().collect()  # as many rows as languages; all of them are learned
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return Crf([], {}, np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    share_of = F.create_map(*itertools.chain.from_iterable((F.lit(r["lang"]), F.lit(min(1.0, per_lang / r["count"]))) for r in counts))
    some = rows.where(share("id", seed=seed) < share_of[F.col("lang")])

    def cut(batches):
        for b in batches:
            out: list = []
            for i, t, lang in zip(b["id"].to_pylist(), strings(b["text"]), b["lang"].to_pylist(), strict=True):
                w = words(t)
                for s in range(spans if w else 0):
                    h = zlib.crc32(f"{seed}:{s}:{i}".encode())
                    a = h % max(1, len(w) - span + 1)
                    out.append((h, lang, w[a : a + span]))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.string()))], ["h", "lang", "words"])

    got = some.mapInArrow(cut, "h long, lang string, words array<string>").orderBy("h", "lang", "words").limit(int(1.2 * per_lang * len(langs) * spans) + 1).collect()
    got.sort(key=lambda r: (r.h, r.lang, r.words))
    return train([(r.words, r.lang) for r in got], langs, seed)


def train(spans: list[tuple[list[str], str]], langs: list[str], seed: int = 13) -> Crf:
    """A model of word spans with one language each; the spans are also joined to switching sequences."""
    of = {lang: i for i, lang in enumerate(langs)}
    seen: dict[str, Counter] = {}
    for w, lang in spans:
        for x in w:
            seen.setdefault(x, Counter())[of[lang]] += 1
    lexicon = {x: [k for k, n in c.items() if n >= 0.8 * c.total()] for x, c in seen.items() if c.total() >= 5}
    lexicon = {x: k for x, k in lexicon.items() if k}
    g = np.random.default_rng(seed)
    sequences = []
    for i, (w, lang) in enumerate(spans):
        seq, y = list(w), [of[lang]] * len(w)
        if g.random() < 0.4 and len(spans) > 1:
            v, other = spans[int(g.integers(len(spans)))]
            a, b = int(g.integers(1, len(w) + 1)), int(g.integers(1, len(v) + 1))
            seq, y = w[:a] + v[:b], [of[lang]] * a + [of[other]] * b
        sequences.append((seq, y))
    return fit(sequences, langs, lexicon) if sequences else Crf([], {}, np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))


def groups(found: list[list[str]], most: int = 150_000):
    """Runs of documents with at most ``most`` words together (or a single longer document)."""
    a = total = 0
    for i, w in enumerate(found):
        if i > a and total + len(w) > most:
            yield a, i
            a, total = i, 0
        total += len(w)
    if a < len(found):
        yield a, len(found)


def identify(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, shares (language -> mean posterior) of every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def own(batches):
        model = sent.value
        cache = Emissions(model)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                found = [words(t) if model.langs else [] for t in strings(part["text"])]
                pred, score = [UND] * len(found), np.zeros(len(found))
                shares: list = [[] for _ in found]
                for lo, hi in groups(found):
                    some = [i for i in range(lo, hi) if found[i]]
                    if some:
                        ids = cache.rows([found[i] for i in some])
                        p = posteriors(model, cache.table, ids, np.array([len(found[i]) for i in some]))
                        for i, k, s in zip(some, p.argmax(axis=1).tolist(), p, strict=True):
                            pred[i], score[i] = model.langs[k], min(1.0, s[k])
                            shares[i] = list(zip(model.langs, s.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(pred, pa.string()), pa.array(score), pa.array(shares, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "shares"])

    return rows.mapInArrow(own, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, shares map<string,double>")
