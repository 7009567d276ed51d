"""Toxicity: boosted trees over dense features with isotonic calibration.

A bounded sample of labelled rows gives the lexicon: words and stems (first four to six letters) whose
odds are much higher in toxic texts. Trees are trained on dense features of whole texts: lexicon densities
(words, stems, obfuscated spellings), closeness of lexicon words to words of the second person, capitals,
punctuation and obfuscation rates. For training, each half of the sample gets its features from the other
half's lexicon, which stops a word that met toxic texts by chance from looking certain. Margins of trees
that didn't see a row give an isotonic calibration.

Defined results: null and empty texts have all features zero and are scored like others; a null id is
never learned from; every row gives a row; without labelled rows of both kinds the score is the share of
label 1 (0.0 without any); an empty table gives no rows; columns other than id and text are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees as T
from .common import Workspace, held_out, scored, ship, strings
from .labelled import labelled_sample

FEATURES = (
    "word_density", "stem_density", "hits", "distinct_hits", "weight", "strongest", "hidden_density", "near_you", "you", "capitals", "capital_words", "capital_hits", "exclaims", "questions",
    "punctuation", "odd_spellings", "densest", "log_words",
)
#: Words of the second person.
YOU = frozenset("you your yours yourself ya u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer eure usted ustedes tú ti tus vosotros vuestro vuestra".split())
_LEET = str.maketrans("013457@$!|€", "oieastasiie")
_EDGE = ".,;:!?\"'()[]{}<>«»„“”‘’¿¡…-–—*_#"


def plain(word: str) -> tuple[str, bool]:
    """A word in lower case without marks at its ends, and whether its spelling was obfuscated."""
    w = word.strip(_EDGE).lower()
    if w.isalpha() or not w or w.isdigit() or "-" in w or "'" in w:
        return w, False
    letters = "".join(c for c in w.translate(_LEET) if c.isalpha())
    odd = any(c.isalpha() for c in w) and 3 <= len(letters) and len(w) <= 24
    return (letters, True) if odd else (w, False)


def stems(w: str) -> list[str]:
    return [f"{w[:k]}*" for k in (4, 5, 6) if len(w) > k]


class Spelling(dict):
    """word as written -> (weight of its lexicon entry or 0, kind bits); kept for at most ``limit`` words of 64 characters."""

    WORD, STEM, HIDDEN, YOU, ODD, UPPER = 1, 2, 4, 8, 16, 32

    def __init__(self, lexicon: dict[str, float], limit: int = 100_000):
        self.lexicon, self.limit = lexicon, limit

    def __missing__(self, word: str) -> tuple[float, int]:
        if len(self) >= self.limit:
            self.clear()
        w, odd = plain(word)
        kind = (self.ODD if odd else 0) | (self.YOU if w in YOU else 0) | (self.UPPER if len(word) > 1 and word.isupper() else 0)
        weight = self.lexicon.get(w, 0.0)
        if weight:
            kind |= self.WORD
        else:
            weight = max((self.lexicon.get(s, 0.0) for s in stems(w)), default=0.0)
            kind |= self.STEM if weight else 0
        if weight and odd:
            kind |= self.HIDDEN
        if len(word) <= 64:
            self[word] = (weight, kind)
        return weight, kind


def features(text: str | None, known: Spelling) -> list[float]:
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    got = [known[w] for w in words]
    hits = [i for i, g in enumerate(got) if g[0]]
    kinds = Counter(g[1] for g in got)
    of = lambda bit: sum(c for k, c in kinds.items() if k & bit)
    you = [i for i, g in enumerate(got) if g[1] & Spelling.YOU]
    near = densest = 0
    if hits:
        h = np.array(hits)
        if you:
            y = np.array([-(10**9), *you, 10**9])
            j = np.searchsorted(y, h)
            near = int((np.minimum(h - y[j - 1], y[j] - h) <= 5).sum())
        densest = int((np.searchsorted(h, h + 50) - np.arange(len(h))).max())
    weights = [got[i][0] for i in hits]
    letters = sum(map(str.isalpha, text)) or 1
    return [
        of(Spelling.WORD) / n, of(Spelling.STEM) / n, math.log1p(len(hits)), math.log1p(len({plain(words[i])[0] for i in hits})), math.log1p(sum(weights)), max(weights, default=0.0), of(Spelling.HIDDEN) / n,
        near / (len(hits) or 1), len(you) / n, sum(map(str.isupper, text)) / letters, of(Spelling.UPPER) / n, sum(1 for i in hits if got[i][1] & Spelling.UPPER) / n, text.count("!") / n, text.count("?") / n,
        sum(text.count(c) for c in ".,;:") / n, of(Spelling.ODD) / n, float(densest), math.log1p(n),
    ]


@dataclass
class ToxicModel:
    lexicon: dict[str, float] = field(default_factory=dict)
    boosted: tuple[float, list[T.Tree]] = (-20.0, [])
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = T.margin(self.boosted, x)
        p = T.sigmoid(z)
        # a trace of the margin keeps the order inside a step
        return np.clip(0.98 * np.interp(z, *self.steps) + 0.02 * p, 0, 1) if self.steps else p


def learn_lexicon(rows: DataFrame, entries: int = 4000, share: float = 0.01) -> dict[str, float]:
    """Words and stems with their log odds; ``rows`` (text, y) is bounded, and so is what is collected.

    An entry is in that share of the toxic texts, and in three to eight of them at least.
    """

    def own(batches):
        pos, neg = Counter(), Counter()
        for b in batches:
            for t, y in zip(strings(b["text"]), b["y"].to_pylist(), strict=True):
                seen = {plain(w)[0] for w in (t or "").split()}
                (pos if y > 0 else neg).update(seen | {s for w in seen for s in stems(w)} | {"\0"})
        keys = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], ["w", "p", "n"])

    total = rows.select("text", "y").mapInArrow(own, "w string, p long, n long").groupBy("w").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    total = total.where("p >= 3 or w = '\\0'").persist()
    kept = total
    try:
        top = total.where("w = '\\0'").first()
        if top is None or not top.p:
            return {}
        total = total.where(F.col("p") >= min(8, max(3, math.ceil(share * top.p))))
        odds = F.log((F.col("p") + 0.5) / (top.p + 1)) - F.log((F.col("n") + 0.5) / (top.n + 1))
        found = total.where("length(w) > 2").select("w", odds.alias("odds")).where("odds > 3").orderBy(F.desc("odds"), "w").limit(entries).collect()
    finally:
        kept.unpersist()
    return {r.w: r.odds for r in found}


def featured(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``rows`` with x, the feature vector of the column text."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)

    def of():
        known = Spelling(sent.value)
        return lambda texts: pa.array([features(t, known) for t in texts], pa.list_(pa.float64()))

    return rows.withColumn("x", scored(of, "array<double>")("text"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 24_000, seed: int = 9, mod: int = 5, rest: int = 0, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    rows = labelled_sample(Workspace(docs.sparkSession), docs, labels, label, sample, seed, mod, rest, id_col, text_col)
    got = []
    for k in (0, 1):
        of_other = learn_lexicon(rows.where(F.col("fold") != k))
        part = rows.where(F.col("fold") == k).select("text", "y", "u")
        got += featured(part, of_other).select("y", "u", "x").orderBy("u", "x").limit(2 * sample).collect()
    lexicon = learn_lexicon(rows)
    got.sort(key=lambda r: (r.u, r.x))
    x = np.array([r.x for r in got], float).reshape(-1, len(FEATURES))
    y, u = np.array([r.y for r in got]), np.array([r.u for r in got])
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        return ToxicModel(boosted=(math.log(p / (1 - p)), []))
    folds = (u * 4).astype(int) % 4
    z = np.zeros(len(y))
    for k in range(4):
        if (folds == k).any() and (folds != k).any():
            z[folds == k] = T.margin(T.boost(x[folds != k], y[folds != k]), x[folds == k])
    return ToxicModel(lexicon, T.boost(x, y), T.isotonic(z, y))


def with_scores(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """doc (all columns) and score."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def of():
        model = sent.value
        known = Spelling(model.lexicon)
        return lambda texts: pa.array(model.scores(np.array([features(t, known) for t in texts], float).reshape(-1, len(FEATURES))))

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    return rows.select("doc", scored(of, "double")(F.col("doc")[text_col]).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, **fit)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = with_scores(slim, model).select("doc.doc_id", "score")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
