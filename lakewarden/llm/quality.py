"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of whole texts (repetition, symbols, capitals, lines) are computed in one scan. On a bounded
sample of labelled rows (``sample``, about that many) boosted trees are grown; each path from a root to a
node is a conjunctive rule; a lasso logistic regression over the rules keeps few of them. The kept rules
are compiled into one Spark column expression over the statistics.

Defined results: null and empty texts have all statistics zero and are scored like others; a null id is
never held out of the score and never learned from; every row gives a row; without labelled rows of both
kinds the score is the share of label 1 (1.0 without any); an empty table gives no rows; columns other
than id and text are passed through by ``with_scores`` and never read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees as T
from .common import Workspace, held_out, scored, ship
from .labelled import labelled_sample

STATISTICS = (
    "log_words", "word_length", "distinct_words", "top_word", "repeated_next", "distinct_pairs", "longest_run", "capitals", "capital_words", "digits", "symbols", "exclaims", "pipes",
    "marks", "stops", "lines", "repeated_lines", "line_length", "short_lines", "long_words", "letters", "ends_alike", "worst_symbols", "worst_repeats", "worst_capitals",
)
_ORDINARY = bytes(c for c in range(256) if chr(c).isalnum() and c < 128 or c in b" \n\t\r.,;:'\"-()?!" or c >= 128)
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = re.compile(rb"[#*%&$@^~<>{}\[\]\\|=+_]")


def _window(words: list[str]) -> tuple[float, float, float]:
    n = len(words)
    text = "".join(words)
    return (
        sum(not c.isalnum() for c in text) / max(1, len(text)),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(w.isupper() for w in words) / n,
    )


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; shares are of words, bytes or lines."""
    if not text or not (words := text.split()):
        return [0.0] * len(STATISTICS)
    raw = text.encode()
    n, size = len(words), len(raw)
    c = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    run = best = 1
    repeated = 0
    for a, b in zip(words, words[1:], strict=False):
        if a == b:
            repeated += 1
            run += 1
            best = max(best, run)
        else:
            run = 1
    letters = sum(map(len, words))
    upper = size - len(raw.translate(None, _UPPER))
    windows = np.array([_window(words[i : i + 50]) for i in {*range(0, n - 49, 50), max(0, n - 50)}])  # the last ends at the last word
    alike = Counter(w[-2:] for w in words).most_common(1)[0][1]
    return [
        float(np.log1p(n)), letters / n, len(c) / n, c.most_common(1)[0][1] / n, repeated / n, len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), best / n,
        upper / size, sum(map(str.isupper, words)) / n, (size - len(raw.translate(None, _DIGIT))) / size, len(raw.translate(None, _ORDINARY)) / size, raw.count(b"!") / n, raw.count(b"|") / n,
        len(_MARKS.findall(raw)) / n, (raw.count(b".") + raw.count(b"?")) / n, len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(letters / max(1, len(lines)))),
        sum(len(x) < 30 for x in lines) / max(1, len(lines)), sum(len(w) > 20 for w in words) / n, letters / max(1, len(text)), alike / n, *windows.max(axis=0).tolist(),
    ]


@dataclass
class RuleModel:
    """score = sigmoid(base + sum of the weights of the rules that apply)."""

    base: float
    rules: list[T.Rule]
    weights: list[float]
    names: tuple[str, ...] = STATISTICS

    def column(self, of) -> Column:
        """The compiled expression; ``of(name)`` gives a statistic's column."""
        z = F.lit(self.base)
        for rule, w in zip(self.rules, self.weights, strict=True):
            cond = None
            for f, le, c in rule:
                one = (of(self.names[f]) <= F.lit(c)) if le else (of(self.names[f]) > F.lit(c))
                cond = one if cond is None else cond & one
            z = z + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray, u: np.ndarray, rounds: int = 40, depth: int = 3) -> RuleModel:
    """Trees on all rows; the lasso's penalty is the best of a few on rows it didn't see."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6))
        return RuleModel(float(np.log(p / (1 - p))), [], [])
    rules = T.rules_of(T.boost(x, y, rounds, depth)[1])
    r = T.applies(rules, x)
    fit = u < 0.75
    best = (np.inf, 1e-3)
    start = None
    for penalty in (1e-2, 3e-3, 1e-3, 3e-4):
        start = T.lasso_logistic(r[fit], y[fit], penalty, start=start)
        q = np.clip(T.sigmoid(r[~fit] @ start[1] + start[0]), 1e-6, 1 - 1e-6)
        if len(q):
            best = min(best, (float(-np.mean(y[~fit] * np.log(q) + (1 - y[~fit]) * np.log(1 - q))), penalty))
    b, w = T.lasso_logistic(r, y, best[1], start=start)
    kept = np.flatnonzero(w)
    return RuleModel(b, [rules[i] for i in kept], [float(w[i]) for i in kept])


def _statistics(texts: list[str | None]) -> pa.Array:
    cols = list(zip(*map(statistics, texts), strict=True)) or [()] * len(STATISTICS)
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in cols], names=list(STATISTICS))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc (all columns as one struct, so that names can't clash) and s (the statistics)."""
    ship(docs.sparkSession)
    of = scored(lambda: _statistics, "struct<" + ",".join(f"{n}:double" for n in STATISTICS) + ">")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    return rows.select("doc", of(F.col("doc")[text_col]).alias("s"))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 12_000, seed: int = 5, mod: int = 5, rest: int = 0, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    rows = labelled_sample(Workspace(docs.sparkSession), docs, labels, label, sample, seed, mod, rest, id_col, text_col)
    s = with_statistics(rows).select("s.*", "doc.y", "doc.u").orderBy("u", *STATISTICS).limit(2 * sample).toPandas()  # the same model whatever the order of arrival
    return fit_rules(s[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), s["y"].to_numpy(float), s["u"].to_numpy(float))


def with_scores(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """doc (all columns) and score."""
    return with_statistics(docs, text_col).select("doc", model.column(lambda n: F.col("s")[n]).alias("score"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col, **fit)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = with_scores(slim, model).select("doc.doc_id", "score")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
