import random
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakewarden.llm import language as L
from lakewarden.llm import queries as Q
from lakewarden.llm import quality as QU
from lakewarden.llm import toxicity as TX
from lakewarden.llm import trees as T
from lakewarden.llm.common import table

SF = "/root/testdata/sf0.01"


def out(doc_id, mod, rest):
    return crc32(str(doc_id).encode()) % mod == rest


@pytest.mark.parametrize("query,label,sf", [(Q.op3_quality, "quality", SF), (Q.op6_toxicity, "toxic", SF.replace("0.01", "0.1"))])
def test_held_out_accuracy(spark, query, label, sf):
    """sf0.01 has six held-out toxic documents, too few to tell; sf0.1 has some hundred."""
    got = query(spark, sf).toPandas()
    assert len(got) == table(spark, sf, "documents").count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda d: out(d, 5, 0))).all()
    m = got.merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m[label]).mean() > 0.97
    pos, neg = m[m[label] == 1].score, m[m[label] == 0].score
    assert np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos]) > 0.95


@pytest.mark.parametrize("module,fn,label", [(QU, QU.quality, "quality"), (TX, TX.toxicity, "toxic")])
def test_odd_rows_have_scores(spark, odd_docs, no_docs, module, fn, label):
    labels = table(spark, SF, "labels")
    got = fn(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd_docs.collect())
    assert fn(no_docs, labels).collect() == []
    none = spark.createDataFrame([(None, None, None), (1, None, None)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in fn(odd_docs, none).collect()} == {1 if label == "quality" else 0}


def test_held_out_labels_are_never_learned(spark):
    """Labels of held-out rows may say anything."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(h, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = QU.fit_quality(docs, labels), QU.fit_quality(docs, turned)
    assert a.rules == b.rules and np.allclose(a.weights, b.weights)


def test_compiled_rules_equal_the_matrix(spark):
    g = np.random.default_rng(0)
    x = g.random((300, len(QU.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    m = QU.fit_rules(x, y, g.random(300))
    assert 0 < len(m.rules) < 200
    want = T.sigmoid(T.applies(m.rules, x) @ np.array(m.weights) + m.base)
    df = spark.createDataFrame(pd.DataFrame(x, columns=QU.STATISTICS))
    got = np.array([r.p for r in df.select(m.column(F.col).alias("p")).collect()])
    assert np.allclose(got, want, atol=1e-5) and ((got > 0.5) == (y > 0)).mean() > 0.97


def test_windows_reach_the_last_word():
    plain = [f"word{i}" for i in range(50)]
    at = lambda tail: dict(zip(QU.STATISTICS, QU.statistics(" ".join(plain + tail)), strict=True))
    for n in (5, 24, 25, 60, 99):
        assert at(["@@##"] * n)["worst_symbols"] >= min(n, 50) / 50 * 0.4 and at(["JUNK"] * n)["worst_capitals"] == min(n, 50) / 50
    assert at([])["worst_symbols"] == 0 and QU._window(plain[:1]) == (0.0, 0.0, 0.0)


def test_lasso_sees_all_tree_paths(monkeypatch):
    g = np.random.default_rng(0)
    x = g.random((4000, len(QU.STATISTICS)))
    y = (g.random(4000) < 0.3 + 0.4 * (x[:, 0] > x[:, 1])).astype(float)
    seen, applies = [], T.applies
    monkeypatch.setattr(T, "applies", lambda rules, x: seen.append(len(rules)) or applies(rules, x))
    monkeypatch.setattr(T, "lasso_logistic", lambda r, *a, **k: (0.0, np.zeros(r.shape[1])))
    QU.fit_rules(x, y, g.random(4000))
    assert seen == [len(T.rules_of(T.boost(x, y, 40, 3)[1]))] and seen[0] > 500


def test_trees_and_isotonic():
    g = np.random.default_rng(1)
    x = g.random((2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0.6)).astype(float)
    assert ((T.margin(T.boost(x, y), x) > 0) == (y > 0)).mean() > 0.98
    centres, values = T.isotonic(x[:, 2], x[:, 2] + g.normal(0, 0.1, 2000))
    assert (np.diff(values) > 0).all() and (np.diff(centres) > 0).all()
    assert all(np.all(np.diff(v) >= 0) for v in (T.isotonic(np.ones(5), np.arange(5.0))[1],))


def test_spellings():
    assert TX.plain("Id1ot!") == ("idiot", True) and TX.plain("(trash)") == ("trash", False) and TX.plain("2024") == ("2024", False)
    known = TX.Spelling({"idiot": 5.0, "lowe*": 4.0})
    f = dict(zip(TX.FEATURES, TX.features("You are an 1d1ot and loweifoo", known), strict=True))
    assert f["word_density"] == 1 / 6 and f["stem_density"] == 1 / 6 and f["hidden_density"] == 1 / 6 and f["near_you"] == 1.0
    assert TX.features(None, known) == TX.features("", known) == [0.0] * len(TX.FEATURES)


def test_languages(spark):
    got = Q.op8_language(spark, SF).toPandas()
    docs = table(spark, SF, "documents").toPandas()
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda d: out(d, 4, 2))).all()
    m = got.merge(docs[["doc_id", "lang"]], on="doc_id")
    assert (m.lang_pred == m.lang)[m.held_out].mean() > 0.97


def test_posteriors_equal_enumeration():
    import itertools

    g = np.random.default_rng(2)
    model = L.Crf(["a", "b", "c"], {}, np.zeros((1, 3), np.float32), g.normal(size=(3, 3)), g.normal(size=3))
    emit = np.exp(g.normal(size=(7, 3))).astype(np.float32)
    docs = [[0, 1, 2, 3], [4], [5, 6, 5]]
    got = L.posteriors_by_word(model, emit, np.concatenate(docs), np.array([4, 1, 3]))
    for block in (1, 2, 3, 32):
        assert np.allclose(got, L.posteriors(model, emit, np.concatenate(docs), np.array([4, 1, 3]), block), atol=1e-5)
    for d, p in zip(docs, got, strict=True):
        want = np.zeros(3)
        total = 0
        for y in itertools.product(range(3), repeat=len(d)):
            w = np.exp(model.start[y[0]]) * np.prod([emit[x, k] for x, k in zip(d, y, strict=True)]) * np.prod([np.exp(model.moves[a, b]) for a, b in itertools.pairwise(y)])
            total += w
            want += w * np.bincount(y, minlength=3) / len(d)
        assert np.allclose(p, want / total, atol=1e-5)


def test_switching_text(spark):
    g = random.Random(1)
    word = {"x": lambda: "".join(g.choice("abc") for _ in range(5)), "y": lambda: "".join(g.choice("def") for _ in range(5))}
    model = L.train([([word[k]() for _ in range(30)], k) for k in "xy" for _ in range(60)], ["x", "y"])
    assert model.moves[0, 0] > model.moves[0, 1] and model.moves[1, 1] > model.moves[1, 0]
    texts = [" ".join(word["x"]() for _ in range(30)) + " " + " ".join(word["y"]() for _ in range(10)), "", None, "123 !?", word["y"](), " ".join(word["y"]() for _ in range(30_000))]
    df = spark.createDataFrame([(i, t, "z", "q") for i, t in enumerate(texts)] + [(None, word["x"](), None, None), (0, texts[0], None, None)], "doc_id long, text string, lang string, shares string")
    got = L.identify(df, model).orderBy("doc_id").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == df.count()
    assert [by[i].lang_pred for i in range(6)] == ["x", "und", "und", "und", "y", "y"] and by[None].lang_pred == "x"
    assert 0.65 < by[0].score < 0.85 and abs(by[0].shares["y"] - 0.25) < 0.1 and by[1].score == 0
    assert L.identify(df.limit(0), model).collect() == []
    nothing = L.learn(df.limit(0))
    assert {r.lang_pred for r in L.identify(df, nothing).collect()} == {"und"}


def test_long_runs_count_whole(spark):
    """Words without an end: the language of a run shows only after its fortieth letter."""
    g = random.Random(4)
    word = {"x": lambda n: "".join(g.choice("abc") for _ in range(n)), "y": lambda n: "".join(g.choice("def") for _ in range(n))}
    model = L.train([([word[k](5) for _ in range(30)], k) for k in "xy" for _ in range(60)], ["x", "y"])
    texts = [word[a](40) + word[b](n) for a, b, n in (("x", "y", 400), ("y", "x", 400), ("x", "y", 1_500_000))]
    got = L.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["y", "x", "y"]
    late = L.train([(["a" * 40 + word[k](60) for _ in range(30)], k) for k in "xy" for _ in range(60)], ["x", "y"])
    assert [late.emissions(["a" * 40 + word[k](60)]).argmax() for k in "xy"] == [0, 1]


def test_features_are_the_same_in_parts():
    found = ["a", "", "of", "日本語" * 50, "word" * 30, "end"]
    of = lambda most: Counter((int(r), int(w)) for rows, owner in L.features(found, {"of": [1]}, most) for r, w in zip(rows, owner, strict=True))
    assert of(1) == of(7) == of(40) == of(L.LETTERS) and sum(of(7).values()) > 2 * sum(map(len, found))
