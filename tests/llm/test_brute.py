"""Operators beyond SQL against plain versions of themselves, and odd rows that they share."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lakewarden.llm import language as L
from lakewarden.llm import queries as Q
from lakewarden.llm import quality as QU
from lakewarden.llm import toxicity as TX
from lakewarden.llm.common import Workspace, components, table
from lakewarden.llm.decontam import decontaminate
from lakewarden.llm.embeddings import near_vectors
from lakewarden.llm.labelled import labelled_sample
from lakewarden.llm.packing import pack
from lakewarden.llm.sharding import interleave
from lakewarden.llm.simhash import near_duplicates
from lakewarden.llm.tokens import count_tokens

SF = "/root/testdata/sf0.001"


def plain_statistics(text):
    w = (text or "").split()
    if not w:
        return dict.fromkeys(QU.STATISTICS, 0.0)
    raw, n = text.encode(), len(w)
    pairs = [(w[i], w[i + 1]) for i in range(n - 1)]
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(len(x) for x in w)
    windows = [w[i : i + 50] for i in sorted({*range(0, n - 49, 50), max(0, n - 50)})]
    ordinary = set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\t\r.,;:'\"-()?!")
    run = max(len(list(g)) for _, g in itertools.groupby(w))
    return {
        "log_words": math.log(1 + n), "word_length": letters / n, "distinct_words": len(set(w)) / n, "top_word": max(w.count(x) for x in set(w)) / n, "repeated_next": sum(a == b for a, b in pairs) / n,
        "distinct_pairs": len(set(pairs)) / max(1, n - 1), "longest_run": run / n, "capitals": sum(65 <= b <= 90 for b in raw) / len(raw), "capital_words": sum(x.isupper() for x in w) / n, "digits": sum(48 <= b <= 57 for b in raw) / len(raw),
        "symbols": sum(b < 128 and b not in ordinary for b in raw) / len(raw), "exclaims": text.count("!") / n, "pipes": text.count("|") / n, "marks": sum(text.count(c) for c in "#*%&$@^~<>{}[]\\|=+_") / n, "stops": (text.count(".") + text.count("?")) / n,
        "lines": len(lines) / n, "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)), "line_length": math.log(1 + letters / max(1, len(lines))), "short_lines": sum(len(x) < 30 for x in lines) / max(1, len(lines)), "long_words": sum(len(x) > 20 for x in w) / n,
        "letters": letters / len(text), "ends_alike": max(Counter(x[-2:] for x in w).values()) / n, "worst_symbols": max(sum(not c.isalnum() for x in v for c in x) / sum(map(len, v)) for v in windows),
        "worst_repeats": max(sum(a == b for a, b in zip(v, v[1:], strict=False)) / len(v) for v in windows), "worst_capitals": max(sum(x.isupper() for x in v) / len(v) for v in windows),
    }


def test_quality_scores_equal_a_plain_version(spark):
    docs = table(spark, SF, "documents")
    model = QU.fit_quality(docs, table(spark, SF, "labels"))
    assert model.rules
    want = {}
    for r in docs.collect():
        s = plain_statistics(r.text)
        z = model.base + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all((s[QU.STATISTICS[f]] <= c) if le else (s[QU.STATISTICS[f]] > c) for f, le, c in rule))
        want[r.doc_id] = 1 / (1 + math.exp(-z))
        assert np.allclose([s[k] for k in QU.STATISTICS], QU.statistics(r.text))
    got = {r.id: r.score for r in QU.with_scores(docs, model).select(F.col("doc.doc_id").alias("id"), "score").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def plain_features(text, lexicon):
    w = (text or "").split()
    if not w:
        return dict.fromkeys(TX.FEATURES, 0.0)
    n, letters = len(w), sum(c.isalpha() for c in text) or 1
    spelled = [TX.plain(x) for x in w]

    def weight(x):
        return lexicon.get(x, 0.0) or max((lexicon.get(f"{x[:k]}*", 0.0) for k in (4, 5, 6) if len(x) > k), default=0.0)

    hits = [i for i, (x, _) in enumerate(spelled) if weight(x)]
    you = [i for i, (x, _) in enumerate(spelled) if x in TX.YOU]
    weights = [weight(spelled[i][0]) for i in hits]
    upper = lambda i: len(w[i]) > 1 and w[i].isupper()
    return {
        "word_density": sum(spelled[i][0] in lexicon for i in hits) / n, "stem_density": sum(spelled[i][0] not in lexicon for i in hits) / n, "hits": math.log(1 + len(hits)), "distinct_hits": math.log(1 + len({spelled[i][0] for i in hits})),
        "weight": math.log(1 + sum(weights)), "strongest": max(weights, default=0.0), "hidden_density": sum(spelled[i][1] for i in hits) / n, "near_you": sum(any(abs(i - j) <= 5 for j in you) for i in hits) / (len(hits) or 1), "you": len(you) / n,
        "capitals": sum(c.isupper() for c in text) / letters, "capital_words": sum(map(upper, range(n))) / n, "capital_hits": sum(map(upper, hits)) / n, "exclaims": text.count("!") / n, "questions": text.count("?") / n,
        "punctuation": sum(c in ".,;:" for c in text) / n, "odd_spellings": sum(o for _, o in spelled) / n, "densest": float(max((sum(i <= j < i + 50 for j in hits) for i in hits), default=0)), "log_words": math.log(1 + n),
    }


def test_toxicity_features_and_scores_equal_a_plain_version(spark):
    docs = table(spark, SF, "documents")
    model = TX.fit_toxicity(docs, table(spark, SF, "labels"))
    lexicon = model.lexicon or {"the": 2.0, "some*": 3.0}
    known, rows = TX.Spelling(lexicon, limit=50), docs.collect()
    for r in rows:
        f = plain_features(r.text, lexicon)
        assert np.allclose([f[k] for k in TX.FEATURES], TX.features(r.text, known))
    got = {r.id: r.score for r in TX.with_scores(docs, model).select(F.col("doc.doc_id").alias("id"), "score").collect()}
    want = dict(zip([r.doc_id for r in rows], model.scores(np.array([[plain_features(r.text, model.lexicon)[k] for k in TX.FEATURES] for r in rows])), strict=True))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def plain_emission(word, model):
    def rows():
        text = f"<{word}>"
        for k in (2, 3):
            yield from ((text[i : i + k], k) for i in range(len(text) - k + 1))
        for k in (1, 2, 3, 4):
            if len(word) >= k:
                yield word[:k], 10 + k
                yield word[-k:], 20 + k

    out = np.zeros(len(model.langs))
    for gram, tag in rows():
        h = tag
        for c in gram:
            h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
            h ^= h >> 29
        out += model.weights[h % L.BUCKETS]
    for k in model.lexicon.get(word, ()):
        out += model.weights[L.BUCKETS + k]
    return out


def plain_language(text, model):
    w = [x for x in re.findall(r"[^\W\d_]+", (text or "").lower()) if any(c.isalpha() for c in x)]
    if not w:
        return "und", 0.0
    e = [np.exp(np.maximum((x := plain_emission(t, model)) - x.max(), -30)) for t in w]
    m = np.exp(model.moves)
    alpha, beta = [np.exp(model.start) * e[0]], [np.ones(len(model.langs))]
    for x in e[1:]:
        alpha.append((alpha[-1] / alpha[-1].sum()) @ m * x)
    for x in reversed(e[1:]):
        b = m @ (x * beta[-1])
        beta.append(b / b.sum())
    p = np.array([a * b / (a * b).sum() for a, b in zip(alpha, reversed(beta), strict=True)]).mean(axis=0)
    return model.langs[int(p.argmax())], float(p.max())


def test_languages_equal_a_plain_version(spark):
    docs = table(spark, SF, "documents")
    model = L.learn(docs, per_lang=20)
    extra = spark.createDataFrame([(9001, "½ ² Ⅷ ³"), (9002, "日本語 の 文章 the"), (9003, None), (9004, "½a Été 3"), (9005, "_ 12 !")], "doc_id long, text string")
    some = docs.select("doc_id", "text").where("length(text) < 3000").union(extra)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(some, model).collect()}
    for r in some.collect():
        lang, score = plain_language(r.text, model)
        assert abs(got[r.doc_id][1] - score) < 1e-4 and (got[r.doc_id][0] == lang or score < 0.6)
    assert [got[i][0] for i in (9001, 9003, 9005)] == ["und"] * 3


def test_no_language_is_too_rare_to_learn(spark):
    rows = [(i, f"{chr(0x4E00 + i % 210) * 3} {chr(0x4E00 + i % 210) * 2}", f"l{i % 210}") for i in range(1260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(docs, per_lang=6)
    assert len(model.langs) == 210
    got = L.identify(docs.limit(210), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() > 200


def test_shards_follow_the_fractional_ranks(spark):
    g = random.Random(5)
    rows = [(i, "t" * g.randint(0, 9), g.choice(["a", "a", "a", "b", None])) for i in range(2000)] + [(None, "same", "a")] * 40 + [(7, "same", "a")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = interleave(docs.coalesce(1), 7, seed=3)
    ids = docs.where("doc_id is not null and doc_id <> 7")
    # ranks by the seeded hash within a source, then by fractional rank over all
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    text = F.col("text").cast("binary")
    stratum = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source"))
    keyed = docs.coalesce(1).select("doc_id", stratum.alias("s"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("c"), own.alias("own"))
    keyed = keyed.withColumn("h", F.xxhash64(F.lit(3), "own", "c", "size")).withColumn("shift", F.shiftrightunsigned(F.xxhash64(F.lit(4), "s"), 11) / F.lit(float(1 << 53))).collect()
    unsigned = lambda h: h % 2**64
    placed = []
    for s in {r.s for r in keyed}:
        own = sorted((r for r in keyed if r.s == s), key=lambda r: (unsigned(r.h) >> 54, r.h, -1 if r.doc_id is None else r.doc_id, r.size))
        placed += [((k + r.shift) / len(own), r.h, r.doc_id, r.size) for k, r in enumerate(own)]
    placed.sort(key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2], x[3]))
    n, want = len(placed), {}
    for at, (_, _, doc_id, _) in enumerate(placed):
        shard = at * 7 // n
        want.setdefault(doc_id, []).append((shard, at - -(-shard * n // 7)))
    have = {}
    for r in got.collect():
        have.setdefault(r.doc_id, []).append((r.shard, r.slot))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()} and ids.count() == 1999


def test_labels_that_contradict_and_ids_of_text(spark):
    docs = spark.createDataFrame([(str(i), f"text {i}") for i in range(200)], "doc_id string, text string")
    labels = spark.createDataFrame([(str(i), i % 2) for i in range(200)] + [("3", 0), ("4", 0), (None, 1)], "doc_id string, toxic int")
    got = labelled_sample(Workspace(spark), docs, labels, "toxic", 1000, 1, 5, 0, "doc_id", "text").collect()
    texts = {r.text: r.y for r in got}
    assert "text 3" not in texts and texts["text 4"] == 0 and 120 < len(texts) < 200
    assert len(QU.quality(docs, labels.withColumnRenamed("toxic", "quality")).collect()) == 200


def test_bytes_that_are_no_text(spark):
    bad = spark.createDataFrame([(1, "66756E20FF20C328206F6B20776F726473"), (2, "6F6B20776F726473"), (3, "EDA080")], "doc_id long, x string").select("doc_id", F.unhex("x").cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    labels = table(spark, SF, "labels")
    items = spark.createDataFrame([(1, "ok words")], "item_id long, text string")
    assert QU.quality(bad, labels).count() == TX.toxicity(bad, labels).count() == near_duplicates(bad).count() == pack(bad, Q.byte_bpe()).count() == interleave(bad).count() == 3
    assert {r.doc_id: r.n_bytes for r in count_tokens(bad, Q.byte_bpe()).collect()} == {1: 17, 2: 8, 3: 3}
    assert {r.doc_id: r.contaminated for r in decontaminate(bad, items).collect()} == {1: True, 2: True, 3: False}
    model = L.train([(["ok", "words"], "en"), (["mots", "bons"], "fr")] * 10, ["en", "fr"])
    assert {r.doc_id: r.lang_pred for r in L.identify(bad, model).collect()}[2] == "en"


def test_vectors_in_double_precision(spark):
    rows = [(1, [1e300, 1e299]), (2, [2e300, 2e299]), (3, [1.0, -1.0]), (4, [0.0, 0.0])]
    got = near_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_benchmark_in_many_blocks(spark):
    g = random.Random(8)
    text = lambda n: " ".join(g.choice("abcdefg") for _ in range(n))
    docs = spark.createDataFrame([(i, text(g.randint(0, 60))) for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(i, text(g.randint(0, 9))) for i in range(25)], "item_id long, text string").coalesce(1)
    one, many = (sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate(docs, items, width=3, block_words=b).collect())) for b in (10**6, 7))
    assert one == many and any(r[2] for r in one)


def test_a_hub_and_a_chain(spark):
    hub = spark.range(1, 200_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(300_000, 300_400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(Workspace(spark), hub.union(chain)).groupBy("root").count().collect()
    assert {r.root: r["count"] for r in got} == {0: 199_999, 300_000: 400}


def test_stages_keep_dotted_and_nested_columns(spark):
    rows = [(i, f"clean words number {i} " + " ".join(f"w{i}x{k}" for k in range(40)), {"k": str(i)}, i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,string>, `a.b` int")
    for stage in (P.keep_good, P.drop_toxic, P.drop_copies, P.drop_leaks):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65])
def test_token_planes(n):
    from lakewarden.llm.tokens import packed, unpacked

    x = np.random.default_rng(n).integers(0, 1 << 30, n).astype(np.uint32)
    assert (unpacked(packed([x]), n) == x).all()
