"""Each stage against what its operator says of the same input, and small planted cases."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lakewarden.llm import quality, toxicity
from lakewarden.llm.common import Workspace, table
from lakewarden.llm.decontam import decontaminate
from lakewarden.llm.simhash import near_duplicates

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def staged(spark):
    docs, ws, out = table(spark, SF, "documents"), Workspace(spark), []
    for name, stage in P.STAGES:
        out.append((docs, docs := ws.stage(stage(spark, docs, SF), name)))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_follow_their_operators(spark, staged):
    labels = table(spark, SF, "labels")
    (d0, d1), (_, d2), (_, d3), (_, d4), (_, d5) = staged
    assert all(d.columns == d0.columns for d in (d1, d2, d3, d4))
    assert ids(d1) == ids(quality.quality(d0, labels).where("predicted = 1"))
    assert ids(d2) == ids(toxicity.toxicity(d1, labels).where("predicted = 0"))
    near = near_duplicates(d2)
    assert ids(d3) == sorted(r.component_id for r in near.select("component_id").distinct().collect())
    assert ids(d4) == ids(decontaminate(d3, table(spark, SF, "benchmark")).where("not contaminated"))
    assert ids(d5.where("piece = 0")) == ids(d4) and 0 < d4.count() < d3.count() < d2.count() < d1.count() < d0.count()


def test_run(spark, staged):
    got, want = P.run(spark, SF), staged[-1][1]
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_clean_labelled_documents_stay(spark, staged):
    lab = table(spark, SF, "labels")
    clean = staged[0][0].join(lab.where("quality = 1"), "doc_id", "left_semi")
    assert clean.join(staged[0][1], "doc_id", "left_anti").count() <= 0.02 * clean.count()
    fine = staged[1][0].join(lab.where("toxic = 0"), "doc_id", "left_semi")
    assert fine.join(staged[1][1], "doc_id", "left_anti").count() <= 0.02 * fine.count()


def test_odd_rows(spark, odd_docs, no_docs):
    extra = odd_docs.withColumn("first", F.lit(1)).withColumn("component_id", F.lit("c"))
    kept = P.drop_copies(spark, extra, SF)
    assert kept.columns == extra.columns
    got = ids(kept.na.fill(-1, ["doc_id"]))
    assert got.count(3) == 1 and 4 not in got and 1 not in got and 2 not in got and 0 in got and -1 in got
    for _, stage in P.STAGES:
        assert stage(spark, no_docs, SF).collect() == []
        assert stage(spark, extra, SF).count() > 0


def test_copies_and_leaks_are_decided_by_row(spark, tmp_path):
    """Null and repeated ids: each row by its own text."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    rows = [(1, "a"), (1, "b"), (2, "b"), (None, "b"), (None, "c"), (None, "c"), (None, "d"), (3, "e"), (3, "f")]
    docs = spark.createDataFrame([(i, text[k], k, "s") for i, k in rows], "doc_id long, text string, lang string, row_key string")
    of = lambda df: sorted(((r.doc_id, r.lang) for r in df.collect()), key=str)
    kept = P.drop_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert of(kept) == sorted([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (3, "e"), (3, "f")], key=str)
    items = [(0, " ".join(text["d"].split()[5:30])), (1, text["e"])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = P.drop_leaks(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert of(clean) == sorted([(i, k) for i, k in rows if k not in "de"], key=str)
