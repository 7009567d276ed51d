from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import pytest

from lakewarden.llm import queries as Q
from lakewarden.llm.common import Workspace, table
from lakewarden.llm.sharding import interleave
from lakewarden.llm.urls import cascade, judge, member


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), h, h + p, v) for h, p, v in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    best = max(fits, default=(0, "", None, "allow"))
    return host, path, best[2], best[3]


def test_urls_equal_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = c.sql(Q.OP7_SQL)
    assert Counter(map(tuple, Q.op7_url_filters(spark, sf).select(want.columns).collect())) == Counter(want.fetchall())


URLS = [None, "", "no scheme", "://", "http://ORG", "http://org/", "HTTP://A.B.Org/x?y#z", "https://example.org/es/1", "https://x.example.org/en/1", "https://example.org/en/12/3", "https://example.org/en/2", "http://notorg/", "http://a.com/fr/", "http://com/de/x", "http://com/frx", "http://u:p@a.com:80/fr/", "a://b://c.org/", "http://a..org/", "http://.org/", "http://org?/", "http://exämple.ORG/é", "http://x.org\n/y", "http://org/#/es/"]


@pytest.mark.parametrize("rules", [Q.URL_RULES, [], [("a.com", "", "block"), ("com", "/fr/", "allow"), ("org", "/x", "block")]])
def test_urls_equal_brute_force(spark, rules):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(None, "http://org/", "c"), (5, "http://org/", "c")], "page_id long, url string, keys string")
    got = Counter(map(tuple, judge(df, rules).collect()))
    assert got == Counter((r.page_id, *brute(r.url, rules)) for r in df.collect())
    assert judge(df.limit(0), rules).collect() == []


def test_cascade_is_exact_over_its_universe(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20_000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit("~")).alias("h2"), "id")
    listed = keys.where("id % 50 = 0").select("h1", "h2")
    levels = cascade(listed, keys.select("h1", "h2"), Workspace(spark), 1 << 20)
    pdf = keys.toPandas()
    assert len(levels) > 1
    assert (member(levels, pdf.h1.to_numpy(), pdf.h2.to_numpy()) == (pdf.id % 50 == 0)).all()
    with pytest.raises(ValueError):
        cascade(listed, keys.select("h1", "h2"), Workspace(spark), 10)


def check_shards(rows, docs, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, crc32((t or "").encode())) for d, t in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and (not rows or max(sizes) - min(sizes) <= 1)


def test_shards(spark, sf, odd_docs, no_docs):
    docs = table(spark, sf, "documents")
    rows = Q.op9_sharding(spark, sf).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 8)
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert sorted(map(tuple, Q.op9_sharding(spark, sf).drop("grown_shard").collect())) == sorted(tuple(r)[:-1] for r in rows)
    check_shards(interleave(odd_docs, 3).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], 3)
    assert interleave(no_docs).collect() == []


def test_shards_match_the_mixture(spark):
    from pyspark.sql import functions as F

    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") < 2000, "big").when(F.col("id") < 2900, "mid").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("source"))
    got = interleave(d, 8).join(d, "doc_id").groupBy("shard", "source").count().collect()
    for name, n in (("big", 2000), ("mid", 900)):
        counts = [r["count"] for r in got if r.source == name]
        assert len(counts) == 8 and max(abs(c - n / 8) for c in counts) <= 12
