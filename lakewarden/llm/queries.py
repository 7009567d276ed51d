"""The thin queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .decontam import decontaminate
from .embeddings import near_vectors
from .language import identify, learn
from .medians import rolling_medians
from .packing import pack
from .prefix_trie import borrowed_heads, prefix_trie, turns
from .quality import quality
from .sharding import interleave
from .simhash import near_duplicates
from .tokens import count_tokens
from .toxicity import toxicity
from .urls import judge
from .windows import pack_online

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), byte_bpe(), limit=1024)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), byte_bpe(), size=2048, end_id=0)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), radius=4, width=4, seed=42)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_online(table(spark, sf_dir, "documents"), word_bpe(), size=2048, end_id=1)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(borrowed_heads(turns(table(spark, sf_dir, "conversations")), family=20, most=4))


def op13_rolling_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_medians(table(spark, sf_dir, "clicks"), minutes=60)


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) t(h, q, v))
SELECT page_id, host, path,
  (SELECT arg_max(h || q, length(h || q)) FROM r WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, q)) AS rule,
  coalesce((SELECT arg_max(v, length(h || q)) FROM r WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, q)), 'allow') AS verdict
FROM p
"""

OP12_SQL = r"""
WITH o AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
c AS (
  SELECT conv_id, ts, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, c: list_reduce(list_prepend(xor(a, c), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 AS h FROM o),
b AS (SELECT c.conv_id, list_concat(coalesce(list_slice(o.ts, 1, h), []), list_slice(c.ts, h + 1, len(c.ts))) AS s FROM c LEFT JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, u.d, list_slice(s, 1, u.d) AS k, len(s) AS n FROM b, unnest(range(0, len(s) + 1)) AS u(d)),
nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(k[d].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM p GROUP BY k, d),
kids AS (SELECT list_slice(k, 1, d - 1) AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.k = nodes.k),
up AS (SELECT list_slice(k, 1, u.j) AS k, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM full_nodes, unnest(range(0, d + 1)) AS u(j) GROUP BY 1)
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, up.n_leaves, CAST(up.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM full_nodes x JOIN up ON up.k = x.k LEFT JOIN nodes y ON x.d > 0 AND y.k = list_slice(x.k, 1, x.d - 1)
"""

OP13_SQL = r"""
WITH r AS (
  SELECT click_id, ts, kind, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents,
    row_number() OVER (PARTITION BY click_id ORDER BY ts NULLS LAST, kind NULLS FIRST, floor(value * 100 + 0.5) NULLS FIRST) AS k
  FROM clicks),
w AS (
  SELECT click_id, kind, cents, list_sort(coalesce(list(cents) FILTER (cents IS NOT NULL) OVER (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING AND CURRENT ROW), [])) AS s
  FROM r WHERE k = 1 AND ts IS NOT NULL),
m AS (SELECT *, CAST(len(s) AS BIGINT) AS n, CASE WHEN len(s) > 1 THEN s[(len(s) + 1) // 2] + s[len(s) // 2 + 1] END AS median2 FROM w),
d AS (SELECT *, list_sort(list_transform(s, lambda x: abs(2 * x - median2))) AS a FROM m),
f AS (SELECT *, CASE WHEN n > 1 THEN a[(n + 1) // 2] + a[n // 2 + 1] END AS mad4 FROM d)
SELECT click_id, kind, n, median2, mad4, 2 * abs(2 * cents - median2) > 3 * mad4 AS far FROM f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filters": OP7_SQL, "op12_prefix_trie": OP12_SQL, "op13_rolling_medians": OP13_SQL}
