"""Queries over histories: deliveries with their retries, files through renames, times of secrets.

A client's changes are the history of its file: an insertion adds it, an update moves it from the path of the number before to its own, a
deletion removes it; ``change_id`` is the commit's place. Late, repeated and missing numbers are in the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import file_lives as L
from ..streaming.delivery_queue import replayed
from .base import table


def delivery_outcomes(spark, sf):
    """Clicks as deliveries to their clients; how many attempts fail depends on the value."""
    fails = F.pmod(F.floor(F.abs("value")).cast("long"), F.lit(5).cast("long"))
    return replayed(table(spark, sf, "clicks").select(F.col("client_id").alias("target"), F.col("click_id").alias("delivery"), "ts", fails.alias("fails")))


def _moves(spark, sf):
    c = table(spark, sf, "client_changes").where("change_id is not null and client_id is not null and seq is not null and op is not null")
    c = c.groupBy("change_id").agg(F.min(F.struct("client_id", "seq", "op", "segment", "balance", "valid_at")).alias("r")).select(F.col("change_id").alias("n"), "r.*")
    path = lambda k: F.concat(F.col("client_id").cast("string"), F.lit("/"), (F.col("seq") - k).cast("string"))
    return c.withColumn("own", path(0)).withColumn("prior", path(1))


def _changes(m):
    kind = F.when(F.col("op") == "I", "A").when(F.col("op") == "D", "D").otherwise("R")
    return m.select("n", kind.alias("change"), F.when(F.col("op") == "D", F.col("prior")).otherwise(F.col("own")).alias("path"), F.when(kind == "R", F.col("prior")).alias("old_path"))


def file_lives(spark, sf):
    """Each stay of a client's file on a path, with where it began and its moves so far."""
    return L.file_lives(_changes(_moves(spark, sf)))


def secret_times(spark, sf):
    """A client's segments as secrets: insertions and updates add them, updates and deletions remove them from the path before, a debt leaves them out."""
    m = _moves(spark, sf)
    secret = F.concat(F.col("client_id").cast("string"), F.lit(":"), "segment").alias("fingerprint")
    out = m.where("op <> 'I'").select(secret, F.col("prior").alias("path"), "n", "valid_at", F.lit(False).alias("added"))
    into = m.where("op <> 'D' and balance >= 0").select(secret, F.col("own").alias("path"), "n", "valid_at", F.lit(True).alias("added"))
    seen = out.union(into).select("fingerprint", "path", "n", F.col("n").cast("string").alias("commit"), F.col("valid_at").alias("ts"), "added")
    return L.secret_intervals(seen, _changes(m)).select("fingerprint", "from_n", "from_commit", "to_n", "to_commit")


QUERIES = {f.__name__: f for f in (delivery_outcomes, file_lives, secret_times)}

_HISTORY = """
WITH RECURSIVE c AS (SELECT change_id AS n, client_id || '/' || seq AS own, client_id || '/' || (seq - 1) AS prior, op, client_id || ':' || segment AS secret, segment, balance FROM client_changes
    WHERE change_id IS NOT NULL AND client_id IS NOT NULL AND seq IS NOT NULL AND op IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY client_id, seq, op, segment NULLS FIRST, balance NULLS FIRST, valid_at NULLS FIRST) = 1),
seg AS (SELECT own AS path, n, max(CASE WHEN op <> 'I' THEN prior END) AS old FROM c WHERE op <> 'D' GROUP BY ALL),
marks AS (SELECT prior AS path, n * 4 + 1 AS o, -1 AS v FROM c WHERE op <> 'I' UNION SELECT own, n * 4 + 2, n FROM c WHERE op <> 'D'),
linked AS (SELECT s.path, s.n, s.old, nullif(m.v, -1) AS old_n FROM (SELECT *, n * 4 AS o FROM seg) s ASOF LEFT JOIN marks m ON s.old = m.path AND s.o > m.o),
lives(path, n, first_path, first_n, moves) AS (SELECT path, n, path, n, 0::BIGINT FROM linked WHERE old_n IS NULL
    UNION ALL SELECT s.path, s.n, l.first_path, l.first_n, l.moves + 1 FROM lives l JOIN linked s ON s.old = l.path AND s.old_n = l.n)
"""
SQL = {
    "delivery_outcomes": """WITH d AS (SELECT click_id, client_id, epoch_us(ts) AS us, coalesce(floor(abs(value))::BIGINT % 5, 0) AS fails FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts, client_id, coalesce(floor(abs(value))::BIGINT % 5, 0)) = 1),
w AS (SELECT *, lead(us) OVER (PARTITION BY client_id ORDER BY us, click_id) - us AS wait FROM d),
a AS (SELECT *, CASE WHEN wait = 0 THEN 0 ELSE 1 + (fails >= 1 AND coalesce(wait > 600000000, true))::INT + (fails >= 2 AND coalesce(wait > 1800000000, true))::INT END::INT AS attempts FROM w)
SELECT client_id AS target, click_id AS delivery, CASE WHEN attempts > fails THEN 'DONE' WHEN attempts = 3 THEN 'DEAD' ELSE 'OBSOLETE' END AS status, attempts FROM a""",
    "file_lives": f"{_HISTORY} SELECT * FROM lives",
    "secret_times": f"""{_HISTORY}, seen AS (SELECT secret AS f, prior AS path, n, n * 4 AS o, false AS added FROM c WHERE op <> 'I' AND segment IS NOT NULL
    UNION ALL SELECT secret, own, n, n * 4 + 3, true FROM c WHERE op <> 'D' AND balance >= 0 AND segment IS NOT NULL),
placed AS (SELECT s.f, s.path, s.n, s.added, nullif(m.v, -1) AS v FROM seen s ASOF LEFT JOIN marks m ON s.path = m.path AND s.o > m.o),
state AS (SELECT p.f, coalesce(l.first_path, p.path) AS file, coalesce(l.first_n, -1) AS file_n, p.n, max(p.added) AS has FROM placed p LEFT JOIN lives l ON l.path = p.path AND l.n = p.v GROUP BY ALL),
turn AS (SELECT *, coalesce(lag(has) OVER (PARTITION BY f, file, file_n ORDER BY n), false) AS had FROM state),
step AS (SELECT f, n, sum(has::INT - had::INT) AS d FROM turn GROUP BY ALL HAVING sum(has::INT - had::INT) <> 0),
held AS (SELECT *, sum(d) OVER (PARTITION BY f ORDER BY n) AS files FROM step),
edge AS (SELECT f, n, files > 0 AS starts, lead(n) OVER (PARTITION BY f ORDER BY n) AS until FROM held WHERE files = 0 OR files = d)
SELECT f AS fingerprint, n AS from_n, n::VARCHAR AS from_commit, until AS to_n, until::VARCHAR AS to_commit FROM edge WHERE starts""",
}
