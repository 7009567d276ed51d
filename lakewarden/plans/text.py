"""Queries over texts, urls and event properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import secrets as S
from ..functions.paths import host_verdict
from ..functions.versions import license_action
from ..operators import lines as L
from ..operators import secrets as scan_op
from .base import table

SALT = "lakewarden"


def secret_scan_documents(spark, sf):
    return scan_op.scan(table(spark, sf, "documents"), ["doc_id"], salt=SALT)


def secret_context_severity(spark, sf):
    d = table(spark, sf, "documents").withColumn("path", F.concat(F.lit("/srv/"), F.when(F.col("lang") == "en", "tests/").otherwise("src/"), "source", F.lit(".py")))
    return scan_op.scan(d, ["doc_id", "path"], path="path", salt=SALT).select("doc_id", "path", "detector", "severity", S.environment(F.col("path")).alias("environment"))


def entropy_tokens(spark, sf):
    """Entropy of the whole source, and the highest of all words of the whole text."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", S.entropy(F.coalesce("source", F.lit(""))).alias("source_entropy"), F.coalesce(F.array_max(F.transform(F.array_distinct(F.split("text", " ")), S.entropy)), F.lit(0.0)).alias("max_entropy"))


def token_entropy(spark, sf):
    """Of each row the entropy of the whole source, the number of distinct tokens of the whole text and their highest entropy."""
    d = table(spark, sf, "documents")
    tokens = F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\r\n]+"), lambda t: t != ""))
    d = d.select("doc_id", S.entropy(F.coalesce("source", F.lit(""))).alias("source_entropy"), tokens.alias("tokens"))
    top = F.coalesce(F.array_max(F.transform("tokens", S.entropy)), F.lit(0.0))
    return d.select("doc_id", "source_entropy", F.size("tokens").cast("long").alias("n_tokens"), top.alias("max_entropy"))


def placeholder_values(spark, sf):
    v = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b\w+ = (\"[^\"\s]+\")"), 1))).alias("v"))
    return v.select("doc_id", S.is_placeholder(F.col("v")).alias("placeholder"), S.redacted(S.unquoted(F.col("v"))).alias("shown"))


LICENSE_LINE = r"(?i)(apache license|mit license|general public license|cc by-nc|all rights reserved)"


def license_policy(spark, sf):
    """The licence lines of documents, named and judged."""
    lines = L.exploded(table(spark, sf, "documents"), ["doc_id"]).where(F.col("line").rlike(LICENSE_LINE))
    text = F.lower("line")
    has = lambda w: F.contains(text, F.lit(w))
    name = F.when(has("apache license"), "Apache-2.0").when(has("mit license"), "MIT").when(has("general public license"), "GPL-3.0").when(has("cc by-nc"), "CC-BY-NC-4.0").otherwise("UNKNOWN")
    return lines.select("doc_id", "line_no", name.alias("license")).withColumn("action", license_action(F.col("license")))


HTML_RULES = (
    ("HTML-001", "html", "HIGH", ("eval(", "document.write("), (), (), "//"),
    ("HTML-002", "html", "MEDIUM", ("<script",), (), ("integrity=",), "<!--"),
    ("HTML-003", "html", "LOW", ("http://",), ("href", "src"), (), ""),
    ("HTML-004", "html", "MEDIUM", ("onclick=", "onload=", "onerror="), (), (), ""),
)


def line_pattern_rules(spark, sf):
    hits = L.pattern_findings(L.exploded(table(spark, sf, "pages"), ["page_id"], "html"), HTML_RULES)
    return hits.select("page_id", F.col("line_no").cast("long").alias("line_no"), "rule_id", "severity")


def line_counts(spark, sf):
    return L.exploded(table(spark, sf, "documents"), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.trim("line") != "").alias("n_filled"))


DENY_HOSTS = (r"^(localhost|127\..*|10\..*|192\.168\..*|169\.254\..*)$", r"\.internal$")
ALLOW_HOSTS = (r"\.example\.(com|org)$",)


def ssrf_host_policy(spark, sf):
    """Deny patterns first, then the allow list."""
    p = table(spark, sf, "pages")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z]+://([^/?#:]+)", 1))
    return p.select("page_id", host.alias("host")).withColumn("verdict", host_verdict(F.col("host"), DENY_HOSTS, ALLOW_HOSTS))


def json_props_extract(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


def function_carry_forward(spark, sf):
    """The user turn that each turn of a conversation answers."""
    c = table(spark, sf, "conversations")
    out = L.carried(c, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "asked_at")
    return out.select("conv_id", "turn", "role", F.coalesce("asked_at", F.lit(-1)).alias("asked_at"))


def line_segments(spark, sf):
    """Blocks of turns, each opened by a user."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("line"))
    s = L.segments(c, ["conv_id"], "turn", F.col("line") == "user")
    return s.select("conv_id", F.col("block").cast("long").alias("block"), "header", "body")


def webhook_latest_wins(spark, sf):
    """Of each user's events of a type the newest counts, all others are obsolete."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"), (F.count("*") - 1).alias("obsolete"))


def lifecycle_exposure(spark, sf):
    """First and last sight of each user's errors, in days."""
    e = table(spark, sf, "events").where("event_type = 'error'")
    return e.groupBy("user_id").agg(F.min("event_id").alias("introduced"), F.max("event_id").alias("last_seen"), F.datediff(F.max("ts"), F.min("ts")).cast("long").alias("exposure_days"))


def workspace_hash(spark, sf):
    """A source's hash: a tree of hashes over runs of a thousand ids, so that no task holds all of a source."""
    d = table(spark, sf, "documents").select("source", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))

    def level(rows, order, *keys):
        g = rows.groupBy("source", *keys).agg(F.array_sort(F.collect_list(F.struct(order, "h"))).alias("a"))
        return g.select("source", *keys, F.sha2(F.array_join(F.transform("a", lambda x: x["h"]), ""), 256).alias("h"))

    low = level(d.withColumn("run", F.floor(F.col("doc_id") / 1000)), "doc_id", "run")
    mid = level(low.withColumn("wide", F.floor(F.col("run") / 1000)), "run", "wide")
    return level(mid, "wide").withColumnRenamed("h", "workspace_hash")


QUERIES = {f.__name__: f for f in (secret_scan_documents, secret_context_severity, entropy_tokens, token_entropy, placeholder_values, license_policy, line_pattern_rules, line_counts, ssrf_host_policy, json_props_extract, function_carry_forward, line_segments, webhook_latest_wins, lifecycle_exposure, workspace_hash)}

_q = lambda s: "'" + s.replace("'", "''") + "'"


def _entropy(v: str) -> str:
    chars = f"string_split({v}, '')"
    return f"CASE WHEN length(coalesce({v}, '')) > 0 THEN round(list_sum(list_transform(list_distinct({chars}), lambda c: -(len(list_filter({chars}, lambda x: x = c)) / len({chars})) * log2(len(list_filter({chars}, lambda x: x = c)) / len({chars})))), 4) ELSE 0.0 END"


def _is_placeholder(v: str) -> str:
    words = ", ".join(_q(w) for w in S.PLACEHOLDERS)
    return f"({v} = '' OR upper({v}) IN ({words}) OR regexp_matches({v}, {_q(S.PLACEHOLDER_PATTERN)}))"


_KINDS = " ".join(f"WHEN kind = {_q(k)} THEN regexp_matches(v, {_q(p)})" for k, p in S.STRUCTURES.items())
_UNQUOTED = "trim(regexp_replace(trim({}), '^[''\"]+|[''\"]+$', '', 'g'))"
_DETECTORS = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, {_q(d)} AS detector, {_q(k)} AS kind, {str(g).upper()} AS generic, {_q(s)} AS severity, {i} AS ord, unnest(list_distinct(regexp_extract_all(text, {_q(p)}, 1))) AS value FROM documents"
    for i, (d, k, g, s, p) in enumerate(scan_op.DETECTORS)
)
_SECRETS = f"""
WITH hits AS ({_DETECTORS}), clean AS (SELECT *, {_UNQUOTED.format('value')} AS v FROM hits),
kept AS (SELECT *, {_entropy('value')} AS entropy, 'sec_fp_' || left(sha256('{SALT}:' || trim(value)), 32) AS fingerprint,
    CASE WHEN length(trim(value)) > 8 THEN left(trim(value), 4) || repeat('*', length(trim(value)) - 8) || right(trim(value), 4) ELSE '[REDACTED]' END AS redacted
  FROM clean WHERE NOT {_is_placeholder('v')} AND CASE {_KINDS} ELSE regexp_matches(v, {_q(S.GENERIC_STRUCTURE)}) END),
best AS (SELECT * FROM kept WHERE kind <> 'HIGH_ENTROPY' OR entropy >= {scan_op.ENTROPY_LEAST}
  QUALIFY row_number() OVER (PARTITION BY doc_id, fingerprint ORDER BY generic, ord) = 1)
"""
_LINES = "SELECT {key}, row_number() OVER () AS _, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line FROM (SELECT {key}, string_split(regexp_replace(regexp_replace(coalesce({text}, ''), '\\r\\n?', chr(10), 'g'), '\\n\\z', ''), chr(10)) AS parts FROM {table})"


def _fires(r) -> str:
    any_ = lambda ws: "(" + " OR ".join(f"contains(line, {_q(w)})" for w in ws) + ")"
    out = [any_(r[3])] + ([any_(r[4])] if r[4] else []) + ([f"NOT {any_(r[5])}"] if r[5] else []) + ([f"NOT starts_with(ltrim(line), {_q(r[6])})"] if r[6] else [])
    return " AND ".join(out)


_ENV = " ".join(f"WHEN regexp_matches(lower(path), {_q('|'.join(w))}) THEN {_q(n)}" for n, w in S.ENVIRONMENTS)
SQL = {
    "secret_scan_documents": f"{_SECRETS} SELECT doc_id, fingerprint, detector, kind, severity, redacted, entropy FROM best",
    "secret_context_severity": f"{_SECRETS}, p AS (SELECT *, '/srv/' || CASE WHEN lang = 'en' THEN 'tests/' ELSE 'src/' END || source || '.py' AS path FROM best) SELECT doc_id, path, detector, CASE WHEN NOT regexp_matches(path, {_q(S.TEST_PATH)}) THEN severity WHEN severity IN ('CRITICAL', 'HIGH') THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE {_ENV} ELSE 'UNKNOWN' END AS environment FROM p",
    "entropy_tokens": f"WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS b FROM documents), e AS (SELECT b, {_entropy('b')} AS x FROM w), m AS (SELECT doc_id, max(x) AS x FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS b FROM documents) JOIN e USING (b) GROUP BY doc_id) SELECT doc_id, {_entropy('d.source')} AS source_entropy, coalesce(m.x, 0.0) AS max_entropy FROM documents d LEFT JOIN m USING (doc_id)",
    "token_entropy": f"WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda t: t <> ''))) AS b FROM documents), u AS (SELECT DISTINCT b FROM w), e AS (SELECT b, {_entropy('b')} AS x FROM u), m AS (SELECT doc_id, count(*) AS n, max(x) AS x FROM w JOIN e USING (b) GROUP BY doc_id) SELECT doc_id, {_entropy('d.source')} AS source_entropy, coalesce(n, 0) AS n_tokens, coalesce(x, 0.0) AS max_entropy FROM documents d LEFT JOIN m USING (doc_id)",
    "placeholder_values": f"WITH h AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b\\w+ = (\"[^\"\\s]+\")', 1))) AS value FROM documents), c AS (SELECT doc_id, {_UNQUOTED.format('value')} AS v FROM h) SELECT doc_id, {_is_placeholder('v')} AS placeholder, CASE WHEN length(v) > 8 THEN left(v, 4) || repeat('*', length(v) - 8) || right(v, 4) ELSE '[REDACTED]' END AS shown FROM c",
    "license_policy": f"WITH l AS ({_LINES.format(key='doc_id', text='text', table='documents')}), n AS (SELECT doc_id, line_no::INT AS line_no, CASE WHEN contains(lower(line), 'apache license') THEN 'Apache-2.0' WHEN contains(lower(line), 'mit license') THEN 'MIT' WHEN contains(lower(line), 'general public license') THEN 'GPL-3.0' WHEN contains(lower(line), 'cc by-nc') THEN 'CC-BY-NC-4.0' ELSE 'UNKNOWN' END AS license FROM l WHERE regexp_matches(line, {_q(LICENSE_LINE)})) SELECT *, CASE license WHEN 'GPL-3.0' THEN 'DENY' WHEN 'MIT' THEN 'ALLOW' WHEN 'Apache-2.0' THEN 'ALLOW' ELSE 'REVIEW_REQUIRED' END AS action FROM n",
    "line_pattern_rules": f"WITH l AS ({_LINES.format(key='page_id', text='html', table='pages')}) " + " UNION ALL ".join(f"SELECT page_id, line_no, {_q(r[0])} AS rule_id, {_q(r[2])} AS severity FROM l WHERE {_fires(r)}" for r in HTML_RULES),
    "line_counts": f"WITH l AS ({_LINES.format(key='doc_id', text='text', table='documents')}) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (trim(line) <> '') AS n_filled FROM l GROUP BY doc_id",
    "ssrf_host_policy": f"WITH h AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z]+://([^/?#:]+)', 1)) AS host FROM pages) SELECT *, CASE WHEN regexp_matches(host, {_q('|'.join(DENY_HOSTS))}) THEN 'DENY' WHEN regexp_matches(host, {_q('|'.join(ALLOW_HOSTS))}) THEN 'ALLOW' ELSE 'REVIEW' END AS verdict FROM h",
    "json_props_extract": "SELECT event_type, (props->>'$.k')::BIGINT AS k, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY ALL",
    "function_carry_forward": "SELECT conv_id, turn, role, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS asked_at FROM conversations",
    "line_segments": "WITH b AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM conversations) SELECT conv_id, block::BIGINT AS block, arg_min(role, turn) AS header, string_agg(role, chr(10) ORDER BY turn) AS body FROM b WHERE block > 0 GROUP BY conv_id, block",
    "webhook_latest_wins": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS latest, count(*) - 1 AS obsolete FROM events GROUP BY ALL",
    "lifecycle_exposure": "SELECT user_id, min(event_id) AS introduced, max(event_id) AS last_seen, date_diff('day', min(ts), max(ts)) AS exposure_days FROM events WHERE event_type = 'error' GROUP BY user_id",
    "workspace_hash": "WITH l AS (SELECT source, doc_id // 1000 AS run, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL), m AS (SELECT source, run // 1000 AS wide, sha256(string_agg(h, '' ORDER BY run)) AS h FROM l GROUP BY ALL) SELECT source, sha256(string_agg(h, '' ORDER BY wide)) AS workspace_hash FROM m GROUP BY source",
}
