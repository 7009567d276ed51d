"""Queries over source files that are derived from the documents, and over findings for reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import behaviour as B
from ..operators import code_rules as C
from ..operators import iac, report, supply
from ..operators.dataflow import labelled_paths, taint_flows
from ..operators.dominance import feasible_flows
from ..sources.control_flow import control_flow
from ..sources.def_use import def_use
from ..sources.manifests import manifest_dependencies
from ..sources.python_facts import python_facts
from . import corpus as K
from .base import FINDINGS, findings, table

#: What each snippet holds, by the snippet's own lines.
FACT_COUNTS = {
    "head": [("import", 10, 0), ("call", 3, 0), ("assign", 2, 0), ("constant", 2, 4)], "shell": [("assign", 1, 0), ("call", 5, 0), ("constant", 4, 12), ("decorator", 1, 0), ("function", 2, 0)],
    "files": [("assign", 1, 0), ("call", 5, 0), ("constant", 2, 14), ("decorator", 1, 0), ("function", 1, 0)], "query": [("assign", 1, 0), ("call", 2, 0), ("constant", 3, 43), ("function", 1, 0)],
    "safe": [("assign", 1, 0), ("call", 6, 0), ("constant", 3, 7), ("function", 1, 0), ("import", 2, 0)], "locks": [("function", 2, 0), ("lock", 2, 0)], "order": [("function", 1, 0), ("lock", 1, 0)],
    "odd": [("assign", 1, 0), ("call", 6, 0), ("class", 2, 0), ("constant", 2, 10), ("function", 1, 0), ("dispatch", 1, 0)], "fetch": [("call", 1, 0), ("constant", 1, 6), ("decorator", 1, 0), ("function", 1, 0)],
    "hidden": [("call", 3, 0), ("constant", 3, 35)], "chain": [("call", 6, 0), ("constant", 1, 4), ("function", 5, 0)], "token": [("call", 2, 0), ("constant", 1, 16), ("function", 1, 0)],
    "tasks": [("assign", 3, 0), ("call", 7, 0), ("class", 1, 0), ("function", 3, 0), ("global", 1, 0), ("await", 2, 0)],
}
_CODE, _READ = ("HIGH", "HIGH", "CODE_INJECTION"), ("HIGH", "HIGH", "UNSAFE_DESERIALIZATION")
CALLS = {
    "shell": [(2, "helper", "os.system", "AST-004", *_CODE), (7, "run", "os.system", "AST-004", *_CODE), (9, "run", "subprocess.run", "AST-005", *_CODE)], "files": [(6, "item", "pickle.loads", "AST-006", *_READ)],
    "safe": [(4, "safe", "os.system", "AST-004", *_CODE), (5, "safe", "os.system", "AST-004", *_CODE), (6, "safe", "eval", "AST-001", *_CODE)], "hidden": [(1, "", "exec", "AST-002", *_CODE)],
    "odd": [(4, "odd", "yaml.load", "AST-007", *_READ), (5, "odd", "eval", "AST-001", *_CODE)], "chain": [(10, "c4", "eval", "AST-001", *_CODE)],
}
FLOWS = {
    "shell": [("run", "TAINT-CMD", "flask.request.args", "HTTP_REQUEST", 5, s, "COMMAND_INJECTION", n) for s, n in (("os.system", 2), ("os.system", 7), ("subprocess.run", 9))],
    "files": [("item", "TAINT-PATH", "flask.request.args.get", "HTTP_REQUEST", 3, "open", "PATH_TRAVERSAL", 5)],
    "query": [("query", "TAINT-SQL", "flask.request.form", "HTTP_REQUEST", 2, "cursor.execute", "SQL_INJECTION", 4)],
    "safe": [("safe", "TAINT-CMD", "flask.request.args", "HTTP_REQUEST", 3, "os.system", "COMMAND_INJECTION", 5)],
    "chain": [("<module>", "TAINT-CODE", "flask.request.args", "HTTP_REQUEST", 11, "eval", "CODE_EXECUTION", 10)],
}
DYNAMIC = {
    "shell": [(3, "", "DECORATOR", "EXACT", "app.route")], "files": [(1, "", "DECORATOR", "EXACT", "app.get"), (6, "item", "DESERIALIZATION", "HIGH_CONFIDENCE", "pickle.loads")], "safe": [(6, "safe", "DYNAMIC_EXECUTION", "UNKNOWN", "eval")],
    "odd": [
        (2, "odd", "REFLECTION", "UNKNOWN", "getattr"), (3, "odd", "REFLECTION", "EXACT", "getattr"), (4, "odd", "DESERIALIZATION", "HIGH_CONFIDENCE", "yaml.load"), (5, "odd", "DYNAMIC_EXECUTION", "EXACT", "eval"),
        (6, "odd", "MONKEY_PATCH", "HIGH_CONFIDENCE", "obj.run"), (7, "odd", "DYNAMIC_DISPATCH", "PARTIAL", "handlers"), (8, "odd", "REFLECTION", "PARTIAL", "vars"), (11, "", "METACLASS", "EXACT", "Model"),
    ],
    "fetch": [(1, "", "DECORATOR", "EXACT", "app.post")], "hidden": [(1, "", "DYNAMIC_EXECUTION", "UNKNOWN", "exec")], "chain": [(10, "c4", "DYNAMIC_EXECUTION", "UNKNOWN", "eval")],
}
WEB = {"files": [(1, "item", "/file/<id>", "WEB-003", "HIGH")], "fetch": [(1, "fetch", "/fetch", "WEB-004", "CRITICAL"), (1, "fetch", "/fetch", "WEB-008", "HIGH")]}
INSTALL = {"hidden": [(1, "", "exec", "OBFUSCATED_EXECUTION"), (2, "", "open", "PERSISTENCE")]}
EDGES = {"shell": [("run", "helper", 1)], "chain": [("<module>", "c0", 1), ("c0", "c1", 1), ("c1", "c2", 1), ("c2", "c3", 1), ("c3", "c4", 1)], "tasks": [("work", "step", 1), ("begin", "step", 1)], "token": [("<module>", "*:run", 4)]}
CONCURRENCY = {
    "head": [(6, "", "SYNC", "threading.Lock")] * 2,
    "tasks": [
        (2, "", "ASYNC_FUNCTION", "work"), (3, "work", "SHARED_GLOBAL", "shared"), (4, "work", "AWAIT", "asyncio.gather"), (4, "work", "GROUP", "asyncio.gather"), (5, "", "ASYNC_FUNCTION", "step"), (6, "step", "AWAIT", "asyncio.sleep"),
        (8, "begin", "THREAD", "threading.Thread"), (9, "begin", "TASK", "asyncio.create_task"), (11, "Counter", "SHARED_ATTRIBUTE", "total"),
    ],
}
ROUTES = {"shell": [(3, "Flask", "run", "/run", "route")], "files": [(1, "Flask", "item", "/file/<id>", "get")], "fetch": [(1, "Flask", "fetch", "/fetch", "post")]}
USES = {"files": [(3, "Flask", "SOURCE", "request.args")], "fetch": [(3, "HTTP", "SINK", "requests.get")]}
FRAMEWORK_RULES = {"token": [(2, "JWT-UNVERIFIED"), (3, "FLASK-DEBUG")]}
EXPLOITABLE = {k: [(r[0], r[5], r[7], r[3], "os.path.exists(name)" if k == "files" else "", "CONDITIONAL" if k == "files" else "EXPLOITABLE") for r in rows] for k, rows in FLOWS.items()}
DOCKER = {"docker": [[(1, "IAC-002", "MEDIUM"), (2, "IAC-003", "CRITICAL")], [(1, "IAC-001", "HIGH"), (1, "IAC-002", "MEDIUM"), (2, "IAC-003", "CRITICAL")]]}
TERRAFORM = {"terraform": [[("aws_s3_bucket", "logs", "IAC-011", "CRITICAL"), ("aws_db_instance", "db", "IAC-012", "CRITICAL"), ("aws_db_instance", "db", "IAC-013", "HIGH")], [("aws_iam_policy", "p", "IAC-014", "CRITICAL")]]}
YAML = {
    "compose": [[("db", "IAC-004", "CRITICAL"), ("db", "IAC-006", "HIGH"), ("web", "IAC-005", "HIGH")], [("api", "IAC-006", "HIGH")]], "workflow": [[("on", "IAC-016", "HIGH"), ("a", "IAC-015", "MEDIUM"), ("a", "IAC-017", "CRITICAL")]],
    "k8s": [[("p", "IAC-007", "CRITICAL"), ("p", "IAC-008", "HIGH"), ("p", "IAC-009", "HIGH"), ("r", "IAC-010", "CRITICAL")], [("c", "IAC-008", "HIGH")]],
}
RESOURCES = {
    "docker": [[("DOCKERFILE", "Dockerfile", False, False)], [("DOCKERFILE", "Dockerfile", False, True)], [("DOCKERFILE", "Dockerfile", False, False)]], "workflow": [[("CICD_WORKFLOW", "workflow", False, False)]] * 2,
    "terraform": [[("CLOUD_STORAGE", "logs", True, False), ("CLOUD_DATABASE", "db", True, False)], [("CLOUD_IAM", "p", False, False)]], "compose": [[("DOCKER_COMPOSE", "db", True, True), ("DOCKER_COMPOSE", "web", False, False)], [("DOCKER_COMPOSE", "api", True, False)]],
    "k8s": [[("KUBERNETES_WORKLOAD", "p", False, True), ("KUBERNETES_RBAC", "r", False, False)], [("KUBERNETES_WORKLOAD", "c", False, False)]],
}
_dep = lambda eco, name, version=None, spec="", direct=True, dev=False, source="registry", ref=None, hashes=0: (eco, name, version, spec, direct, dev, source, ref, hashes)
DEPS = {
    "requirements": [
        [_dep("pypi", "six", "1.16.0", "==1.16.0"), _dep("pypi", "flask", spec=">=2.0"), _dep("pypi", "requests"), _dep("pypi", "tool", source="vcs", ref="main"), _dep("pypi", "pkg", source="url"), _dep("pypi", "idna", "3.7", "==3.7", hashes=1)],
        [_dep("pypi", "six", "1.15.0", "==1.15.0"), _dep("pypi", "helper")],
    ],
    "npm": [[_dep("npm", "left", "1.2.3", "1.2.3"), _dep("npm", "right", spec="^2.0.0"), _dep("npm", "lint", spec="*", dev=True)]],
    "go": [[_dep("go", "github.com/a/b", "1.2.3"), _dep("go", "github.com/c/d", "0.1.0", direct=False)]],
}
SUPPLY = {
    "requirements": [
        [("flask", "DEP-002", "LOW"), ("pkg", "SUPPLY-002", "MEDIUM"), ("pkg", "SUPPLY-003", "LOW"), ("requests", "DEP-001", "LOW"), ("tool", "SUPPLY-001", "HIGH"), ("tool", "SUPPLY-003", "LOW")],
        [("helper", "DEP-001", "LOW")],
    ],
    "npm": [[("lint", "DEP-001", "LOW"), ("lint", "DEP-002", "LOW")]],
}


def _facts(spark, sf, kinds=None, texts=()):
    return python_facts(K.modules(spark, sf), kinds, texts)


def _deps(spark, sf):
    return manifest_dependencies(K.other_files(spark, sf, "requirements", "npm", "go"))


_SARIF = "runs array<struct<results:array<struct<ruleId:string,level:string,ruleIndex:int,partialFingerprints:struct<primary:string>>>>>"


def py_ast_facts(spark, sf):
    """Facts of each file by kind, and the characters of its string constants (whole texts among them)."""
    return _facts(spark, sf, None, ("constant",)).groupBy("path", "kind").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kind") == "constant", F.length("text")).otherwise(0)).alias("chars"))


def py_call_rules(spark, sf):
    return C.call_findings(_facts(spark, sf, ("call",)))


def py_taint_flows(spark, sf):
    return taint_flows(K.modules(spark, sf))


_DYNAMIC = ("assign", "call", "class", "decorator", "dispatch", "function")


def dynamic_events(spark, sf):
    return C.dynamic_events(_facts(spark, sf, _DYNAMIC, C.DYNAMIC_TEXTS))


def dynamic_summary(spark, sf):
    """Certain events of each file by kind."""
    return B.summary(C.dynamic_events(_facts(spark, sf, _DYNAMIC, C.DYNAMIC_TEXTS), conservative=True), "event")


def toctou_races(spark, sf):
    return C.toctou(_facts(spark, sf, ("call",)))


def lock_cycles(spark, sf):
    return C.lock_cycles(C.lock_edges(_facts(spark, sf, ("lock",)))).select("path", F.array_join("cycle", ">").alias("cycle"))


_CONCURRENCY = ("assign", "await", "call", "function", "global")


def concurrency_events(spark, sf):
    return B.concurrency_events(_facts(spark, sf, _CONCURRENCY))


def concurrency_summary(spark, sf):
    return B.summary(B.concurrency_events(_facts(spark, sf, _CONCURRENCY)), "event")


def _routes(spark, sf):
    return C.routes(_facts(spark, sf, ("class", "decorator", "function"), ("decorated",)))


def web_rules(spark, sf):
    return C.web_findings(_routes(spark, sf))


def web_summary(spark, sf):
    """Routes of each file, those without a sign of authentication, and those that a forged request can't harm."""
    return _routes(spark, sf).groupBy("path").agg(F.count("*").alias("routes"), F.count_if(~F.col("authenticated")).alias("open"), F.count_if("csrf_safe").alias("csrf_safe"))


def install_events(spark, sf):
    return C.install_events(_facts(spark, sf, ("call",), ("call",)))


def malware_summary(spark, sf):
    return B.malware_summary(C.install_events(_facts(spark, sf, ("call",), ("call",))))


def framework_evidence(spark, sf):
    return C.frameworks(_facts(spark, sf, ("import",)))


def framework_routes(spark, sf):
    return B.framework_routes(_facts(spark, sf, ("assign", "call", "decorator", "import")))


def framework_uses(spark, sf):
    return B.framework_uses(_facts(spark, sf, ("call",)))


def framework_findings(spark, sf):
    return B.framework_findings(_facts(spark, sf, ("assign", "call", "class", "decorator", "function", "import"), ("call", "function")))


def exploitability(spark, sf):
    files = K.modules(spark, sf)
    out = feasible_flows(labelled_paths(def_use(files)), control_flow(files)).where("verdict <> 'NOT_EXPLOITABLE'")
    return out.select("path", "fn", "sink", "sink_line", "source_kind", F.array_join("conditions", " and ").alias("conditions"), "verdict")


def call_edges(spark, sf):
    return C.call_edges(_facts(spark, sf, ("call", "function", "import")))


def dockerfile_rules(spark, sf):
    return iac.dockerfile_findings(K.other_files(spark, sf, "docker"))


def terraform_rules(spark, sf):
    return iac.terraform_findings(K.other_files(spark, sf, "terraform"))


def yaml_rules(spark, sf):
    return iac.yaml_findings(K.other_files(spark, sf, "compose", "workflow", "k8s"))


def manifest_deps(spark, sf):
    return _deps(spark, sf)


def supply_rules(spark, sf):
    return supply.supply_findings(_deps(spark, sf))


def package_shadowing(spark, sf):
    """Local modules named like a package that a manifest asks for."""
    i = F.col("doc_id")
    local = table(spark, sf, "documents").select(F.concat(F.lit("lib"), i.cast("string"), F.lit("/"), F.when(i % 3 == 0, "six").when(i % 3 == 1, "idna").otherwise("own"), F.lit(".py")).alias("path"))
    return supply.shadowing(local, _deps(spark, sf))


def dependency_inventory(spark, sf):
    return supply.inventory(_deps(spark, sf))


def sbom_components(spark, sf):
    return report.sbom(_deps(spark, sf))


def check_annotations(spark, sf):
    return report.annotations(findings(spark, sf))


def json_report(spark, sf):
    return report.json_report(findings(spark, sf))


def sarif_report(spark, sf):
    """Each project's SARIF log read back from the JSON: results, rules, errors, the first result's rule, place and fingerprint, and all fingerprints' checksum."""
    s = report.sarif(findings(spark, sf)).withColumn("v", F.parse_json("sarif"))
    n = lambda p: F.size(F.try_variant_get("v", p, "array<variant>")).cast("long")
    return s.select("project", n("$.runs[0].results").alias("results"), n("$.runs[0].tool.driver.rules").alias("rules"), F.try_variant_get("v", "$.runs[0].results[0].ruleId", "string").alias("first_rule"),
        F.size(F.filter(F.from_json("sarif", _SARIF)["runs"][0]["results"], lambda r: r["level"] == "error")).cast("long").alias("errors"), F.try_variant_get("v", "$.runs[0].results[0].locations[0].physicalLocation.artifactLocation.uri", "string").alias("first_file"),
        F.try_variant_get("v", "$.runs[0].results[0].locations[0].physicalLocation.region.startLine", "long").alias("first_line"), F.md5(F.array_join(F.transform(F.from_json("sarif", _SARIF)["runs"][0]["results"], lambda r: r["partialFingerprints"]["primary"]), ",")).alias("prints"),
        F.try_variant_get("v", "$.version", "string").alias("version"), F.size(F.filter(F.from_json("sarif", _SARIF)["runs"][0]["results"], lambda r: r["ruleIndex"].isNull() | (r["ruleIndex"] < 0))).cast("long").alias("unplaced"))


def iac_resources(spark, sf):
    """What infrastructure files declare, and whether it is public or privileged."""
    return iac.resources(K.other_files(spark, sf, "docker", "terraform", "compose", "workflow", "k8s"))


def json_findings(spark, sf):
    """Findings as JSON lines: the report's array, a row each, so that it has no bound."""
    return findings(spark, sf).select("ordinal", F.to_json(F.struct("rule_id", "severity", "confidence", "file_path", "line", "title", "risk_score", "state")).alias("finding"))


def windowed_event_counts(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {f.__name__: f for f in (py_ast_facts, py_call_rules, py_taint_flows, dynamic_events, dynamic_summary, toctou_races, lock_cycles, concurrency_events, concurrency_summary, web_rules, web_summary, install_events, malware_summary, framework_evidence, framework_routes, framework_uses, framework_findings, exploitability, call_edges, dockerfile_rules, terraform_rules, yaml_rules, manifest_deps, supply_rules, package_shadowing, dependency_inventory, sbom_components, check_annotations, json_report, sarif_report, iac_resources, json_findings, windowed_event_counts)}
_DEP_COLS = ["ecosystem", "name", "version", "spec", "is_direct", "is_dev", "source_type", "vcs_ref", "hashes"]
_DEPS_SQL = K.found(_DEP_COLS, DEPS)
_EVENTS = K.placed(["line", "fn", "event", "state", "target"], DYNAMIC)
_CONCURRENT = K.placed(["line", "fn", "event", "target"], CONCURRENCY)
_INSTALLED = K.placed(["line", "fn", "resolved", "event"], INSTALL)
SQL = {
    "check_annotations": f"{FINDINGS} SELECT ordinal, file_path, line, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'failure' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'notice' END AS level, left(title, 1000) AS message FROM findings ORDER BY risk_score DESC, ordinal LIMIT 50",
    "sarif_report": f"{FINDINGS} SELECT project, count(*) AS results, count(DISTINCT rule_id) AS rules, arg_min(rule_id, ordinal) AS first_rule, count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS errors, arg_min(file_path, ordinal) AS first_file, greatest(arg_min(line, ordinal), 1) AS first_line, md5(string_agg(fingerprint, ',' ORDER BY ordinal)) AS prints, '2.1.0' AS version, 0::BIGINT AS unplaced FROM findings GROUP BY project",
    "json_report": f"""{FINDINGS} SELECT project, '{{"schema_version":"1.0","total":' || count(*) || ',"severity":{{"critical":' || count(*) FILTER (severity = 'CRITICAL') || ',"high":' || count(*) FILTER (severity = 'HIGH') || ',"medium":' || count(*) FILTER (severity = 'MEDIUM') || ',"low":' || count(*) FILTER (severity = 'LOW') || ',"info":' || count(*) FILTER (severity = 'INFO') || '}},"max_risk":' || max(risk_score) || '}}' AS report FROM findings GROUP BY project""",
    "windowed_event_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "iac_resources": K.found(["kind", "name", "is_public", "is_privileged"], RESOURCES),
    "json_findings": f"{FINDINGS} SELECT ordinal, '{{\"rule_id\":\"' || rule_id || '\",\"severity\":\"' || severity || '\",\"confidence\":\"' || confidence || '\",\"file_path\":\"' || file_path || '\",\"line\":' || line || ',\"title\":\"' || title || '\",\"risk_score\":' || risk_score || ',\"state\":\"' || state || '\"}}' AS finding FROM findings",
    "py_ast_facts": f"WITH c AS ({K.placed(['kind', 'n', 'chars'], FACT_COUNTS, ())} UNION ALL SELECT {K.PATH}, 'constant', 0, length(coalesce(text, '')) FROM documents) SELECT path, kind, sum(n)::BIGINT AS n, sum(chars)::BIGINT AS chars FROM c GROUP BY ALL",
    "py_call_rules": K.placed(["line", "fn", "resolved", "rule_id", "severity", "confidence", "category"], CALLS),
    "py_taint_flows": K.placed(["fn", "rule_id", "source", "source_kind", "source_line", "sink", "sink_kind", "sink_line"], FLOWS, ("source_line", "sink_line")),
    "dynamic_events": _EVENTS,
    "dynamic_summary": f"SELECT path, event, count(*) AS events FROM ({_EVENTS}) WHERE state IN ('EXACT', 'HIGH_CONFIDENCE') GROUP BY ALL",
    "toctou_races": K.placed(["fn", "line", "check_line", "resolved"], {"files": [("item", 5, 4, "open")]}, ("line", "check_line")),
    "lock_cycles": K.placed(["cycle"], {"locks": [("lock_a>lock_b",)]}),
    "concurrency_events": _CONCURRENT,
    "concurrency_summary": f"SELECT path, event, count(*) AS events FROM ({_CONCURRENT}) GROUP BY ALL",
    "web_rules": K.placed(["line", "handler", "route", "rule_id", "severity"], WEB),
    "web_summary": f"SELECT path, count(*) AS routes, count(*) AS open, count(*) FILTER (verb <> 'post') AS csrf_safe FROM ({K.placed(['line', 'framework', 'handler', 'route', 'verb'], ROUTES)}) GROUP BY path",
    "install_events": _INSTALLED,
    "malware_summary": f"SELECT path, count(*) FILTER (event = 'INSTALL_EXECUTION') AS install_execution, count(*) FILTER (event = 'OBFUSCATED_EXECUTION') AS obfuscated_execution, count(*) FILTER (event = 'PERSISTENCE') AS persistence, 90 AS risk FROM ({_INSTALLED}) GROUP BY path",
    "framework_evidence": f"SELECT path, framework, imports::BIGINT AS imports FROM ({K.placed(['framework', 'imports'], {'head': [('Flask', 2), ('HTTP', 1), ('Auth', 1)]})})",
    "framework_routes": K.placed(["line", "framework", "handler", "route", "verb"], ROUTES),
    "framework_uses": K.placed(["line", "framework", "role", "name"], USES),
    "framework_findings": K.placed(["line", "rule_id"], FRAMEWORK_RULES),
    "exploitability": K.placed(["fn", "sink", "sink_line", "source_kind", "conditions", "verdict"], EXPLOITABLE, ("sink_line",)),
    "call_edges": f"SELECT path || ':' || caller AS src, CASE WHEN tier = 4 THEN callee ELSE path || ':' || callee END AS dst, tier FROM ({K.placed(['caller', 'callee', 'tier'], EDGES)})",
    "dockerfile_rules": K.found(["line_no", "rule_id", "severity"], DOCKER),
    "terraform_rules": K.found(["kind", "name", "rule_id", "severity"], TERRAFORM),
    "yaml_rules": K.found(["name", "rule_id", "severity"], YAML),
    "manifest_deps": _DEPS_SQL,
    "supply_rules": K.found(["name", "rule_id", "severity"], SUPPLY),
    "package_shadowing": "SELECT 'lib' || doc_id || '/' || CASE WHEN doc_id % 3 = 0 THEN 'six' ELSE 'idna' END || '.py' AS path, CASE WHEN doc_id % 3 = 0 THEN 'six' ELSE 'idna' END AS name FROM documents WHERE doc_id % 3 < 2",
    "dependency_inventory": f"SELECT ecosystem, count(*) AS total, count(*) FILTER (is_direct) AS direct, count(*) FILTER (NOT is_direct) AS transitive, count(*) FILTER (is_dev) AS dev, count(*) FILTER (version IS NULL) AS unpinned FROM ({_DEPS_SQL}) GROUP BY ecosystem",
    "sbom_components": f"SELECT DISTINCT 'pkg:' || ecosystem || '/' || lower(name) || coalesce('@' || version, '') AS purl, CASE WHEN is_direct THEN 'direct' ELSE 'transitive' END AS relation FROM ({_DEPS_SQL})",
}
