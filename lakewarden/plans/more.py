"""Queries over redaction, paths, package versions, relations between findings, layers and services."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import pep440
from ..functions import redaction as R
from ..operators import code_rules as C
from ..operators import gates as G
from ..operators import graph, sca
from ..operators import program_model as PM
from ..operators import relations as L
from ..operators import structure as ST
from ..operators.lines import exploded
from ..sources import constants as CS
from ..sources.manifests import manifest_dependencies
from ..sources.python_facts import python_facts
from ..operators.dataflow import labelled_flows
from . import corpus as K
from .base import EDGES, FINDINGS, dependencies, edges, findings, pick, table
from .code import FLOWS
from .deps import _DEPS, _WALK

_q = K.literal


# --- texts and paths --------------------------------------------------------------------------


def redactions(spark, sf):
    """Checksums of each whole text as reports, logs, payloads and evidence show it."""
    d, t = table(spark, sf, "documents"), F.col("text")
    word = F.split_part(t, F.lit(" "), F.lit(2))
    shown = {"report": R.report_text(t), "log": R.log_text(t, ["the ", "abc"]), "payload": R.payload_text(t), "evidence": R.evidence_text(t, word)}
    return d.select("doc_id", *(F.md5(c).alias(k) for k, c in shown.items()))


def masked_values(spark, sf):
    p = table(spark, sf, "part")
    short = F.substr("p_name", F.lit(1), F.col("p_size") % 12)
    return p.select("p_partkey", R.comment_value(short).alias("comment"), R.masked_token(short).alias("token"))


def _paths(spark, sf):
    i = F.col("doc_id")
    folder, end = pick(i, "/srv/tests/", "/srv/docs/", "/srv/api/", "/srv/.github/workflows/", "src/"), pick(F.floor(i / 5), ".py", ".md", ".yml", ".exe", "", ".spec.ts")
    return table(spark, sf, "documents").select("doc_id", F.concat(folder, "source", end).alias("path"), "lang", "source", "text")


def path_predicates(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select("doc_id", P.is_test(p).alias("test"), P.is_documentation(p).alias("documentation"), P.is_pipeline(p).alias("pipeline"), P.is_security_relevant(p).alias("security"), P.is_scanned(p).alias("scanned"), P.extension(p).alias("ext"))


def secret_privilege(spark, sf):
    """Scope and confidence of a candidate by kind, key and the whole text as its context."""
    d = _paths(spark, sf)
    kind = pick(F.col("doc_id"), "DATABASE_URL", "CLOUD_CREDENTIAL", "SIGNING_KEY", "ACCESS_TOKEN")
    c = P.context_confidence(F.col("source"), pick(F.col("doc_id"), "api_key", "name", "test_key"), F.col("path"))
    return d.select("doc_id", P.privilege(kind, F.col("text")).alias("privilege"), c.alias("c")).select("doc_id", "privilege", "c.*")


def identifier_types(spark, sf):
    k = F.col("p_partkey")
    raw = F.concat(pick(k, "CVE-", "ghsa-", " PYSEC-", "OSV-", "X-"), k.cast("string"))
    return table(spark, sf, "part").select(k, P.identifier_type(raw).alias("type"))


# --- packages ---------------------------------------------------------------------------------

SPECS = (">=1.0,<3.4.5", "~=4.2", "==5.*", "!=2.0.0", ">=3.0rc1")


def pep440_matches(spark, sf):
    d = dependencies(spark, sf)
    return d.select("ord", F.explode(F.array(*(F.struct(F.lit(s).alias("spec"), pep440.matches(F.col("version"), F.lit(s)).alias("fits")) for s in SPECS))).alias("m")).select("ord", "m.*")


def _constrained(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("name"), pick(F.col("p_size"), ">=2,<3", ">=3", "==1.0.0", "<2.19", "").alias("spec"))


def constraint_conflicts(spark, sf):
    return L.conflicting_constraints(_constrained(spark, sf))


RANGES = (("ADV-1", "STANDARD", "2.0.0", "3.0.0"), ("ADV-2", "PROMO", "0.5", None), ("ADV-3", "STANDARD", "1.0.0", "1.5"))


def constraint_overlap(spark, sf):
    r = spark.createDataFrame(RANGES, "id string, package string, introduced string, until string")
    return L.constraint_overlaps(_constrained(spark, sf), r)


def _specs(n, w):
    """A specifier in one of seven forms about the version n (of tens and ones), up to w further on."""
    v = lambda x: F.concat(F.floor(x / 10).cast("string"), F.lit("."), (x % 10).cast("string"))
    whole = F.floor(n / 10).cast("string")
    forms = (F.concat(F.lit(">="), v(n), F.lit(",<"), v(n + w)), F.concat(F.lit("=="), v(n)), F.concat(F.lit("=="), whole, F.lit(".*")), F.concat(F.lit("~="), v(n)), F.concat(F.lit(">"), v(n), F.lit(", <="), v(n + w)), F.concat(F.lit("<"), v(n)), F.concat(F.lit(">="), v(n)))
    out = forms[-1]
    for i, f in enumerate(forms[:-1]):
        out = F.when((n + w) % len(forms) == i, f).otherwise(out)
    return out


def constraint_algebra(spark, sf):
    """Of each part two constraints and an advisory's interval: whether the first two conflict, and what lies in the interval."""
    p = table(spark, sf, "part")
    n, w = (F.col("p_partkey") % 89).cast("int"), (F.col("p_size") % 13 + 1).cast("int")
    m = (F.floor(F.col("p_retailprice")) % 83).cast("int")
    a, b = _specs(n, w), _specs(m, w + 1)
    version = lambda x: F.concat(F.floor(x / 10).cast("string"), F.lit("."), (x % 10).cast("string"))
    return L.constraint_algebra(p.select("p_partkey", a.alias("first"), b.alias("second"), version(m).alias("introduced"), version(m + w).alias("until"))).drop("introduced", "until")


def _spec_sql(n: str, w: str) -> tuple[str, str, str]:
    """SQL of a specifier's text and of its two cuts, as numbers: four to a version, from its earliest pre-release to beyond its post-releases."""
    v = lambda x: f"(({x}) // 10) || '.' || (({x}) % 10)"
    pick_ = lambda *forms: f"CASE ({n} + {w}) % 7 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"
    text = pick_(f"'>=' || {v(n)} || ',<' || {v(f'{n} + {w}')}", f"'==' || {v(n)}", f"'==' || ({n} // 10) || '.*'", f"'~=' || {v(n)}", f"'>' || {v(n)} || ', <=' || {v(f'{n} + {w}')}", f"'<' || {v(n)}", f"'>=' || {v(n)}")
    whole, nxt = f"({n} // 10) * 40", f"({n} // 10) * 40 + 40"
    return text, pick_(f"4 * {n} + 1", f"4 * {n} + 1", whole, f"4 * {n} + 1", f"4 * {n} + 3", "-1", f"4 * {n} + 1"), pick_(f"4 * ({n} + {w})", f"4 * {n} + 2", nxt, nxt, f"4 * ({n} + {w}) + 2", f"4 * {n}", "100000")


def _algebra_sql() -> str:
    (t1, l1, h1), (t2, l2, h2) = _spec_sql("n", "w"), _spec_sql("m", "(w + 1)")
    return f"""WITH k AS (SELECT p_partkey, (p_partkey % 89)::INT AS n, (p_size % 13 + 1)::INT AS w, (floor(p_retailprice)::BIGINT % 83)::INT AS m FROM part),
r AS (SELECT p_partkey, {t1} AS first, {t2} AS second, {l1} AS l1, {h1} AS h1, {l2} AS l2, {h2} AS h2, 4 * m + 1 AS l3, 4 * (m + w) + 1 AS h3 FROM k)
SELECT p_partkey, first, second, l1 >= h1 OR l2 >= h2 OR greatest(l1, l2) >= least(h1, h2) AS conflict, l1 < h1 AND greatest(l1, l3) < least(h1, h3) AS exposed,
  (CASE WHEN l1 < least(h1, l3) THEN 1 ELSE 0 END + CASE WHEN greatest(l1, h3) < h1 THEN 1 ELSE 0 END)::INT AS safe_ranges FROM r"""


def tamper_warnings(spark, sf):
    p = table(spark, sf, "part")
    url = F.when(F.col("p_partkey") % 3 < 2, F.concat(pick(F.col("p_partkey"), "https://a/", "http://b/", ""), "p_name"))
    return L.tamper_warnings(p.select(F.col("p_partkey").alias("name"), url.alias("url"), pick(F.col("p_size"), "sha256-x", "abc", "0123456789abcdef0123456789abcdef", "").alias("integrity")))


def npm_reachability(spark, sf):
    d = table(spark, sf, "documents")
    return L.imported_packages(d.select(F.col("source").alias("name")).distinct(), d.where("doc_id % 3 = 0").select(F.concat("source", F.lit("/lib/x")).alias("module")))


def locked_versions(spark, sf):
    d = dependencies(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), "p_size", F.split_part("p_type", F.lit(" "), F.lit(2)).alias("name")), "ord")
    return L.locked_versions(d.where("p_size <= 20"), d.where("p_size >= 15 and name <> 'TIN'"))


VULNERABLE = (("ring", "ADV-1", ["widget"]), ("nosuch", "ADV-2", None), ("bo", "ADV-3", ["no.function"]), ("small.gear", "ADV-4", []))


def dependency_reachability(spark, sf):
    """Packages and their functions in the names that code calls: every part's name is a call."""
    calls = table(spark, sf, "part").select(F.concat(F.lit("f"), "p_partkey").alias("fn"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit(".")).alias("callee"), (F.col("p_size") % 7 == 0).alias("endpoint"))
    return L.call_reachability(spark.createDataFrame(VULNERABLE, "name string, id string, functions array<string>"), calls)


# --- findings ---------------------------------------------------------------------------------


def _place():
    return F.concat_ws(":", "file_path", F.col("line").cast("string"), "rule_id")


def duplicate_relations(spark, sf):
    return L.duplicate_relations(findings(spark, sf), _place())


def cluster_keys(spark, sf):
    f = findings(spark, sf).withColumn("file_path", F.when(F.col("ordinal") % 4 > 0, F.col("file_path")))
    return L.keyed_clusters(f).groupBy("cluster").agg(F.count("*").alias("members"))


def policy_profile(spark, sf):
    f = findings(spark, sf).where("ordinal % 3 = 0 and (severity <> 'CRITICAL' or project % 2 = 0)")
    return G.evaluate_profile(f, ["project"], F.max("risk_score") / 10, [("POL-NO-HIGH-RISK", "2020-01-01")], "2025-01-01")


def threshold_gate(spark, sf):
    f = findings(spark, sf).where("severity <> 'CRITICAL' or project % 2 = 0").where("severity <> 'HIGH' or project % 3 = 0")
    return G.threshold_gate(f, ["project"], "high", F.max("risk_score"))


def category_view(spark, sf):
    f = findings(spark, sf)
    cat = pick(F.col("ordinal"), "SQL", "SHELL_EXEC", "HTTP_REQUEST", "FILESYSTEM", "HTML_OUTPUT", "DESERIALIZATION", "OTHER")
    return G.category_view(f.select("ordinal", cat.alias("category"), (F.col("line") % 4 == 0).alias("sanitised"), (F.col("ordinal") % 10 / 10).alias("certainty")))


def invariant_violations(spark, sf):
    f, i = findings(spark, sf), F.col("ordinal")
    c = f.select("ordinal", pick(i, "ADMIN", "AUTH", "TENANT").alias("needs"), pick(F.floor(i / 3), "ANONYMOUS", "AUTHENTICATED", "ADMINISTRATOR").alias("role"), (F.floor(i / 3) % 3 > 0).alias("authenticated"), F.when(F.col("line") % 2 == 0, F.lit("t1")).alias("tenant"))
    return G.invariant_violations(c)


def merged_flows(spark, sf):
    f = findings(spark, sf)
    first = f.where("line < 30").select("file_path", "category", "ordinal")
    return G.merged_flows(first, f.where("line >= 20").select("file_path", "category", F.concat(F.lit("p"), "rule_id").alias("proof")), ["file_path", "category"])


def queue_status(spark, sf):
    e = table(spark, sf, "events")
    return G.queue_status(e.select((F.col("user_id") % 20).alias("repo"), pick(F.col("event_id"), "QUEUED", "RUNNING", "DONE", "DEAD", "OBSOLETE", "OTHER").alias("status")))


def finding_page(spark, sf):
    return G.finding_page(findings(spark, sf), 2, 25)


# --- layers and services ----------------------------------------------------------------------

KINDS = ("INGRESS", "SERVICE", "WORKLOAD", "DATASTORE", "IAM", "SAST", "SCA", "INFRA", "OTHER")


def layer_edges(spark, sf):
    p = table(spark, sf, "part")
    return L.layer_edges(p.select(F.col("p_size").cast("string").alias("repo"), F.concat(F.lit("r"), "p_partkey").alias("id"), pick(F.col("p_partkey"), *KINDS).alias("kind")))


#: Functions of each snippet, and whether their text holds a dangerous call.
FUNCTIONS = {
    "shell": [("helper", True), ("run", True)], "files": [("item", False)], "query": [("query", True)], "safe": [("safe", True)], "locks": [("both", False), ("reverse", False)], "order": [("one_way", False)], "odd": [("odd", True)],
    "fetch": [("fetch", False)], "chain": [("c0", False), ("c1", False), ("c2", False), ("c3", False), ("c4", True)], "tasks": [("work", False), ("step", False), ("begin", False)], "token": [("token", False)],
}


def _knowledge(spark, sf):
    return L.knowledge_graph(python_facts(K.modules(spark, sf), L.GRAPH_KINDS, ("function",)))


def knowledge_nodes(spark, sf):
    return _knowledge(spark, sf)[0]


def knowledge_edges(spark, sf):
    return _knowledge(spark, sf)[1]


def public_edges(spark, sf):
    """What flows from route handlers into dangerous calls."""
    nodes, edges = _knowledge(spark, sf)
    return L.public_edges(edges, nodes.withColumn("is_entry", F.col("name").isin("run", "item", "fetch", "query")))


def _service_files(spark, sf):
    i = F.col("doc_id")
    folder = pick(i, "gateway/", "billing/", "services/orders/", "a/b/c/d/deep/", "", "my-auth/", "web/")
    name = F.when(i % 7 == 6, "package.json").otherwise(F.concat(F.lit("f"), i.cast("string"), pick(F.floor(i / 7), ".py", ".js", ".py")))
    line = pick(i, "requests.get('http://billing/api')", "x = 1", "httpx.post(\"http://orders.local/\" )", "", "axios.put( 'http://web')", "fetch('/orders/1')", "{}")
    return table(spark, sf, "documents").select(F.concat(folder, name).alias("path"), F.concat(F.lit("# 1\n"), line, F.lit("\n")).alias("content"))


ADVISORIES = (("ADV-6", "six", "1.0.0", "1.16.0", False), ("ADV-7", "idna", "0.0.0", "3.8.0", False), ("ADV-8", "left", "2.0.0", None, None))


def sca_scan(spark, sf):
    """Manifests of the corpus against advisories, with calls of its modules."""
    deps = manifest_dependencies(K.other_files(spark, sf, "requirements", "npm"))
    ranges = spark.createDataFrame(ADVISORIES, "id string, package string, introduced string, until string, inclusive boolean")
    fixes = spark.createDataFrame([("six", "1.16.0"), ("idna", "3.8.0")], "name string, fix string")
    vulnerable = spark.createDataFrame([("six", "ADV-6", ["six.moves"]), ("idna", "ADV-7", ["jwt.decode"])], "name string, id string, functions array<string>")
    calls = python_facts(K.modules(spark, sf), ("call",), ()).select(F.concat_ws(":", "path", "fn").alias("fn"), F.col("resolved").alias("callee"), F.lit(False).alias("endpoint"))
    return sca.scan(deps, ranges, fixes, vulnerable, calls)


GO = 'func getUser(c *Context) {\n  id := c.Query("id")\n  load(id)\n}\nfunc load(id string) {\n  runIt(id)\n}\nfunc runIt(q string) {\n  db.Query(q)\n}\n'
CALLER = "def handler_a(request):\n    v = request.args\n    shared(v)\n\ndef offline(x):\n    os.system(x)\n"


def polyglot_flows(spark, sf):
    """Flows over files of two languages; the only function ``shared`` is called from many files."""
    i = F.col("doc_id")
    files = table(spark, sf, "documents").select(F.concat(F.lit("f"), i.cast("string"), pick(i, ".go", ".py")).alias("path"), F.when(i == 3, "def shared(v):\n    os.system(v)\n").otherwise(pick(i, GO, CALLER)).alias("content"))
    return PM.flows(exploded(files, ["path"], "content")).select("start", "node", "sink", "category", "severity")


def exploit_labels(spark, sf):
    """All flows with their label, those that were made safe among them."""
    return labelled_flows(K.modules(spark, sf)).select("path", "fn", "sink", "sink_line", "label")


def callback_edges(spark, sf):
    return C.callback_edges(python_facts(K.modules(spark, sf), ("call", "function"), ()))


def constant_sets(spark, sf):
    """What names reflection may reach."""
    return CS.constant_sets(K.modules(spark, sf)).select("path", "line", "call", F.array_join("values", ",").alias("values"), "state")


def module_outline(spark, sf):
    """Functions of the modules by their lines alone, after the line with the text."""
    lines = exploded(K.modules(spark, sf), ["path"], "content").where("line_no > 1")
    return ST.outline(lines).where("node = 'FUNCTION'").select("path", "name")


def line_routes(spark, sf):
    lines = exploded(K.modules(spark, sf), ["path"], "content").where("line_no > 1")
    return ST.line_routes(lines).select("path", "framework", "method", "route", "guarded")


def ranked_attack_paths(spark, sf):
    """Paths of up to four steps between suppliers' classes, riskiest first, three of each pair and fifty in all."""
    e = edges(spark, sf)
    starts = spark.createDataFrame([(0,), (5,), (7,)], "node long")
    risk = e.select(F.col("src").alias("node")).distinct().select("node", (F.col("node") % 7).cast("double").alias("risk"))
    targets = spark.createDataFrame([(n,) for n in (11, 23, 36, 2, 8)], "node long")
    top = graph.best_paths(e, starts, targets, risk, 4, 3).orderBy(F.desc("risk"), F.size("path"), "path").limit(50)
    return top.select("start", "node", F.array_join("path", ">").alias("path"), "risk")


def service_discovery(spark, sf):
    return L.services(_service_files(spark, sf))


def service_api_calls(spark, sf):
    return L.api_calls(exploded(_service_files(spark, sf), ["path"], "content"))


def cross_service_paths(spark, sf):
    f = _service_files(spark, sf)
    return L.cross_service_paths(L.services(f), L.api_calls(exploded(f, ["path"], "content")))


QUERIES = {f.__name__: f for f in (redactions, masked_values, path_predicates, secret_privilege, identifier_types, pep440_matches, constraint_conflicts, constraint_overlap, constraint_algebra, tamper_warnings, npm_reachability, locked_versions, dependency_reachability, duplicate_relations, cluster_keys, policy_profile, threshold_gate, category_view, invariant_violations, merged_flows, queue_status, finding_page, layer_edges, knowledge_nodes, knowledge_edges, public_edges, sca_scan, polyglot_flows, exploit_labels, callback_edges, constant_sets, module_outline, line_routes, ranked_attack_paths, service_discovery, service_api_calls, cross_service_paths)}


def _replaced(text: str, patterns) -> str:
    for pattern, shown in patterns:
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(shown.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
    return text


def _picked(n: str, *values) -> str:
    return "[" + ", ".join(map(_q, values)) + f"][({n}) % {len(values)} + 1]"


_T = "coalesce(text, '')"
_WORD = "split_part(text, ' ', 2)"
_RED = f"CASE WHEN length(trim({_WORD})) > 8 THEN left(trim({_WORD}), 4) || repeat('*', length(trim({_WORD})) - 8) || right(trim({_WORD}), 4) ELSE '[REDACTED]' END"
_PATHS = f"p AS (SELECT doc_id, {_picked('doc_id', '/srv/tests/', '/srv/docs/', '/srv/api/', '/srv/.github/workflows/', 'src/')} || source || {_picked('doc_id // 5', '.py', '.md', '.yml', '.exe', '', '.spec.ts')} AS path, source, text FROM documents)"
_WORDS = "test|mock|dummy|fake|example|sample|sandbox|placeholder|demo"
_KEYNAME = _picked("doc_id", "api_key", "name", "test_key")
_CON = f"c AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS name, {_picked('p_size', '>=2,<3', '>=3', '==1.0.0', '<2.19', '')} AS spec FROM part)"
_SERVICE_FILES = f"""f AS (SELECT doc_id, {_picked('doc_id', 'gateway/', 'billing/', 'services/orders/', 'a/b/c/d/deep/', '', 'my-auth/', 'web/')} || CASE WHEN doc_id % 7 = 6 THEN 'package.json' ELSE 'f' || doc_id || {_picked('doc_id // 7', '.py', '.js', '.py')} END AS path,
  {_picked('doc_id', 'gateway', 'billing', 'orders', 'deep', 'root_service', 'my-auth', 'web')} AS service, doc_id % 7 AS k FROM documents)"""
_SERVICES = f"{_SERVICE_FILES}, s AS (SELECT service, max(CASE WHEN k = 6 THEN 1 ELSE 0 END) AS js FROM f WHERE k <> 3 AND (k = 6 OR path LIKE '%.py') GROUP BY service), v AS (SELECT service, CASE WHEN js = 1 THEN 'JAVASCRIPT' ELSE 'PYTHON' END AS language, CASE WHEN service IN ('gateway', 'my-auth') THEN 'PUBLIC_API' ELSE 'INTERNAL_SERVICE' END AS boundary FROM s)"
_API = "a AS (SELECT service, path, 2 AS line_no, ['GET', '', 'POST', '', 'PUT', 'GET'][k + 1] AS method, ['http://billing/api', '', 'http://orders.local/', '', 'http://web', '/orders/1'][k + 1] AS url FROM f WHERE k IN (0, 2, 4, 5))"
_FN = K.placed(["name", "danger"], FUNCTIONS)
_NODES = f"nodes AS (SELECT 'module:' || path AS id, 'MODULE' AS type, path AS name, 10.0::DOUBLE AS risk FROM (SELECT {K.PATH} AS path FROM documents) UNION ALL SELECT 'fn:' || path || ':' || name, 'FUNCTION', name, 20.0 FROM fns UNION ALL SELECT 'sink:' || path || ':' || name, 'TAINT_SINK', 'Sink in ' || name, 85.0 FROM fns WHERE danger)"
_ENDS = lambda kinds: "(" + " OR ".join(f"(a.kind = {_q(k)} AND b.kind IN ({', '.join(map(_q, below))}))" for k, below in kinds.items()) + ")"
_CASES = "CASE " + " ".join(f"WHEN category = {_q(c)} THEN {{'rule_id': {_q(r)}, 'severity': {_q(s)}, 'risk_score': {x}::DOUBLE, 'cwe': {_q(w)}}}" for c, r, s, x, w in G.CATEGORIES) + " END"
_VULN = "(VALUES " + ", ".join(f"({_q(n)}, {_q(i)}, {'[]::VARCHAR[]' if not f else '[' + ', '.join(map(_q, f)) + ']'})" for n, i, f in VULNERABLE) + ") t(name, id, functions)"
SQL = {
    "redactions": f"SELECT doc_id, md5({_replaced(_T, R.REPORT_PATTERNS)}) AS report, md5({_replaced(f'replace({_T}, ' + _q('the ') + ', ' + _q('[REDACTED_SECRET]') + ')', R.LOG_PATTERNS)}) AS log, md5({_replaced(_T, [R.PAYLOAD])}) AS payload, md5(CASE WHEN coalesce({_WORD}, '') = '' THEN {_T} ELSE replace(text, {_WORD}, {_RED}) END) AS evidence FROM documents",
    "masked_values": "WITH s AS (SELECT p_partkey, substr(p_name, 1, p_size % 12) AS v FROM part) SELECT p_partkey, CASE WHEN v = '' THEN '' WHEN length(v) <= 6 THEN '******' ELSE left(v, 3) || '****' || right(v, 3) END AS comment, CASE WHEN length(v) < 8 THEN '********' ELSE left(v, 4) || '****' || right(v, 4) END AS token FROM s",
    "path_predicates": f"WITH {_PATHS} SELECT doc_id, regexp_matches(path, {_q(P.TEST_PATH)}) AS test, regexp_matches(path, {_q(P.DOC_PATH)}) AS documentation, regexp_matches(path, {_q(P.CI_PATH)}) AS pipeline, regexp_matches(lower(path), {_q(P.SECURITY_PATH)}) AS security, NOT (doc_id // 5 % 6 = 3) AS scanned, ['py', 'md', 'yml', 'exe', '', 'ts'][doc_id // 5 % 6 + 1] AS ext FROM p",
    "secret_privilege": f"WITH {_PATHS} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'DATABASE' WHEN 1 THEN CASE WHEN regexp_matches(lower(coalesce(text, '')), 'admin|root') THEN 'ADMINISTRATIVE' ELSE 'CLOUD' END WHEN 2 THEN 'SIGNING' ELSE CASE WHEN regexp_matches(lower(coalesce(text, '')), 'admin|master|root') THEN 'ADMINISTRATIVE' WHEN regexp_matches(lower(coalesce(text, '')), 'write|upload') THEN 'WRITE' WHEN regexp_matches(lower(coalesce(text, '')), 'read|fetch') THEN 'READ' ELSE 'UNKNOWN' END END AS privilege, CASE WHEN doc_id % 3 = 2 OR regexp_matches(lower(source), '{_WORDS}') THEN 'LOW' WHEN regexp_matches(path, {_q(P.TEST_PATH)}) THEN 'MEDIUM' WHEN doc_id % 3 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, (doc_id % 3 = 2 OR regexp_matches(lower(source), '{_WORDS}') OR regexp_matches(path, {_q(P.TEST_PATH)})) AS is_test FROM p",
    "identifier_types": f"SELECT p_partkey, {_picked('p_partkey', 'CVE', 'GHSA', 'PYSEC', 'OSV', 'UNKNOWN')} AS type FROM part",
    "pep440_matches": f"""{_DEPS} SELECT ord, spec, CASE spec WHEN '>=1.0,<3.4.5' THEN k >= [1,0,0,1] AND k < [3,4,5,1] AND k[4] = 1 WHEN '~=4.2' THEN k >= [4,2,0,1] AND k[1] = 4 AND k[4] = 1 WHEN '==5.*' THEN k[1] = 5 AND k[4] = 1
      WHEN '!=2.0.0' THEN k <> [2,0,0,1] AND k[4] = 1 ELSE k >= [3,0,0,0] END AS fits FROM named, (VALUES {', '.join(f'({_q(s)})' for s in SPECS)}) t(spec)""",
    "constraint_algebra": _algebra_sql(),
    "constraint_conflicts": f"WITH {_CON} SELECT a.name, a.spec AS first, b.spec AS second, TRUE AS empty, TRUE AS sampled FROM c a JOIN c b ON a.name = b.name WHERE (a.spec, b.spec) IN (('<2.19', '>=3'), ('==1.0.0', '>=2,<3'), ('==1.0.0', '>=3'), ('>=2,<3', '>=3'))",
    "constraint_overlap": f"WITH {_CON} SELECT name, spec, id, ends FROM c, (VALUES ('ADV-1', 'STANDARD', '>=2,<3', TRUE), ('ADV-1', 'STANDARD', '<2.19', TRUE), ('ADV-1', 'STANDARD', '', TRUE), ('ADV-2', 'PROMO', '<2.19', TRUE), ('ADV-2', 'PROMO', '', TRUE), ('ADV-2', 'PROMO', '>=2,<3', FALSE), ('ADV-2', 'PROMO', '>=3', FALSE), ('ADV-2', 'PROMO', '==1.0.0', FALSE), ('ADV-3', 'STANDARD', '==1.0.0', TRUE), ('ADV-3', 'STANDARD', '<2.19', TRUE), ('ADV-3', 'STANDARD', '', TRUE)) t(id, package, fits, ends) WHERE name = package AND spec = fits",
    "tamper_warnings": "SELECT p_partkey AS name, 'UNENCRYPTED_SOURCE' AS warning, 'HIGH' AS severity FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 'SUSPICIOUS_INTEGRITY_HASH', 'MEDIUM' FROM part WHERE p_size % 4 = 1",
    "npm_reachability": "SELECT DISTINCT source AS name, source IN (SELECT source FROM documents WHERE doc_id % 3 = 0) AS used FROM documents",
    "locked_versions": f"{_DEPS}, t AS (SELECT n.ord, n.size, n.version, n.k, split_part(p_type, ' ', 2) AS name FROM named n JOIN part ON ord = p_partkey), d AS (SELECT name, arg_max(version, (k, version)) AS asked FROM t WHERE size <= 20 GROUP BY name), l AS (SELECT name, arg_max(version, (k, version)) AS got FROM t WHERE size >= 15 AND name <> 'TIN' GROUP BY name) SELECT coalesce(d.name, l.name) AS name, coalesce(got, asked) AS version, asked IS NOT NULL AS is_direct FROM d FULL JOIN l ON d.name = l.name",
    "dependency_reachability": f"WITH v AS (SELECT * FROM {_VULN}), n AS (SELECT name, id, unnest(list_append(functions, name)) AS needle FROM v), c AS (SELECT 'f' || p_partkey AS fn, replace(lower(p_name), ' ', '.') AS callee, p_size % 7 = 0 AS endpoint FROM part), h AS (SELECT n.name, n.id, bool_or(endpoint) AS endpoint, count(DISTINCT fn) AS callers, arg_min(fn, (NOT endpoint, fn)) AS entry FROM n JOIN c ON contains(callee, lower(needle)) GROUP BY ALL) SELECT v.name, v.id, callers IS NOT NULL AS reachable, CASE WHEN endpoint THEN 'CONFIRMED' WHEN callers > 0 THEN 'HIGH' ELSE 'LOW' END AS confidence, coalesce(callers, 0) AS callers, entry FROM v LEFT JOIN h USING (name, id)",
    "duplicate_relations": f"{FINDINGS}, r AS (SELECT ordinal, first_value(ordinal) OVER (PARTITION BY file_path, line, rule_id ORDER BY flow DESC, weight DESC, mult DESC, ordinal) AS duplicate_of FROM findings) SELECT *, 'DUPLICATE' AS relation FROM r WHERE ordinal <> duplicate_of",
    "cluster_keys": f"{FINDINGS} SELECT CASE WHEN ordinal % 4 = 0 THEN rule_id || ':' || title ELSE file_path || ':' || line || ':' || rule_id END AS cluster, count(*) AS members FROM findings GROUP BY 1",
    "policy_profile": f"{FINDINGS}, g AS (SELECT project, count(*) FILTER (severity = 'CRITICAL') > 0 AS a, max(risk_score) / 10 >= 8.0 AS b FROM findings WHERE ordinal % 3 = 0 AND (severity <> 'CRITICAL' OR project % 2 = 0) GROUP BY project) SELECT project, CASE WHEN a OR b THEN 'FAIL' ELSE 'PASS' END AS status, 3 - a::INT - b::INT AS passed, a::INT + b::INT AS failed, (a OR b)::INT AS exit_code, concat_ws(',', CASE WHEN a THEN 'POL-NO-CRITICAL' END, CASE WHEN b THEN 'POL-NO-HIGH-RISK' END) AS violations FROM g",
    "threshold_gate": f"{FINDINGS} SELECT project, (bool_or(severity IN ('CRITICAL', 'HIGH')) OR max(risk_score) >= 80)::INT AS exit_code FROM findings WHERE (severity <> 'CRITICAL' OR project % 2 = 0) AND (severity <> 'HIGH' OR project % 3 = 0) GROUP BY project",
    "category_view": f"{FINDINGS}, e AS (SELECT ordinal, {_picked('ordinal', 'SQL', 'SHELL_EXEC', 'HTTP_REQUEST', 'FILESYSTEM', 'HTML_OUTPUT', 'DESERIALIZATION', 'OTHER')} AS category, line, (ordinal % 10) / 10 AS certainty FROM findings), h AS (SELECT *, {_CASES} AS h FROM e WHERE line % 4 <> 0) SELECT ordinal, h.rule_id, h.severity, h.risk_score, h.cwe, CASE WHEN category <> 'SQL' OR certainty > 0.8 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM h WHERE h IS NOT NULL",
    "invariant_violations": f"{FINDINGS}, v AS (SELECT ordinal, CASE WHEN ordinal % 3 = 0 AND (ordinal // 3) % 3 <> 2 THEN 'admin_endpoint_requires_admin_role' WHEN ordinal % 3 = 1 AND (ordinal // 3) % 3 = 0 THEN 'sensitive_operation_requires_auth' WHEN ordinal % 3 = 2 AND line % 2 <> 0 THEN 'tenant_isolation_required' END AS invariant FROM findings) SELECT * FROM v WHERE invariant IS NOT NULL",
    "merged_flows": f"{FINDINGS}, a AS (SELECT file_path, category, ordinal, ordinal = min(ordinal) OVER (PARTITION BY file_path, category) AS lead FROM findings WHERE line < 30), b AS (SELECT file_path, category, 'p' || rule_id AS proof FROM findings WHERE line >= 20), m AS (SELECT file_path, category, min(proof) AS proof FROM b GROUP BY ALL) SELECT a.file_path, a.category, a.ordinal, CASE WHEN lead THEN m.proof END AS proof FROM a LEFT JOIN m USING (file_path, category) UNION ALL SELECT file_path, category, NULL, proof FROM b WHERE (file_path, category) NOT IN (SELECT (file_path, category) FROM a)",
    "queue_status": "SELECT user_id % 20 AS repo, count(*) FILTER (event_id % 6 = 0) AS queued, count(*) FILTER (event_id % 6 = 1) AS running, count(*) FILTER (event_id % 6 = 2) AS done, count(*) FILTER (event_id % 6 = 3) AS dead, count(*) FILTER (event_id % 6 = 4) AS obsolete FROM events GROUP BY 1",
    "finding_page": f"{FINDINGS} SELECT ordinal AS id, title, severity, confidence, file_path AS file, line, risk_score, state FROM findings ORDER BY risk_score DESC, ordinal LIMIT 25 OFFSET 50",
    "layer_edges": f"WITH r AS (SELECT DISTINCT p_size::VARCHAR AS repo, 'r' || p_partkey AS id, {_picked('p_partkey', *KINDS)} AS kind FROM part), j AS (SELECT a.id AS up, b.id AS down, a.repo, b.kind FROM r a JOIN r b ON a.repo = b.repo AND {_ENDS(L.LAYERS)}) SELECT DISTINCT up AS src, 'hub:' || repo || ':' || kind AS dst FROM j UNION ALL SELECT DISTINCT 'hub:' || repo || ':' || kind, down FROM j",
    "knowledge_nodes": f"WITH fns AS ({_FN}), {_NODES} SELECT * FROM nodes",
    "knowledge_edges": f"WITH fns AS ({_FN}) SELECT 'project' AS src, 'module:' || {K.PATH} AS dst, 'CONTAINS' AS relation FROM documents UNION ALL SELECT 'module:' || path, 'fn:' || path || ':' || name, 'CONTAINS' FROM fns UNION ALL SELECT 'fn:' || path || ':' || name, 'sink:' || path || ':' || name, 'FLOWS_TO' FROM fns WHERE danger",
    "public_edges": f"WITH fns AS ({_FN}) SELECT name AS source, 'Sink in ' || name AS target, 'FLOWS_TO' AS relation, 85.0::DOUBLE AS risk FROM fns WHERE danger AND name IN ('run', 'item', 'fetch', 'query')",
    "sca_scan": f"WITH d AS ({K.found(['name', 'version'], {'requirements': [[('six', '1.16.0'), ('idna', '3.7')], [('six', '1.15.0')]]})}), n AS (SELECT count(*) AS callers FROM documents WHERE doc_id % 12 = 0) SELECT path, name, version, CASE name WHEN 'six' THEN 'ADV-6' ELSE 'ADV-7' END AS id, name = 'idna' AND callers > 0 AS reachable, CASE WHEN name = 'idna' AND callers > 0 THEN 'HIGH' ELSE 'LOW' END AS confidence, CASE name WHEN 'idna' THEN callers ELSE 0 END AS callers, 'UPGRADE' AS action, CASE name WHEN 'six' THEN '1.16.0' ELSE '3.8.0' END AS fix, 'LOW' AS impact FROM d, n WHERE version <> '1.16.0'",
    "polyglot_flows": "SELECT 'f' || doc_id || '.go:getUser' AS start, 'f' || doc_id || '.go:runIt' AS node, 'db.Query' AS sink, 'SQL' AS category, 'CRITICAL' AS severity FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'f' || doc_id || '.py:handler_a', 'f3.py:shared', 'os.system', 'SHELL_EXEC', 'CRITICAL' FROM documents WHERE doc_id % 2 = 1 AND doc_id <> 3 AND EXISTS (SELECT 1 FROM documents WHERE doc_id = 3)",
    "exploit_labels": K.placed(["fn", "sink", "sink_line", "label"], {k: [(r[0], r[5], r[7], "HIGHLY_LIKELY") for r in rows] + ([("safe", "os.system", 4, "NOT_EXPLOITABLE"), ("safe", "eval", 6, "NOT_EXPLOITABLE")] if k == "safe" else []) for k, rows in FLOWS.items()}, ("sink_line",)),
    "callback_edges": f"SELECT path || ':begin' AS src, path || ':work' AS dst FROM ({K.placed(['x'], {'tasks': [(1,)]})})",
    "constant_sets": K.placed(["line", "call", "values", "state"], {"odd": [(2, "getattr", "", "UNKNOWN"), (3, "getattr", "known", "EXACT")]}),
    "module_outline": f"SELECT path, name FROM ({_FN})",
    "line_routes": K.placed(["framework", "method", "route", "guarded"], {"shell": [("Flask", "ROUTE", "/run", False)], "files": [("FastAPI", "GET", "/file/<id>", False)], "fetch": [("FastAPI", "POST", "/fetch", False)]}),
    "ranked_attack_paths": f"WITH RECURSIVE {EDGES}, starts AS (SELECT unnest([0, 5, 7])::BIGINT AS node){_WALK(4)}, w AS (SELECT start, node, path, unnest(path) AS x FROM walk WHERE node IN (11, 23, 36, 2, 8) AND len(path) > 1), p AS (SELECT start, node, path, coalesce(max(CASE WHEN src IS NOT NULL THEN x % 7 END), 0)::DOUBLE AS risk FROM w LEFT JOIN (SELECT DISTINCT src FROM edges) ON x = src GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY risk DESC, len(path), path) AS n FROM p) SELECT start, node, array_to_string(path, '>') AS path, risk FROM r WHERE n <= 3 ORDER BY risk DESC, len(r.path), r.path LIMIT 50",
    "service_discovery": f"WITH {_SERVICES} SELECT * FROM v",
    "service_api_calls": f"WITH {_SERVICE_FILES}, {_API} SELECT * FROM a",
    "cross_service_paths": f"WITH {_SERVICES}, {_API} SELECT DISTINCT a.service, method, url, i.service AS target, 8.5::DOUBLE AS risk FROM a JOIN v p ON a.service = p.service AND p.boundary = 'PUBLIC_API' JOIN v i ON i.boundary = 'INTERNAL_SERVICE' AND contains(lower(url), lower(i.service))",
}
