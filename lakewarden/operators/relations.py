"""Joins whose keys are parts of strings, and relations between findings, packages, services and layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pep440
from ..functions.ranks import confidence_multiplier, is_flow, severity_weight
from ..functions.versions import version_key
from .graph import _cut

GRAM = 3


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Rows of both sides where the text contains the needle, case aside; empty needles fit nothing.

    Distinct texts meet distinct needles on the needle's first three characters, an equi-join that Spark splits,
    and are then compared; needles of one or two characters meet on those. Columns must not clash.
    """
    t = texts.select(F.col(text).alias("_t")).where("_t is not null").distinct()
    n = needles.select(F.col(needle).alias("_n")).where("_n <> ''").distinct()
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(F.lower("_t")), F.lit(1))), lambda i: F.transform(F.array(*map(F.lit, range(1, GRAM + 1))), lambda k: F.substr(F.lower("_t"), i, k)))))
    pairs = t.select("_t", F.explode(grams).alias("_g")).join(n.select("_n", F.left(F.lower("_n"), F.lit(GRAM)).alias("_g")), "_g")
    pairs = pairs.where(F.contains(F.lower("_t"), F.lower("_n"))).select("_t", "_n").distinct()
    return texts.join(pairs, F.col(text) == F.col("_t")).drop("_t").join(needles, F.col("_n") == F.col(needle)).drop("_n")


def duplicate_relations(findings: DataFrame, key: Column, ordinal: str = "ordinal") -> DataFrame:
    """(ordinal, duplicate_of): every finding that a stronger one of its key stands for.

    The strongest is found by a partial aggregate; the others join it, so a hot key is split and no list grows.
    """
    strength = F.struct(is_flow(F.col("category")).alias("flow"), severity_weight(F.col("severity")).alias("w"), confidence_multiplier(F.col("confidence")).alias("m"), (-F.col(ordinal)).alias("o"))
    f = findings.select(key.alias("_k"), F.col(ordinal).alias("ordinal"), strength.alias("s"))
    best = f.groupBy("_k").agg(F.max_by("ordinal", "s").alias("duplicate_of"))
    return f.join(best, "_k").where("ordinal <> duplicate_of").select("ordinal", "duplicate_of", F.lit("DUPLICATE").alias("relation"))


def keyed_clusters(findings: DataFrame) -> DataFrame:
    """Cluster key of each finding: file:line:rule, or rule:title without a file."""
    place = F.concat_ws(":", "file_path", F.col("line").cast("string"), "rule_id")
    return findings.withColumn("cluster", F.when(F.coalesce("file_path", F.lit("")) == "", F.concat_ws(":", "rule_id", "title")).otherwise(place))


# --- packages ---------------------------------------------------------------------------------


def conflicting_constraints(deps: DataFrame) -> DataFrame:
    """(name, first, second, empty, sampled): constraints of one package that can't hold together.

    ``empty``: their ranges have no version in common. ``sampled``: none of some tried versions fits both, as plain scanners
    judge; it takes narrow ranges for conflicts. Constraints are made distinct and their ranges found before they meet.
    """
    c = deps.select("name", "spec").where("spec <> ''").distinct().withColumn("ranges", pep440.spec_ranges(F.col("spec")))
    pairs = c.withColumnsRenamed({"spec": "first", "ranges": "r1"}).join(c.withColumnsRenamed({"spec": "second", "ranges": "r2"}), "name").where("first < second")
    judged = pairs.select("name", "first", "second", (F.size(pep440.intersect(F.col("r1"), F.col("r2"))) == 0).alias("empty"), pep440.conflicting(F.col("first"), F.col("second")).alias("sampled"))
    return judged.where("empty or sampled")


def constraint_overlaps(deps: DataFrame, ranges: DataFrame) -> DataFrame:
    """deps(name, spec) with the advisories whose interval has a version that fits the constraint; ``ends``: an end of it fits."""
    inclusive = F.col("inclusive") if "inclusive" in ranges.columns else None
    r = ranges.withColumnRenamed("package", "name").withColumn("hit", pep440.affected_ranges(F.col("introduced"), F.col("until"), inclusive))
    c = deps.select("name", "spec").distinct().withColumn("fit", pep440.spec_ranges(F.col("spec")))
    pairs = c.join(r, "name").where(F.size(pep440.intersect(F.col("fit"), F.col("hit"))) > 0)
    return pairs.groupBy("name", "spec", "id").agg(F.max(pep440.overlaps(F.col("spec"), F.col("introduced"), F.col("until"))).alias("ends"))


def constraint_algebra(rows: DataFrame) -> DataFrame:
    """``rows(first, second, introduced, until, ...)`` with conflict (no version fits both), exposed (the first takes a version of the interval) and safe_ranges (the first's outside it).

    What rows repeat is found once: the ranges of each distinct specifier and interval, then the verdict of each distinct four;
    to the rows it comes by a join, nulls alike.
    """
    parts = 2 * rows.sparkSession.sparkContext.defaultParallelism  # few bytes, much work each: not to be merged into one task
    key = ["first", "second", "introduced", "until"]
    spec = _cut(rows.select(F.col("first").alias("spec")).union(rows.select("second")).distinct().repartition(parts).withColumn("ranges", pep440.spec_ranges(F.col("spec"))))
    span = _cut(rows.select("introduced", "until").distinct().repartition(parts).withColumn("hit", pep440.affected_ranges(F.col("introduced"), F.col("until"))))
    each = rows.select(*key).distinct()
    for side, r in (("first", "r1"), ("second", "r2")):
        each = each.join(spec.select(F.col("spec").alias("_s"), F.col("ranges").alias(r)), F.col(side).eqNullSafe(F.col("_s"))).drop("_s")
    each = each.join(span.withColumnsRenamed({"introduced": "_i", "until": "_u"}), F.col("introduced").eqNullSafe(F.col("_i")) & F.col("until").eqNullSafe(F.col("_u")))
    meet = lambda x, y: F.size(pep440.intersect(x, y))
    r1, r2, hit = F.col("r1"), F.col("r2"), F.col("hit")
    judged = each.repartition(parts).select(*(F.col(c).alias(f"_{c}") for c in key), (meet(r1, r2) == 0).alias("conflict"), (meet(r1, hit) > 0).alias("exposed"), meet(r1, pep440.complement(hit)).alias("safe_ranges"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key))
    return rows.join(_cut(judged), same).drop(*(f"_{c}" for c in key))


def call_reachability(vulnerable: DataFrame, calls: DataFrame) -> DataFrame:
    """Per (package, id) whether code calls the package or a vulnerable function.

    ``vulnerable(name, id, functions)``, ``calls(fn, callee, endpoint)``. CONFIRMED from an endpoint, HIGH from
    other code, LOW (not reachable) without a call.
    """
    needles = vulnerable.select("name", "id", F.explode(F.array_union(F.array("name"), F.coalesce("functions", F.array().cast("array<string>")))).alias("needle"))
    hit = contains_join(calls.select("fn", "callee", "endpoint").distinct(), "callee", needles, "needle")
    hit = hit.groupBy("name", "id").agg(F.max("endpoint").alias("endpoint"), F.countDistinct("fn").alias("callers"), F.min_by("fn", F.struct(~F.col("endpoint"), "fn")).alias("entry"))
    out = vulnerable.select("name", "id").distinct().join(hit, ["name", "id"], "left")
    return out.select("name", "id", F.col("callers").isNotNull().alias("reachable"), F.when(F.col("endpoint"), "CONFIRMED").when(F.col("callers") > 0, "HIGH").otherwise("LOW").alias("confidence"), F.coalesce("callers", F.lit(0)).alias("callers"), "entry")


def imported_packages(deps: DataFrame, imports: DataFrame) -> DataFrame:
    """deps(name) with ``used``: whether a module imports the package itself or a path below it."""
    top = F.when(F.startswith("module", F.lit("@")), F.concat_ws("/", F.slice(F.split("module", "/"), 1, 2))).otherwise(F.split("module", "/")[0])
    used = imports.select(top.alias("name")).distinct().withColumn("_u", F.lit(True))
    return deps.join(used, "name", "left").withColumn("used", F.coalesce("_u", F.lit(False))).drop("_u")


def locked_versions(direct: DataFrame, locked: DataFrame) -> DataFrame:
    """name, version, is_direct: declared packages take the lock file's version; the others are transitive."""
    latest = F.max_by("version", F.struct(version_key(F.col("version")), F.col("version")))  # 10.0 comes after 9.0
    d = direct.groupBy("name").agg(latest.alias("asked"))
    k = locked.groupBy("name").agg(latest.alias("got"))
    return d.join(k, "name", "full_outer").select("name", F.coalesce("got", "asked").alias("version"), F.col("asked").isNotNull().alias("is_direct"))


def tamper_warnings(deps: DataFrame) -> DataFrame:
    """deps(name, url, integrity): sources without encryption, checksums of no known form."""
    weak = (F.coalesce("integrity", F.lit("")) != "") & ~F.col("integrity").rlike("^sha(256|512)-") & (F.length("integrity") < 32)
    hits = F.array_compact(F.array(F.when(F.contains("url", F.lit("http://")), F.struct(F.lit("UNENCRYPTED_SOURCE").alias("warning"), F.lit("HIGH").alias("severity"))), F.when(weak, F.struct(F.lit("SUSPICIOUS_INTEGRITY_HASH").alias("warning"), F.lit("MEDIUM").alias("severity")))))
    return deps.withColumn("hit", F.explode(hits)).select("name", "hit.*")


# --- layers -----------------------------------------------------------------------------------

#: Layer and the layers below it: every member leads to every member of those, through one hub node.
LAYERS = {"INGRESS": ("SERVICE", "WORKLOAD"), "SERVICE": ("WORKLOAD",), "WORKLOAD": ("DATASTORE", "IAM"), "SAST": ("SCA",), "SCA": ("INFRA",)}


def layer_edges(resources: DataFrame, layers: dict = LAYERS) -> DataFrame:
    """src, dst of ``resources(repo, id, kind)``: members to a hub of the layer below, the hub to that layer's members.

    That all of one layer reach all of the next takes as many edges as there are members, not their product.
    """
    r = resources.select("repo", "id", "kind").distinct()
    hub = lambda kind: F.concat_ws(":", F.lit("hub"), "repo", kind)
    lower = F.create_map(*(x for k, below in layers.items() for x in (F.lit(k), F.array(*map(F.lit, below)))))
    down = r.withColumn("below", F.explode(lower[F.col("kind")]))
    there = r.select("repo", F.col("kind").alias("below")).distinct()
    up = down.join(there, ["repo", "below"]).select(F.col("id").alias("src"), hub(F.col("below")).alias("dst"))
    return up.union(down.select("repo", F.col("below").alias("kind")).distinct().join(r, ["repo", "kind"]).select(hub(F.col("kind")).alias("src"), F.col("id").alias("dst")))


def public_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """FLOWS_TO and REACHES edges that leave an entry point: names of both ends and the target's risk."""
    s = nodes.where("is_entry or type in ('API_ENDPOINT', 'TAINT_SOURCE')").select(F.col("id").alias("src"), F.col("name").alias("source"))
    t = nodes.select(F.col("id").alias("dst"), F.col("name").alias("target"), "risk")
    return edges.where("relation in ('FLOWS_TO', 'REACHES')").join(s, "src").join(t, "dst").select("source", "target", "relation", "risk")


#: What tells of a dangerous call in a function's text.
SINK_TEXT = ("execute(", "system(", "eval(", "requests.post(", "call(", "subprocess.")

#: Facts that ``knowledge_graph`` needs: of a file without functions that it has any.
GRAPH_KINDS = ("error", "function", "module")


def knowledge_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a project: modules, their functions, and the dangerous calls that functions hold.

    Nodes and edges are made of one written table of functions, with a row without a name for other facts of a file, so files are parsed once.
    A function's text is judged where its row is made; texts aren't shuffled. ``GRAPH_KINDS`` are the facts that suffice.
    """
    of = lambda c: F.when(F.col("kind") == "function", c)
    every = facts.select("path", of(F.col("name")).alias("name"), of(F.concat_ws(":", F.lit("fn"), F.col("path"), F.concat_ws(".", F.nullif("fn", F.lit("")), "name"))).alias("id"), F.coalesce(of(F.expr(" or ".join(f"contains(text, '{w}')" for w in SINK_TEXT))), F.lit(False)).alias("dangerous"))
    # a function that is defined again is one node with all its texts
    every = _cut(every.groupBy("path", "name", "id").agg(F.max("dangerous").alias("dangerous")))
    modules = every.select("path").distinct()
    fns = every.where("id is not null")
    hit = fns.where("dangerous")
    sink = F.concat_ws(":", F.lit("sink"), "path", "name")
    module = F.concat_ws(":", F.lit("module"), "path")
    nodes = modules.select(module.alias("id"), F.lit("MODULE").alias("type"), F.col("path").alias("name"), F.lit(10.0).alias("risk"))
    nodes = nodes.union(fns.select("id", F.lit("FUNCTION"), "name", F.lit(20.0))).union(hit.select(sink, F.lit("TAINT_SINK"), F.concat(F.lit("Sink in "), "name"), F.lit(85.0)))
    edges = modules.select(F.lit("project").alias("src"), module.alias("dst"), F.lit("CONTAINS").alias("relation"))
    edges = edges.union(fns.select(module, "id", F.lit("CONTAINS"))).union(hit.select("id", sink, F.lit("FLOWS_TO")))
    return nodes, edges


# --- services ---------------------------------------------------------------------------------

#: Outbound calls of HTTP clients; the first group is the method where there is one.
CLIENTS = (
    r"requests\.(get|post|put|delete)\(\s*['\"]([^'\"]+)['\"]",
    r"httpx\.(get|post|put|delete)\(\s*['\"]([^'\"]+)['\"]",
    r"axios\.(get|post|put|delete)\(\s*['\"]([^'\"]+)['\"]",
    r"fetch\(()\s*['\"]([^'\"]+)['\"]",
)


def services(files: DataFrame) -> DataFrame:
    """service, language, boundary: folders of at most three levels with a package.json or a Python file."""
    parts = F.split("path", "/")
    f = files.select(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("dirs"), F.element_at(parts, -1).alias("name"))
    f = f.where((F.size("dirs") <= 3) & ((F.col("name") == "package.json") | F.endswith("name", F.lit(".py"))))
    service = F.when(F.size("dirs") == 0, "root_service").otherwise(F.element_at("dirs", -1))
    g = f.groupBy(service.alias("service")).agg(F.max(F.col("name") == "package.json").alias("js"))
    return g.select("service", F.when(F.col("js"), "JAVASCRIPT").otherwise("PYTHON").alias("language"), F.when(F.lower("service").rlike("gateway|auth"), "PUBLIC_API").otherwise("INTERNAL_SERVICE").alias("boundary"))


def api_calls(lines: DataFrame) -> DataFrame:
    """service, path, line_no, method, url of outbound calls in ``lines(path, line_no, line)``: one a client and line."""
    parts = F.split("path", "/")
    found = F.array(*(F.struct(F.upper(F.regexp_extract("line", p, 1)).alias("method"), F.regexp_extract("line", p, 2).alias("url")) for p in CLIENTS))
    out = lines.withColumn("hit", F.explode(F.filter(found, lambda h: h["url"] != "")))
    return out.select(F.when(F.size(parts) == 1, "root_service").otherwise(F.element_at(parts, -2)).alias("service"), "path", "line_no", F.when(F.col("hit.method") == "", "GET").otherwise(F.col("hit.method")).alias("method"), F.col("hit.url").alias("url"))


def cross_service_paths(svc: DataFrame, calls: DataFrame) -> DataFrame:
    """Public services that call a url which names an internal one."""
    public = svc.where("boundary in ('PUBLIC_API', 'INTERNET')").select("service")
    internal = svc.where("boundary = 'INTERNAL_SERVICE'").select(F.col("service").alias("target"))
    hit = contains_join(calls.join(public, "service", "left_semi").select("service", "method", "url").distinct(), "url", internal, "target")
    return hit.select("service", "method", "url", "target", F.lit(8.5).alias("risk"))
