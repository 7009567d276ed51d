"""Queries over dependencies and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.versions import normalised, satisfies
from ..operators import diff, graph, sca
from ..operators.supply import lookalikes
from .base import EDGES, dependencies, edges, part_edges, table

#: Advisory events: id, package, position, kind, version.
ADVISORIES = (
    ("ADV-1", "small-ring-economy", 0, "introduced", "0.0.0"),
    ("ADV-1", "small-ring-economy", 1, "fixed", "3.5.0"),
    ("ADV-2", "red-widget-economy", 0, "introduced", "1.2.0"),
    ("ADV-2", "red-widget-economy", 1, "last_affected", "4.0.0"),
    ("ADV-3", "small-ring-economy", 0, "introduced", "5.0.0"),
)
FIXES = (("small-ring-economy", "3.5.0"), ("small-ring-economy", "5.9.9"), ("red-widget-economy", "4.0.1"))
CONSTRAINT = ">=1.0.0,<3.4.5||^4.2"


def _deps(spark, sf):
    return dependencies(spark, sf).select("ord", normalised(F.col("raw_name")).alias("name"), "version")


def _advisories(spark):
    return sca.intervals(spark.createDataFrame(ADVISORIES, "id string, package string, ord int, kind string, version string"))


def name_normalise(spark, sf):
    return dependencies(spark, sf).select("ord", normalised(F.col("raw_name")).alias("name"))


def semver_satisfies(spark, sf):
    return _deps(spark, sf).select("ord", "version", satisfies(F.col("version"), F.lit(CONSTRAINT)).alias("fits"))


def semver_range_join(spark, sf):
    return sca.affected(_deps(spark, sf), _advisories(spark)).select("ord", "name", "version", "id")


def advisory_status(spark, sf):
    d = _deps(spark, sf).withColumn("version", F.when(F.col("ord") % 11 > 0, F.col("version")))
    return sca.advisory_status(d, _advisories(spark), ["ord"]).groupBy("id", "status").agg(F.count("*").alias("n"))


def version_conflicts(spark, sf):
    return sca.version_conflicts(_deps(spark, sf)).select("name", F.array_join("versions", ",").alias("versions"))


def fix_recommendation(spark, sf):
    fixes = spark.createDataFrame(FIXES, "name string, fix string")
    return sca.recommended_fix(_deps(spark, sf), fixes, ["ord"])


def typosquat(spark, sf):
    """Package names one letter off a well-known brand word."""
    names = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    known = spark.createDataFrame([("widgat",), ("bolx",), ("rung",), ("greem",), ("gear",)], "known string")
    return lookalikes(names, known).withColumnRenamed("name", "word")


def dep_diff(spark, sf):
    """Small parts as the base, large ones as the head; sizes 20 to 30 are in both."""
    d = _deps(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), "p_size"), "ord")
    return diff.dependency_diff(d.where("p_size <= 30"), d.where("p_size >= 20"))


def lockfile_sync(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("name"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("name"))
    return sca.undeclared(c, e)


def _start(spark):
    return spark.createDataFrame([(0,), (5,)], "node long")


def call_reachability(spark, sf):
    """The first shortest path of each start to each target class."""
    targets = spark.createDataFrame([(i,) for i in (11, 23, 36)], "node long")
    return graph.shortest_paths(edges(spark, sf), _start(spark), targets, 8).select("start", "node", "hops", F.array_join("path", ">").alias("path"))


def attack_paths(spark, sf):
    p = graph.simple_paths(edges(spark, sf), _start(spark), 5).where("node in (11, 23, 36)")
    return p.select("start", "node", F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("hops"))


def dep_depth(spark, sf):
    return graph.levels(edges(spark, sf), _start(spark), 10).select("start", "node", F.col("level").cast("long").alias("level"))


def dep_spof(spark, sf):
    return sca.shared_parents(edges(spark, sf))


def scc_cycles(spark, sf):
    return graph.strong_components(edges(spark, sf))


def what_if(spark, sf):
    """Nodes that the starts still reach when two nodes are removed."""
    removed = spark.createDataFrame([(1,), (16,)], "node long")
    left = graph.without_nodes(edges(spark, sf), removed)
    return graph.levels(left, _start(spark), 6).select("start", "node", F.col("level").cast("long").alias("level"))


# The same over real keys; the queries above fold the keys. Recursive SQL is too slow for the cycles of these graphs, so
# there is none for them; a test holds all of these queries against brute force.


def part_reachability(spark, sf):
    """The first shortest path of each start to every part within four steps."""
    e = part_edges(spark, sf)
    return graph.shortest_paths(e, _start_parts(spark), e.select(F.col("dst").alias("node")), 4).select("start", "node", "hops", F.array_join("path", ">").alias("path"))


def part_paths(spark, sf):
    """All simple paths of up to three steps."""
    p = graph.simple_paths(part_edges(spark, sf), _start_parts(spark), 3)
    return p.select("start", "node", F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("hops"))


def part_best_paths(spark, sf):
    """The three riskiest ways of up to four steps from each start to each part of a brand; sizes are the risks, so many tie."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("node"), F.col("p_size").cast("double").alias("risk"), "p_brand")
    best = graph.best_paths(part_edges(spark, sf), _start_parts(spark), p.where("p_brand = 'Brand#7'"), p, 4, 3)
    return best.select("start", "node", F.array_join("path", ">").alias("path"), "risk")


def part_depth(spark, sf):
    return graph.levels(part_edges(spark, sf), _start_parts(spark), 10).select("start", "node", F.col("level").cast("long").alias("level"))


def part_spof(spark, sf):
    return sca.shared_parents(part_edges(spark, sf))


def part_cycles(spark, sf):
    return graph.strong_components(part_edges(spark, sf))


def part_what_if(spark, sf):
    """Parts that the starts still reach when two parts are removed."""
    left = graph.without_nodes(part_edges(spark, sf), spark.createDataFrame([(2,), (3,)], "node long"))
    return graph.levels(left, _start_parts(spark), 6).select("start", "node", F.col("level").cast("long").alias("level"))


def _start_parts(spark):
    return spark.createDataFrame([(1,), (5,)], "node long")


QUERIES = {f.__name__: f for f in (name_normalise, semver_satisfies, semver_range_join, advisory_status, version_conflicts, fix_recommendation, typosquat, dep_diff, lockfile_sync, call_reachability, attack_paths, dep_depth, dep_spof, scc_cycles, what_if, part_reachability, part_paths, part_best_paths, part_depth, part_spof, part_cycles, part_what_if)}

_VALUES = lambda rows: ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)
_KEY = lambda v: f"[split_part(split_part({v}, '-', 1), '.', 1)::INT, split_part(split_part({v}, '-', 1), '.', 2)::INT, split_part(split_part({v}, '-', 1), '.', 3)::INT, CASE WHEN contains({v}, '-') THEN 0 ELSE 1 END]"
_DEPS = f"""
WITH deps AS (SELECT p_partkey AS ord, p_size AS size,
    replace(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') || '_' || lower(p_type), ' ', '.') AS raw_name,
    (p_size % 6) || '.' || (p_partkey % 10) || '.' || floor(p_retailprice % 7)::BIGINT || CASE WHEN p_partkey % 9 = 0 THEN '-rc1' ELSE '' END AS version
  FROM part),
named AS (SELECT ord, size, lower(regexp_replace(trim(raw_name), '[-_.]+', '-', 'g')) AS name, version, {_KEY('version')} AS k FROM deps),
adv AS (SELECT id, package, version AS introduced, lead(kind) OVER w AS end_kind, lead(version) OVER w AS until, kind FROM (VALUES {_VALUES(ADVISORIES)}) t(id, package, ord, kind, version) WINDOW w AS (PARTITION BY id, package ORDER BY ord)),
ranges AS (SELECT * FROM adv WHERE kind = 'introduced'),
hit AS (SELECT n.*, r.id FROM named n JOIN ranges r ON n.name = r.package WHERE k >= {_KEY('introduced')} AND (until IS NULL OR k < {_KEY('until')} OR (end_kind = 'last_affected' AND k = {_KEY('until')})))
"""
_GRAPH = f"WITH RECURSIVE {EDGES}, starts AS (SELECT unnest([0, 5])::BIGINT AS node)"
_WALK = lambda depth, e="edges": f", walk(start, node, path) AS (SELECT node, node, [node] FROM starts UNION ALL SELECT w.start, e.dst, list_append(w.path, e.dst) FROM walk w JOIN {e} e ON w.node = e.src WHERE NOT list_contains(w.path, e.dst) AND len(w.path) <= {depth})"
_REACH = lambda depth, e="edges": f", reach(start, node, level) AS (SELECT node, node, 0 FROM starts UNION SELECT r.start, e.dst, r.level + 1 FROM reach r JOIN {e} e ON r.node = e.src WHERE r.level < {depth})"
_PARTS = "WITH RECURSIVE l AS (SELECT l_partkey::BIGINT AS src, lead(l_partkey::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem), edges AS (SELECT DISTINCT src, dst FROM l WHERE dst IS NOT NULL), starts AS (SELECT unnest([1, 5])::BIGINT AS node)"
SQL = {
    "part_reachability": f"{_PARTS}{_WALK(4)} SELECT start, node, (len(path) - 1)::INT AS hops, array_to_string(path, '>') AS path FROM walk WHERE node <> start QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY len(path), path) = 1",
    "part_paths": f"{_PARTS}{_WALK(3)} SELECT start, node, array_to_string(path, '>') AS path, len(path) - 1 AS hops FROM walk WHERE len(path) > 1",
    "part_best_paths": f"{_PARTS}{_WALK(4)}, w AS (SELECT start, node, path FROM walk JOIN part t ON t.p_partkey = node WHERE t.p_brand = 'Brand#7' AND len(path) > 1), x AS (SELECT *, unnest(path) AS n FROM w), r AS (SELECT start, node, path, coalesce(max(p_size), 0)::DOUBLE AS risk FROM x LEFT JOIN part ON p_partkey = n GROUP BY ALL) SELECT start, node, array_to_string(path, '>') AS path, risk FROM r QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY risk DESC, len(r.path), r.path) <= 3",
    "part_depth": f"{_PARTS}{_REACH(10)} SELECT start, node, min(level)::BIGINT AS level FROM reach GROUP BY ALL",
    "part_spof": f"{_PARTS} SELECT dst AS name, count(DISTINCT src) AS parents FROM edges GROUP BY dst HAVING count(DISTINCT src) >= 2",
    "part_what_if": f"{_PARTS}, rest AS (SELECT * FROM edges WHERE src NOT IN (2, 3) AND dst NOT IN (2, 3)){_REACH(6, 'rest')} SELECT start, node, min(level)::BIGINT AS level FROM reach GROUP BY ALL",
    "name_normalise": f"{_DEPS} SELECT ord, name FROM named",
    "semver_satisfies": f"{_DEPS} SELECT ord, version, ((k >= [1,0,0,1] AND k < [3,4,5,1]) OR (k >= [4,2,0,1] AND k[1] = 4)) AS fits FROM named",
    "semver_range_join": f"{_DEPS} SELECT ord, name, version, id FROM hit",
    "advisory_status": f"{_DEPS}, pairs AS (SELECT DISTINCT n.ord, n.name, n.version, r.id FROM named n JOIN ranges r ON n.name = r.package) SELECT p.id, CASE WHEN p.ord % 11 = 0 THEN 'UNKNOWN' WHEN h.id IS NOT NULL THEN 'AFFECTED' ELSE 'NOT_AFFECTED' END AS status, count(*) AS n FROM pairs p LEFT JOIN hit h ON p.ord = h.ord AND p.id = h.id GROUP BY ALL",
    "version_conflicts": f"{_DEPS} SELECT name, string_agg(version, ',' ORDER BY version) AS versions FROM (SELECT DISTINCT name, version FROM named) GROUP BY name HAVING count(*) > 1",
    "fix_recommendation": f"{_DEPS}, f AS (SELECT n.ord, n.name, n.version, n.k, t.fix, {_KEY('t.fix')} AS fk FROM named n JOIN (VALUES {_VALUES(FIXES)}) t(name, fix) ON n.name = t.name), b AS (SELECT ord, name, version, any_value(k) AS k, coalesce(arg_min(fix, fk) FILTER (fk > k), arg_max(fix, fk)) AS fix FROM f GROUP BY ord, name, version) SELECT ord, name, version, fix, CASE WHEN split_part(fix, '.', 1) <> k[1]::VARCHAR THEN 'HIGH' ELSE 'LOW' END AS impact FROM b",
    "typosquat": "WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), k AS (SELECT unnest(['widgat','bolx','rung','greem','gear']) AS known) SELECT word, known FROM w, k WHERE word <> known AND abs(length(word) - length(known)) <= 1 AND len(list_filter(range(1, least(length(word), length(known)) + 1), lambda i: word[i] <> known[i])) = 1",
    "dep_diff": f"{_DEPS}, a AS (SELECT name, arg_max(version, ord) AS old FROM named WHERE size <= 30 GROUP BY name), b AS (SELECT name, arg_max(version, ord) AS new FROM named WHERE size >= 20 GROUP BY name) SELECT * FROM (SELECT coalesce(a.name, b.name) AS name, old, new, CASE WHEN old IS NULL THEN 'ADDED' WHEN new IS NULL THEN 'REMOVED' WHEN old <> new THEN 'CHANGED' ELSE 'SAME' END AS change FROM a FULL JOIN b ON a.name = b.name) WHERE change <> 'SAME'",
    "lockfile_sync": "SELECT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
    "call_reachability": f"{_GRAPH}{_WALK(8)} SELECT start, node, (len(path) - 1)::INT AS hops, array_to_string(path, '>') AS path FROM walk WHERE node IN (11, 23, 36) AND node <> start QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY len(path), path) = 1",
    "attack_paths": f"{_GRAPH}{_WALK(5)} SELECT start, node, array_to_string(path, '>') AS path, len(path) - 1 AS hops FROM walk WHERE node IN (11, 23, 36) AND len(path) > 1",
    "dep_depth": f"{_GRAPH}{_REACH(10)} SELECT start, node, min(level)::BIGINT AS level FROM reach GROUP BY ALL",
    "dep_spof": f"WITH {EDGES} SELECT dst AS name, count(DISTINCT src) AS parents FROM edges GROUP BY dst HAVING count(DISTINCT src) >= 2",
    "scc_cycles": f"WITH RECURSIVE {EDGES}, clo(a, b) AS (SELECT src, dst FROM edges UNION SELECT c.a, e.dst FROM clo c JOIN edges e ON c.b = e.src) SELECT x.a AS node, least(min(x.b), x.a) AS component FROM clo x JOIN clo y ON x.a = y.b AND x.b = y.a GROUP BY x.a",
    "what_if": f"{_GRAPH}, rest AS (SELECT * FROM edges WHERE src NOT IN (1, 16) AND dst NOT IN (1, 16)){_REACH(6, 'rest')} SELECT start, node, min(level)::BIGINT AS level FROM reach GROUP BY ALL",
}
