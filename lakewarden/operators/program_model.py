"""Functions, calls and cross-function flows of any language, from numbered lines.

Lines that open a function name it for the lines after them (a running window per file); other lines
with a parenthesis hold calls. Sources, sinks and sanitizers are lookup tables of substrings with word
edges. A flow goes from a function that reads a source (or serves an endpoint) along at most ``depth``
calls to one that holds a sink, unless a function on the way makes its category safe.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut
from .lines import carried

#: Name and category.
SOURCES = (
    ("request.args", "QUERY_PARAM"), ("request.form", "REQUEST_BODY"), ("request.json", "REQUEST_BODY"), ("request.headers", "HEADER"), ("request.cookies", "COOKIE"), ("request.getParameter", "QUERY_PARAM"),
    ("c.Query", "QUERY_PARAM"), ("$_GET", "QUERY_PARAM"), ("$_POST", "REQUEST_BODY"), ("params", "QUERY_PARAM"), ("os.environ", "ENV_VAR"), ("open.read", "FILE"), ("mq.consume", "MESSAGE_QUEUE"),
)
SINKS = (
    ("cursor.execute", "SQL"), ("stmt.executeQuery", "SQL"), ("db.Query", "SQL"), ("os.system", "SHELL_EXEC"), ("subprocess.call", "SHELL_EXEC"), ("Runtime.getRuntime().exec", "SHELL_EXEC"), ("exec.Command", "SHELL_EXEC"),
    ("open(", "FILESYSTEM"), ("new File(", "FILESYSTEM"), ("requests.get", "HTTP_REQUEST"), ("http.Get", "HTTP_REQUEST"), ("pickle.loads", "DESERIALIZATION"), ("in.readObject", "DESERIALIZATION"), ("response.write", "HTML_OUTPUT"),
)
SANITIZERS = (
    ("html.escape", ("HTML_OUTPUT", "TEMPLATE_RENDERING")), ("shlex.quote", ("SHELL_EXEC",)), ("filepath.Clean", ("FILESYSTEM",)), ("url.validate", ("HTTP_REQUEST", "REDIRECT")),
    ("prepare_statement", ("SQL",)), ("int", ("SQL", "FILESYSTEM", "SHELL_EXEC")),
)
OPENER = r"^\s*(?:@?(?:public|private|protected|static|final|async|export|pub|unsafe)\s+)*(?:def|func|function|fn|void|String|int|Object)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\("
KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "def", "func", "function", "fn")


def _holds(line: Column, name: str) -> Column:
    left = r"(^|\W)" if re.match(r"\w", name) else ""
    right = r"(\W|$)" if re.search(r"\w$", name) else ""
    return line.rlike(left + re.escape(name).replace(r"\ ", " ") + right)


def functions(lines: DataFrame) -> DataFrame:
    """path, line_no, line, fn: every line with its function (null before the first)."""
    name = F.nullif(F.regexp_extract("line", OPENER, 1), F.lit(""))
    return carried(lines.select("path", "line_no", "line", name.alias("opens")), ["path"], "line_no", F.col("opens"), "fn")


def call_edges(fn_lines: DataFrame) -> DataFrame:
    """src -> dst between functions, by short name; a call goes to its own file's function if there is one.

    A name that several other files define is one node ``*:name``, which ``members`` leads on to each of them: as
    many rows as there are calls and definitions, not their product.
    """
    calls = fn_lines.where("fn is not null and opens is null")
    calls = calls.select("path", "fn", F.explode(F.regexp_extract_all("line", F.lit(r"([A-Za-z_]\w*)\s*\("), 1)).alias("callee")).where(~F.col("callee").isin(*KEYWORDS)).distinct()
    targets = fn_lines.where("opens is not null").select(F.col("path").alias("to_path"), F.col("opens").alias("callee")).distinct()
    here = targets.select(F.col("to_path").alias("path"), "callee")
    own = calls.join(here, ["path", "callee"]).select(F.concat_ws(":", "path", "fn").alias("src"), F.concat_ws(":", "path", "callee").alias("dst"))
    names = targets.groupBy("callee").agg(F.count("*").alias("n"), F.min("to_path").alias("to_path"))
    far = calls.join(here, ["path", "callee"], "left_anti").join(names, "callee")
    far = far.select(F.concat_ws(":", "path", "fn").alias("src"), F.when(F.col("n") == 1, F.concat_ws(":", "to_path", "callee")).otherwise(F.concat(F.lit("*:"), "callee")).alias("dst"))
    return own.union(far).distinct()


def members(fn_lines: DataFrame) -> DataFrame:
    """hub, member: the functions that a node ``*:name`` stands for."""
    targets = fn_lines.where("opens is not null").select(F.concat(F.lit("*:"), "opens").alias("hub"), F.concat_ws(":", "path", "opens").alias("member")).distinct()
    return targets.join(targets.groupBy("hub").count().where("count > 1").select("hub"), "hub")


def marks(fn_lines: DataFrame) -> DataFrame:
    """Per function: whether it serves an endpoint, its sources, sinks and what it makes safe."""
    line = F.col("line")
    found = lambda table: F.array_compact(F.array(*(F.when(_holds(line, n), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"))) for n, c in table)))
    safe = F.flatten(F.array_compact(F.array(*(F.when(_holds(line, n), F.array(*map(F.lit, c))) for n, c in SANITIZERS))))
    f = fn_lines.where("fn is not null").withColumn("so", found(SOURCES)).withColumn("si", found(SINKS)).withColumn("sa", safe)
    g = f.groupBy(F.concat_ws(":", "path", "fn").alias("node")).agg(
        F.max(F.lower("fn").rlike("route|get|handler") | F.lower("line").contains("controller")).alias("endpoint"),
        F.array_distinct(F.flatten(F.collect_list("so"))).alias("sources"),
        F.array_distinct(F.flatten(F.collect_list("si"))).alias("sinks"),
        F.array_distinct(F.flatten(F.collect_list("sa"))).alias("safe"),
    )
    return g


def flows(lines: DataFrame, depth: int = 8, per_pair: int = 10) -> DataFrame:
    """start, sink function, sink, category, path, severity of unsanitised flows.

    CRITICAL where an endpoint is on the path, else HIGH. What a path makes safe and whether it holds an endpoint
    is carried from call to call for every start, so no flow of at most ``depth`` calls is lost. A call path may
    pass a function again (recursion). Each distinct state has its first shortest path; of a flow and severity
    the ``per_pair`` shortest of these are shown.
    """
    fn = functions(lines)
    m = _cut(marks(fn).select("node", F.coalesce("endpoint", F.lit(False)).alias("endpoint"), "sources", "sinks", F.array_sort("safe").alias("safe")))
    e, hubs = _cut(call_edges(fn)), _cut(members(fn))
    held = m.select(F.col("node").alias("dst"), F.col("safe").alias("more"), F.col("endpoint").alias("serves"))
    key = ["start", "node", "safe", "endpoint"]
    at = known = m.where("endpoint or size(sources) > 0").select(F.col("node").alias("start"), "node", "safe", "endpoint", F.array("node").alias("path"))
    for _ in range(depth):
        # what reaches a hub is made one row a state before it goes on to the hub's members
        out = at.join(e, at.node == e.src).groupBy("start", "dst", "safe", "endpoint").agg(F.min("path").alias("path"))
        on = out.join(hubs, out.dst == hubs.hub).select("start", F.col("member").alias("dst"), "safe", "endpoint", "path")
        step = out.where("not startswith(dst, '*:')").unionByName(on).join(held, "dst")
        step = step.select("start", F.col("dst").alias("node"), F.array_sort(F.array_union("safe", "more")).alias("safe"), (F.col("endpoint") | F.col("serves")).alias("endpoint"), F.concat("path", F.array("dst")).alias("path"))
        at = _cut(step.groupBy(key).agg(F.min("path").alias("path")).join(known.select(key), key, "left_anti"))
        if at.isEmpty():
            break
        known = known.union(at)
    out = known.join(m.select("node", "sinks"), "node").select("*", F.explode("sinks").alias("sink")).where("not array_contains(safe, sink.category)")
    out = out.select("start", "node", F.col("sink.name").alias("sink"), F.col("sink.category").alias("category"), "path", F.when(F.col("endpoint"), "CRITICAL").otherwise("HIGH").alias("severity"))
    w = Window.partitionBy("start", "node", "sink", "category", "severity").orderBy(F.size("path"), "path")
    return out.distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_pair).drop("n")
