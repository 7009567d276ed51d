"""Queries over packages that are derived from the documents: flows across files and names handed on.

Each document gives a package of four files; the whole text is a constant of one of them and goes through the calls as a value.
``VIEWS`` are the ways in which its last file uses the package, dealt by the id; what each must give is listed by hand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dataflow import shared_paths
from ..operators.dominance import feasible_flows
from ..operators.nesting import outline
from ..operators.symbols import final_bindings
from ..sources.control_flow import control_flow
from ..sources.def_use import def_use
from . import corpus as K
from .base import spread, table

INIT = "from .api import *\n"
API = "from .core import handle as serve, clean, fetch, Runner as Task\nfrom . import core\n"
CORE = (
    "import os, shlex\n"
    "from flask import request\n"
    "def handle(value, *, mode=None):\n"
    "    return Runner().run(value)\n"
    "def clean(v):\n"
    "    return shlex.quote(v)\n"
    "def fetch():\n"
    "    return request.form['f']\n"
    "class Runner:\n"
    "    def __init__(self, first=None):\n"
    "        self.first = first\n"
    "    def run(self, v):\n"
    "        return self.send(cmd=v)\n"
    "    def send(self, cmd):\n"
    "        os.system(cmd)\n"
    "        return cmd\n"
    "    def again(self):\n"
    "        eval(self.first)\n"
)
_HEAD = "import os, subprocess\nfrom flask import request\nfrom pkg{} import serve, clean, fetch, Task\n"  # three lines
#: The last file of a package, and its flows: fn, source, line, sink's file, sink, line, label, way.
_A, _F, _H, _L, _N = "flask.request.args", "flask.request.form", "HIGHLY_LIKELY", "LIKELY", "NOT_EXPLOITABLE"
_RUN = "pkg{}/core.py:4 Runner.run(v)", "pkg{}/core.py:13 Runner.send(cmd)"
VIEWS = (
    # a helper of a helper in another file, by a name handed on three times
    ("serve(request.args['a'])\n", [("<module>", _A, 4, "core.py", "os.system", 15, _H, ("pkg{}/views.py:4 handle(value)", *_RUN))]),
    # methods of equal names, a method called on self
    ("class A:\n    def run(self):\n        os.system(request.args['x'])\nclass B:\n    def run(self, q):\n        self.go(q)\n    def go(self, q):\n        exec(q)\nB().run(request.form)\n", [("A.run", _A, 6, "views.py", "os.system", 6, _H, ()), ("<module>", _F, 12, "views.py", "exec", 11, _H, ("pkg{}/views.py:12 B.run(q)", "pkg{}/views.py:9 B.go(q)"))]),
    # keywords and stars
    ("def h(a, *rest, v=None):\n    os.popen(v)\n    eval(rest[1])\nh(1, v=request.args['v'])\nh(*request.form)\n", [("<module>", _A, 7, "views.py", "os.popen", 5, _H, ("pkg{}/views.py:7 h(v)",)), ("<module>", _F, 8, "views.py", "eval", 6, _H, ("pkg{}/views.py:8 h(rest)",))]),
    # a function of another file that gives a source, and its result through another
    ("def g():\n    return fetch()\nx = g()\nos.system(serve(x))\n", [("fetch", _F, 8, "core.py", "os.system", 15, _H, ("pkg{}/views.py:5 back from fetch", "pkg{}/views.py:6 back from g", "pkg{}/views.py:7 handle(value)", *_RUN)), ("fetch", _F, 8, "views.py", "os.system", 7, _H, ("pkg{}/views.py:5 back from fetch", "pkg{}/views.py:6 back from g", "pkg{}/views.py:7 handle(value), back from handle"))]),
    # patterns, an assignment in a condition, the body of a class
    ("match request.args:\n    case {'k': [first, *_]}:\n        eval(first)\nif (n := request.form):\n    exec(n)\nclass C:\n    os.system(request.args['c'])\n", [("<module>", _A, 4, "views.py", "eval", 6, _H, ()), ("<module>", _F, 7, "views.py", "exec", 8, _H, ()), ("C", _A, 10, "views.py", "os.system", 10, _H, ())]),
    # values that need more than two turns of a loop
    ("a = b = c = d = ''\nwhile a != 'x':\n    eval(d)\n    d = c\n    c = b\n    b = a\n    a = request.args['a']\n", [("<module>", _A, 10, "views.py", "eval", 6, _H, ())]),
    # a command by keyword; a list that no shell sees
    ("subprocess.run(args=request.args['a'], shell=True)\nsubprocess.run(args=['ls', request.form])\n", [("<module>", _A, 4, "views.py", "subprocess.run", 4, _H, ())]),
    # made safe in another file: for a shell, not for code
    ("v = clean(request.args['v'])\nos.system(v)\nexec(v)\n", [("<module>", _A, 4, "views.py", "os.system", 5, _N, ("pkg{}/views.py:4 clean(v), back from clean",)), ("<module>", _A, 4, "views.py", "exec", 6, _H, ("pkg{}/views.py:4 clean(v), back from clean",))]),
    # of two ways to a sink the one that isn't made safe counts
    ("v = request.args['v']\nif len(v) > 3:\n    v = clean(v)\nos.system(v)\n", [("<module>", _A, 4, "views.py", "os.system", 7, _H, ())]),
    # an attribute set in one method and used in another, of an object made elsewhere
    ("t = Task(request.args['t'])\nt.again()\nt.run(request.form)\n", [("<module>", _A, 4, "core.py", "eval", 18, _H, ("pkg{}/views.py:4 Runner.__init__(first)",)), ("<module>", _F, 6, "core.py", "os.system", 15, _H, ("pkg{}/views.py:6 Runner.run(v)", "pkg{}/core.py:13 Runner.send(cmd)"))]),
    # each call gets back its own value only
    ("def same(x):\n    return x\na = same(request.args['a'])\nb = same('b')\nos.system(b)\nos.popen(a)\n", [("<module>", _A, 6, "views.py", "os.popen", 9, _H, ("pkg{}/views.py:6 same(x), back from same",))]),
)


#: Functions with one sink each, and what holds at it: conditions and verdict. The source is in the function's second line.
GUARDS = (
    ("    while False:\n        os.system(v)\n", [], "UNREACHABLE"),
    ("    if not True or 0:\n        os.system(v)\n", [], "UNREACHABLE"),
    ("    if v:\n        return\n        os.system(v)\n", [], "UNREACHABLE"),
    ("    if not allowed(v):\n        return None\n    os.system(v)\n", ["not (not allowed(v))"], "CONDITIONAL"),
    ("    if v and check():\n        if ready:\n            os.system(v)\n", ["v and check()", "ready"], "CONDITIONAL"),
    ("    if v:\n        x = 1\n    else:\n        x = 2\n    os.system(v)\n", [], "EXPLOITABLE"),
    ("    while True:\n        if v:\n            break\n    os.system(v)\n", ["v"], "CONDITIONAL"),
    ("    while True:\n        step()\n    os.system(v)\n", [], "UNREACHABLE"),
    ("    for x in v:\n        os.system(x)\n", [], "EXPLOITABLE"),
    ("    try:\n        step()\n    except E:\n        raise\n    os.system(v)\n", [], "EXPLOITABLE"),
    ("    assert known\n    os.system(v)\n", ["known"], "CONDITIONAL"),
    ("    match v:\n        case 'a':\n            os.system(v)\n        case _:\n            pass\n", ["case 'a'"], "CONDITIONAL"),
    ("    sys.exit(1)\n    os.system(v)\n", [], "UNREACHABLE"),
    ("    if DEBUG:\n        os.system(v)\n", [], "UNREACHABLE"),
    ("    try:\n        return 1\n    finally:\n        os.system(v)\n", [], "EXPLOITABLE"),
)
_GUARD_HEAD = "import os, sys\nfrom flask import request\ndef run(v):\n"
_GUARD_TAIL = "def enter():\n    if opened:\n        run(request.args)\n"


def guarded(spark, sf):
    """path, content of a file for each document: a function whose sink is guarded in one of several ways, called under a condition.

    The whole text stands in a string before the function's body.
    """
    body = F.element_at(F.array(*(F.lit(code) for code, *_ in GUARDS)), (F.col("doc_id") % len(GUARDS) + 1).cast("int"))
    text = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text")))
    return spread(table(spark, sf, "documents")).where("doc_id is not null").select(F.concat(F.lit("guard"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit(_GUARD_HEAD), F.lit("    t = "), text, F.lit("\n"), body, F.lit(_GUARD_TAIL)).alias("content"))


def guarded_flows(spark, sf):
    """Flows with the conditions on their way, and whether they can happen."""
    files = guarded(spark, sf)
    out = feasible_flows(shared_paths(files), control_flow(files))
    return out.select("path", "fn", "source_line", "sink_line", F.array_join("conditions", " and ").alias("conditions"), "verdict")


def packages(spark, sf):
    """path, content of the four files of each document's package."""
    i = F.col("doc_id").cast("string")
    view = F.element_at(F.array(*(F.lit(_HEAD + code) for code, _ in VIEWS)), (F.col("doc_id") % len(VIEWS) + 1).cast("int"))
    text = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text")))
    files = {"__init__.py": F.lit(INIT), "api.py": F.concat(F.lit(API), F.lit("core.handle("), text, F.lit("['text'])\n")), "core.py": F.lit(CORE), "views.py": F.regexp_replace(view, r"\{\}", i)}
    parts = F.explode(F.array(*(F.struct(F.concat(F.lit("pkg"), i, F.lit(f"/{name}")).alias("path"), content.alias("content")) for name, content in files.items())))
    return spread(table(spark, sf, "documents")).where("doc_id is not null").select(parts.alias("f")).select("f.*")


def taint_paths(spark, sf):
    """Flows across files with their label and the calls on their way."""
    out = shared_paths(packages(spark, sf))
    return out.select("path", "fn", "rule_id", "source", "source_line", "sink_path", "sink", "sink_line", "label", F.array_join("via", " > ").alias("way"))


def handed_on_names(spark, sf):
    """What the names that each package hands on finally mean."""
    facts = def_use(packages(spark, sf)).where("kind in ('bind', 'def', 'module')").select("kind", "name", "text")
    bind = facts.where("kind = 'bind'").select("name", F.col("text").alias("target"))
    return final_bindings(bind, facts.where("kind in ('def', 'module')").select("name"))


_RULE = {"os.system": "TAINT-CMD", "os.popen": "TAINT-CMD", "subprocess.run": "TAINT-CMD", "eval": "TAINT-CODE", "exec": "TAINT-CODE"}


def _expected() -> str:
    rows = [(k, f"pkg{{}}/{'core.py' if fn == 'fetch' else 'views.py'}", fn, _RULE[sink], source, line, f"pkg{{}}/{where}", sink, at, label, " > ".join(way)) for k, (_, flows) in enumerate(VIEWS) for fn, source, line, where, sink, at, label, way in flows]
    cols = ["k", "path", "fn", "rule_id", "source", "source_line", "sink_path", "sink", "sink_line", "label", "way"]
    named = lambda c: f"replace({c}, '{{}}', doc_id::VARCHAR)"
    return f"SELECT {named('path')} AS path, fn, rule_id, source, source_line::INT AS source_line, {named('sink_path')} AS sink_path, sink, sink_line::INT AS sink_line, label, {named('way')} AS way FROM (SELECT doc_id FROM documents) d, {K._values(rows, cols)} WHERE doc_id IS NOT NULL AND doc_id % {len(VIEWS)} = k"


def _judged() -> str:
    rows = []
    for k, (code, conditions, verdict) in enumerate(GUARDS):
        lines = code.split("\n")
        at, end = 5 + next(i for i, x in enumerate(lines) if "os.system" in x), 4 + code.count("\n")
        rows.append((k, "enter", end + 3, at, " and ".join(["opened", *conditions]), "CONDITIONAL" if verdict == "EXPLOITABLE" else verdict))
    return f"SELECT 'guard' || doc_id || '.py' AS path, fn, source_line::INT AS source_line, sink_line::INT AS sink_line, conditions, verdict FROM (SELECT doc_id FROM documents) d, {K._values(rows, ['k', 'fn', 'source_line', 'sink_line', 'conditions', 'verdict'])} WHERE doc_id IS NOT NULL AND doc_id % {len(GUARDS)} = k"


_BOUND = [("api.serve", "core.handle"), ("api.clean", "core.clean"), ("api.fetch", "core.fetch"), ("api.Task", "core.Runner")]
_NAMES = [*_BOUND, *((a.removeprefix("api."), b) for a, b in _BOUND), *((f"views.{a.removeprefix('api.')}", b) for a, b in _BOUND), ("api.core", "core")]
#: Code after a comment that holds the whole text, after a template that holds it, and after a string that does; what is in each.
_BEFORE = "function outer(a,\n  b) {\n  if (a) { // }\n    const inner = (x) => {\n      return '}';\n    };\n  }\n}\n"
_AFTER = (
    ("class K extends B {\n  run(v) { return v }\n  async stop() {\n    for (const x of y) {\n      go(x);\n    }\n  }\n}\n", [("K", "class", 1, 8, None, 0), ("run", "method", 2, 2, "K", 1), ("stop", "method", 3, 7, "K", 1)]),
    ("const api = {\n  get: function(q) {\n    return q.map(r => r + 1);\n  },\n};\n", [("get", "function", 2, 4, None, 0)]),
    ("async function main() {\n  /* function no() { */ const f = async (z) => {\n    class L {\n      m() {\n      }\n    }\n  }\n}\nfunction open() {\n", [("main", "function", 1, 8, None, 0), ("f", "function", 2, 7, "main", 1), ("L", "class", 3, 6, "f", 2), ("m", "method", 4, 5, "L", 3), ("open", "function", 9, None, None, 0)]),
)
_OUTER = [("outer", "function", 1, 8, None, 0), ("inner", "function", 4, 6, "outer", 1)]


def nested_outline(spark, sf):
    """Definitions of script files that hold a document's whole text in a comment, in a template and in a string."""
    text = F.coalesce("text", F.lit(""))
    after = F.element_at(F.array(*(F.lit(c) for c, _ in _AFTER)), (F.col("doc_id") % len(_AFTER) + 1).cast("int"))
    parts = (F.lit("/* "), F.regexp_replace(text, r"\*/", "*  "), F.lit("*/\n" + _BEFORE + "const t = `"), F.translate(text, "`\\", ""), F.lit("`;\nconst s = "), F.to_json(F.struct(text.alias("text"))), F.lit(";\n"), after)
    d = table(spark, sf, "documents").where("doc_id is not null").select(F.concat(F.lit("web"), F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), F.concat(*parts).alias("content"))
    return outline(d.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line_no"), "text"))


def _outlined() -> str:
    cols = ["name", "kind", "line", "last", "parent", "level", "k"]
    rows = [(*r, -1) for r in _OUTER] + [(*r, k) for k, (_, found) in enumerate(_AFTER) for r in found]
    nl = "length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))"
    moved = lambda c: f"({c} + CASE WHEN k < 0 THEN n + 1 ELSE 2 * n + {_BEFORE.count(chr(10)) + 3} END)::INT AS {c}"
    return f"SELECT 'web' || doc_id || '.js' AS path, name, kind, {moved('line')}, {moved('last')}, parent, level FROM (SELECT doc_id, {nl} AS n FROM documents) d, {K._values(rows, cols)} WHERE doc_id IS NOT NULL AND (k < 0 OR doc_id % {len(_AFTER)} = k)"


QUERIES = {f.__name__: f for f in (taint_paths, handed_on_names, guarded_flows, nested_outline)}
SQL = {
    "taint_paths": _expected(),
    "guarded_flows": _judged(),
    "nested_outline": _outlined(),
    "handed_on_names": f"SELECT 'pkg' || doc_id || '.' || name AS name, 'pkg' || doc_id || '.' || target AS target FROM documents, {K._values(_NAMES, ['name', 'target'])} WHERE doc_id IS NOT NULL"
    " UNION ALL SELECT 'pkg' || doc_id || m || '.request', 'flask.request' FROM documents, (VALUES ('.views'), ('.core')) t(m) WHERE doc_id IS NOT NULL",
}
