"""The reader of Python files makes and hands on only what a query can use."""

import ast

from lakewarden.operators import behaviour as B
from lakewarden.sources import python_facts as P

CODE = "import yaml\n@app.route('/a')\ndef f(a):\n    if a and b:\n        return yaml.load(a)\n    g(a)\ndef g(b):\n    pass\n"


def test_functions_of_equal_source_are_written_out_once(monkeypatch):
    seen = []
    monkeypatch.setattr(P.ast, "unparse", lambda node, f=ast.unparse: seen.append(type(node).__name__) or f(node))
    P._TEXTS.clear()
    a, b = (P.facts_of(p, c, frozenset(("function",)), frozenset(("function",))) for p, c in (("a.py", CODE), ("b.py", "# other\r\n" + CODE.replace("\n", "\r\n"))))
    assert seen == ["FunctionDef"] * 2
    assert [r[11] for r in a] == [r[11] for r in b] == [ast.unparse(x) for x in ast.parse(CODE).body[1:]]


def test_texts_of_some_calls_and_functions_only():
    text = {(r[1], r[6]): r[11] for r in P.facts_of("a.py", CODE, None, frozenset(("decorated", "call:yaml.load")))}
    assert text["function", "f"] == ast.unparse(ast.parse(CODE).body[1]) and text["function", "g"] is None
    assert text["call", "yaml.load"] == "yaml.load(a)" and text["call", "g"] is None


def test_conditions_are_written_out_where_a_fact_needs_them(monkeypatch):
    seen = []
    monkeypatch.setattr(P.ast, "unparse", lambda node, f=ast.unparse: seen.append(node) or f(node))
    assert P.facts_of("a.py", CODE, frozenset(("function",)), frozenset()) and not seen
    rows = P.facts_of("a.py", "if a:\n    f()\n    g()\nelse:\n    h()\n", frozenset(("call",)), frozenset())
    assert [r[12] for r in rows] == [["a"], ["a"], ["not (a)"]] and len(seen) == 1


def test_routes_write_only_what_can_matter(spark, monkeypatch):
    written = []
    monkeypatch.setattr(B, "_cut", lambda df: written.extend(df.collect()) or df)
    rows = B.framework_routes(P.python_facts(spark.createDataFrame([("a.py", "import os, flask\napp = flask.Flask(x)\nos.system(y)\n@app.get('/a')\n@cache\ndef f(): pass\n")], "path string, content string"))).collect()
    assert [(r.framework, r.handler, r.route) for r in rows] == [("Flask", "f", "/a")]
    assert sorted((r["kind"], r["name"]) for r in written) == [("assign", "app"), ("call", "flask.Flask"), ("decorator", "app.get"), ("import", "flask")]
