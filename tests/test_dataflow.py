"""Flows over files: rules by small files, calls and names by cases, fixpoints by brute force over random programs."""

import random

import pytest

from lakewarden.operators.dataflow import TaintConfig, labelled_paths
from lakewarden.operators.symbols import final_bindings, resolve_names
from lakewarden.sources.def_use import def_use, def_use_of

RULES = [
    ("q = 'SELECT ' + request.args['u']\ncursor.execute(q)", ["SQL_INJECTION"]),
    ("cursor.execute('SELECT ?', (request.args['u'],))", []),
    ("import subprocess\nsubprocess.run(['ls', request.args['u']])", []),
    ("import requests\nrequests.get(request.args['u'])", ["SSRF"]),
    ("import os\nx = os.path.basename(request.args['p'])\nopen(x)", []),
    ("x = 1\nif x:\n    y = request.args['p']\nelse:\n    y = ''\neval(y)", ["CODE_EXECUTION"]),
    ("z = ''\nfor i in range(2):\n    eval(z)\n    z = request.args['p']", ["CODE_EXECUTION"]),
    ("x = request.args['p']\nx = 'constant'\neval(x)", []),
    ("def f(a):\n    g(a)\ndef g(b):\n    eval(b)\nf(request.args['p'])", ["CODE_EXECUTION"]),
    ("import sys\nopen(sys.argv[1])", ["PATH_TRAVERSAL"]),
    ("def broken(:", []),
    ("", []),
    # breaks and returns end their way; what stands after them is looked at by itself
    ("x = request.args['p']\nwhile True:\n    if x:\n        x = 'a'\n        break\n    x = 'b'\neval(x)", ["CODE_EXECUTION"]),
    ("def f(x):\n    if x:\n        return 1\n        eval(x)\nf(request.args['p'])", ["CODE_EXECUTION"]),
    ("def f(x):\n    while x:\n        x = 'a'\n        break\n        x = request.args\n    return x\neval(f(1))", []),
    ("try:\n    x = request.args['p']\n    x = 'b'\nexcept E:\n    eval(x)", ["CODE_EXECUTION"]),
    ("def f(x):\n    def g():\n        eval(x)\n    g()\nf(request.args['p'])", ["CODE_EXECUTION"]),
    ("x = request.args['p']\ndef g():\n    eval(x)\ng()", ["CODE_EXECUTION"]),
    ("def set_it():\n    global shared\n    shared = request.args['p']\ndef use():\n    eval(shared)", ["CODE_EXECUTION"]),
    ("eval([y for y in request.args if y][0])", ["CODE_EXECUTION"]),
    ("f = lambda v: eval(v)\nf(request.args['p'])", ["CODE_EXECUTION"]),
    ("f = lambda v, w: w\neval(f(request.args['p'], 'a'))", []),
    ("async def f(q=request.args['p']):\n    await g(q)\nasync def g(x):\n    exec(f'{x}')", ["CODE_EXECUTION"]),
    ("class A:\n    @staticmethod\n    def s(v):\n        eval(v)\n    @classmethod\n    def c(cls, v):\n        cls.s(v)\nA.c(request.args['p'])", ["CODE_EXECUTION"]),
    ("class A:\n    def m(self, v):\n        eval(v)\nclass B(A):\n    def n(self, w):\n        super().m(w)\nb = B()\nb.n(request.args['p'])", ["CODE_EXECUTION"]),
    ("def f(v):\n    yield v\nfor x in f(request.args['p']):\n    eval(x)", ["CODE_EXECUTION"]),
    ("def r(n, v):\n    if n:\n        return r(n - 1, v)\n    return v\neval(r(5, request.args['p']))", ["CODE_EXECUTION"]),
    ("def a(v):\n    b(v)\ndef b(v):\n    a(v)\na(request.args['p'])", []),
]
LABELS = [
    ("os.system(v)", "HIGHLY_LIKELY"),
    ("os.system(shlex.quote(v))", "NOT_EXPLOITABLE"),
    ("if re.fullmatch('a', v):\n    os.system(v)", "UNLIKELY"),
    ("if v.isdigit():\n    pass\nos.system(v)", "HIGHLY_LIKELY"),
    ("if not v.isdigit():\n    raise E\nos.system(v)", "UNLIKELY"),
    ("if x:\n    v = shlex.quote(v)\nelse:\n    v = html.escape(v)\nos.system(v)", "HIGHLY_LIKELY"),
    ("v = shlex.quote(v) if x else int(v)\nos.system(v)", "NOT_EXPLOITABLE"),
    ("os.system(sys.argv[1])", "LIKELY"),
]
HELPERS = [f"def h{i}(a):\n    h{i + 1}(a)\n" for i in range(6)] + ["def h6(a):\n    eval(a)\n"]
LONG = "".join(f"def c{i}(a):\n    c{i + 1}(a)\n" for i in range(2000)) + "def c2000(a):\n    eval(a)\n"


@pytest.fixture(scope="module")
def flows(spark):
    files = [(f"rule{i}.py", body) for i, (body, _) in enumerate(RULES)]
    files += [(f"label{i}.py", f"import os, shlex, re, html, sys\nv = request.args['v']\n{body}") for i, (body, _) in enumerate(LABELS)]
    files += [(f"order{i}.py", "".join(order) + "h0(request.args['q'])\n") for i, order in enumerate((HELPERS, HELPERS[::-1], random.Random(2).sample(HELPERS, 7)))]
    files += [("long.py", f"{LONG}c0(request.args['q'])\n"), ("none.py", None), ("odd.py", "x = " + "(" * 3000 + ")" * 3000)]
    out = {}
    for r in labelled_paths(def_use(spark.createDataFrame(files, "path string, content string"))).collect():
        out.setdefault(r.path, []).append(r)
    return out


@pytest.mark.parametrize("i", range(len(RULES)), ids=lambda i: RULES[i][0][:30])
def test_rules(flows, i):
    assert sorted(r.sink_kind for r in flows.get(f"rule{i}.py", ()) if r.label != "NOT_EXPLOITABLE") == RULES[i][1]


@pytest.mark.parametrize("i", range(len(LABELS)), ids=lambda i: LABELS[i][0][:30])
def test_labels(flows, i):
    assert [(r.sink, r.label) for r in flows[f"label{i}.py"]] == [("os.system", LABELS[i][1])]


def test_helpers_in_any_order_and_two_thousand_of_them(flows):
    for i in range(3):
        (r,) = flows[f"order{i}.py"]
        assert r.sink == "eval" and len(r.via) == 7
    (r,) = flows["long.py"]
    assert len(r.via) == 2001 and r.via[-1].endswith("c2000(a)")


def test_configuration(spark):
    config = TaintConfig().override({"sources": {"queue.take": "MESSAGE", "sys.argv": None}, "sinks": {"LOG": ["log.write"], "SSRF": None}, "sanitizers": {"scrub": "LOG_SAFE"}, "needs": {"LOG": "LOG_SAFE"}, "validators": ["known"]})
    body = "import sys\nm = queue.take()\nlog.write(m)\nlog.write(scrub(m))\nos.system(sys.argv)\nrequests.get(m)\nif known(m):\n    log.write(m)\n"
    got = labelled_paths(def_use(spark.createDataFrame([("a.py", body)], "path string, content string")), config).collect()
    assert sorted((r.sink_line, r.rule_id, r.label) for r in got) == [(3, "TAINT-LOG", "LIKELY"), (4, "TAINT-LOG", "NOT_EXPLOITABLE"), (8, "TAINT-LOG", "UNLIKELY")]
    with pytest.raises(ValueError, match="unknown parts"):
        TaintConfig().override({"sauces": {}})


def program(rng, n):
    """Functions that call each other at random, with sanitizers, and main flows; and all realisable flows by walking calls."""
    body = {}
    for f in range(n):
        steps = []
        for _ in range(rng.randint(1, 3)):
            kind = rng.choice(["call", "safe", "sink", "copy", "html"])
            steps.append((kind, rng.randrange(f + 1, n) if f + 1 < n and kind == "call" else None))
        body[f] = (steps, rng.random() < 0.7)
    text = "import os, shlex, html\n"
    for f, (steps, back) in body.items():
        text += f"def f{f}(v):\n"
        for kind, g in steps:
            text += {"call": f"    v = f{g}(v)\n" if g is not None else "    v = v\n", "safe": "    v = shlex.quote(v)\n", "html": "    v = html.escape(v)\n", "sink": "    os.system(v)\n", "copy": "    v = v + 'x'\n"}[kind]
        text += "    return v\n" if back else "    return ''\n"
    text += "f0(request.args['q'])\n"
    found = {}

    def walk(f, safe):
        """Contexts of what comes back, or None; sinks met on the way."""
        at = text.split(f"def f{f}(v):\n")[0].count("\n") + 2
        for kind, g in body[f][0]:
            if kind == "call" and g is not None:
                safe = walk(g, safe) if safe is not None else None
            elif safe is not None and kind in ("safe", "html"):
                safe = safe | {kind}
            elif safe is not None and kind == "sink":
                found[at] = found.get(at, False) or "safe" not in safe
            at += 1
        return safe if body[f][1] else None

    walk(0, frozenset())
    return text, found


def test_random_programs_equal_walking_them(spark):
    rng = random.Random(7)
    made = [program(rng, rng.randint(2, 9)) for _ in range(60)]
    got = {}
    for r in labelled_paths(def_use(spark.createDataFrame([(f"p{i}.py", t) for i, (t, _) in enumerate(made)], "path string, content string"))).collect():
        got.setdefault(r.path, {})[r.sink_line] = r.label != "NOT_EXPLOITABLE"
    for i, (text, want) in enumerate(made):
        assert got.get(f"p{i}.py", {}) == want, text


def test_names(spark):
    bind = [("a.x", "b.x"), ("b.x", "c.y"), ("c.y", "d.z"), ("r.p", "r.q"), ("r.q", "r.p"), ("s.*", "b"), ("t.*", "s"), ("s.own", "d.own"), ("lead.r", "r.p")]
    names = [("b.f",), ("b._hidden",), ("b.own",), ("d.z",)]
    b, n = spark.createDataFrame(bind, "name string, target string"), spark.createDataFrame(names, "name string")
    got = {r.name: r.target for r in final_bindings(b, n).collect()}
    assert {k: got[k] for k in ("a.x", "b.x", "c.y", "s.f", "t.f", "s.own", "t.own", "s.x", "t.x")} == {"a.x": "d.z", "b.x": "d.z", "c.y": "d.z", "s.f": "b.f", "t.f": "b.f", "s.own": "d.own", "t.own": "d.own", "s.x": "d.z", "t.x": "d.z"}
    assert "s._hidden" not in got
    asked = spark.createDataFrame([("a.x.method",), ("a.x",), ("other.y",), ("t.f.a.b",)], "name string")
    assert {r.name: r.resolved for r in resolve_names(asked, b, n).collect()} == {"a.x.method": "d.z.method", "a.x": "d.z", "other.y": "other.y", "t.f.a.b": "b.f.a.b"}
    chain = spark.createDataFrame([(f"m{i}.n", f"m{i + 1}.n") for i in range(70)], "name string, target string")
    assert {r.target for r in final_bindings(chain, n).collect()} == {"m70.n"}


def test_facts_of_odd_files():
    assert def_use_of("a.py", None) == def_use_of("a.py", "def (") == def_use_of("a.py", "x\0") == []
    assert {r[5] for r in def_use_of("pkg/sub/mod.py", "from . import a\nfrom ..b import c as d\nimport e.f\n") if r[1] == "bind"} == {"pkg.sub.mod.a", "pkg.sub.mod.d"}
    assert {r[8] for r in def_use_of("pkg/sub/__init__.py", "from . import a\nfrom ..b import c as d\nfrom .x import *\n") if r[1] == "bind"} == {"pkg.sub.a", "pkg.b.c", "pkg.sub.x"}
