"""Control flow: constants, dominators against taking blocks out one by one, conditions of lines, verdicts of flows."""

import ast
import random

import pytest

from lakewarden.operators.dataflow import labelled_paths
from lakewarden.operators.dominance import blocks, dominators, feasible_flows, line_conditions
from lakewarden.sources.control_flow import control_flow, control_flow_of, folded
from lakewarden.sources.def_use import def_use

TESTS = {"False": False, "0": False, "not True": False, "1 > 2": False, "x": None, "x and False": False, "x or True": True, "x and True": None, "not ''": True, "DEBUG": False, "not DEBUG": True, "1 < 'a'": None, "[]": False, "()": False, "[x]": True, "None": False, "x == 1": None, "'a' == 'a'": True}


@pytest.mark.parametrize("test", TESTS)
def test_constants(test):
    assert folded(ast.parse(test, mode="eval").body) is TESTS[test]


@pytest.mark.parametrize("seed", range(30))
def test_dominators_equal_taking_blocks_out(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 14)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 30))]

    def reach(without):
        seen, todo = set(), [0] if without != 0 else []
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += [y for x, y in edges if x == b and y != without]
        return seen

    idom, live = dominators(n, edges), reach(None)
    assert {b for b in range(n) if idom[b] >= 0} == live | {0}
    for b in live - {0}:
        strict = {a for a in live - {b} if b not in reach(a)}
        chain, at = set(), b
        while at:
            at = idom[at]
            chain.add(at)
        assert chain == strict


CODE = """import os
def f(v):
    if not ok(v):
        return
    for x in v:
        if x:
            continue
        use(x)
    else:
        end()
    try:
        a()
        return 1
    except E:
        b()
    with c():
        d()
    return 2
    e()
class K:
    if x:
        def m(self):
            if self.y:
                raise E
            g()
assert ready
h()
"""


def test_conditions_of_lines(spark):
    files = spark.createDataFrame([("a.py", CODE), ("bad.py", "def ("), ("none.py", None), ("empty.py", "")], "path string, content string")
    rows = control_flow(files)
    got = {r.line: (r.reached, r.conditions) for r in line_conditions(rows).where("path = 'a.py'").collect()}
    guard = "not (not ok(v))"
    assert got[4] == (True, ["not ok(v)"]) and got[8] == (True, [guard, "not (x)"]) and got[7] == (True, [guard, "x"])
    assert got[10] == got[12] == got[15] == got[17] == got[18] == (True, [guard]) and not got[19][0]
    assert got[24] == (True, ["self.y"]) and got[25] == (True, ["not (self.y)"]) and got[27] == (True, ["ready"])
    assert {r.fn for r in blocks(rows).where("path = 'a.py'").collect()} == {"<module>", "f", "K.m"}
    assert blocks(rows).where("path <> 'a.py'").count() == 1  # the entry of the empty file


def test_facts_of_odd_files():
    assert control_flow_of("a.py", None) == control_flow_of("a.py", "def (") == control_flow_of("a.py", "x\0") == []
    deep = "".join("    " * i + f"if a{i}:\n" for i in range(80)) + "    " * 80 + "use()\n"
    assert sum(r[3] == "block" for r in control_flow_of("a.py", deep)) == 1 + 80 * 2 + 80


def test_verdicts(spark):
    body = "import os\nfrom flask import request\ndef helper(v):\n    os.system(v)\ndef a():\n    if False:\n        helper(request.args)\ndef b():\n    if on:\n        helper(request.form)\ndef c():\n    helper(request.json)\ndef d():\n    import shlex\n    os.system(shlex.quote(request.data))\n"
    files = spark.createDataFrame([("a.py", body)], "path string, content string")
    got = {r.fn: (r.verdict, r.conditions) for r in feasible_flows(labelled_paths(def_use(files)), control_flow(files)).collect()}
    assert got == {"a": ("UNREACHABLE", []), "b": ("CONDITIONAL", ["on"]), "c": ("EXPLOITABLE", []), "d": ("NOT_EXPLOITABLE", [])}
