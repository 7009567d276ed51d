"""Nesting: states of lines against a walk over characters, outlines of files with everything in the way."""

import random

import pytest

from lakewarden.operators import nesting
from lakewarden.operators.nesting import CODE, COMMENT, TEMPLATE, code_lines, outline


def walk(lines):
    """(state at the start, code) of each line, character by character."""
    state, out = CODE, []
    for text in lines:
        first, code, i = state, "", 0
        while i < len(text):
            if state == COMMENT:
                at = text.find("*/", i)
                if at < 0:
                    break
                i, state = at + 2, CODE
            elif state == TEMPLATE:
                if text[i] == "\\":
                    i += 2
                    if i > len(text):  # a stroke at the line's end takes nothing with it
                        i = len(text)
                else:
                    state = CODE if text[i] == "`" else TEMPLATE
                    i += 1
            elif text.startswith("//", i):
                i = len(text)
            elif text.startswith("/*", i):
                i, state = i + 2, COMMENT
            elif text[i] == "`":
                i, state = i + 1, TEMPLATE
            elif text[i] in "\"'":
                quote, i = text[i], i + 1
                while i < len(text) and text[i] != quote:
                    i += 2 if text[i] == "\\" and i + 1 < len(text) else 1
                i += 1
            else:
                code += text[i]
                i += 1
        out.append((first, code))
    return out


@pytest.mark.parametrize("block", [1, 3, 256])
def test_states_equal_a_walk(spark, block, monkeypatch):
    monkeypatch.setattr(nesting, "BLOCK", block)
    rng, rows, want = random.Random(block), [], {}
    for f in range(40):
        lines = ["".join(rng.choice(["a", "{", "}", '"', "'", "`", "/*", "*/", "//", " ", "*", "/"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 14))]
        rows += [(f"f{f}", i, t) for i, t in enumerate(lines)]
        want |= {(f"f{f}", i): (s, c.replace(" ", "")) for i, (s, c) in enumerate(walk(lines))}
    df = spark.createDataFrame(rows, "path string, line_no int, text string")
    got = {(r.path, r.line_no): (r.state, r.code.replace(" ", "")) for r in code_lines(df).collect()}
    assert got == want


JS = """/* function dead() { */
const s = "function fake(y) {";
function outer(a,
               b) {
  if (a) { // }
    const inner = (x) => {
      return `multi {
 line } template {`;
    };
  }
  let short = x => x + 1;
}
/* a
function alsoDead() {
*/ function live() {}
var o = { m: function() { return 1 }, n: 2 };
if (x) { while (y) { } }
function open() {
"""


def test_outline(spark):
    rows = [("a.js", i, t) for i, t in enumerate(JS.split("\n"), 1)] + [("b.js", 1, None), ("c.js", 1, "} } function g() {"), ("c.js", 2, "}")]
    got = {(r.path, r.name, r.kind, r.line, r.last, r.parent, r.level) for r in outline(spark.createDataFrame(rows, "path string, line_no int, text string")).collect()}
    assert got == {
        ("a.js", "outer", "function", 3, 12, None, 0), ("a.js", "inner", "function", 6, 9, "outer", 1), ("a.js", "short", "function", 11, 11, "outer", 1), ("a.js", "live", "function", 15, 15, None, 0),
        ("a.js", "m", "function", 16, 16, None, 0), ("a.js", "open", "function", 18, None, None, 0), ("c.js", "g", "function", 1, 2, None, 0),
    }


def test_no_lines(spark):
    assert outline(spark.createDataFrame([], "path string, line_no int, text string")).collect() == []
