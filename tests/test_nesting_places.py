"""Places of tokens in files with many lines, and in lines with many characters."""

import pytest

from lakewarden.operators.nesting import outline


def found(spark, rows):
    return sorted(tuple(r)[1:] for r in outline(spark.createDataFrame(rows, "path string, line_no int, text string")).collect())


@pytest.mark.parametrize("at", [2_146, 3_000, 2_147_483_000])
def test_files_of_many_lines(spark, at):
    rows = [("a.js", at, "function f() {"), ("a.js", at + 1, "  const g = (x) => {"), ("a.js", at + 2, "}}")]
    assert found(spark, rows) == [("f", "function", at, at + 2, None, 0), ("g", "function", at + 1, at + 2, "f", 1)]


def test_a_line_of_over_a_million_characters(spark):
    rows = [("a.js", 1, "class A { " + "x " * 600_000 + "}"), ("a.js", 2, "function f() { }")]
    assert found(spark, rows) == [("A", "class", 1, 1, None, 0), ("f", "function", 2, 2, None, 0)]
