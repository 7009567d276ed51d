"""Lines that can't matter to the nesting aren't shuffled."""

from lakewarden.operators import nesting as N

TEXT = "/* some words\nit's {not} code\nmore words\n*/\nfunction f() {\n  x = 1\n  const t = `a\nplain\n{`\n}\n"


def test_only_lines_that_matter_are_composed(spark, monkeypatch):
    seen, whole = [], N.code_lines
    monkeypatch.setattr(N, "code_lines", lambda lines: seen.extend(r.line_no for r in lines.collect()) or whole(lines))
    lines = spark.createDataFrame([("a.js", i + 1, x) for i, x in enumerate(TEXT.split("\n"))] + [("a.js", 99, None)], "path string, line_no int, text string")
    got = [tuple(r) for r in N.outline(lines).collect()]
    assert got == [("a.js", "f", "function", 5, 10, None, 0)]
    assert sorted(seen) == [1, 2, 4, 5, 7, 9, 10]
