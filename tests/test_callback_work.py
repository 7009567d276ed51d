"""Callbacks meet their functions in one shuffle."""

import pytest

from lakewarden.operators import code_rules as C
from lakewarden.sources import python_facts as P


def test_callbacks_need_no_written_table(spark, monkeypatch):
    monkeypatch.setattr(C, "_cut", lambda df: pytest.fail("written"))
    text = "def f(): pass\nclass A:\n    def f(self): run(target=f)\n    async def g(self): pass\nrun(f, 'f', 1, f(), g, b'x', None)\n"
    got = C.callback_edges(P.python_facts(spark.createDataFrame([("a.py", text)], "path string, content string"), ("call", "function"), ())).collect()
    assert {(r.src, r.dst) for r in got} == {("a.py:A.f", "a.py:f"), ("a.py:A.f", "a.py:A.f"), ("a.py:<module>", "a.py:f"), ("a.py:<module>", "a.py:A.f"), ("a.py:<module>", "a.py:A.g")}
    assert len(got) == 5
