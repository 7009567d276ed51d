"""The knowledge graph needs few facts and shuffles no texts."""

import small_corpus as small

from lakewarden.operators import relations as L
from lakewarden.sources import python_facts as P


def test_a_file_with_any_fact_has_a_module_row():
    of = lambda c: [r[1] for r in P.facts_of("a.py", c, frozenset(L.GRAPH_KINDS), frozenset())]
    assert (of("f()\n"), of("def f(): pass\n"), of(""), of("def (")) == (["module"], ["function", "module"], [], ["error"])


def test_graph_of_fewer_facts_is_the_same(spark):
    files = small.files(spark).where("path like '%.py'")
    whole, some = (L.knowledge_graph(P.python_facts(files, kinds, ("function",))) for kinds in (None, L.GRAPH_KINDS))
    for a, b in zip(whole, some, strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_graph_shuffles_no_texts(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(L, "_cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    L.knowledge_graph(spark.createDataFrame([], P.FACTS))
    assert len(plans) == 1 and "collect_list" not in plans[0]
