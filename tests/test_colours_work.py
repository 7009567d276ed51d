"""Only colours that are new go on."""

from lakewarden.operators import graph as G


def test_components_follow_new_colours_only(spark, monkeypatch):
    seen, cut = [], G._cut

    def kept(df):
        out = cut(df)
        if "new" in out.columns:
            seen.append(out.where("new").count())
        return out

    monkeypatch.setattr(G, "_cut", kept)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (5, 4), (3, 4), (6, 6)], "src long, dst long")
    assert sorted(map(tuple, G.strong_components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]
    assert seen and seen[0] > 0 and 0 in seen
