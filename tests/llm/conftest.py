import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string, row string, token string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, odd characters, clashing columns."""
    texts = [None, "", " ", "a", "a", "  two  spaces \n\n here ", "it's <|endoftext|> a ² test ½", "naïve Ünïcode 日本語 　 x", "\x1c odd \x85 \xa0 space", "A" * 3000, "word " * 20000, "tab\tand\nnewline", "emoji 😀😀 done", "\0 null byte"]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, 1, "x", "y", "z", "q") for i, t in enumerate(texts)]
    rows += [(None, "no id at all here", None, None, None, None, None, None, None), (3, "a", "en", "s", 1, "x", "y", "z", "q")]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
