import hashlib
import re
from collections import Counter

import pytest

from lakewarden.llm import queries as Q
from lakewarden.llm.common import Workspace, table
from lakewarden.llm.decontam import build_index, decontaminate, matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for at in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[at : at + width]), set()).add(i)
    sizes = {len(w) for w in windows}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if got := windows.get(tuple(w[at : at + n])):
                    hit.update(range(at, at + n))
                    found |= got
        names = sorted({str(i) for i in found if i is not None})
        yield d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def test_equals_brute_force(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = Counter(brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))
    assert sum(x[5] for x in want) > 0
    assert Counter(map(tuple, Q.op10_decontamination(spark, sf).collect())) == want
    small = decontaminate(docs, items, block_words=50)
    assert Counter(map(tuple, small.select(*Q.op10_decontamination(spark, sf).columns).collect())) == want


@pytest.mark.parametrize("block_words", [1, 1000])
def test_odd_rows(spark, odd_docs, no_docs, block_words):
    items = [(1, "word " * 12), (None, "unicode 日本語"), (2, None), (3, "..."), (4, "A"), (4, "tab and newline"), (10, "it's"), (5, "é " * 11)]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, spans string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = decontaminate(odd_docs, bench, block_words=block_words).select(cols).collect()
    assert Counter(map(tuple, got)) == Counter(brute([(r.doc_id, r.text) for r in odd_docs.collect()], items))
    assert decontaminate(no_docs, bench).collect() == []
    none = decontaminate(odd_docs, bench.limit(0)).collect()
    assert len(none) == odd_docs.count() and not any(r.contaminated for r in none)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "the very quick brown fox"), (3, "fox"), (4, "quick the fox")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the quick fox")], "item_id long, text string")
    found = matches(build_index(docs, Workspace(spark)), items, slop=1).where("size(items) > 0")
    assert sorted(r.doc_id for r in found.collect()) == [1, 2, 4]
