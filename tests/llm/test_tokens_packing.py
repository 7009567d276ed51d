import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest

from lakewarden.llm import queries as Q
from lakewarden.llm import tokens as T
from lakewarden.llm.common import table
from lakewarden.llm.packing import best_fit, exact_complements, pack, slots
from lakewarden.llm.tokens import count_tokens, pre_tokens


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.byte_bpe())


def counted(rows, lib):
    return Counter((d, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows)


def test_counts_equal_the_library(spark, sf, lib, odd_docs, no_docs, monkeypatch):
    docs = table(spark, sf, "documents")
    want = counted([(r.doc_id, r.text) for r in docs.collect()], lib)
    assert Counter(map(tuple, Q.op2_token_counts(spark, sf).collect())) == want
    want = counted([(r.doc_id, r.text) for r in odd_docs.collect()], lib)
    for most in ((60_000, 1_000_000, 1 << 25), (3, 5, 1 << 25), (60_000, 1_000_000, 10)):
        monkeypatch.setattr(T, "SEGMENT", most)
        assert Counter(map(tuple, count_tokens(odd_docs, Q.byte_bpe()).collect())) == want
    assert count_tokens(no_docs, Q.byte_bpe()).collect() == []


def test_chunks_are_the_librarys_pre_tokens(lib):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    cut = pre_tokens(Q.byte_bpe())

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sabcé1²!\x1c\x85\xa0\0"), st.characters(exclude_categories=["Cs"])), max_size=40))
    def same(text):
        ids = [i for c in cut.chunks(text) for i in lib.encode(c, add_special_tokens=False).ids]
        assert ids == lib.encode(text, add_special_tokens=False).ids
        ids = [i for c in cut.chunks(text) for p in cut.pieces(c) for i in lib.encode(p, add_special_tokens=False).ids]
        assert ids == lib.encode(text, add_special_tokens=False).ids

    same()


def check_packing(rows, docs, lib, size):
    want = Counter()
    for d, t in docs:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        a, b, k = 0, len(ids) % size or min(size, len(ids)), 0
        while a < len(ids):
            want[d, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())] += 1
            a, b, k = b, b + size, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= size
    return len(seqs), -(-sum(r.length for r in rows) // size)


def test_packing_is_exact_and_tight(spark, sf, lib, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    used, least = check_packing(Q.op4_packing(spark, sf).collect(), docs, lib, 2048)
    assert used <= least + 2
    check_packing(pack(odd_docs, Q.byte_bpe()).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], lib, 2048)
    check_packing(pack(odd_docs, Q.byte_bpe(), size=7).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], lib, 7)
    assert pack(no_docs, Q.byte_bpe()).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_plan_uses_every_piece_once(seed):
    g = np.random.default_rng(seed)
    size = int(g.integers(5, 200))
    have = np.zeros(size + 1, np.int64)
    np.add.at(have, g.integers(1, size + 1, 400), 1)
    counts, left = {i: int(c) for i, c in enumerate(have) if c}, have.copy()
    exact = exact_complements(left, size)
    assert all(sum(n * c for n, c in runs) == size for runs, _ in exact)
    plan = exact + best_fit(left, size)
    got = Counter()
    for runs, times in plan:
        assert sum(n * c for n, c in runs) <= size
        for n, c in runs:
            got[n] += c * times
    assert got == counts
    assert len(slots(counts, size)["key"]) == sum(len(r) for r, _ in plan)


def test_triples_fill_gaps():
    have = np.zeros(101, np.int64)
    have[[60, 22, 13, 5]] = [2, 2, 2, 2]
    assert exact_complements(have, 100) == [(((60, 1), (5, 1), (13, 1), (22, 1)), 2)] and not have.any()
