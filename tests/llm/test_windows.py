import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lakewarden.llm import queries as Q
from lakewarden.llm.common import table
from lakewarden.llm.windows import ChunkIds, online, pack_online, powers


def ids_of(texts):
    lib = Tokenizer.from_file(Q.word_bpe())
    return [np.array([*e.ids, 1], "<u4") for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(docs, rows, size=2048):
    """Every id lies in one piece, windows are gapless and need no padding."""
    want = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs), key=str)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == size or at < size and at & (at - 1) == 0
    texts = defaultdict(list)
    for none, doc, text in want:
        texts[None if none else doc].append(text)
    assert texts.keys() == pieces.keys()
    for doc, own in texts.items():
        if len(own) > 1:  # pieces of rows that share an id aren't told apart by the result
            assert sum(r.length for r in pieces[doc]) == sum(map(len, ids_of(own)))
            continue
        ids, at = ids_of(own)[0], 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    check(docs.collect(), Q.op11_packing(spark, sf).collect())


@pytest.mark.parametrize(("size", "keep", "parts"), [(64, 1, 5), (128, 4, 3), (2048, 32, 7), (1000, 2, 1)])
def test_odd_rows(spark, odd_docs, size, keep, parts):
    docs = odd_docs.repartition(parts)
    got = pack_online(docs, Q.word_bpe(), size=size, keep=keep)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(odd_docs.collect(), got.collect(), size)


def test_no_rows(spark, no_docs):
    assert pack_online(no_docs, Q.word_bpe()).collect() == []


def test_other_id_types(spark):
    docs = spark.createDataFrame([("x", "one two"), ("y", None)], "doc_id string, text string")
    check([], [])
    assert sorted((r.doc_id, r.length) for r in pack_online(docs, Q.word_bpe()).collect()) == [("x", 1), ("x", 2), ("y", 1)] or sum(r.length for r in pack_online(docs, Q.word_bpe()).collect()) == 4


def test_chunks_give_the_librarys_ids():
    texts = ["", " ", "a\x1cb c", "ÀÉ ́x İstanbul ΣΑΣ", "x\xa0y z", "<|endoftext|> a<|startoftext|>B <|ENDOFTEXT|>", "it's I'LL 'S ''", "①½²", "日本語　テキスト", "\x85a\x0bb", "a\x00b", "🙂👍🏽 test​", "KΩ", "w" * 5000, "a b " * 9]
    cache = ChunkIds(Q.word_bpe(), limit=5)
    want = [x.tobytes() for x in ids_of(texts)]

    def encoded(texts):
        raw, at = cache.encode(pa.array(texts, pa.string()), 1)
        return [raw[4 * a : 4 * b] for a, b in zip(at, at[1:], strict=False)]

    assert encoded(texts) == want
    assert encoded(texts[::-1]) == want[::-1]  # from the old generation
    assert encoded([None, "x"]) == encoded(["", "x"])
    assert cache.encode(pa.array([], pa.string()), 1)[0] == b""
    assert cache.encode(pa.array(["a b"]))[0] == want[texts.index("a b " * 9)][:8]
    bad = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, 3], "<i4").tobytes()), pa.py_buffer(b"a\xff "))
    assert cache.encode(bad)[0] == cache.encode(pa.array(["a\ufffd "]))[0]


def test_other_tokenizers_raise():
    with pytest.raises(ValueError, match="white space"):
        ChunkIds(Q.byte_bpe())


def test_space_is_bounded_and_best_fit():
    def piece(n, doc):
        return doc, 0, b"\0" * 4 * n, n

    pieces = [piece(60, 1), piece(70, 2), piece(30, 3), piece(25, 4), piece(90, 5), piece(250, 6), piece(50, 7)]
    got = [[(p[0], p[1], len(p[2]) // 4) for p in w] for _, w in online(iter(pieces), 100, 2)]
    # 30 fills 70 best; none has room for 25 in it but the other; 90 tops up 70 + 30 (full), then opens a window
    assert got[0] == [(2, 0, 70), (3, 0, 30)]
    assert all(sum(n for _, _, n in w) == 100 for w in got[:-1])
    assert sum(n for w in got for _, _, n in w) == 575


def test_leftovers_are_cut_into_powers_of_two():
    got = list(powers([("a", 5, b"\1" * 4 * 1000, 1005), ("b", 0, b"\2" * 4 * 500, 500)]))
    assert [sum(len(p[2]) // 4 for p in w) for w in got] == [1024, 256, 128, 64, 16, 8, 4]
    assert b"".join(p[2] for w in got for p in w) == b"\1" * 4000 + b"\2" * 2000
