"""Ids by chunks equal the library's, whatever the caches hold, and a worker keeps one cache."""

from array import array

from tokenizers import Tokenizer

from lakewarden.llm.queries import byte_bpe
from lakewarden.llm.tokens import IdCache, id_cache

TEXTS = ["", " ", "a b c, d.", "  a  b ", "\n\n x", "a\0b c", "a <|endoftext|> b", "日本 語", "don't we'll 12 34a", "x" * 300 + " y" * 3, "é ü — z", "tab\tb \t c", *(f"word{i} of {i % 7} more" for i in range(60))]


def test_ids_equal_the_library():
    lib = Tokenizer.from_file(byte_bpe())
    lib.no_truncation()
    lib.no_padding()
    want = [array("I", e.ids).tobytes() for e in lib.encode_batch_fast(TEXTS, add_special_tokens=False)]
    for cache in (IdCache(byte_bpe()), IdCache(byte_bpe(), limit=5, room=100, words=7)):
        for n in (1, 5, len(TEXTS)):
            assert [x for i in range(0, len(TEXTS), n) for x in cache.encode(TEXTS[i : i + n])] == want
    assert max(map(len, cache.words)) <= 256


def test_a_worker_keeps_its_cache():
    assert id_cache(byte_bpe()) is id_cache(byte_bpe())
