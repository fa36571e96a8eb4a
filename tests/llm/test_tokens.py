import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import packing, queries, token_files
from quern.llm.tokens import Encoder, encoder

WORD, BYTE = (queries.tokenizer(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
TRICKY = ["a\n\nb", "  x", "x  y ", "\n", "a \n b", "don't  it's", "a b　c", "\x1c a\x1fb", "a\x85b", "É Ünal É́ ß ẞ ŉ ª º", "İ ΑΣ Ǆ", "<|endoftext|> a<|startoftext|>", "1234 5.6", "", " ", "a" * 5000, " " * 2000, "!!!'''s 'LL DON'T", "\x00\x7f", "word. Word, (word)!"]


@lru_cache
def untouched(path):
    return Tokenizer.from_file(path)


def ids_of(path, text):
    return untouched(path).encode(text, add_special_tokens=False).ids


def test_added_tokens_are_found(spark):
    texts = ["x <|endoftext|> y", "<|startoftext|>a<|endoftext|>", "<|EndOfText|> <|endoftext", "a <|endoftext|><|endoftext|>b"]
    for path in (WORD, BYTE):
        assert [x.tolist() for x in encoder(path).encode(texts)] == [ids_of(path, t) for t in texts]
    assert encoder(WORD).encode(["<|endoftext|>"])[0].tolist() == [49407]


def test_query_of_files_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op7_token_ids(spark, sf).collect()}
    at = 0
    for doc, text in docs:
        ids = [*ids_of(WORD, text), 1]
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


def test_query_of_packing_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: [*ids_of(BYTE, r.text or ""), 1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_packing(spark, sf).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == docs.keys()
    for doc, ids in docs.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_short_ways_equal_the_library(path):
    for text, got in zip(TRICKY, encoder(path).encode(TRICKY), strict=True):
        assert got.tolist() == ids_of(path, text), text[:40]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeiou .,\n'st É"))))
def test_any_text_equals_the_library(text):
    for path in (WORD, BYTE):
        assert encoder(path).encode([text])[0].tolist() == ids_of(path, text)


def test_memory_is_emptied_when_full(monkeypatch):
    monkeypatch.setattr("quern.llm.tokens.CACHE_WORDS", 3)
    enc = Encoder(WORD)
    texts = ["one two three four five", "six one seven", "two nine"]
    assert [x.tolist() for x in enc.encode(texts)] == [ids_of(WORD, t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1))))
def test_streams_round_trip(values):
    x = np.array(values, "<u4")
    control, data = token_files.encode_ids(x)
    assert token_files.decode_ids(control, data, len(x)).tolist() == values
    assert len(control) == -(-len(values) // 4)


def documents(spark):
    texts = [None, "", *TRICKY, *(f"word{i} " * (i * 40 % 900) for i in range(40)), *["same text here"] * 30, "long text " * 9000]
    rows = [(i * 7 % 1000, t, "x", 1) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string, row int")


def test_files_round_trip_in_order(spark):
    rows, docs = documents(spark)
    enc = encoder(WORD)
    tokens = token_files.written(token_files.token_table(docs, WORD, 1), "tokens")
    ranks = token_files.id_ranks(tokens, enc.size, enc.dtype.itemsize)
    assert sorted(ranks.tolist()) == list(range(enc.size))
    read = token_files.read_blocks(token_files.write_blocks(tokens, ranks, enc.dtype.itemsize), ranks)
    at = 0
    got = sorted(read.collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    for r, (doc, text, *_) in zip(got, sorted(rows), strict=True):
        want = [*ids_of(WORD, text or ""), 1]
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, len(want))
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        at += len(want)


def test_packing_holds_each_id_once(spark):
    rows, docs = documents(spark)
    window = 64
    pieces = packing.pack_documents(docs, BYTE, 1, window).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert len(by_doc) == len(rows)
    for doc, text, *_ in rows:
        ids = [*ids_of(BYTE, text or ""), 1]
        found = sorted(by_doc[doc], key=lambda p: p.start)
        assert [i for p in found for i in np.frombuffer(p.ids, "<u4").tolist()] == ids
        for p in found:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or at & (at - 1) == 0 and at < window


def test_plan_uses_combinations():
    histogram = np.zeros(64, np.int64)
    histogram[[20, 44, 30, 34, 10, 50]] = [100, 90, 40, 40, 7, 100]
    made = packing.plan(histogram, 5)
    assert (made.planned <= histogram).all() and made.planned.sum() > 250
    taken = [(s + k, o, a) for a in range(64) for lo, hi, s, o in zip(made.lows[a], [*made.lows[a][1:], made.planned[a]], made.sequences[a], made.offsets[a], strict=False) for k in range(hi - lo)]
    filled = np.bincount([s for s, _, _ in taken], [a for _, _, a in taken])
    assert set(filled[5:]) == {64}


def test_residuals_are_packed_greedily():
    left = np.zeros(64, np.int64)
    left[[40, 9, 5, 1, 63]] = [6, 12, 7, 9, 1]
    before = left.copy()
    found = packing.greedy(left)
    assert all(sum(combo) == 64 for combo, _ in found) and (left >= 0).all()
    taken = sum((np.bincount(combo, minlength=64) * n for combo, n in found), np.zeros(64, np.int64))
    assert (before - taken == left).all() and taken[63] == 1 and taken[40] == 6
    made = packing.plan(before, 0)
    assert (made.planned == taken).all()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, BYTE, 1).collect() == []
    tokens = token_files.written(token_files.token_table(docs, WORD, 1), "tokens")
    ranks = token_files.id_ranks(tokens, encoder(WORD).size, 2)
    assert token_files.read_blocks(token_files.write_blocks(tokens, ranks, 2), ranks).collect() == []


def test_words_of_a_text_with_a_new_one_are_looked_up_once():
    class Counted(dict):
        calls = 0

        def __getitem__(self, key):
            self.calls += 1
            return super().__getitem__(key)

    enc = Encoder(WORD)
    enc.cache = Counted()
    enc.encode(["known words, Again"])
    enc.cache.calls = 0
    text = "known words, Again Unheard-of Ünheard! 12,5 İx ƀy"
    assert enc.encode([text])[0].tolist() == enc.library.encode(text, add_special_tokens=False).ids
    assert enc.cache.calls == 8
