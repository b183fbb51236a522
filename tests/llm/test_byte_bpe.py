import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from llm_fixtures import SF001, no_docs, odd  # noqa: F401
from revmine.llm import byte_bpe as B, queries as Q
from revmine.llm.common import table

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return B.BytePairCodec(B.PerfectHash.build(B.read_ranks(PATH)), public_tokenizers.PATTERN), enc


def test_perfect_hash_is_minimal_and_exact(both):
    ph, ranks = both[0].ranks, B.read_ranks(PATH)
    assert len(ph.keys) == len(ranks) and sorted(ph.keys) == sorted(ranks)
    assert all(ph.get(k) == v for k, v in ranks.items())
    assert ph.get(b"no such token, surely") == -1 and ph.get(b"") == -1


@pytest.mark.parametrize("n", [0, 1, 2, 5, 9, 300])
def test_small_tables(n):
    table_ = {bytes([i % 256, i // 256]): i * 3 for i in range(n)}
    if n:
        ph = B.PerfectHash.build(table_)
        assert all(ph.get(k) == v for k, v in table_.items()) and ph.get(b"zzz") == -1


@given(st.text(max_size=300))
@settings(max_examples=150, deadline=None)
def test_equals_the_library(both, text):
    codec, enc = both
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@given(st.lists(st.binary(min_size=1, max_size=70), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_side_by_side_equals_one_heap_for_each(both, keys):
    merge = both[0].merge
    ids, n = merge.many(keys)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [merge.long(k) for k in keys]


def test_more_pre_tokens_than_a_worker_keeps(both, monkeypatch):
    codec, enc = both
    monkeypatch.setattr(B, "_KNOWN", 5)
    for text in ("one two three four five six seven eight nine ten", "one eleven twelve\n\n one two", "zwölf  Boxkämpfer\tjagen\n Viktor "):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == enc.encode_ordinary(text)


def test_long_texts_and_pre_tokens(both):
    codec, enc = both
    for text in ("ab" * 4000, "x" * 3001, "é" * 2000, "word " * 300_000, " " * 2000 + "a", "<|endoftext|>"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == enc.encode_ordinary(text)


def test_query_equals_the_library(spark, both):
    want = set()
    for r in table(spark, SF001, "documents").collect():
        ids = np.array(both[1].encode_ordinary(r["text"] or ""), "<u4").tobytes()
        want.add((r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = Q.op8_byte_bpe(spark, SF001).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_odd_rows(spark, odd, no_docs, both):
    rows = B.encode(odd, PATH, public_tokenizers.PATTERN).collect()
    want = sorted(both[0].encode(r["text"] or "") for r in odd.collect())
    assert sorted(bytes(r["ids"]) for r in rows) == want
    assert B.encode(no_docs, PATH, public_tokenizers.PATTERN).collect() == []
    assert B.digests(no_docs, PATH, public_tokenizers.PATTERN).collect() == []
