import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as C
from llm_fixtures import SF001, odd  # noqa: F401
from revmine.llm import quality_rank as QR
from revmine.llm.common import learnable, table
from test_near_dup import brute as groups
from test_phrase_index import brute as contaminated
from test_rules_chat_urls import measures


def test_run_equals_a_plain_version(spark):
    docs = table(spark, SF001, "documents")
    model = QR.fit(docs, table(spark, SF001, "labels"), train=learnable())
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    keep = [r["id"] for r in QR.score(docs, model).collect() if r["score"] >= 0.3]
    good = []
    for i in sorted(keep):
        n, chars, symbols, lines, dup, repeated = measures(rows[i])
        if not (n < 10 or 100 * repeated > 20 * n or 100 * symbols > 10 * chars or 100 * dup > 50 * lines or chars < 2 * n or chars > 30 * n):
            good.append((i, rows[i]))
    alone = [(i, rows[i]) for i, (_, c) in groups(good).items() if i == c]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF001, "benchmark").collect()]
    clean = [v[0] for v in contaminated(alone, items) if not v[5]]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i in clean:
        ids = np.array(enc.encode_ordinary(rows[i]), "<u4")
        want.add((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(rows[i].encode()).hexdigest()))
    out = C.run(spark, SF001)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in out.collect()} == want and len(want) > 100


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF001, "documents")
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "decontamination", "byte_bpe"]
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_stages_of_no_documents(spark):
    none = table(spark, SF001, "documents").where("doc_id < 0")
    for _, stage in C.STAGES:
        assert stage(spark, none, SF001).collect() == []


def test_names_that_stages_use_themselves(spark):
    docs = table(spark, SF001, "documents").selectExpr("*", "doc_id as _gone", "doc_id as _bad_id", "text as _bad_own", "1 as _rules_x", "2 as _score")
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_stages_on_odd_rows(spark, odd):
    """Nulls, empty and very long texts, repeated rows, clashing names: whole rows out, none invented."""
    rows = {tuple(r) for r in odd.collect()}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, odd, SF001)
        got = [tuple(r) for r in out.collect()]
        assert out.columns == odd.columns and set(got) <= rows, name
    assert len(C.byte_bpe_ids(spark, odd, SF001).collect()) == odd.count()
