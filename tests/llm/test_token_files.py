import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from llm_fixtures import SF001, no_docs, odd  # noqa: F401
from revmine.llm import queries as Q, token_files as TF
from revmine.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


def reference(texts):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    return [e.ids + [1] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@given(st.integers(1, 40), st.integers(0, 3000), st.data())
@settings(max_examples=40, deadline=None)
def test_packing_round_trip_and_random_access(bits, n, data):
    ids = np.random.default_rng(n).integers(0, 1 << min(bits, 32), n)
    packed = np.frombuffer(TF.pack(ids, bits), np.uint8)
    assert len(packed) == -(-n * bits // 8) or bits in (8, 16, 32)
    a = data.draw(st.integers(0, n))
    b = data.draw(st.integers(a, n))
    assert (TF.unpack(packed, bits, a, b - a) == ids[a:b].astype(np.uint32)).all()


def test_bits_are_the_fewest():
    assert [TF.bits_for(n) for n in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_query_equals_the_tokenizer(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, SF001, "documents").collect())
    want, start = {}, 0
    for (i, _), ids in zip(docs, reference([t for _, t in docs]), strict=True):
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in Q.op1_token_files(spark, SF001).collect()}
    assert got == want


@pytest.mark.parametrize("by_unit", [True, False])
def test_odd_rows_read_back_by_random_access(spark, odd, by_unit, tmp_path):
    files = TF.write_token_files(odd, PATH, 1, by_unit=by_unit)
    rows = sorted(files.collect(), key=lambda r: (r["part"], r["seq"]))
    got = []
    for r in rows:
        f = TF.TokenFile(bytes(r["image"]))
        assert f.bits == 16 and f.n_ids == r["n_ids"]
        got += [(None if not v else int(i), f.document(k).tolist()) for k, (i, v) in enumerate(zip(f.doc_ids, f.valid, strict=True))]
    texts = odd.select("doc_id", "text").collect()
    want = [(r["doc_id"], ids) for r, ids in zip(texts, reference([r["text"] for r in texts]), strict=True)]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert [i for i, _ in got] == sorted([i for i, _ in got], key=lambda i: (i is not None, i or 0))
    # exported files: memory-mapped, part of a document alone
    paths = sorted(r["path"] for r in TF.export_files(files, str(tmp_path / "x")).collect())
    assert len(paths) == len(rows)
    f = TF.TokenFile(np.memmap(paths[-1], np.uint8, "r"))
    assert (f.ids(3, 9) == f.ids()[3:9]).all()
    starts = sorted((r["start"], r["n_tokens"]) for r in TF.read_token_files(files).collect())
    assert [s for s, _ in starts] == np.cumsum([0, *[n for _, n in starts]])[:-1].tolist()


def test_no_rows(spark, no_docs):
    assert TF.read_token_files(TF.write_token_files(no_docs, PATH, 1)).collect() == []


def test_every_character_encodes_as_in_its_text():
    with open(PATH, encoding="utf-8") as f:
        encoder = TF._Encoder(f.read(), 1, True)
    import pyarrow as pa
    cps = [chr(c) for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1 {c}{c} bJ{c}\n{c}! 'S,W{c}.T{c}T's" for c in cps[i:i + 50]) for i in range(0, len(cps), 50)]
    texts += ["\x01", "a\x01b \x01 !\x01 c", "J\u030c j\u030c I\u0307 DON'T X''S rock'n'roll"]
    ids, starts = encoder(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == reference(texts)
