import base64
import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import byte_bpe as op
from tests.llm.cases import ROWS, documents

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return op.Codec(PATH, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_as_tiktoken(both):
    codec, tik = both

    @settings(max_examples=500, deadline=None)
    @given(st.one_of(st.text(), st.text("aeinst ' \x1c\x1f\n　​ßéИ字9<|endoftext|>", max_size=60)))
    def run(text):
        ids = codec.encode(text)
        assert ids == struct.pack(f"<{len(ids) // 4}I", *tik.encode_ordinary(text))
        assert codec.decode(ids) == text.encode()

    run()


def test_rows(spark, both):
    out = {(r.doc_id, r.ids_sha256): r for r in op.encode(documents(spark), PATH, P.PATTERN, with_ids=True).collect()}
    for i, text, *_ in ROWS:
        ids = both[1].encode_ordinary(text or "")
        r = out[i, hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()]
        assert r.n_tokens == len(ids) and r.ids == ids and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert op.encode(documents(spark, []), PATH, P.PATTERN).collect() == []


def test_long_pre_tokens_are_encoded_whole_and_not_remembered(both):
    codec, tik = both
    for text in ("a" * 5_000, "日本" * 3_000, "x" * 17 + " " + "!" * 4_000, " " * 3_000 + "end"):
        ids = codec.encode(text)
        assert ids == struct.pack(f"<{len(ids) // 4}I", *tik.encode_ordinary(text)) and codec.decode(ids) == text.encode()
    assert max(len(p.encode()) for p in codec.seen) <= op.REMEMBERED_BYTES


def test_memory_is_emptied_and_changes_nothing(monkeypatch):
    monkeypatch.setattr(op, "REMEMBERED", 10)
    codec, fresh = op.Codec(PATH, P.PATTERN), op.Codec(PATH, P.PATTERN)
    texts = [f"word{k} and other{k % 7} words {k}" for k in range(200)]
    monkeypatch.setattr(op, "REMEMBERED", 10)
    first = [codec.encode(t) for t in texts]
    assert len(codec.seen) < 40
    monkeypatch.setattr(op, "REMEMBERED", 10**6)
    assert first == [fresh.encode(t) for t in texts]
