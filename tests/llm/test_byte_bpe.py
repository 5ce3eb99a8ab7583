import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import byte_bpe
from tests.llm.helpers import EDGE, clashing, docs, sha

tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
DATA = open(PATH, "rb").read()
CODEC = byte_bpe.Codec(DATA, PATTERN)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(st.sampled_from("ab \n\té漢😀1!▁Āſ<unk>\r\x00 the"), max_size=60))
def test_same_ids_and_round_trip(text):
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
    ids = CODEC.encode(text)
    assert ids == ref.encode_ordinary(text)
    assert b"".join(byte_bpe.tokens(DATA)[i] for i in ids) == text.encode()


def test_forgetting_changes_nothing(monkeypatch, reference):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    c = byte_bpe.Codec(DATA, PATTERN)
    texts = [f"some words {i} and others {i * i} again" for i in range(200)]
    assert c.encode_all(texts) == [reference.encode_ordinary(t) for t in texts]


def test_edge_rows(spark, reference):
    df = clashing(docs(spark))
    ids = byte_bpe.encode(df, PATH, PATTERN)
    assert set(df.columns) == set(ids.columns)
    out = byte_bpe.with_digest(byte_bpe.decode(ids, PATH, PATTERN)).collect()
    want = sorted((str(i), len(x := reference.encode_ordinary(t or "")), sha(",".join(map(str, x))), sha(t or "")) for i, t, *_ in EDGE)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, hashlib.sha256(bytes(r.decoded)).hexdigest()) for r in out) == want
    assert byte_bpe.encode(docs(spark, []), PATH, PATTERN).count() == 0


def test_null_ids_decode_to_nothing(spark):
    got = byte_bpe.decode(spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>"), PATH, PATTERN).collect()
    assert {bytes(r.decoded) for r in got} == {b""}


def test_vocabulary_must_be_whole():
    with pytest.raises(ValueError):
        byte_bpe.model_bytes({b"a": 0})
    with pytest.raises(ValueError):
        byte_bpe.model_bytes({bytes([b]): b + 1 for b in range(256)})


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "the same text", "en", "s", 1)] * 3
    out = byte_bpe.decode(byte_bpe.encode(docs(spark, rows), PATH, PATTERN), PATH, PATTERN).collect()
    assert len(out) == 3 and {bytes(r.decoded) for r in out} == {b"the same text"}
    assert byte_bpe.decode(byte_bpe.encode(docs(spark, []), PATH, PATTERN), PATH, PATTERN).count() == 0
