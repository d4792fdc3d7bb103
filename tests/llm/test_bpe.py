import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strataline.llm import bpe
from strataline.llm.q_bpe import op7_byte_bpe, rank_bytes

RAW = rank_bytes()
RANKS = bpe.parse_ranks(RAW)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MINE = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
DECODER = bpe.Decoder(RANKS)
WORDS = sorted(RANKS)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids = MINE.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert bpe.decoded(DECODER, np.array(ids, np.int64)) == (text.encode(), True)
    assert bpe.decoded(DECODER, np.array(ids, np.int64), 1) == (text.encode(), True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, len(WORDS) - 1), max_size=8))
def test_joined_tokens(picked):
    text = b"".join(WORDS[i] for i in picked).decode("utf-8", "ignore").replace(" ", "")
    assert MINE.encode(text) == THEIRS.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", "a" * 3000, "ab" * 2000, "=" * 777, "é" * 999, "x y " * 100, "<|endoftext|>", "日本🙂"])
def test_long_and_odd(text):
    assert MINE.encode(text) == THEIRS.encode_ordinary(text)


def test_table_starts_anew_when_full():
    small = bpe.Transducer(RANKS, max_states=5, max_pairs=5)
    for word in ["unbelievably", "thanonndha", "aaaaaaaaab", "1234567890"]:
        assert list(small.encode_piece(word.encode())) == THEIRS.encode_ordinary(word)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50255), max_size=12))
def test_streaming_decode_any_ids(ids):
    raw = b"".join(DECODER.tokens[i] for i in ids)
    try:
        raw.decode()
        fine = True
    except UnicodeDecodeError:
        fine = False
    for chunk in (1, 3, 4096):
        assert bpe.decoded(DECODER, np.array(ids, np.int64), chunk) == (raw.decode("utf-8", "replace").encode(), fine)


def test_a_cut_character_waits():
    stream = bpe.Stream(DECODER)
    one, two = RANKS["é".encode()[:1]], RANKS["é".encode()[1:]]
    assert stream.feed(np.array([RANKS[b"a"], one])) == b"a" and stream.feed(np.array([two])) == "é".encode() and stream.end() == b"" and stream.well_formed


def test_documents_nulls_and_repeats(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello  world's é\n", "z"), (3, "Hello  world's é\n", "z"), (None, "🙂" * 500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = bpe.encode_documents(docs, RAW, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, tuple(r.token_ids)) for r in got) == sorted((a or 0, tuple(THEIRS.encode_ordinary(b or ""))) for a, b, _ in rows)
    both = bpe.encode_documents(docs, RAW, public_tokenizers.PATTERN, out="bytes").collect()
    again = bpe.decode_documents(bpe.encode_documents(docs, RAW, public_tokenizers.PATTERN), RAW).collect()
    assert sorted(bytes(r.bytes) for r in both) == sorted(bytes(r.decoded) for r in again) == sorted((b or "").encode() for _, b, _ in rows) and all(r.well_formed for r in both)
    assert bpe.encode_documents(docs.limit(0), RAW, public_tokenizers.PATTERN).count() == 0


def test_query_matches_tiktoken(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = THEIRS.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
