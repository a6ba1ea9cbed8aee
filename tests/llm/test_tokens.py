"""Byte-level BPE and token files against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from odd_rows import ODD_ROWS
from hypothesis import given, settings
from hypothesis import strategies as st

from slopecast.llm import byte_bpe, queries, token_files
from slopecast.session import shared_dir

OWN = byte_bpe.encoding(queries.BYTE_RANKS, public_tokenizers.PATTERN)
PIECES = st.lists(st.sampled_from(["a", "B", "'s", "'", " ", "  ", "\n", "\t", " ", "\x1c", "7", "é", "日", "!", "\U0001f600", "the", "\r\n"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(1, 6))
def test_chunks_change_no_id(text, size):
    parts = list(byte_bpe.chunks(text, size))
    assert "".join(parts) == text
    assert [i for p in parts for i in OWN.encode_ordinary(p)] == OWN.encode_ordinary(text)


def test_encode_and_decode_whole_texts(odd_docs, no_docs):
    encoded = byte_bpe.encode(odd_docs, queries.BYTE_RANKS, public_tokenizers.PATTERN)
    rows = byte_bpe.decode(encoded.withColumn("again", encoded.ids), queries.BYTE_RANKS, public_tokenizers.PATTERN, "again").collect()
    got = sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in rows)
    assert got == sorted((str(i), OWN.encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD_ROWS)
    assert byte_bpe.encode(no_docs, queries.BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_bytes_that_are_no_text_decode(spark):
    ids = [int(i) for i in OWN.encode_ordinary("日本")][:1]
    (row,) = byte_bpe.decode(spark.createDataFrame([(ids,), ], "ids array<int>"), queries.BYTE_RANKS, public_tokenizers.PATTERN).collect()
    assert bytes(row.decoded) == OWN.decode_bytes(ids)
    (row,) = byte_bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), queries.BYTE_RANKS, public_tokenizers.PATTERN).collect()
    assert bytes(row.decoded) == b""


def test_op1_digests(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.QUERIES["op1_byte_bpe"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = OWN.encode_ordinary(d.text or "")
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def library_ids(text):
    return token_files.tokenizer(queries.WORD_BPE).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(PIECES | st.text(max_size=40))
def test_words_have_the_ids_of_the_text(text):
    text = text.encode("utf-8", "ignore").decode()
    (raw,) = token_files.word_ids(queries.WORD_BPE).texts([text])
    assert np.frombuffer(raw, "<u4").tolist() == library_ids(text)


SIMPLE_WORDS = st.lists(st.sampled_from([*map(chr, range(0x21, 0x7F)), *map(chr, range(0xC0, 0x100)), "'s", "'ll", "don", "ß", "\x00", "\x7f"]), min_size=1, max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(SIMPLE_WORDS, max_size=8).map(" ".join))
def test_pieces_of_a_word_have_its_ids(text):
    (raw,) = token_files.WordIds(queries.WORD_BPE).texts([text])
    assert np.frombuffer(raw, "<u4").tolist() == library_ids(text)


def test_simple_words_go_to_the_model_and_few_are_kept(monkeypatch):
    monkeypatch.setattr(token_files, "WORDS_KEPT", 10)
    words = token_files.WordIds(queries.WORD_BPE)
    words.own = None  # asked for other words only
    text = " ".join(f"Wort{chr(97 + n % 26)}{n}ähnlich,%% it's" for n in range(50))
    assert np.frombuffer(b"".join(words.texts([text])), "<u4").tolist() == library_ids(text)
    assert len(words) <= 10


def expected(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, out = 0, []
    for i, t in ordered:
        ids = [*library_ids(t), 1]
        out.append((i, start, len(ids), np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_files_round_trip(spark, odd_docs, no_docs):
    folder = shared_dir(spark, "test-tokens")
    token_files.write(odd_docs, folder, queries.WORD_BPE)
    got = sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in token_files.read(spark, folder).collect()), key=lambda r: r[1])
    assert got == expected(ODD_ROWS)
    some = sorted((r.doc_id, bytes(r.ids)) for r in token_files.read(spark, folder, 7, 9).collect())
    assert some == sorted((i, x) for i, _, _, x in expected(ODD_ROWS) if i is not None and 7 <= i <= 9)
    empty = shared_dir(spark, "test-tokens")
    token_files.write(no_docs, empty, queries.WORD_BPE)
    assert token_files.read(spark, empty).count() == 0


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_blocks_of_any_size(spark, sf_dir, monkeypatch, block):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(token_files, "BLOCK_BYTES", block)
    folder = shared_dir(spark, "test-tokens")
    token_files.write(docs, folder, queries.WORD_BPE)
    got = {r.doc_id: (r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in token_files.read(spark, folder).collect()}
    assert got == {i: (s, n, zlib.crc32(x)) for i, s, n, x in expected(rows)}
