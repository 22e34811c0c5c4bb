from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kgspark.llm import bpe
from kgspark.llm.common import WordEncoder, tokenizer_path

LIBRARY = Tokenizer.from_file(tokenizer_path())
ENCODER = WordEncoder.of(tokenizer_path())


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300), st.sampled_from([1, 2, 4]))
def test_chunks_join_to_the_library_s_ids(text, bits):
    data = (text * 3).encode("utf-8", "ignore")
    parts = bpe.chunks(data, bpe.cuts([data], bits)[0])
    assert b"".join(parts) == data
    whole = bpe.repaired(ENCODER, parts, [ENCODER.encode(p) for p in parts]) if parts else b""
    assert list(memoryview(whole).cast("I")) == library(data.decode())
    assert ENCODER.decode(whole) == LIBRARY.decode(library(data.decode()), skip_special_tokens=False)


def test_chunks_depend_on_nearby_bytes_alone():
    a = b"".join(hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(200))
    here, there = ({bpe.digest(c) for c in bpe.chunks(t, bpe.cuts([b"x" * 77, t], 7)[1])} for t in (a, b"prefix " + a))
    assert len(here & there) >= len(here) - 1


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_encoding_agrees_with_the_library(which, request):
    df = request.getfixturevalue(which)
    want = sorted((r.doc_id or 0, library(r.text)) for r in df.collect())
    got = sorted((r.doc_id or 0, list(memoryview(bytes(r.ids)).cast("I")), r.decoded) for r in bpe.encode(df).collect())
    assert [(a, b) for a, b, _ in got] == want
    assert all(t == LIBRARY.decode(ids, skip_special_tokens=False) for _, ids, t in got)


def test_query_digests(spark, sf, texts):
    rows = bpe.op10_bpe_chunk_reuse(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows[:40]:
        ids = np.array(library(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())


def test_nothing(nothing):
    assert bpe.encode(nothing).collect() == []


def test_a_stretch_is_widened_until_the_outer_words_agree():
    """Ids of a chunk that are not those of its words, as of an encoder that looks across words, are not built upon."""
    parts = [b"one two thr", b"ee four five six seven"]
    wrong = b"\0\0\0\0" * 2 + ENCODER.encode(b" six seven")
    whole = bpe.repaired(ENCODER, parts, [ENCODER.encode(parts[0]), wrong])
    assert list(memoryview(whole).cast("I")) == library("one two three four five six seven")


def test_repeated_rows_need_their_chunks_once(spark, monkeypatch):
    """Equal rows have one key; its list holds the chunks of the text, not those of all its copies."""
    text = " ".join(f"word{i * 7919 % 5000} and{i}" for i in range(1500))
    rows = [(1, text)] * 2000 + [(2, text + " more"), (3, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    seen = []
    monkeypatch.setattr(bpe, "joined", lambda a, b, *k, real=bpe.joined, **kw: seen.append(real(a, b, *k, **kw)) or seen[-1])
    got = {(r.doc_id, bytes(r.ids)) for r in bpe.encode(df).collect()}
    assert {(i, list(memoryview(b).cast("I"))[:3] != []) for i, b in got} == {(1, True), (2, True), (3, True)}
    for i, b in got:
        assert list(memoryview(b).cast("I")) == library(dict(rows)[i])
    sizes = [r.n for r in seen[0].groupBy("key").agg(F.size(F.collect_set(F.struct("hash", "ids"))).alias("n")).collect()]
    assert max(sizes) == len({bpe.digest(c) for c in bpe.chunks(text.encode(), bpe.cuts([text.encode()])[0])})
