"""Token ids in binary files: the format itself, and whole tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from scribeprint.llm import token_files
from scribeprint.llm.scratch import folder

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
LIB = tokenizers.Tokenizer.from_file(PATH)


def encode(text):
    return LIB.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("ids", [[0], [7] * 300, [0, (1 << 32) - 1], list(range(500)), [1] * 400 + [1 << 31] * 20])
def test_blocks(ids):
    ids = np.array(ids, np.uint32)
    for percentile in (1, 50, 95, 100):
        assert (token_files.unpack_block(memoryview(token_files.pack_block(ids, percentile)), len(ids)) == ids).all()


def test_outliers_do_not_widen_a_block():
    rng = np.random.default_rng(1)
    ids = rng.integers(100, 164, 512, dtype=np.uint32)
    ids[::64] = 49_000
    assert len(token_files.pack_block(ids)) < 512 * 6 // 8 + 8 + 6 * 8 + 1


def test_chunks_and_block_starts():
    ids = np.random.default_rng(2).integers(0, 49_408, 5_000).astype(np.uint32)
    documents = np.array([(5, 4_999, 0, 0), (6, 1, 0, token_files.GOES_ON)], token_files._DOCUMENT)
    data = token_files.pack_chunk(3, 9, documents, ids) + b"\n"
    bodies = list(token_files.chunks_of(data * 2))
    assert len(bodies) == 2
    shard, chunk, docs, got = token_files.read_chunk(bodies[1])
    assert (shard, chunk) == (3, 9) and (docs == documents).all() and (got == ids).all()
    for number in (0, 2, 4):
        assert (token_files.read_block(bodies[0], number) == ids[number * 1024:number * 1024 + 1024]).all()
    with pytest.raises(ValueError):
        list(token_files.chunks_of(data[:-1] + b"x"))


def test_joined_crc():
    data = random.Random(3).randbytes(3 << 20)
    cuts = [0, 0, 5, 70_000, 70_000, 2_500_000, len(data)]
    parts = [(zlib.crc32(data[a:b]), b - a) for a, b in zip(cuts, cuts[1:])]
    assert token_files.joined_crc(parts) == zlib.crc32(data)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'stre <|endoftext|>́ \u0085 é１Σς"), st.characters(
    codec="utf-8")), max_size=40))
def test_words_are_encoded_as_the_whole_text_is(text):
    import pyarrow as pa

    own = token_files.word_ids(PATH)
    assert [x.tolist() for x in own.texts(pa.array([text, None]))] == [encode(text), []]


def test_words_that_the_cache_has_no_room_for(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "CACHE_WORDS", 3)
    own, texts = token_files.WordIds(PATH), ["one two three four", "two five", "six one two"]
    for _ in range(2):
        assert [x.tolist() for x in own.texts(pa.array(texts))] == [encode(t) for t in texts]


def rows_of():
    rng = random.Random(4)
    rows = [(k * 3 - 60, " ".join(rng.choices(["one", "Two", "it's", "<|endoftext|>", "9,5"], k=rng.randrange(40))))
            for k in range(60)]
    return rows + [(1000, None), (1001, ""), (1002, "long text " * 3_000), (None, "no id"), (1003, "x"), (1004, "y z")]


@pytest.mark.parametrize("sizes", [{}, {"chunk_ids": 64, "shard_ids": 500, "file_chunks": 3}, {"chunk_ids": 1}])
def test_round_trip(spark, sizes):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(7) for c in ("id", "ids", "row", "n_tokens", "shard", "a.b", "c`d")}).repartition(4)
    got = token_files.round_trip(docs, PATH, **sizes).orderBy("start").collect()
    assert [tuple(r) for r in got] == brute.token_files(rows, encode)


def test_repeated_rows_and_an_empty_table(spark):
    docs = spark.createDataFrame([(5, "one two")] * 50 + [(5, "three")] + [(6, "four " * 100)] * 3, "doc_id long, text string")
    got = sorted(tuple(r) for r in token_files.round_trip(docs, PATH, chunk_ids=16, shard_ids=40).collect())
    assert sorted((r[0], *r[2:]) for r in got) == sorted(
        (r[0], *r[2:]) for r in brute.token_files([tuple(r) for r in docs.collect()], encode))
    ends = sorted((r[1], r[1] + r[2]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert token_files.round_trip(docs.filter("false"), PATH).count() == 0


def test_files_are_cut_and_hold_nothing_else(spark):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string")
    path = token_files.write_files(token_files.encoded(docs, PATH), folder(spark, "files"), chunk_ids=64, file_chunks=2)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    assert len(files) > 3
    for f in files:
        assert 1 <= len(list(token_files.chunks_of(bytes(f["content"])))) <= 2
