from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from echofield.llm import packing
from echofield.llm.queries import BYTE_BPE, op6_binary_packing

TOKENIZER = Tokenizer.from_file(BYTE_BPE)


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_same_ids_as_the_tokenizer(text):
    assert list(packing._encoder(BYTE_BPE)(text)) == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_added_token_in_a_text():
    text = "a <|endoftext|> b"
    assert list(packing._encoder(BYTE_BPE)(text)) == TOKENIZER.encode(text, add_special_tokens=False).ids


@given(st.integers(0, 1 << 20))
def test_binary_lengths(n):
    parts = packing.binary_lengths(n)
    assert sum(parts) == n and parts == sorted(parts, reverse=True)
    assert all(p & (p - 1) == 0 and p <= 2048 for p in parts) and len({p for p in parts if p < 2048}) == sum(p < 2048 for p in parts)


def test_query_covers_every_id_once(spark, odd_dir, odd_docs, none_dir):
    rows = op6_binary_packing(spark, odd_dir).collect()
    want = []
    for doc, text, *_ in odd_docs:
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for n in packing.binary_lengths(len(ids)):
            want.append((doc is None, doc or 0, at, n, zlib.crc32(ids[at:at + n].tobytes()), len(ids)))
            at += n
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows]
    assert sorted(got) == sorted(want)
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    assert op6_binary_packing(spark, none_dir).count() == 0


def test_buckets_on_disk(spark, odd, tmp_path):
    packing.write_buckets(packing.sequences(odd, BYTE_BPE), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.filter("length <> power(2, bucket) OR octet_length(ids) <> 4 * length").count() == 0


def test_length_must_be_a_power_of_two(odd):
    with pytest.raises(ValueError):
        packing.pieces(odd, BYTE_BPE, longest=1000)
