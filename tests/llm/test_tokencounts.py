from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from echofield.llm import tokencounts
from echofield.llm.queries import BYTE_BPE, op11_token_counts, table

TOKENIZER = Tokenizer.from_file(BYTE_BPE)
SF = "/root/testdata/sf0.001"


def n_tokens(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)


@given(st.text(max_size=60) | st.text(alphabet="a1 \n\t'st֋₝\U0001f600 ́é.<|>", max_size=60))
@settings(max_examples=300, deadline=None)
def test_pretokens_are_those_of_the_library(text):
    words, added = tokencounts._splitter(BYTE_BPE)(text)
    assert added == 0 and words == [text[lo:hi] for _, (lo, hi) in TOKENIZER.pre_tokenizer.pre_tokenize_str(text)]


def test_characters_of_unicode_3_2_are_cut_alike():
    newer = tokencounts._newer()
    split = tokencounts._splitter(BYTE_BPE)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or newer.match(chr(c)):
            continue
        text = f"a{chr(c)}1 {chr(c)}."
        assert split(text)[0] == [text[lo:hi] for _, (lo, hi) in TOKENIZER.pre_tokenizer.pre_tokenize_str(text)], hex(c)


@pytest.mark.parametrize("share", [tokencounts.SHARE, 0.01, 1.0])
def test_counts_equal_the_library(spark, odd_docs, share):
    texts = [t for _, t, *_ in odd_docs] + [
        "a <|endoftext|>b<|endoftext|><|endoftext|>", "<|endoftext", " " * 5000 + "\n" * 7, "z" * 30_000, "don't we'll 12345 don't",
        "₝₞ x౜9", *["zyxwvutsr"] * 40, *[f"qq{i}xj" for i in range(400)],
    ]
    docs = spark.createDataFrame([(i, t, "n", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, word string, row int")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokencounts.token_counts(docs, BYTE_BPE, share=share).collect()}
    assert got == {i: (len((t or "").encode()), n_tokens(t)) for i, t in enumerate(texts)}


def test_frequent_pretokens_are_bounded_and_none_above_twice_the_share_is_missed(spark):
    docs = table(spark, SF, "documents").repartition(5)
    counts = {}
    for (text,) in docs.select("text").collect():
        for w in tokencounts._splitter(BYTE_BPE)(text or "")[0]:
            counts[w] = counts.get(w, 0) + 1
    total, share = sum(counts.values()), 1e-3
    found = {r["word"]: r["n"] for r in tokencounts.frequent_pretokens(docs, BYTE_BPE, share=share).collect()}
    listed = tokencounts._listed(BYTE_BPE)
    assert found and len(found) <= 1 / share and all(share * total <= n <= counts[w] for w, n in found.items())
    assert all(w in found or w in listed for w, n in counts.items() if n >= 2 * share * total)


def test_query(spark, odd_dir, odd_docs, none_dir):
    rows = op11_token_counts(spark, odd_dir).collect()
    want = [(i, len((t or "").encode()), n_tokens(t), n_tokens(t) > 512) for i, t, *_ in odd_docs]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert op11_token_counts(spark, none_dir).count() == 0
    whole = {r["doc_id"]: r["n_tokens"] for r in op11_token_counts(spark, SF).collect()}
    assert whole == {r["doc_id"]: n_tokens(r["text"]) for r in table(spark, SF, "documents").collect()}
