"""The lattice of rare units within a task, and the words of Arrow texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from echofield.llm import lattice
from echofield.llm.queries import PIECES
from test_lattice import WORDS, inside, viterbi


def test_paths_as_by_plain_viterbi():
    words = [w for w in [*WORDS, "a\x00b", "é\U0001F600߿ࠀ￿", "internationalisation" * 30] if lattice.MARK not in w]
    want = [viterbi(w)[1] for w in words] + [inside(w) for w in words if w]
    got = lattice.unit_paths([lattice.MARK + w for w in words] + [w for w in words if w], PIECES)
    assert [np.frombuffer(ids, np.int32).tolist() for ids in got] == want
    assert lattice.unit_paths([], PIECES) == []


def test_words_of_slices():
    texts = ["é one", None, "", " two  blanks ", "x", None, "日本 語", ""] * 50
    for lo, n in ((0, 400), (3, 100), (250, 150), (2, 1), (0, 0)):
        part = texts[lo:lo + n]
        sizes, words = lattice._words(pa.array(texts, pa.string()).slice(lo, n))
        assert sizes.tolist() == [len(t.split(" ")) if t else 0 for t in part]
        assert words.to_pylist() == [w for t in part if t for w in t.split(" ")]


def test_no_text_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id int, text string")
    coded = lattice.with_text(lattice.encodings(docs, PIECES, word_share=2.0), PIECES)
    assert "Exchange" not in coded._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["text"] for r in coded.collect()} == {1: "one two", 2: "three"}
