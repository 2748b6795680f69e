from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from echofield.llm import lm
from echofield.llm.queries import op4_suffix_tree_lm


def tree(texts, share, divergence):
    """Counts of every context, and the contexts that are kept, by plain counting."""
    counts: dict[bytes, Counter] = {}
    for text in texts:
        s = lm.symbols_of(lm.words_of(text.encode()))
        for i in range(lm.DEPTH, len(s)):
            for k in range(lm.DEPTH + 1):
                counts.setdefault(s[i - k:i], Counter())[s[i]] += 1
    total = sum(counts[b""].values())
    kept = {b""}
    for c, following in counts.items():
        n, parent = sum(following.values()), counts[c[1:]] if c else None
        if c and n >= share * total:
            size = sum(parent.values())
            kl = sum(v / n * math.log(v / n / (parent[a] / size)) for a, v in following.items())
            if kl >= divergence - 1e-12:
                kept |= {c[i:] for i in range(len(c) + 1)}
    return counts, kept


def probability(counts, context, symbol):
    below = probability(counts, context[1:], symbol) if context else 1 / 256
    following = counts[context]
    return (following[symbol] + len(following) * below) / (sum(following.values()) + len(following))


TEXTS = ["the cat sat on the mat the cat sat", "The dog sat on the log", "", "a \x00 bébé café", "the " * 900]


def test_scores_as_by_plain_counting(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(90, None), (91, "unseen zebra!"), (91, "unseen zebra!")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    share, divergence = 0.001, 0.05
    counted = lm.count_training(docs.filter("doc_id < 90"))
    got = lm.score_texts(docs, counted, word_share=0.01, share=share, divergence=divergence).collect()
    counts, kept = tree(TEXTS, share, divergence)
    words = Counter(w for t in TEXTS for w in [*lm.words_of(t.encode()), b""])
    n, v = sum(words.values()), len(words)
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        body = (text[r["doc_id"]] or "").encode()
        tokens = [*lm.words_of(body), b""]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens)
        s, score = lm.symbols_of(lm.words_of(body)), 0.0
        for i in range(lm.DEPTH, len(s)):
            context = next(s[i - k:i] for k in range(lm.DEPTH, -1, -1) if s[i - k:i] in kept)
            score += math.log10(probability(counts, context, s[i]))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(w in words for w in tokens), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-5)


def test_smoothed_distributions_add_up_to_one():
    s = lm.symbols_of([b"abc", b"abd"])
    grams, n = lm.grams_of(s)
    k = np.repeat(np.arange(lm.DEPTH + 1), len(grams))
    context = np.concatenate([(grams >> np.uint64(8)).astype(np.int64) & ((1 << 8 * d) - 1) for d in range(lm.DEPTH + 1)])
    symbol = np.tile((grams & np.uint64(255)).astype(np.int64), lm.DEPTH + 1)
    model = lm.SuffixTree(k, context, symbol, np.tile(n, lm.DEPTH + 1))
    p = 10.0 ** model.logp.reshape(-1, model.size).astype(float)
    seen = p[:, 1:].sum(axis=1) + p[:, 0] * (256 - (model.size - 1))
    assert np.allclose(seen, 1, atol=1e-5)


def test_windows_across_chunks(spark):
    size = lm._CHUNK
    lm_text = "ab cd " * 2000
    docs = spark.createDataFrame([(1, lm_text)], "doc_id int, text string")
    try:
        lm._CHUNK = 1000
        got = {r["gram"]: r["n"] for r in lm.count_training(docs).filter("gram is not null").collect()}
    finally:
        lm._CHUNK = size
    keys, n = lm.grams_of(lm.symbols_of(lm.words_of(lm_text.encode())))
    assert got == dict(zip(keys.view(np.int64).tolist(), n.tolist()))


def test_query_on_odd_and_empty_tables(spark, odd_dir, odd_docs, none_dir):
    rows = op4_suffix_tree_lm(spark, odd_dir).collect()
    assert len(rows) == len(odd_docs) and all(r["score"] <= 0 and r["base_score"] <= 0 for r in rows)
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (3, 4, 5, 14))
    assert op4_suffix_tree_lm(spark, none_dir).count() == 0


def test_held_out_texts_score_above_the_base(spark):
    rows = op4_suffix_tree_lm(spark, "/root/testdata/sf0.1").filter("held_out")
    assert rows.agg(F.avg((F.col("score") > F.col("base_score")).cast("double"))).first()[0] > 0.8
