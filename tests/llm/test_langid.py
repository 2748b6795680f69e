from __future__ import annotations

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echofield.llm import langid
from echofield.llm.queries import op1_language_id

SAMPLE = [("de", "der hund und die katze sind in dem haus"), ("en", "the dog and the cat are in the house")]


def parsed(text: str, reference: str) -> int:
    """Phrases of ``text`` against ``reference`` by trying every length."""
    at = n = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in reference:
            size += 1
        at += size
        n += 1
    return n


@given(st.text("ab ", max_size=40), st.text("abc ", max_size=60))
@settings(max_examples=60, deadline=None)
def test_phrases_as_by_brute_force(reference, text):
    models = langid.Models((("x", reference + "ab"),))
    codes = models.encode(text)
    names = {0: " ", **{int(models.codes[ord(c)]): c for c in "abc"}}
    read = "".join("?" if c == 1 else names[int(c)] for c in codes)
    known = "".join(names[int(c)] for c in models.encode(reference + "ab"))
    got = models.phrases([codes], block=1 << 20)[0, 0] if len(codes) else 0
    assert got == parsed(read, known)


def test_automaton_reads_exactly_the_substrings():
    word = [1, 2, 1, 2, 2, 3, 1]
    moves = langid.suffix_automaton(word)
    subs = {tuple(word[i:j]) for i in range(len(word)) for j in range(i + 1, len(word) + 1)}

    def reads(s):
        at = 0
        for c in s:
            if c not in moves[at]:
                return False
            at = moves[at][c]
        return True

    every = {s for n in range(1, 5) for s in np.ndindex(*[4] * n)}
    assert {s for s in every if reads(s)} == {s for s in subs if len(s) < 5}


def test_score_is_the_lead_over_the_second():
    models = langid.Models(tuple(SAMPLE))
    codes = models.encode("the cat")
    counts = models.phrases([codes])[0]
    per = sorted(counts * np.array(models.norms) / len(codes))
    langs, scores = models.judge(["the cat", "", "12"])
    assert langs == ["en", "und", "und"] and scores[1:] == [0.0, 0.0]
    assert math.isclose(scores[0], 1 - per[0] / per[1])


def test_odd_rows(spark, odd, none):
    got = langid.predict(odd.select("doc_id", "text", "fp"), SAMPLE).collect()
    assert len(got) == odd.count()
    unknown = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {3, 4, 5, 8, 14} == unknown
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.predict(none.select("doc_id", "text"), []).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd.select("text"), []).collect()} == {"und"}
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5
    assert langid.keep_known(none).count() == 0


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    rows = [(i, f"word{'abcdefgh'[i % 8] * (i % 5 + 1)} text", "en") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    assert len(langid.training_sample(docs, F.lit(True), texts=7)) <= 7
    assert langid.training_sample(docs, F.lit(False)) == []


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98 and got.count() == 1000


def test_two_scripts_of_over_a_thousand_letters():
    rng = np.random.default_rng(4)
    han, hangul = ([chr(base + i) for i in range(1500)] for base in (0x4E00, 0xAC00))

    def text(letters):
        common = rng.choice(letters[:300], (60, 4))
        return " ".join("".join(w) for w in np.where(rng.random((60, 4)) < 0.8, common, rng.choice(letters, (60, 4))))

    sample = tuple((lang, text(letters)) for lang, letters in (("ko", hangul), ("zh", han)) for _ in range(96))
    sample += tuple(("en", text(list("etaoinshrdlu"))) for _ in range(20))
    models = langid.Models(sample)
    assert {lang: t.size > 1000 for lang, t in zip(models.langs, models.tables)} == {"en": False, "ko": True, "zh": True}
    got, scores = models.judge([text(han) for _ in range(40)] + [text(hangul) for _ in range(40)])
    assert got == ["zh"] * 40 + ["ko"] * 40 and np.mean(scores) > 0.1


@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.text("xyzé ", min_size=1, max_size=30)), min_size=1, max_size=5), st.text("xyzéq ,", max_size=80))
@settings(max_examples=100, deadline=None)
def test_listed_moves_read_like_full_tables(sample, text):
    sample = tuple(s for s in sample if s[1].strip()) or (("a", "x"),)
    full, listed = langid.Models(sample), langid.Models(sample, cells=0)
    assert all(t.table is not None for t in full.tables) and all(t.table is None for t in listed.tables)
    assert full.judge([text]) == listed.judge([text])


def test_labels_are_bounded(spark):
    rows = [(i, f"text number {w} of it", f"l{i % 9:02d}") for i in range(400) for w in ("one", "two")] + [(1000 + i, f"word {i} more", "big") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    sample = langid.training_sample(docs, F.lit(True), texts=16, languages=3)
    assert len({lang for lang, _ in sample}) == 3 and "big" in {lang for lang, _ in sample} and len(sample) <= 48
