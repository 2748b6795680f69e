from __future__ import annotations

import hashlib
import time

from pyspark.sql import functions as F

from echofield.llm import lattice
from echofield.llm.queries import PIECES, op5_piece_lattice

TABLE = {p: (i, s) for p, i, s in lattice._pieces(PIECES)}
LONGEST = max(map(len, TABLE))
FLOOR = min(s for _, s in TABLE.values()) - lattice.BYTE_COST


def viterbi(word: str):
    marked, best = lattice.MARK + word, [(0.0, [])]
    for end in range(1, len(marked) + 1):
        chosen = None
        for size in range(min(LONGEST, end), 0, -1):
            part = marked[end - size:end]
            inner = part[1:] if end == size else part
            if part in TABLE and lattice.MARK not in inner:
                ids, score = [TABLE[part][0]], TABLE[part][1]
            elif size == 1:
                ids, score = [lattice._bytes(PIECES)[b] for b in part.encode()], FLOOR
            else:
                continue
            total = best[end - size][0] + score
            if chosen is None or total > chosen[0]:
                chosen = total, best[end - size][1] + ids
        best.append(chosen)
    return best[-1]


WORDS = ["", "hello", "a" * 300, "naïve,", "日本語", "x▁y", "▁", "\U0001F600!", "new\nline\ttab", "Straße", "'s", "12345"]


def test_words_as_by_plain_viterbi(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS + WORDS[:3]] + [(None,)], "word string")
    got = {r["word"]: (r["score"], r["ids"]) for r in lattice.encode_words(rows, PIECES).collect()}
    assert got == {w: viterbi(w) for w in WORDS}


def test_round_trip(spark):
    texts = [" ".join(WORDS), "  two  blanks ", "", None, "one", "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    coded = lattice.encode(docs, PIECES).cache()
    back = {r["doc_id"]: r["text"] for r in lattice.decode(coded, PIECES).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert lattice.encode(docs.limit(0), PIECES).count() == 0


def test_query_as_by_plain_viterbi(spark, odd_dir, odd_docs, none_dir):
    rows = op5_piece_lattice(spark, odd_dir).collect()
    known, want = {}, []
    hashed = spark.createDataFrame([(w, viterbi(w)[1]) for w in {w for d in odd_docs for w in (d[1] or "").split(" ")}], "w string, ids array<int>")
    digests = {r["w"]: r["h"] for r in hashed.select("w", F.pmod(F.xxhash64("ids"), F.lit(lattice.PRIME)).alias("h")).collect()}
    for doc, text, *_ in odd_docs:
        words = text.split(" ") if text else []
        for w in words:
            known.setdefault(w, viterbi(w))
        digest = sum((2 * i + 1) * digests[w] for i, w in enumerate(words)) % lattice.PRIME
        want.append((doc is None, doc or 0, len(words), sum(len(known[w][1]) for w in words), digest))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_pieces"], r["digest"]) for r in rows) == sorted(want)
    assert op5_piece_lattice(spark, none_dir).count() == 0


def test_query_gives_whole_ids_and_texts(spark, odd_dir, odd_docs):
    known = {w: viterbi(w)[1] for w in {w for d in odd_docs for w in (d[1] or "").split(" ")}}
    want = [(d is None, d or 0, [i for w in (t.split(" ") if t else []) for i in known[w]],
             hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in odd_docs]
    rows = op5_piece_lattice(spark, odd_dir).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"], r["decoded_sha256"]) for r in rows) == sorted(want)


def test_rare_and_frequent_words_and_repeated_keys(spark):
    texts = ["one two one", " one", "one  three", None, "", "😀 one two"]
    docs = spark.createDataFrame([(k, t) for t in texts for k in (7, None)], "doc_id int, text string")
    want = sorted((k is None, t or "") for t in texts for k in (7, None))
    for share in (0.0, 0.2, 2.0):
        coded = lattice.encodings(docs, PIECES, word_share=share)
        assert sorted((r["doc_id"] is None, r["text"]) for r in lattice.with_text(coded, PIECES).collect()) == want
    assert sorted((r["doc_id"] is None, r["text"]) for r in lattice.decode(lattice.encode(docs, PIECES), PIECES).collect()) == want


def test_units_have_the_path_of_their_word():
    adjacent = lattice._adjacent(PIECES)
    for word in [*WORDS, "garden,", "(well-known)", "a1b22c333", "x▁", "▁▁y", "Dampfschifffahrtsgesellschaft.", "qzxjkvw"]:
        units = lattice.units_of(word, adjacent)
        assert "".join(units) == lattice.MARK + word
        ids = []
        for i, unit in enumerate(units):
            if i and unit == lattice.MARK:
                ids += [lattice._bytes(PIECES)[b] for b in unit.encode()]
            elif i:
                # A unit inside a word, read as if it stood behind a mark that no piece spans.
                ids += inside(unit)
            else:
                ids += viterbi(unit[1:])[1]
        assert ids == viterbi(word)[1]


def inside(unit: str) -> list[int]:
    best = [(0.0, [])]
    for end in range(1, len(unit) + 1):
        chosen = None
        for size in range(min(LONGEST, end), 0, -1):
            part = unit[end - size:end]
            if part in TABLE:
                ids, score = [TABLE[part][0]], TABLE[part][1]
            elif size == 1:
                ids, score = [lattice._bytes(PIECES)[b] for b in part.encode()], FLOOR
            else:
                continue
            total = best[end - size][0] + score
            if chosen is None or total > chosen[0]:
                chosen = total, best[end - size][1] + ids
        best.append(chosen)
    return best[-1][1]


def test_common_words_agree_with_the_library():
    """The file holds merges, not probabilities, so the best path is not always the library's."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    words = "the quick brown things internationalization of house and people government water would before between children".split()
    agree = sum(viterbi(w)[1] == sp.encode(w) for w in words)
    assert agree >= 0.8 * len(words) and viterbi("the")[1] == sp.encode("the")


def test_one_very_long_word(spark):
    word = "internationalisation" * 1000
    docs = spark.createDataFrame([(1, word), (2, f"{word} {word} x")], "doc_id int, text string")
    begin = time.perf_counter()
    rows = {r["doc_id"]: r for r in lattice.with_text(lattice.encodings(docs, PIECES, word_share=2.0), PIECES).collect()}
    assert time.perf_counter() - begin < 60
    assert rows[1]["text"] == word and rows[2]["text"] == f"{word} {word} x" and rows[2]["n_words"] == 3
    assert rows[1]["n_pieces"] < len(word) / 3
