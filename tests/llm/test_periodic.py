from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echofield.llm import periodic
from echofield.llm.queries import op13_periodic_runs, table

SF = "/root/testdata/sf0.001"


def brute(words, shortest=24, repeats=3):
    """Every maximal stretch per period, kept where no smaller period holds on it."""
    n, found = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q))
            if length >= max(shortest, repeats * q) and not smaller:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_long(words, shortest=24, repeats=3):
    """The same for long texts: a stretch has a smaller period where a run of that period holds it."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w, found = np.array([numbers[x] for x in words]), []
    for q in range(1, len(w) // repeats + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (w[:-q] == w[q:]).astype(np.int8), [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s + q >= max(shortest, repeats * q) and not any(t <= s and e + q <= t + m for t, m, _ in found):
                found.append((s, e - s + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def want_row(doc, text, brute=brute):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@given(st.lists(st.integers(0, 2), max_size=60) | st.tuples(
    st.lists(st.integers(0, 1), max_size=6), st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 12),
    st.lists(st.integers(0, 1), max_size=9), st.integers(1, 3),
).map(lambda t: (t[0] + t[1] * t[2] + t[3]) * t[4]))
@settings(max_examples=400, deadline=None)
def test_runs_equal_brute_force(words):
    for shortest, repeats in ((24, 3), (6, 2), (5, 3), (1, 2)):
        assert periodic.runs_of(np.array(words, np.int64), shortest, repeats) == brute(words, shortest, repeats)


def test_large_sets_of_positions():
    members = list(range(0, 40_000, 2))
    random.Random(1).shuffle(members)
    held = periodic.Positions(members[0])
    for x in members[1:]:
        held.add(x)
    assert list(held) == sorted(members) and held.size == len(members) and len(held.blocks) > 10
    assert held.around(-1) == (None, 0) and held.around(2047) == (2046, 2048) and held.around(39_999) == (39_998, None)


def test_long_texts_of_one_word_and_of_long_periods():
    assert periodic.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    unit = np.random.default_rng(3).permutation(30_000)
    words = np.concatenate([[-1], np.tile(unit, 4)[:100_000], [-2]])
    assert periodic.runs_of(words) == [(1, 100_000, 30_000)]


def test_windows_that_repeat_are_never_missed():
    rnd = np.random.default_rng(5)
    words = rnd.integers(0, 3, 4000)
    doc = np.repeat(np.arange(100), 40)
    found = set(periodic.with_repeats(words, doc, 6).tolist())
    for d in range(100):
        own = words[40 * d:40 * d + 40].tolist()
        seen = [tuple(own[i:i + 6]) for i in range(35)]
        assert (len(set(seen)) < len(seen)) == (d in found)
    assert periodic.with_repeats(words[:3], doc[:3], 6).size == 0


def test_operator_and_its_parameters(spark):
    rows = [(1, "a b " * 20, "x"), (1, "a b " * 20, "x"), (None, "q  " * 30 + "\n\tend of", "y"), (2, None, None), (3, "", "z"), (4, "  one", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect())
    assert got == [
        ("1", 40, [(0, 40, 2)], "a b"), ("1", 40, [(0, 40, 2)], "a b"), ("2", 0, [], ""), ("3", 0, [], ""),
        ("4", 2, [], "  one"), ("None", 31, [(0, 30, 1)], "q end of"),
    ]
    assert periodic.periodic_runs(docs, shortest=50).filter("size(runs) > 0").count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, repeats=1)


def test_query(spark, odd_dir, odd_docs, none_dir):
    got = [tuple(r) for r in op13_periodic_runs(spark, odd_dir).collect()]
    want = [want_row(i, t, brute_long if i == 6 else brute) for i, t, *_ in odd_docs]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert op13_periodic_runs(spark, none_dir).count() == 0


def test_query_on_a_whole_table(spark):
    docs = [r for r in table(spark, SF, "documents").select("doc_id", "text").collect() if len(r["text"] or "") < 6000]
    got = {r["doc_id"]: tuple(r) for r in op13_periodic_runs(spark, SF).collect()}
    assert any(got[r["doc_id"]][1] for r in docs)
    for r in docs:
        assert got[r["doc_id"]] == want_row(*r)
