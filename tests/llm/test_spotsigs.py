from __future__ import annotations

import hashlib
import re

from echofield.llm import spotsigs
from echofield.llm.queries import op7_spot_signatures
from pyspark.sql import functions as F


def chains(text: str) -> set:
    words = [w for w in re.sub(r"[^\w]+|_", " ", text.lower()).split(" ") if w]
    anchors, found = set(spotsigs.ANCHORS), set()
    for i, w in enumerate(words):
        if w in anchors:
            content = [x for x in words[i + 1:i + 1 + spotsigs.REACH] if x not in anchors][:spotsigs.CHAIN]
            if len(content) == spotsigs.CHAIN:
                found.add((w, *content))
    return found or set(words) or ({text} if text else set())


def likeness(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_as_by_brute_force(spark, odd_dir, odd_docs, none_dir):
    rows = op7_spot_signatures(spark, odd_dir).collect()
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows)
    marks = {r["t"]: r["h"] for r in spark.createDataFrame([(d[1] or "",) for d in odd_docs], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((d[0] is not None, d[0] or 0, d[1] or "") for d in odd_docs), key=lambda d: (d[0], d[1], marks[d[2]]))
    want = []
    for i, (known, doc, text) in enumerate(order):
        other = order[(i + 1) % len(order)][2]
        k = len(text) // 4
        edited = text[:len(text) - k] + other[:k]
        want.append((known, doc, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                     round(likeness(chains(text), chains(edited)), 9), round(likeness(chains(text), chains(other)), 9)))
    assert got == sorted(want)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["fingerprint"], set()).add(r["n_chars"])
    assert op7_spot_signatures(spark, none_dir).count() == 0


def test_pairs_as_by_brute_force(spark):
    base = " ".join(f"the c{i} d{i}" for i in range(40)).split()
    texts = [" ".join(base[:n] + [f"w{i}"] * (i % 4) + base[5 * (i % 5):]) for i, n in enumerate(range(0, 60, 3))]
    texts += texts[:2] + ["", "!!", "unrelated words only here"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("spots", spotsigs.signatures("text"))
    sets = {r["fp"]: set(r["spots"]) for r in docs.select(spotsigs.fingerprint(F.col("spots")).alias("fp"), "spots").collect()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and likeness(sets[a], sets[b]) >= 0.8}
    assert want and {(r["a"], r["b"]) for r in spotsigs.near_pairs(docs).collect()} == want


def test_distant_partitions_are_never_alike(spark):
    for n in range(1, 60):
        for m in range(n, 60):
            import math
            p, q = (math.floor(math.log(x) / math.log(1 / spotsigs.ALIKE)) for x in (n, m))
            if q - p >= 2:
                assert n / m < spotsigs.ALIKE
