from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from echofield.llm import simhash
from echofield.llm.common import components
from echofield.llm.queries import op10_simhash_near_dedup


def fingerprint(text: str | None) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(prints: list[int]) -> list[int]:
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bucket", [1, 64])
def test_classes_as_by_brute_force(spark, bucket):
    draw = random.Random(5)
    prints = [draw.getrandbits(64) for _ in range(30)]
    for _ in range(400):
        x = draw.choice(prints)
        for b in draw.sample(range(64), draw.randint(1, 4)):
            x ^= 1 << b
        prints.append(x)
    crowd = draw.getrandbits(32) << 32
    prints += [crowd | draw.getrandbits(9) for _ in range(150)]
    rows = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    found = components(simhash.links(rows, bucket)).collect()
    root = {r["node"]: r["root"] for r in found}
    want = {}
    for p, c in zip(prints, classes(prints)):
        want.setdefault(c, set()).add(signed(p))
    got = {}
    for p in {signed(p) for p in prints}:
        got.setdefault(root.get(p, p), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    found = components(edges.union(spark.createDataFrame([(900, 900), (1000, 2000)], "a bigint, b bigint")))
    rows = {r["node"]: r["root"] for r in found.collect()}
    assert len(rows) == 303 and {rows[i] for i in range(301)} == {0} and rows[2000] == 1000


def test_query_on_odd_rows(spark, odd_dir, odd_docs, none_dir):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in op10_simhash_near_dedup(spark, odd_dir).collect())
    prints = [fingerprint(t) for _, t, *_ in odd_docs]
    groups = classes(prints)
    least = {c: min(d[0] for d, g in zip(odd_docs, groups) if g == c and d[0] is not None) for c in groups}
    want = sorted((d[0] is None, d[0] or 0, f"{p:016x}", least[g]) for d, p, g in zip(odd_docs, prints, groups))
    assert got == want
    assert op10_simhash_near_dedup(spark, none_dir).count() == 0


def test_keep_one(spark, odd, odd_docs, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    prints = [fingerprint(t) for _, t, *_ in odd_docs]
    groups = set(classes(prints))
    rows = kept.collect()
    assert len(rows) == len(groups)
    assert len(set(classes([fingerprint(r["text"]) for r in rows]))) == len(rows)
    assert simhash.keep_one(none).count() == 0


def test_probes_are_not_broadcast(spark):
    """They are 17 times the rows that Spark estimates, so their join is by shuffle however small they look."""
    prints = spark.range(300).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(prints)._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"SortMergeJoin \[seg#\d+, at#\d+L\]", plan)
    assert not re.search(r"BroadcastHashJoin \[seg#\d+, at#\d+L\]", plan)
