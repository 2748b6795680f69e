"""Settled rewiring and attachment against one edge, one node after the other."""

from __future__ import annotations

import hashlib
import math
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from echofield.operators import edges, settled


def uni(seed, salt, *keys):
    digest = hashlib.md5("|".join([str(seed), salt, *map(str, keys)]).encode()).hexdigest()
    return int(digest[:13], 16) / 2**52


def pairs_of(df):
    rows = [(r.source, r.target) for r in df.collect()]
    assert len(set(rows)) == len(rows) and {(b, a) for a, b in rows} == set(rows) and all(a != b for a, b in rows)
    return {(a, b) for a, b in rows if a < b}


def rewired(pairs, p, n, tries):
    taken, moved = set(pairs), {}
    left = {e: uni(42, "rewire", *e) for e in pairs}
    left = {e: roll for e, roll in left.items() if roll < p}
    chosen = len(left)
    for lo, hi in settled.windows(tries):
        asked = {}
        for (u, v), roll in left.items():
            for t in range(lo, hi + 1):
                x = math.floor(uni(42, "rewire.target", u, v, t) * n)
                new = (min(u, x), max(u, x))
                if x != u and new not in taken:
                    asked[new] = min(asked.get(new, (2.0,)), (roll, u, v))
                    break
        for new, (_, u, v) in asked.items():
            moved[u, v] = new
            taken.add(new)
            del left[u, v]
    return {moved.get(e, e) for e in pairs}, (chosen, chosen - len(left), len(left))


@pytest.mark.parametrize("n, k, p, tries", [(40, 6, 0.5, 100), (14, 8, 1.0, 100), (14, 12, 1.0, 9), (60, 4, 0.0, 100), (60, 4, 1.0, 3)])
def test_rewiring_in_rounds(spark, n, k, p, tries):
    lattice = edges.ring_lattice_edges(spark.range(n), k, dense=True)
    got, report = settled.rewire_edges_settled(lattice, p, spark.range(n), tries=tries, dense=True)
    want, counts = rewired(pairs_of(lattice), p, n, tries)
    assert pairs_of(got) == want and tuple(report.first()) == counts and len(want) == n * k // 2


def test_share_of_moved_edges(spark):
    n, k, p = 4000, 6, 0.3
    lattice = edges.ring_lattice_edges(spark.range(n), k, dense=True)
    got, report = settled.rewire_edges_settled(lattice, p, spark.range(n), dense=True)
    before, after = pairs_of(lattice), pairs_of(got)
    counts = report.first()
    assert len(after) == len(before) and counts.stayed == 0 and len(before - after) == counts.moved
    assert abs(counts.moved - p * len(before)) < 3 * math.sqrt(p * (1 - p) * len(before))


def test_rewiring_nodes_with_names(spark):
    names = spark.range(30).select(F.concat(F.lit("n"), "id").alias("name"))
    ring = spark.range(30).select(F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("n"), ((F.col("id") + 1) % 30).cast("string")).alias("target"))
    ring = ring.withColumn("weight", F.lit(1.0)).unionByName(ring.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(1.0).alias("weight")))
    got, report = settled.rewire_edges_settled(ring, 1.0, names, "name")
    assert len(pairs_of(got)) == 30 and report.first().moved == 30 and not pairs_of(got) & pairs_of(ring)
    none, report = settled.rewire_edges_settled(ring.limit(0), 0.5, names, "name")
    assert none.count() == 0 and tuple(report.first()) == (0, 0, 0)


def grown(n, m):
    """Nodes one after the other; every copied slot is read from the list of slots as it really is."""
    slots = [node for node in range(m + 1) for _ in range(m)]
    pairs = {(a, b) for b in range(m + 1) for a in range(b)}
    first, redrawn = m * (m + 1) // 2, 0
    for i in range(m + 1, n):
        ends, draw = [], 0
        while len(ends) < m:
            u = uni(42, "attach", first + draw) if draw < m else uni(42, "attach.again", first, draw)
            end = slots[math.floor(u * len(slots))]
            redrawn += end in ends
            if end not in ends:
                ends.append(end)
            draw += 1
        for end in ends:
            slots += [i, end]
            pairs.add((end, i))
        first += m
    degrees = Counter(x for pair in pairs for x in pair)
    assert Counter(slots) == degrees
    return pairs, redrawn


@pytest.mark.parametrize("n, m", [(200, 1), (200, 2), (300, 3), (120, 8), (5, 4), (3, 4)])
def test_attachment_by_the_degrees_of_the_output(spark, n, m):
    got = pairs_of(settled.preferential_edges_settled(spark.range(n), m, dense=True))
    if n <= m + 1:
        assert got == {(a, b) for b in range(n) for a in range(b)}
        return
    want, redrawn = grown(n, m)
    assert got == want and (redrawn > 0 or m == 1)


def test_attachment_of_any_ids(spark):
    nodes = spark.range(100).select((F.col("id") * 7 + 1000).alias("id"))
    got = pairs_of(settled.preferential_edges_settled(nodes, 3))
    assert len(got) == 6 + 96 * 3 and all(a >= 1000 for a, _ in got)


def test_attachment_in_many_runs(spark, monkeypatch):
    """Draws replaced in one run of nodes are followed in all others."""
    monkeypatch.setattr(settled, "RUN", 40)
    got = pairs_of(settled.preferential_edges_settled(spark.range(700), 4, dense=True))
    want, redrawn = grown(700, 4)
    assert got == want and redrawn > 0


def test_attachment_of_many_nodes(spark):
    """Three times the nodes of 0.1 GB of events; interpreted hops took a minute for 1,500 nodes."""
    began = time.time()
    got = pairs_of(settled.preferential_edges_settled(spark.range(27_000), 3, dense=True))
    assert time.time() - began < 120
    assert got == grown(27_000, 3)[0]


def test_attachment_refuses_other_ids(spark):
    with pytest.raises(Exception, match="dense node ids must be 0..n-1"):
        settled.preferential_edges_settled(spark.range(1, 30), 2, dense=True).collect()
    assert settled.preferential_edges_settled(spark.range(0), 2, dense=True).collect() == []
