"""Triangle counts by colour triples against counting by hand."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from echofield.operators import graph


def brute(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    counts = Counter()
    for a in near:
        counts[a] = sum(1 for b, c in combinations(near[a], 2) if c in near[b])
    return {a: (len(near[a]), counts[a]) for a in near}


def got(spark, pairs, kind="long", **options):
    both = [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]
    per_node, deg = graph.triangle_counts(spark.createDataFrame(both, f"source {kind}, target {kind}"), **options)
    tri = {r.node: r.triangles for r in per_node.collect()}
    return {r.node: (r.degree, tri.get(r.node, 0)) for r in deg.collect()}


@pytest.mark.parametrize("per_task", [1 << 18, 40, 3])
def test_any_graph(spark, monkeypatch, per_task):
    monkeypatch.setattr(graph, "WEDGES", 50)
    rnd = random.Random(per_task)
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(260)] + [(0, i) for i in range(200, 300)] + [(5, 6)] * 3
    pairs += [(a + 1000, b + 1000) for a, b in combinations(range(9), 2)]
    assert got(spark, pairs, per_task=per_task) == brute(pairs)


def test_star_and_clique(spark):
    star = [(0, i) for i in range(1, 500)]
    assert got(spark, star, per_task=50) == {0: (499, 0), **{i: (1, 0) for i in range(1, 500)}}
    clique = list(combinations(range(30), 2))
    assert set(got(spark, clique, per_task=20).values()) == {(29, 29 * 28 // 2)}


def test_names_as_nodes_and_no_edges(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")]
    assert got(spark, pairs, "string") == {"a": (2, 1), "b": (2, 1), "c": (3, 1), "d": (1, 0)}
    assert got(spark, []) == {}


def test_one_triple_may_hold_several_colour_patterns():
    """Colours 0, 0, 1: the triangle of colour 0 alone belongs to the triple of that colour."""
    lo, hi = np.array([0, 0, 1, 0, 1]), np.array([1, 2, 2, 3, 3])
    assert graph._triangles_inside(lo, hi, np.array([0, 0, 1, 0])).tolist() == [1, 1, 1, 0]
    assert graph._triangles_inside(lo, hi, np.array([0, 0, 0, 0])).tolist() == [2, 2, 1, 1]
