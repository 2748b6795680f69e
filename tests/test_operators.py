"""Worked cases and properties of the operators."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echofield import schemas as S
from echofield.functions import columns as col
from echofield.functions import ranking, sequence, special
from echofield.functions.skew import hot_keys, salted_join
from echofield.operators import (
    affect, bandit, calibration, edges, exposure, graph, metrics, quality, sampling, stats, transitions, upkeep,
)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def one(df):
    (row,) = df.collect()
    return row


# --- keyed randomness ---

def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(1000).withColumns({"u": col.uni(1, "x", "id"), "z": col.gauss(1, "x", "id")})
    two = {r.id: (r.u, r.z) for r in df.repartition(2).collect()}
    eight = {r.id: (r.u, r.z) for r in df.repartition(8, "id").collect()}
    assert two == eight
    us = [u for u, _ in two.values()]
    assert 0 <= min(us) and max(us) < 1 and abs(sum(us) / 1000 - 0.5) < 0.05
    assert abs(sum(z * z for _, z in two.values()) / 1000 - 1) < 0.2


@pytest.mark.parametrize("mean", [0.3, 1.0, 7.5])
def test_poisson_draws_have_the_mean_and_variance(spark, mean):
    n = 4000
    counts = col.poisson_draws(spark.range(n), F.lit(mean), 3, "p", ["id"]).groupBy("id").count()
    got = [r["count"] for r in counts.collect()]
    got += [0] * (n - len(got))
    avg = sum(got) / n
    assert abs(avg - mean) < 5 * math.sqrt(mean / n)
    assert abs(sum((g - avg) ** 2 for g in got) / n - mean) < 0.15 * mean + 0.05


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-2.0,), (0.5,), (3.0,), (None,)], "x double")
    assert [r.y for r in df.select(col.clip("x", -1, 1).alias("y")).collect()] == [-1.0, 0.5, 1.0, None]


def test_draw_category_shares(spark):
    df = sampling.draw_category(spark.range(3000), "c", {"a": 0.2, "b": 0.6, "d": 0.2}, ["id"])
    n = {r.c: r["count"] for r in df.groupBy("c").count().collect()}
    assert abs(n["a"] / 3000 - 0.2) < 0.04 and abs(n["b"] / 3000 - 0.6) < 0.04


def test_synthetic_population_ranges(spark):
    df = sampling.synth_entities(spark.range(500).withColumnRenamed("id", "humanId"))
    bounds = {**S.TRAITS, **S.BASELINES, "valence": (-1, 1), "arousal": (-1, 1)}
    assert all(r.violations == 0 for r in quality.check_ranges(df, bounds).collect())
    assert quality.check_domain(df, "mood", S.CLASSES).count() == 0
    assert quality.check_class_consistency(df).count() == 0


# --- ranking ---

def reference_gini(xs):
    xs, n = sorted(xs), len(xs)
    return sum((2 * i - n - 1) * x for i, x in enumerate(xs, 1)) / (n * sum(xs)) if sum(xs) else 0.0


def test_gini_worked(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0), ("c", 0.0)], "g string, x double")
    got = {r.g: r.gini for r in ranking.gini(df, "x", ["g"]).collect()}
    assert got == {"a": pytest.approx(0.25), "b": 0.0, "c": 0.0}
    assert one(ranking.gini(df.limit(0), "x")).gini == 0.0


def test_gini_and_quantiles_with_one_hot_group(spark):
    rnd = random.Random(5)
    data = [("hot" if rnd.random() < 0.7 else f"g{i % 5}", rnd.choice([0.0, rnd.random(), rnd.random() ** 8])) for i in range(5000)]
    df = spark.createDataFrame(data, "g string, x double").repartition(8)
    groups = {}
    for g, x in data:
        groups.setdefault(g, []).append(x)
    for r in ranking.gini(df, "x", ["g"]).collect():
        assert r.gini == pytest.approx(reference_gini(groups[r.g]))
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    for r in ranking.quantiles(df, "x", probs, ["g"], kind="rank", accuracy=100).collect():
        xs = sorted(groups[r.g])
        assert [r[f"q{i}"] for i in range(5)] == [xs[min(int(len(xs) * p), len(xs) - 1)] for p in probs]
    for r in ranking.quantiles(df, "x", probs, ["g"], accuracy=100).collect():
        xs = sorted(groups[r.g])
        for i, p in enumerate(probs):
            pos = (len(xs) - 1) * p
            lo = int(pos)
            hi = min(lo + 1, len(xs) - 1)
            assert r[f"q{i}"] == pytest.approx(xs[lo] + (xs[hi] - xs[lo]) * (pos - lo))


@pytest.mark.parametrize("n", [1, 2, 5, 37, 101, 294])
@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_of_small_groups(spark, n, accuracy):
    xs = sorted(random.Random(n).sample(range(10_000), n))
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    r = one(ranking.quantiles(df, "x", probs, accuracy=accuracy))
    for i, p in enumerate(probs):
        pos = (n - 1) * p
        lo, hi = xs[int(pos)], xs[min(int(pos) + 1, n - 1)]
        assert r[f"q{i}"] == pytest.approx(lo + (hi - lo) * (pos - int(pos)))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40))
def test_gini_properties(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    g = one(ranking.gini(df, "x")).gini
    assert -1e-12 <= g < 1 and g == pytest.approx(reference_gini(xs), abs=1e-12)


def test_dense_index_is_dense_and_stable(spark):
    df = spark.range(0, 5000, 3).withColumnRenamed("id", "k")
    a = rows(ranking.dense_index(df.repartition(2), "k"), "k", "idx")
    assert a == rows(ranking.dense_index(df.repartition(8), "k"), "k", "idx")
    assert sorted(i for _, i in a) == list(range(len(a)))


@pytest.mark.parametrize("block", [1, 3, 50])
def test_beside_and_numbered_across_blocks(spark, block):
    data = [(k, s) for k in range(3) for s in random.Random(k).sample(range(40), 15)]
    df = spark.createDataFrame(data, "k long, s long").repartition(4)
    prev = {(r.k, r.s): r.previous_s for r in sequence.beside(df, "k", ["s"], ["s"], "previous", F.floor(F.col("s") / block)).collect()}
    nxt = {(r.k, r.s): r.next_s for r in sequence.beside(df, "k", ["s"], ["s"], "next", F.floor(F.col("s") / block)).collect()}
    place = {(r.k, r.s): (r.position, r["size"]) for r in sequence.numbered(df, "k", "s", block).collect()}
    for k in range(3):
        order = sorted(s for j, s in data if j == k)
        for i, s in enumerate(order):
            assert prev[k, s] == (order[i - 1] if i else None)
            assert nxt[k, s] == (order[i + 1] if i + 1 < len(order) else None)
            assert place[k, s] == (i + 1, 15)


def test_one_bucket_with_all_rows_is_cut(spark):
    from echofield.functions.sequence import _pieces

    df = spark.range(20_000).select(F.lit(1).alias("g"), F.lit(0).alias("day"), F.col("id").alias("t"), (F.col("id") * 7 % 31).alias("who"))
    whole = edges.edges_from_sequence(df, "g", "who", ["t"], "day", most=1 << 30)
    cut = edges.edges_from_sequence(df, "g", "who", ["t"], "day", most=1000)
    assert rows(whole, "source", "target", "weight") == rows(cut, "source", "target", "weight")
    sizes = [r["count"] for r in _pieces(df.withColumn("_b", F.col("day")), "g", "t", 1000).groupBy("_piece").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 2 * 20_000 / len(sizes)
    assert _pieces(df.withColumn("_b", F.col("day")), "g", "t", 1 << 30).select("_piece").distinct().count() == 1


def test_salted_join_equals_plain_join(spark):
    big = spark.range(5000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 200)).alias("k"), "id")
    small = spark.range(150).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert [r.k for r in hot_keys(big, "k").collect()] == [0]
    for how in ("inner", "left"):
        assert rows(salted_join(big, small, "k", how), "id", "k") == rows(big.join(small, "k", how), "id", "k")


# --- graph ---

TRIANGLE = [(0, 1), (1, 2), (0, 2), (2, 3)]


@pytest.fixture()
def small_graph(spark):
    both = [(x, y, 1.0) for a, b in TRIANGLE for x, y in ((a, b), (b, a))]
    return spark.createDataFrame(both, S.EDGES)


def test_graph_statistics_worked(small_graph):
    c = one(graph.graph_counts(small_graph))
    assert (c.num_nodes, c.num_edges, c.average_degree) == (4, 8, 2.0)
    assert rows(graph.degrees(small_graph), "source", "degree") == [(0, 2), (1, 2), (2, 3), (3, 1)]
    assert rows(graph.degree_histogram(small_graph), "degree", "count") == [(1, 1), (2, 2), (3, 1)]
    s = one(graph.degree_stats(small_graph))
    assert (s.max_degree, s.min_degree) == (3, 1) and s.std_degree == pytest.approx(math.sqrt(2 / 3))
    p = one(graph.power_law_exponent(small_graph))
    assert p.exponent == pytest.approx(math.log(2) / math.log(1.5))
    got = {r.node: (r.triangles, r.clustering) for r in graph.local_clustering(small_graph).collect()}
    assert got == {0: (1, 1.0), 1: (1, 1.0), 2: (1, pytest.approx(1 / 3)), 3: (0, 0.0)}
    k = one(graph.clustering(small_graph, k=6))
    assert k["global"] == pytest.approx(3 / 5) and k.expected_lattice == pytest.approx(0.6)


def test_power_law_needs_two_points(spark):
    ring = edges.ring_lattice_edges(spark.range(10), 2)
    assert math.isnan(one(graph.power_law_exponent(ring)).exponent)


def test_lattice_clustering_matches_the_formula(spark):
    got = one(graph.clustering(edges.ring_lattice_edges(spark.range(60), 6), k=6))
    assert got.mean_local == pytest.approx(got.expected_lattice)


def test_generated_graphs(spark):
    nodes = spark.range(100)
    scale_free = edges.preferential_edges(nodes, 3)
    lattice = edges.ring_lattice_edges(nodes, 6)
    rewired = edges.rewire_edges(lattice, 0.3, F.lit(100))
    uniform = edges.random_edges(nodes, 6)
    for g, least in ((scale_free, 4.0), (lattice, 5.0), (rewired, 5.0), (uniform, 4.0)):
        c = one(graph.graph_counts(g))
        assert c.num_nodes == 100 and c.average_degree >= least
        pairs = [(r.source, r.target) for r in g.collect()]
        assert len(set(pairs)) == len(pairs) and all(a != b and (b, a) in set(pairs) for a, b in pairs)
    assert rewired.count() == lattice.count() == 600
    assert 0 < rewired.join(lattice, ["source", "target"], "left_anti").count() < 400
    assert one(graph.degree_stats(scale_free)).max_degree > 12
    assert one(graph.degree_check(lattice, 6.0, 100)).degree_ok


@pytest.mark.parametrize("first,step", [(0, 10), (1, 1), (-7, 3)])
def test_graphs_on_any_ids(spark, first, step):
    ids = [first + step * i for i in range(60)]
    nodes = spark.createDataFrame([(i,) for i in ids], "name long")
    lattice = edges.ring_lattice_edges(nodes, 6, "name")
    grown = edges.preferential_edges(nodes, 5, "name")
    for g in (lattice, grown, edges.random_edges(nodes, 6, "name"), edges.rewire_edges(lattice, 0.4, nodes=nodes, key="name")):
        ends = {x for r in g.collect() for x in (r.source, r.target)}
        assert ends <= set(ids) and len(ends) > 50
    assert {r["count"] for r in lattice.groupBy("source").count().collect()} == {6}
    # 6 nodes form a clique of 15 pairs, each of the other 54 joins exactly 5.
    assert grown.count() == 2 * (15 + 54 * 5) == grown.distinct().count()


def test_dense_ids_and_size_are_checked(spark):
    for call in (lambda: edges.random_edges(spark.range(1, 20), 3, dense=True).collect(),
                 lambda: edges.ring_lattice_edges(spark.range(4), 8).collect()):
        with pytest.raises(Exception, match="0..n-1|needs 9 nodes"):
            call()


def test_random_edges_hit_the_expected_number(spark):
    n, k = 400, 10.0
    m = edges.random_edges(spark.range(n), k).count() / 2
    assert abs(m - n * k / 2) < 5 * math.sqrt(n * k / 2)


@pytest.mark.parametrize("call", [
    lambda s: edges.preferential_edges(s.range(20), 0),
    lambda s: edges.ring_lattice_edges(s.range(20), 3),
    lambda s: edges.rewire_edges(edges.ring_lattice_edges(s.range(20), 4), 1.5, F.lit(20)),
    lambda s: bandit.bandit_scores(s.range(1), mode="other"),
    lambda s: sampling.sample_rows(s.range(1), 1.5, ["id"]),
])
def test_bad_arguments_are_refused(spark, call):
    with pytest.raises(ValueError):
        call(spark)


def test_edges_from_sequence_cross_buckets(spark):
    df = spark.createDataFrame(
        [(7, 0, 1, 1), (7, 0, 2, 2), (7, 1, 3, 3), (7, 4, 4, 1), (8, 0, 5, 9), (7, 4, 6, 1)],
        "item long, day long, t long, who long",
    )
    got = edges.edges_from_sequence(df, "item", "who", ["t"], "day")
    assert rows(got, "source", "target", "weight") == [
        (1, 2, 1.0), (1, 3, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 2, 1.0)]


def test_neighbor_aggregates(spark, small_graph):
    acts = spark.createDataFrame([(0, 5), (0, 5), (1, 5), (3, 6)], "humanId long, contentId long")
    got = rows(graph.neighbor_activity(small_graph, acts), "humanId", "contentId", "neighbor_count")
    assert got == [(0, 5, 1), (1, 5, 2), (2, 5, 3), (2, 6, 1)]
    state = spark.createDataFrame([(0, 0.2, 0.0), (1, 0.4, 1.0), (2, -0.6, 0.5)], "humanId long, valence double, arousal double")
    near = {r.humanId: r.neighbor_valence for r in graph.neighbor_mean(small_graph, state).collect()}
    assert near == {0: pytest.approx(-0.1), 1: pytest.approx(-0.2), 2: pytest.approx(0.3), 3: pytest.approx(-0.6)}
    d = {r.humanId: r.mean_distance for r in affect.mean_affect_distance(small_graph, state).collect()}
    assert d[0] == pytest.approx((math.hypot(0.2, 1.0) + math.hypot(0.8, 0.5)) / 2)


# --- exposure and state ---

def test_visibility_half_life_and_future(spark):
    items = spark.createDataFrame([(1, 0, 10.0), (2, 10, 5.0), (3, 11, 5.0), (4, 0, 1.0)], "contentId long, createdAtStep long, halfLife double")
    got = {r.contentId: r.visibility for r in exposure.visibility(items, 10).collect()}
    assert got == {1: 0.5, 2: 1.0, 3: 0.0, 4: pytest.approx(2.0**-10)}
    assert rows(exposure.visibility(items, 10, 0.01), "contentId") == [(1,), (2,)]


def _crowd(spark, n=300, m=40):
    people = sampling.synth_entities(spark.range(n).withColumnRenamed("id", "humanId"))
    items = sampling.synth_items(spark.range(m).withColumnRenamed("id", "contentId"))
    return people, exposure.visibility(items, 8)


def test_sampled_exposures_match_the_pair_probabilities(spark):
    people, items = _crowd(spark)
    got = exposure.sampled_exposures(people, items, rate=0.9)
    assert got.count() == got.select("humanId", "contentId").distinct().count()
    pairs = people.select("humanId").withColumn("contentId", F.explode(F.sequence(F.lit(0), F.lit(39))))
    p = exposure.pair_scores(pairs, people, items, 0.9).agg(
        F.sum("exposureProb").alias("m"), F.sum(F.col("exposureProb") * (1 - F.col("exposureProb"))).alias("v"))
    want = one(p)
    assert abs(got.count() - want.m) < 5 * math.sqrt(want.v)
    # and per item, which is where thinning would show
    seen = {r.contentId: r["count"] for r in got.groupBy("contentId").count().collect()}
    each = exposure.pair_scores(pairs, people, items, 0.9).groupBy("contentId").agg(F.sum("exposureProb").alias("m"))
    for r in each.collect():
        assert abs(seen.get(r.contentId, 0) - r.m) < 6 * math.sqrt(r.m + 1)


def test_cold_start_and_explore_shares(spark):
    people, items = _crowd(spark)
    cold = exposure.cold_start(people, items, 0.1)
    assert abs(cold.count() - 1200) < 5 * math.sqrt(1200)
    near = cold.withColumn("neighbor_count", F.lit(4).cast("long")).limit(50).checkpoint()
    mixed = exposure.explore_mix(near, people, items)
    assert mixed.filter("neighbor_count = 4").count() == 50
    assert mixed.count() == mixed.select("humanId", "contentId").distinct().count()


def test_blend_scores_worked(spark):
    c = spark.createDataFrame([(1, 0.5, 0.8, "JOY", 3, 1.0, "NEUTRAL", 0.4, 2), (1, 0.5, 0.8, "JOY", 4, 0.5, "NEUTRAL", 0.4, 0)],
                              "humanId long, attentionSpan double, addictionCoeff double, mood string, contentId long, visibility double, emotionType string, intensity double, neighbor_count long")
    scores = spark.createDataFrame([(3, 0.6)], "contentId long, score double")
    got = {r.contentId: r.exposureProb for r in exposure.blend_scores(c, scores).collect()}
    assert got == {3: pytest.approx(0.4 * (0.375 + 0.3)), 4: 0.0}
    assert {r.contentId: r.exposureProb for r in exposure.blend_scores(c, floor=0.1).collect()}[4] == pytest.approx(0.02)


def test_deltas_and_totals(spark):
    df = spark.createDataFrame([(1, "POSITIVE", True), (1, "POSITIVE", True), (1, "NEGATIVE", False), (2, "NEGATIVE", True), (2, "NEUTRAL", True)],
                               "humanId long, emotionType string, reacted boolean")
    got = dict(rows(transitions.signal_totals(transitions.emotion_delta(df)), "humanId", "totalEmotionDelta"))
    assert got == {1: 0.17, 2: -0.15}


def test_transition_rules(spark):
    state = spark.createDataFrame([(1, "NEUTRAL"), (2, "NEUTRAL"), (3, "JOY"), (4, "RAGE"), (5, "RAGE"), (6, "NEUTRAL")], "humanId long, mood string")
    totals = spark.createDataFrame([(1, 0.21), (2, -0.21), (3, -0.31), (4, 0.41), (5, 0.4), (6, 0.2)], "humanId long, totalEmotionDelta double")
    calm = spark.createDataFrame([(0.0, 0.0)], "joyPressure double, ragePressure double")
    got = dict(rows(transitions.class_transition(state, totals, calm), "humanId", "mood"))
    assert got == {1: "JOY", 2: "RAGE", 3: "NEUTRAL", 4: "NEUTRAL", 5: "RAGE", 6: "NEUTRAL"}
    storm = spark.createDataFrame([(0.0, 1.0)], "joyPressure double, ragePressure double")
    after = dict(rows(transitions.class_transition(state, None, storm), "humanId", "mood"))
    assert after[1] == after[2] == after[6] == "RAGE" and after[4] == "RAGE"
    p = one(transitions.class_pressure(state, 2.0, 1.0))
    assert (p.joyPressure, p.ragePressure) == (pytest.approx(2 / 60), pytest.approx(2 / 60))


def test_affect_update_worked(spark):
    state = spark.createDataFrame([(1, 0.5, 0.4, 0.1, -0.2), (2, 1.0, -1.0, None, None)],
                                  "humanId long, valence double, arousal double, baselineValence double, baselineArousal double")
    near = spark.createDataFrame([(1, 0.6, 0.2)], "humanId long, neighbor_valence double, neighbor_arousal double")
    seen = spark.createDataFrame([(1, -0.4, 0.8)], "humanId long, content_valence double, content_arousal double")
    got = {r.humanId: r for r in affect.affect_update(state, near, seen).collect()}
    assert got[1].valence == pytest.approx(0.35 - 0.06 + 0.06 + 0.005) and got[1].mood == "JOY"
    assert got[1].arousal == pytest.approx(0.4 * 0.63 + 0.12 + 0.02 - 0.01)
    assert got[2].valence == pytest.approx(0.7)
    alone = {r.humanId: r for r in affect.affect_update(state, None, None).collect()}
    assert alone[1].valence == pytest.approx(0.355)


def test_item_affect_prefers_own_values(spark):
    items = spark.createDataFrame([(1, "NEGATIVE", 0.5, None, None), (2, "POSITIVE", 0.5, 0.1, 0.2)],
                                  "contentId long, emotionType string, intensity double, valence double, arousal double")
    acts = spark.createDataFrame([(9, 1), (9, 2)], "humanId long, contentId long")
    got = affect.attach_item_affect(acts, items)
    assert rows(got, "contentId", "contentValence", "contentArousal") == [(1, -0.7, 0.8), (2, 0.1, 0.2)]
    w = one(affect.weighted_affect(got))
    assert w.content_valence == pytest.approx(-0.3) and w.total_intensity == 1.0


def test_fill_missing_steps(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 4, 0.8, -0.4), (2, 3, 0.1, 0.1)], "humanId long, step long, valence double, arousal double")
    got = {(r.humanId, r.step): (round(r.valence, 9), round(r.arousal, 9), r.recorded) for r in affect.fill_missing_steps(df).collect()}
    assert got == {(1, 0): (0.0, 0.0, True), (1, 1): (0.2, -0.1, False), (1, 2): (0.4, -0.2, False),
                   (1, 3): (0.6, -0.3, False), (1, 4): (0.8, -0.4, True), (2, 3): (0.1, 0.1, True)}


def test_decay_and_fatigue_worked(spark):
    df = spark.createDataFrame([(1, 0.51, 0.995), (2, 0.49, 0.005)], "humanId long, attentionSpan double, fatigue double")
    before = dict(rows(upkeep.decay_recover(df), "humanId", "attentionSpan"))
    after = dict(rows(upkeep.decay_recover(df, recover_on="after"), "humanId", "attentionSpan"))
    assert before == {1: pytest.approx(0.4845), 2: pytest.approx(0.4855)} and after[1] == pytest.approx(0.5045)
    acts = spark.createDataFrame([(1, True), (1, True), (2, False)], "humanId long, reacted boolean")
    assert dict(rows(upkeep.fatigue_update(df, acts), "humanId", "fatigue")) == {1: 1.0, 2: 0.0}


def fold_by_hand(events, start, acc, rec, first):
    out, by = {}, {}
    for who, step, reacted in events:
        by.setdefault(who, {}).setdefault(step, 0)
        by[who][step] += reacted
    for who, steps in by.items():
        x = start
        for s in range(first, max(steps) + 1):
            n = steps.get(s, 0)
            x = min(1.0, max(0.0, x + (acc * n if n else -rec)))
            if s in steps:
                out[who, s] = x
    return out


@pytest.mark.parametrize("block", [1, 3, 16, 128])
def test_fold_equals_a_step_loop(spark, block):
    rnd = random.Random(block)
    events = [(rnd.choice([0, 0, 0, 1, 2]), int(rnd.random() ** 2 * 90) + 5, rnd.random() < 0.6) for _ in range(400)]
    df = spark.createDataFrame(events, "humanId long, step long, reacted boolean")
    got = upkeep.fold_by_step(df, start=0.4, accumulation=0.2, recovery=0.15, first_step=2, block=block)
    want = fold_by_hand(events, 0.4, 0.2, 0.15, 2)
    assert {(r.humanId, r.step): pytest.approx(r.fatigue) for r in got.collect()} == want


# --- metrics ---

def test_class_metrics_worked(spark):
    df = spark.createDataFrame([("JOY",)] * 2 + [("NEUTRAL",)] * 5 + [("RAGE",)] * 3, "mood string")
    assert one(metrics.polarization(df)).polarizationIndex == pytest.approx(0.1)
    assert one(metrics.extremism(df)).extremismRate == pytest.approx(0.5)
    assert one(metrics.fragmentation(df)).fragmentationIndex == pytest.approx(0.5)
    assert one(metrics.dominance(df)).emotionDominanceRatio == pytest.approx(0.5)
    want = -sum(p * math.log2(p) for p in (0.2, 0.5, 0.3))
    assert one(metrics.class_entropy(df)).moodEntropy == pytest.approx(want)
    assert one(metrics.class_distribution(df)).moodDistribution == {"JOY": 2, "NEUTRAL": 5, "RAGE": 3}
    empty = df.limit(0)
    assert one(metrics.polarization(empty)).polarizationIndex == 0.0
    assert one(metrics.fragmentation(empty)).fragmentationIndex == 0.0


def test_engagement_counts_people_without_any(spark):
    people = spark.range(4).withColumnRenamed("id", "humanId")
    acts = spark.createDataFrame([(0,), (0,), (0,), (1,)], "humanId long")
    assert rows(metrics.engagement_per_entity(people, acts), "humanId", "engagement") == [(0, 3), (1, 1), (2, 0), (3, 0)]
    assert one(metrics.engagement_gini(people, acts)).gini == pytest.approx(reference_gini([3, 1, 0, 0]))
    assert one(metrics.avg_engagement(people, acts)).avgEngagement == 1.0


def test_metrics_row_has_the_stored_schema(spark):
    state = spark.createDataFrame([(1, 0, "JOY", 0.4, 0.99), (2, 0, "RAGE", 0.6, 0.1)], "humanId long, step long, mood string, attentionSpan double, fatigue double")
    acts = spark.createDataFrame([(1, 0, "POSITIVE")], "humanId long, step long, emotionType string")
    df = metrics.as_metrics_row(metrics.step_metrics(state, acts))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in S.METRICS]
    r = one(df)
    assert (r.collapsedCount, r.engagementGini, r.fatigueP95, r.moodDistribution["RAGE"]) == (1, 0.5, 0.99, 1)


def test_grid_edges(spark):
    df = spark.createDataFrame([(1.0, -1.0), (0.99, -0.99), (-0.01, 0.0), (1.2, 0.0)], "valence double, arousal double")
    assert rows(metrics.affect_grid(df, 4), "valence_bin", "arousal_bin", "count") == [(1, 2, 1), (3, 0, 2)]
    assert one(metrics.quadrant_counts(df)).pos_neg == 2


def test_transition_matrix_rows_sum_to_one(spark):
    df = spark.createDataFrame([(1, 0, "JOY"), (1, 1, "RAGE"), (1, 2, "RAGE"), (2, 0, "JOY"), (2, 5, "JOY")], "humanId long, step long, mood string")
    got = {(r.from_class, r.to_class): r.share for r in metrics.transition_matrix(df).collect()}
    assert got == {("JOY", "JOY"): 0.5, ("JOY", "NEUTRAL"): 0.0, ("JOY", "RAGE"): 0.5,
                   ("RAGE", "JOY"): 0.0, ("RAGE", "NEUTRAL"): 0.0, ("RAGE", "RAGE"): 1.0,
                   ("NEUTRAL", "JOY"): 0.0, ("NEUTRAL", "NEUTRAL"): 0.0, ("NEUTRAL", "RAGE"): 0.0}


# --- bandit ---

def test_beta_draws_follow_the_distribution(spark):
    arms = spark.createDataFrame([(4.0, 2.0), (700.0, 500.0)], "successes double, failures double").withColumn(
        "trial", F.explode(F.sequence(F.lit(1), F.lit(1500))))
    got = bandit.beta_draws(arms, keys=["successes", "trial"]).groupBy("successes", "failures").agg(
        F.avg("draw").alias("m"), F.stddev_samp("draw").alias("s"), F.min("draw").alias("lo"), F.max("draw").alias("hi"))
    for r in got.collect():
        a, b = r.successes + 1, r.failures + 1
        sd = math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        assert abs(r.m - a / (a + b)) < 5 * sd / math.sqrt(1500) and abs(r.s / sd - 1) < 0.1
        assert 0 <= r.lo and r.hi <= 1


def test_top_k_and_ties(spark):
    df = spark.createDataFrame([(1, 7, 0.5), (1, 3, 0.5), (1, 9, 0.1), (2, 9, 0.2)], "humanId long, contentId long, score double")
    assert rows(bandit.top_k_items(df, 2), "humanId", "rank", "contentId") == [(1, 1, 3), (1, 2, 7), (2, 1, 9)]


def test_ks_matches_brute_force(spark):
    rnd = random.Random(2)
    a = [round(rnd.gauss(0, 1), 1) for _ in range(300)]
    b = [round(rnd.gauss(0.4, 1), 1) for _ in range(200)]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, x double").repartition(5)
    got = one(bandit.ks_two_sample(df, "g", "x", "a", "b"))
    want = max(abs(sum(v <= x for v in a) / 300 - sum(v <= x for v in b) / 200) for x in a + b)
    lam = math.sqrt(300 * 200 / 500) * want
    assert got.statistic == pytest.approx(want)
    assert got.p_value == pytest.approx(2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 60)))


@pytest.mark.parametrize("a,b", [(6.0, 4.0), (300.0, 700.0), (400_000.0, 600_000.0), (1.0, 1.0)])
def test_beta_draws_at_all_sizes(spark, a, b):
    n = 3000
    arms = spark.range(n).select(F.col("id").alias("contentId"), F.lit(a - 1).alias("successes"), F.lit(b - 1).alias("failures"))
    got = sorted(r.draw for r in bandit.beta_draws(arms).collect())
    mean, sd = a / (a + b), math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    assert abs(sum(got) / n - mean) < 4 * sd / math.sqrt(n)
    assert abs(sum((x - mean) ** 2 for x in got) / n / sd**2 - 1) < 0.15
    import numpy as np
    other = np.sort(np.random.default_rng(1).beta(a, b, 20_000))
    gap = np.abs(np.searchsorted(other, got) / len(other) - np.arange(n) / n).max()
    assert gap < 1.63 * math.sqrt(1 / n + 1 / len(other))


def test_beta_moments_agree_with_exact_draws(spark):
    arms = spark.createDataFrame([(1, 92.0, 15.0), (2, 35.0, 80.0), (3, 8.0, 10.0)], "contentId long, successes double, failures double")
    assert one(bandit.selection_agreement(arms, 300, mode="beta_moments")).agreement > 0.9


# --- statistics ---

@pytest.mark.parametrize("n", [10, 1e3, 1e6, 1e9, 1e11, 1e12, 1e13])
def test_tails_keep_their_digits(n):
    from echofield.functions.special import _betainc

    def f_tail(f, d1, d2):
        return _betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))

    for f in (0.1, 1.0, 2.0, 30.0):
        assert f_tail(f, 2, n) == pytest.approx(math.exp(-n / 2 * math.log1p(2 * f / n)), rel=1e-9)
        # Two more degrees of freedom, in closed form.
        z = 4 * f / n
        exact = math.exp(-n / 2 * math.log1p(z)) * (1 + n / 2 * z / (1 + z))
        assert f_tail(f, 4, n) == pytest.approx(exact, rel=1e-9)


def test_quantile_chunks_hold_few_rows_per_task(spark):
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_013).cast("double").alias("x"))
    xs = sorted(i * 7919 % 60_013 for i in range(60_000))
    got = one(ranking.quantiles(df, "x", [0.01, 0.5, 0.95], kind="rank"))
    assert (got.q0, got.q1, got.q2) == (xs[600], xs[30_000], xs[57_000])
    plan = ranking.quantiles(df, "x", [0.5])._jdf.queryExecution().executedPlan().toString().split("\n")
    single = [plan[i + 1] for i, line in enumerate(plan) if "Exchange SinglePartition" in line]
    # Only what has been summed up meets in one task: sketches, chunk sums and the picks.
    assert single and all("Aggregate" in line for line in single)


def test_hot_keys_follow_the_cluster(spark):
    big = spark.range(100_000).select(F.when(F.col("id") % 1000 < 50, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
    hot = hot_keys(big, "k").collect()
    assert [(r.k, r["_salts"]) for r in hot] == [(0, 2)]
    small = spark.range(0, 100_000, 50).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    assert salted_join(big, small, "k").count() == big.join(small, "k").count()


def test_tail_probabilities():
    # Known quantiles: t(10) at 2.228 and F(2, 10) at 4.103 both leave 5%.
    assert special._betainc(5, 0.5, 10 / (10 + 2.228139**2), 2.228139**2 / (10 + 2.228139**2)) == pytest.approx(0.05, abs=1e-6)
    assert special._betainc(5, 1, 10 / (10 + 2 * 4.102821), 8.205642 / (10 + 8.205642)) == pytest.approx(0.05, abs=1e-6)


def test_anova_of_two_groups_is_the_squared_t(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 4.0)] + [("b", x) for x in (3.0, 5.0, 4.0, 6.0, 7.0)], "g string, x double")
    f, t = one(stats.anova_oneway(df, "g", "x")), one(stats.ttest(df, "g", "x", "a", "b"))
    assert f.f_stat == pytest.approx(t.t_stat**2) and f.p_value == pytest.approx(t.p_value)
    assert (f.df1, f.df2, t.df) == (1, 7, 7.0)
    assert one(stats.ttest(df, "g", "x", "a", "b", equal_var=False)).df < 7
    (p,) = stats.pairwise_ttests(df, "g", "x").collect()
    assert p.t_stat == pytest.approx(t.t_stat) and p.mean_diff == -2.5


def test_constant_groups_give_null_tests(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, x double")
    assert one(stats.ttest(df, "g", "x", "a", "b")).t_stat is None
    assert one(stats.anova_oneway(df, "g", "x")).f_stat is None


def test_box_stats_worked(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)], "g string, x double")
    r = one(stats.box_stats(df, ["g"], "x"))
    assert (r.q1, r.median, r.q3, r.whisker_lo, r.whisker_hi, r.outliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_bootstrap_band_covers_the_mean(spark):
    df = spark.createDataFrame([("a", 0, i, float(i % 10)) for i in range(200)], "g string, step long, i long, x double")
    r = one(stats.bootstrap_band(df, ["g"], "step", "x", ["g", "i"], b=300))
    half = 1.96 * math.sqrt(8.25 / 200)
    assert r.lo < 4.5 < r.hi and (r.hi - r.lo) / 2 == pytest.approx(half, rel=0.25)


def test_grids(spark):
    base = spark.createDataFrame([(1.0, 0.3)], "a double, b double")
    grid = stats.condition_grid(base, {"a": [0.0, 2.0], "b": [0.1]}, ["x", "y", "z"])
    assert grid.count() == 12 and rows(grid.filter("topology = 'x'"), "setting", "a", "b") == [
        ("a=0.0", 0.0, 0.3), ("a=2.0", 2.0, 0.3), ("b=0.1", 1.0, 0.1), ("baseline", 1.0, 0.3)]
    runs = stats.replicate_grid(grid, 10, ["setting", "topology"])
    assert runs.select("seed").distinct().count() == 120


def test_divergence_step(spark):
    data = [("a", s, v) for s, v in enumerate((1.0, 3.0, 1.0, 4.0, 5.0))] + [("b", s, 2.0) for s in range(5)]
    df = spark.createDataFrame(data, "c string, step long, v double")
    assert one(stats.divergence_step(df, "c", "step", "v", "a", "b")).divergence_step == 3
    assert one(stats.divergence_step(df, "c", "step", "v", "b", "a")).divergence_step is None


# --- calibration and sensitivity ---

def test_abc_distance_worked_and_missing_parts(spark):
    runs = spark.createDataFrame([(1, [0.2, 0.5, 0.3], 0.1), (2, [0.2, 0.5, 0.3], None)], "draw long, mood_distribution array<double>, polarization_index double")
    seen = spark.createDataFrame([([0.2, 0.2, 0.6], 0.45)], "mood_distribution array<double>, polarization_index double")
    got = {r.draw: r.distance for r in calibration.abc_distance(runs, seen).collect()}
    assert got == {1: pytest.approx(2 * math.hypot(0.3, 0.3) + 0.35), 2: pytest.approx(2 * math.hypot(0.3, 0.3))}


def test_sobol_indices_of_a_known_function(spark):
    names = ["x", "y", "z"]
    ids = spark.range(4000).withColumnRenamed("id", "row")
    design = calibration.saltelli_design(ids, {n: (0.0, 1.0) for n in names})
    assert design.count() == 4000 * 8
    outcome = design.withColumn("y_", F.col("x") + 2 * F.col("y") + 3 * F.col("x") * F.col("z")).select("row", "block", *names, F.col("y_"))
    results = outcome.select("row", "block", F.create_map(F.lit("m"), F.col("y_")).alias("metrics"))
    d = calibration.attach_outcomes(design.select("row", "block"), results, "m")
    s1 = {r.parameter: r.S1 for r in calibration.sobol_first(d, names).collect()}
    st_ = {r.parameter: r.ST for r in calibration.sobol_total(d, names).collect()}
    s2 = {(r.parameter1, r.parameter2): r.S2 for r in calibration.sobol_second(d, names).collect()}
    # x + 2y + 3xz on the unit cube: variances by hand
    vx, vy, vz, vxz = 2.5**2 / 12, 4 / 12, 1.5**2 / 12, 9 / 144
    v = vx + vy + vz + vxz
    for n, first, tot in (("x", vx, vx + vxz), ("y", vy, vy), ("z", vz, vz + vxz)):
        assert s1[n] == pytest.approx(first / v, abs=0.06) and st_[n] == pytest.approx(tot / v, abs=0.06)
    assert s2["x", "z"] == pytest.approx(vxz / v, abs=0.12) and abs(s2["x", "y"]) < 0.12
    conf = {r.parameter: r.S1_conf for r in calibration.sobol_confidence(d, names, 40).collect()}
    assert all(0 < c < 0.15 for c in conf.values())


# --- quality ---

def test_check_params_lists_failures(spark):
    df = spark.createDataFrame([(50, 3, 1.5), (1000, 6, 0.5), (1000, None, 0.5)], "populationSize int, networkK int, networkP double")
    got = [r.failed_rules for r in quality.check_params(df).collect()]
    assert got == [["populationSize: below 100", "networkK: odd", "networkP: above 1.0"], [], ["networkK: missing"]]


def test_check_ranges_reports_missing_columns(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (None,)], "valence double")
    got = rows(quality.check_ranges(df, {"valence": (-1, 1), "arousal": (-1, 1)}), "column", "present", "violations")
    assert got == [("arousal", False, None), ("valence", True, 1)]


def test_neighbor_activity_moves_lists(spark, monkeypatch):
    """Hubs on both ends and long lists; an edge is shuffled as lists of its neighbour's items, not as rows per item."""
    monkeypatch.setattr(graph, "ITEMS", 3)
    rnd = random.Random(4)
    pairs = [(0, t) for t in range(1, 60)] + [(s, 0) for s in range(1, 60)] + [(rnd.randrange(20), rnd.randrange(20)) for _ in range(90)]
    acts = [(rnd.randrange(60), rnd.randrange(12)) for _ in range(300)] + [(0, i) for i in range(12)] * 2 + [(5, None)]
    want = {}
    for s, t in pairs:
        for who, item in acts:
            if who == t:
                want[s, item] = want.get((s, item), 0) + 1
    e = spark.createDataFrame(pairs, "source long, target long")
    df = graph.neighbor_activity(e, spark.createDataFrame(acts, "humanId long, contentId long"))
    assert {(r.humanId, r.contentId): r.neighbor_count for r in df.collect()} == want
    assert "collect_list" in df._jdf.queryExecution().sparkPlan().toString()
