"""Quantiles of long-tailed values, stored sketches, and brackets that miss."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from echofield.functions import ranking
from echofield.functions.columns import uni

PROBS = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]


def exact(xs, p, kind):
    xs = sorted(xs)
    if kind == "rank":
        return xs[min(int(len(xs) * p), len(xs) - 1)]
    at = (len(xs) - 1) * p
    low = int(at)
    return xs[low] + (xs[min(low + 1, len(xs) - 1)] - xs[low]) * (at - low)


def groups_of(spark):
    rnd = random.Random(8)
    data = [("big" if i % 3 else f"g{i % 7}", math.exp(20 * rnd.random())) for i in range(30_000)]
    data += [("one", 5.0), (None, 1.0), (None, 2.0), ("big", None)]
    groups = {}
    for g, x in data:
        if x is not None:
            groups.setdefault(g, []).append(x)
    return spark.createDataFrame(data, "g string, x double").repartition(6), groups


def test_a_long_tail_is_cut_evenly(spark):
    """The pieces of a bracket hold about as many rows each, though values span nine orders of magnitude."""
    df = spark.range(400_000).select(F.exp(F.lit(20.0) * uni(3, "tail", "id")).alias("x"))
    sketch = df.select(F.col("x").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("_min"), F.max("v").alias("_max"),
        F.percentile_approx("v", F.array(*map(F.lit, ranking._marks([1.0], 0.1))), F.lit(40_000)).alias("_m"),
    )
    s = ranking._brackets(sketch, [], [1.0], 0.1, F.lit(False)).first()._s
    inside = [r.x for r in df.filter(F.col("x") >= s.lo0).collect()]
    sizes = {}
    for x in inside:
        k = sum(c < x for c in s.cuts)
        sizes[k] = sizes.get(k, 0) + 1
    # Half of the marks lie beyond rank 1; the others cut 40,000 rows in eight.
    assert len(sizes) >= 8 and max(sizes.values()) < 2 * len(inside) / 8


@pytest.mark.parametrize("kind", ["rank", "linear"])
def test_exact_quantiles_from_stored_sketches(spark, kind):
    df, groups = groups_of(spark)
    groups = {g: xs for g, xs in groups.items() if g is not None}
    df = df.filter("g is not null")
    stored = ranking.quantile_sketches(df, "x", ["g"], 256)
    for r in ranking.quantiles_from(df, "x", PROBS, stored, ["g"], kind, slack=0.02).collect():
        assert r.n == len(groups[r.g])
        for i, p in enumerate(PROBS):
            assert r[f"q{i}"] == pytest.approx(exact(groups[r.g], p, kind))
    whole = ranking.merge_sketches(stored, [], 256)
    (r,) = ranking.quantiles_from(df, "x", PROBS, whole, [], kind, slack=0.02).collect()
    everything = [x for xs in groups.values() for x in xs]
    assert [r[f"q{i}"] for i in range(len(PROBS))] == pytest.approx([exact(everything, p, kind) for p in PROBS])


def test_a_missed_bracket_is_widened(spark):
    """Sketches of other values put every bracket in the wrong place; the ranks are found all the same."""
    df, groups = groups_of(spark)
    df = df.filter("g is not null")
    wrong = ranking.quantile_sketches(df.withColumn("x", F.col("x") * F.when(F.col("g") == "big", 3.0).otherwise(1.0)), "x", ["g"])
    right = ranking.quantile_sketches(df, "x", ["g"]).select("g", F.col("lowest").alias("l"), F.col("highest").alias("h"))
    stored = wrong.join(right, "g").select("g", "n", F.col("l").alias("lowest"), F.col("h").alias("highest"), "sketch")
    found = {r.g: r for r in ranking.quantiles_from(df, "x", [0.3, 0.7], stored, ["g"], slack=0.001).collect()}
    assert found.keys() == {g for g in groups if g is not None}
    for g, r in found.items():
        assert r.q0 == pytest.approx(exact(groups[g], 0.3, "linear")) and r.q1 == pytest.approx(exact(groups[g], 0.7, "linear"))


def test_sketches_alone_are_close(spark):
    df = spark.range(50_000).select((F.col("id") % 5).alias("g"), F.col("id").cast("double").alias("x"))
    merged = ranking.merge_sketches(ranking.quantile_sketches(df, "x", ["g"]))
    (r,) = ranking.sketched_quantiles(merged, [0.1, 0.5]).collect()
    assert r.n == 50_000 and abs(r.q0 - 5_000) < 250 and abs(r.q1 - 25_000) < 250


def test_empty_and_null_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", float("nan"))], "g string, x double")
    stored = ranking.quantile_sketches(df, "x", ["g"])
    assert [(r.g, r.n, r.q0) for r in ranking.quantiles_from(df, "x", [0.5], stored, ["g"]).collect()] == [("b", 1, 1.0)]
    assert ranking.quantiles_from(df.limit(0), "x", [0.5], stored.limit(0), ["g"]).count() == 0


def test_rows_do_not_move_to_the_bracket_of_their_group(spark):
    """Two groups share all rows: a join by group would put them in two tasks."""
    from echofield.session import setting

    df = spark.range(60_000).select((F.col("id") % 2).alias("g"), uni(5, "q", "id").alias("x"))
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "65536"):
        found = ranking.quantiles(df, "x", [0.5], ["g"])
        plan = found._jdf.queryExecution().sparkPlan().toString()
        rows = {r.g: r.q0 for r in found.collect()}
    assert "BroadcastHashJoin" in plan and plan.count("SortMergeJoin") <= 1  # the offsets, SLICES rows a group
    xs = {}
    for r in df.collect():
        xs.setdefault(r.g, []).append(r.x)
    assert rows == {g: pytest.approx(exact(v, 0.5, "linear")) for g, v in xs.items()}
