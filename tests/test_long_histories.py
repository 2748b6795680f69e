"""Folds over very long histories, long gaps, and tables stored by entity."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofield.operators import affect, upkeep
from echofield.sources import bucketed


@pytest.mark.parametrize("fanout", [2, 5, 128])
def test_trees_of_any_height(spark, monkeypatch, fanout):
    monkeypatch.setattr(upkeep, "FANOUT", fanout)
    rnd = np.random.default_rng(fanout)
    rows = [(int(w), int(s), bool(r)) for w, s, r in zip(rnd.integers(0, 3, 300), rnd.integers(0, 900, 300) ** 2 // 700, rnd.random(300) < 0.7)]
    df = spark.createDataFrame(rows, "humanId long, step long, reacted boolean")
    got = {(r.humanId, r.step): r.fatigue for r in upkeep.fold_by_step(df, start=0.4, accumulation=0.3, recovery=0.01, first_step=0, block=3).collect()}
    per = {}
    for w, s, r in rows:
        per.setdefault(w, {}).setdefault(s, 0)
        per[w][s] += r
    for w, steps in per.items():
        x = 0.4
        for s in range(max(steps) + 1):
            n = steps.get(s, 0)
            x = min(1.0, max(0.0, x + (0.3 * n if n else -0.01)))
            if s in steps:
                assert got.pop((w, s)) == pytest.approx(x)
    assert not got
    assert upkeep.fold_by_step(df.limit(0), first_step=0).count() == 0


def test_an_entity_with_a_million_steps(spark):
    n = 1_000_000
    reacted = (F.xxhash64("id") % 100) < 30
    df = spark.range(n).select(F.lit(1).cast("long").alias("humanId"), (F.col("id") * 3).alias("step"), reacted.alias("reacted"))
    got = upkeep.fold_by_step(df, start=0.5, accumulation=0.03, recovery=0.01, first_step=0)
    flags = df.orderBy("step").toPandas()["reacted"].to_numpy()
    x, want = 0.5, np.empty(n)
    for i, r in enumerate(flags.tolist()):
        if i:
            x = max(0.0, x - 0.02)
        x = min(1.0, x + 0.03) if r else max(0.0, x - 0.01)
        want[i] = x
    table = got.orderBy("step").toPandas()
    assert len(table) == n and np.allclose(table["fatigue"].to_numpy(), want)


def test_gaps_are_filled_span_by_span(spark, monkeypatch):
    monkeypatch.setattr(affect, "SPAN", 4)
    df = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 11, 1.1, -0.1), (1, 12, 0.5, 0.5), (2, 5, 0.1, 0.2)], "humanId long, step long, valence double, arousal double")
    got = sorted(tuple(r) for r in affect.fill_missing_steps(df).collect())
    assert [(k, s) for k, s, *_ in got] == [(1, s) for s in range(13)] + [(2, 5)]
    assert all(v == pytest.approx(min(1.0, s / 10)) and a == pytest.approx(1 - s / 10) for k, s, v, a, _ in got if k == 1 and s < 11)


def test_a_gap_of_ten_million_steps(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 10_000_000, 1.0, 0.0)], "humanId long, step long, valence double, arousal double")
    r = affect.fill_missing_steps(df).agg(F.count(F.lit(1)).alias("n"), F.avg("valence").alias("m"), F.count_distinct("step").alias("d")).first()
    assert r.n == r.d == 10_000_001 and r.m == pytest.approx(0.5)


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange")


def test_bucketed_state_and_interactions_join_in_place(spark, tmp_path):
    ids = spark.range(400)
    state = ids.select(F.col("id").alias("humanId"), (F.col("id") % 10 / 10).alias("fatigue"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("step"))
    acts = spark.range(3000).select((F.col("id") * 7 % 400).alias("humanId"), (F.col("id") % 3 > 0).alias("reacted"), (F.col("id") % 2).alias("step"))
    bucketed.write_bucketed(state, "state_by_entity", str(tmp_path / "state"), buckets=6)
    bucketed.write_bucketed(acts, "acts_by_entity", str(tmp_path / "acts"), buckets=6)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        moved = upkeep.fatigue_update(bucketed.read_step(spark, "state_by_entity", 1), bucketed.read_step(spark, "acts_by_entity", 1))
        plain = upkeep.fatigue_update(state.filter("step = 1"), acts.filter("step = 1"))
        assert exchanges(moved) == 0 and exchanges(plain) > 0
        key = lambda r: r.humanId
        want = sorted(plain.select("humanId", "fatigue").collect(), key=key)
        assert sorted(moved.select("humanId", "fatigue").collect(), key=key) == want
        # The next step is added twice: the second run replaces the first.
        for _ in range(2):
            bucketed.add_bucketed(moved.withColumn("step", F.lit(2).cast("long")), "state_by_entity")
        steps = {r.step: r["count"] for r in spark.table("state_by_entity").groupBy("step").count().collect()}
        assert steps == {0: 400, 1: 400, 2: 400} and bucketed.buckets_of(spark, "state_by_entity") == 6
        again = upkeep.fatigue_update(bucketed.read_step(spark, "state_by_entity", 2), bucketed.read_step(spark, "acts_by_entity", 0))
        assert exchanges(again) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS state_by_entity")
        spark.sql("DROP TABLE IF EXISTS acts_by_entity")
    with pytest.raises(ValueError):
        bucketed.write_bucketed(state, "x", str(tmp_path / "x"), buckets=0)
