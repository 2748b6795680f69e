"""Sources, sinks and streams on small tables in a temporary folder."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from echofield import schemas as S
from echofield.operators import metrics, upkeep
from echofield.sources import experiments as ex
from echofield.sources import snapshots as snap
from echofield.streaming.events import combined, stream_fold_events
from echofield.streaming.fold import stream_fold, stream_step_counts
from echofield.streaming.metrics import stream_step_metrics
from echofield.streaming.run import drain, parquet_stream, rocksdb_state


def states(spark, *data):
    return spark.createDataFrame(data, "humanId long, step long, mood string")


def test_rewriting_a_step_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "state")
    snap.write_snapshot(states(spark, (1, 0, "JOY"), (1, 1, "JOY")), path)
    snap.write_snapshot(states(spark, (1, 1, "RAGE")), path)
    snap.write_snapshot(states(spark, (2, 9, "NEUTRAL")).drop("step"), path, step=2)
    got = sorted((r.step, r.mood) for r in snap.read_partitioned(spark, path).collect())
    assert got == [(0, "JOY"), (1, "RAGE"), (2, "NEUTRAL")]
    one = snap.read_snapshot(spark, path, 1)
    assert [(r.step, r.mood) for r in one.collect()] == [(1, "RAGE")]
    assert "PartitionFilters: [isnotnull(step" in one._jdf.queryExecution().toString()


def test_steps_from_paths(spark, tmp_path):
    for s in (3, 12):
        states(spark, (1, s, "JOY")).drop("step").write.parquet(str(tmp_path / f"step_{s:05d}.parquet"))
    df = snap.read_snapshots(spark, str(tmp_path / "step_*.parquet"))
    assert sorted(r.step for r in df.collect()) == [3, 12]


def test_steps_from_a_partitioned_table(spark, tmp_path):
    path = str(tmp_path / "state")
    snap.write_snapshot(states(spark, *[(1, s, "JOY") for s in [*range(40), 12_000]]), path)
    df = snap.read_snapshots(spark, f"{path}/step=*", pattern=snap.STEP_FOLDER)
    assert sorted(r.step for r in df.collect()) == [*range(40), 12_000]


def test_read_or_default(spark, tmp_path):
    empty = snap.read_or_default(spark, str(tmp_path / "none"), S.INTERACTIONS)
    assert empty.count() == 0 and empty.schema == S.INTERACTIONS
    other = states(spark, (1, 0, "JOY"))
    assert snap.read_or_default(spark, str(tmp_path / "none"), other.schema, other).count() == 1


def test_runs_from_folders_and_latest(spark, tmp_path):
    m = spark.createDataFrame([(0, 1.0)], "timeStep long, value double")
    for run, cond, rep in (("r1", "ring", 0), ("r1", "random", 3), ("r2", "ring", 0)):
        m.write.parquet(str(tmp_path / run / "data" / cond / f"replicate_{rep:02d}" / "metrics"))
    df = ex.read_experiment(spark, str(tmp_path), layout="folders")
    got = sorted((r.run, r.condition, r.replicate) for r in df.collect())
    assert got == [("r1", "random", 3), ("r1", "ring", 0), ("r2", "ring", 0)]
    last = ex.read_experiment(spark, str(tmp_path), latest=True, layout="folders")
    assert [r.run for r in last.collect()] == ["r2"]


def test_params_from_json_defaults_and_unknown_keys(spark):
    df = spark.createDataFrame([('{"seed": 7, "nope": 1, "initialMoodDistribution": [0.1, 0.3]}',), ("{}",)], "p string")
    a, b = ex.params_from_json(df, "p").collect()
    assert (a.seed, a.initialMoodDistribution) == (7, [0.1, 0.3])
    assert (b.seed, b.populationSize, b.networkP, b.networkType) == (42, 10_000, 0.05, "ALL_TO_ALL")
    assert b.initialMoodDistribution == [0.2, 0.6] and b.useContinuousEmotions is False


def test_append_and_history(spark, tmp_path):
    path = str(tmp_path / "metrics")
    for s in (2, 0, 1):
        snap.append_metrics(spark.createDataFrame([(s,)], "timeStep long"), path)
    assert [r.timeStep for r in snap.metrics_history(spark, path).collect()] == [0, 1, 2]


def event_files(spark, folder, parts):
    """Events of 12 days in ``parts`` files by time, one entity with a third of them."""
    rnd = random.Random(11)
    rows = []
    for i in range(900):
        who = 0 if rnd.random() < 0.34 else rnd.randrange(1, 9)
        t = rnd.random() ** 1.3 * 12 * 86_400
        rows.append((who, 1_704_067_200 + int(t), rnd.random() < 0.5, rnd.choice(["JOY", "NEUTRAL", "RAGE"])))
    rows.sort(key=lambda r: r[1])
    size = -(-len(rows) // parts)
    schema = "humanId long, sec long, reacted boolean, mood string"
    for p in range(parts):
        df = spark.createDataFrame(rows[p * size:(p + 1) * size], schema)
        df.select("humanId", F.timestamp_seconds("sec").alias("ts"), "reacted", "mood").coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).withColumn("step", F.floor((F.unix_seconds("ts") - 1_704_067_200) / 86_400).cast("long"))


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_equal_batch(spark, tmp_path, parts):
    batch = event_files(spark, str(tmp_path / "in"), parts)
    stream = parquet_stream(spark, str(tmp_path / "in"), batch.drop("step").schema)
    closed = batch.agg(F.floor((F.unix_seconds(F.max("ts")) - 3600 - 1_704_067_200) / 86_400)).first()[0]

    drain(stream_step_metrics(stream), str(tmp_path / "m"), str(tmp_path / "mc"))
    got = {r.n for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    want = {r.n for r in metrics.class_counts(batch.filter(F.col("step") < closed), ["step"]).collect()}
    assert got == want

    counts = stream_step_counts(stream, "2024-01-01 00:00:00")
    drain(counts, str(tmp_path / "c"), str(tmp_path / "cc"))
    folded = stream_fold(parquet_stream(spark, str(tmp_path / "c"), counts.schema), start=0.5, recovery=0.1)
    drain(folded, str(tmp_path / "f"), str(tmp_path / "fc"))
    got = {(r.humanId, r.step): (r.n, round(r.fatigue, 9)) for r in spark.read.parquet(str(tmp_path / "f")).collect()}
    twin = upkeep.fold_by_step(batch, start=0.5, recovery=0.1, first_step=0).filter(F.col("step") < closed)
    assert got == {(r.humanId, r.step): (r.n, round(r.fatigue, 9)) for r in twin.collect()}


def test_fold_over_many_micro_batches(spark, tmp_path):
    rows = [(who, step, (who * 7 + step * 3) % 4) for step in range(0, 21) for who in range(5) if (who + step) % 3]
    schema = "humanId long, step long, n long"
    for lo in range(0, 21, 3):
        part = [r for r in rows if lo <= r[1] < lo + 3]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    got = {}
    for name, files in (("one", None), ("seven", 1)):
        stream = parquet_stream(spark, str(tmp_path / "c"), spark.createDataFrame([], schema).schema, max_files=files)
        drain(stream_fold(stream, start=0.5), str(tmp_path / name), str(tmp_path / f"{name}-state"))
        # A second run picks up from the checkpoint and finds nothing new.
        drain(stream_fold(stream, start=0.5), str(tmp_path / name), str(tmp_path / f"{name}-state"))
        got[name] = sorted((r.humanId, r.step, r.n, round(r.fatigue, 9)) for r in spark.read.parquet(str(tmp_path / name)).collect())
    assert got["one"] == got["seven"] and len(got["one"]) == len(rows)


def test_a_late_step_is_refused(spark, tmp_path):
    schema = "humanId long, step long, n long"
    for step in (5, 1):
        spark.createDataFrame([(1, step, 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    stream = parquet_stream(spark, str(tmp_path / "c"), spark.createDataFrame([], schema).schema, max_files=1)
    with pytest.raises(Exception, match="arrived after step 5"):
        drain(stream_fold(stream), str(tmp_path / "f"), str(tmp_path / "fc"))


EVENTS = "humanId long, sec long, reacted boolean"
DAY = 86_400
FOLDED = "humanId long, step long, n long, fatigue double, late boolean"


def write_events(spark, folder, rows):
    df = spark.createDataFrame(rows, EVENTS).select("humanId", F.timestamp_seconds(F.col("sec") + 1_704_067_200).alias("ts"), "reacted")
    df.coalesce(1).write.mode("append").parquet(folder)
    return df.schema


@pytest.mark.parametrize("parts", [1, 3])
def test_fold_of_events_equals_batch(spark, tmp_path, parts):
    batch = event_files(spark, str(tmp_path / "in"), parts)
    stream = parquet_stream(spark, str(tmp_path / "in"), batch.drop("step").schema, max_files=1)
    closed = batch.agg(F.floor((F.unix_seconds(F.max("ts")) - 3600 - 1_704_067_200) / DAY)).first()[0]
    with rocksdb_state(spark):
        drain(stream_fold_events(stream, "2024-01-01 00:00:00", start=0.5, recovery=0.1), str(tmp_path / "f"), str(tmp_path / "fc"), "late")
    got = {(r.humanId, r.step): (r.n, round(r.fatigue, 9), r.late) for r in spark.read.schema(FOLDED).parquet(str(tmp_path / "f")).collect()}
    twin = upkeep.fold_by_step(batch, start=0.5, recovery=0.1, first_step=0).filter(F.col("step") < closed)
    assert got == {(r.humanId, r.step): (r.n, round(r.fatigue, 9), False) for r in twin.collect()}


def test_late_events_go_apart_and_the_stream_runs_on(spark, tmp_path):
    """Ten micro-batches, a restart in between, late events for a closed step and for a step nobody had."""
    rnd = random.Random(4)
    days = [[(who, d * DAY + rnd.randrange(DAY), rnd.random() < 0.6) for who in range(4) for _ in range(rnd.randrange(4))] for d in range(12)]
    late = [(1, 0 * DAY + 5, True), (1, 0 * DAY + 9, True), (2, 1 * DAY, False), (77, 3 * DAY, True)]
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for d in range(5):
        schema = write_events(spark, folder, days[d])

    def run():
        stream = parquet_stream(spark, folder, schema, max_files=1)
        with rocksdb_state(spark):
            drain(stream_fold_events(stream, "2024-01-01 00:00:00", start=0.5, recovery=0.1), out, state, "late")

    run()
    write_events(spark, folder, days[5] + late)
    for d in range(6, 10):
        write_events(spark, folder, days[d])
    run()
    write_events(spark, folder, days[10] + days[11] + [(1, 2 * DAY, True)])
    run()
    rows = spark.read.schema(FOLDED).parquet(out)
    got = {(r.humanId, r.step): (r.n, round(r.fatigue, 9)) for r in rows.filter("not late").collect()}
    sound = [(w, s // DAY, re) for day in days for w, s, re in day]
    batch = spark.createDataFrame(sound, "humanId long, step long, reacted boolean")
    end = max(s for day in days for _, s, _ in day) - 3600
    twin = upkeep.fold_by_step(batch, start=0.5, recovery=0.1, first_step=0).filter((F.col("step") + 1) * DAY <= end)
    assert got == {(r.humanId, r.step): (r.n, round(r.fatigue, 9)) for r in twin.collect()} and len(got) > 20
    aside = sorted((r.humanId, r.step, r.n, r.fatigue) for r in rows.filter("late").collect())
    assert aside == [(1, 0, 2, None), (1, 2, 1, None), (2, 1, 0, None), (77, 3, 1, None)]
    assert not spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")


def test_events_are_combined_before_the_shuffle(spark):
    rows = [(0, 10 * i, i % 2 == 0) for i in range(2000)] + [(None, 5, True), (3, DAY, False)]
    df = spark.createDataFrame(rows, EVENTS).coalesce(1).select(
        "humanId", F.timestamp_seconds(F.col("sec") + 1_704_067_200).alias("ts"), "reacted")
    df = df.union(df.limit(1).select(F.lit(9).cast("long"), F.lit(None).cast("timestamp"), F.lit(True)))
    got = sorted(tuple(r) for r in combined(df, "2024-01-01 00:00:00", "humanId", "ts", DAY).na.fill(-1, ["humanId"]).collect())
    assert got == [(-1, 0, 1, 1), (0, 0, 1000, 2000), (3, 1, 0, 1)]


def test_a_step_that_runs_again_replaces_its_metrics(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = lambda *r: spark.createDataFrame(r, "timeStep long, n long")
    snap.append_metrics(rows((0, 5), (1, 6)), path, "timeStep")
    snap.append_metrics(rows((1, 7), (10, 8)), path, "timeStep")
    snap.append_metrics(rows((1, 7), (10, 8)), path, "timeStep")
    history = snap.metrics_history(spark, path)
    assert [(r.timeStep, r.n) for r in history.collect()] == [(0, 5), (1, 7), (10, 8)]
    assert dict(history.dtypes)["timeStep"] == "bigint"


def test_nested_report(spark, tmp_path):
    one = spark.createDataFrame([(2.5, None)], "f double, p double")
    pairs = spark.createDataFrame([("b", "c", 0.5), ("a", "b", None)], "g1 string, g2 string, p double")
    ex.write_nested_report({"anova": one, "pairwise": pairs, "none": pairs.limit(0), "missing": pairs.limit(0)}, str(tmp_path / "r"), ["anova", "missing"])
    (line,) = [x.value for x in spark.read.text(str(tmp_path / "r")).collect()]
    assert json.loads(line) == {
        "anova": {"f": 2.5, "p": None}, "none": [], "missing": None,
        "pairwise": [{"g1": "a", "g2": "b", "p": None}, {"g1": "b", "g2": "c", "p": 0.5}],
    }
    with pytest.raises(ValueError):
        ex.nested_report({})
