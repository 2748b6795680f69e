"""Queries: tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofield import schemas as S
from echofield.operators.metrics import step_metrics
from echofield.plans import adapters as a
from echofield.plans.registry import CTES, query, r
from echofield.session import scratch_path
from echofield.sources import experiments as ex
from echofield.sources import snapshots as snap

_STATE = f"humanId, step, {r('valence')} AS valence, {r('arousal')} AS arousal, mood"


def _states(spark, sf_dir):
    return a.states(spark, sf_dir).select("humanId", "step", "valence", "arousal", "mood")


@query("write_snapshot", f"SELECT {_STATE} FROM states")
def write_snapshot(spark, sf_dir):
    path = scratch_path(spark, "snapshots")
    snap.write_snapshot(_states(spark, sf_dir), path)
    # Writing a step again replaces that step only.
    snap.write_snapshot(_states(spark, sf_dir).filter("step = 3"), path)
    return snap.read_partitioned(spark, path)


@query("read_snapshot", f"SELECT {_STATE} FROM states WHERE step = 15")
def read_snapshot(spark, sf_dir):
    path = scratch_path(spark, "snapshots")
    snap.write_snapshot(_states(spark, sf_dir), path)
    return snap.read_snapshot(spark, path, 15)


@query("read_snapshots", f"SELECT {_STATE} FROM states")
def read_snapshots(spark, sf_dir):
    path = scratch_path(spark, "steps")
    snap.write_snapshot(_states(spark, sf_dir), path)
    return snap.read_snapshots(spark, f"{path}/step=*", pattern=snap.STEP_FOLDER)


CTES["class_rows"] = """
SELECT step AS timeStep, count(*) FILTER (mood = 'JOY') AS joyCount, count(*) FILTER (mood = 'RAGE') AS rageCount FROM states GROUP BY step
"""


@query("append_metrics", "SELECT * FROM class_rows ORDER BY timeStep")
def append_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    counts = a.states(spark, sf_dir).groupBy(F.col("step").alias("timeStep")).agg(
        F.count_if(F.col("mood") == S.JOY).alias("joyCount"), F.count_if(F.col("mood") == S.RAGE).alias("rageCount")
    )
    snap.append_metrics(counts.filter("timeStep >= 10"), path)
    snap.append_metrics(counts.filter("timeStep < 10"), path)
    return snap.metrics_history(spark, path)


@query("append_metrics_again", "SELECT * FROM class_rows ORDER BY timeStep")
def append_metrics_again(spark, sf_dir):
    """All steps are appended, then the last ten once more, as by a job that failed and ran again."""
    path = scratch_path(spark, "metrics")
    counts = a.states(spark, sf_dir).groupBy(F.col("step").alias("timeStep")).agg(
        F.count_if(F.col("mood") == S.JOY).alias("joyCount"), F.count_if(F.col("mood") == S.RAGE).alias("rageCount")
    )
    snap.append_metrics(counts.withColumn("joyCount", F.lit(-1).cast("long")).filter("timeStep >= 20"), path, "timeStep")
    snap.append_metrics(counts, path, "timeStep")
    return snap.metrics_history(spark, path)


@query("metrics_history", "SELECT timeStep, joyCount, rageCount FROM class_rows ORDER BY timeStep")
def metrics_history(spark, sf_dir):
    from echofield.operators.metrics import as_metrics_row

    path = scratch_path(spark, "metrics")
    rows = step_metrics(a.states(spark, sf_dir), a.interactions(spark, sf_dir))
    snap.append_metrics(as_metrics_row(rows), path)
    return snap.metrics_history(spark, path).select(
        "timeStep", F.element_at("moodDistribution", S.JOY).alias("joyCount"),
        F.element_at("moodDistribution", S.RAGE).alias("rageCount"),
    )


@query("read_or_default", f"SELECT {_STATE} FROM states WHERE mood = 'JOY' UNION ALL SELECT {_STATE} FROM states WHERE mood = 'RAGE'")
def read_or_default(spark, sf_dir):
    path = scratch_path(spark, "optional")
    df = _states(spark, sf_dir)
    df.filter(F.col("mood") == S.JOY).write.parquet(f"{path}/there")
    found = snap.read_or_default(spark, f"{path}/there", df.schema)
    instead = snap.read_or_default(spark, f"{path}/missing", df.schema, df.filter(F.col("mood") == S.RAGE))
    empty = snap.read_or_default(spark, f"{path}/missing", df.schema)
    return found.unionByName(instead).unionByName(empty)


def _experiment(spark, sf_dir, latest):
    root = scratch_path(spark, "experiment")
    metrics = a.run_metrics(spark, sf_dir)
    ex.write_run(metrics, root, "run_2024_01")
    ex.write_run(metrics.withColumn("extra", F.col("n") * 2), root, "run_2024_02")
    return ex.read_experiment(spark, root, latest).select(
        "run", "condition", F.col("replicate").cast("int").alias("replicate"), "timeStep", "n", "extra"
    )


_RUNS = "SELECT '{run}' AS run, condition, replicate, timeStep, n, {extra} AS extra FROM run_metrics"
_FIRST = _RUNS.format(run="run_2024_01", extra="CAST(NULL AS BIGINT)")
_SECOND = _RUNS.format(run="run_2024_02", extra="n * 2")


@query("read_experiment", f"{_FIRST} UNION ALL {_SECOND}")
def read_experiment(spark, sf_dir):
    return _experiment(spark, sf_dir, False)


@query("read_experiment_latest", _SECOND)
def read_experiment_latest(spark, sf_dir):
    return _experiment(spark, sf_dir, True)


@query("params_from_json", f"""
SELECT event_id, CAST(42 AS BIGINT) AS seed, CAST(event_id + 100 AS INTEGER) AS populationSize, CAST(json_extract_string(props, '$.k') AS INTEGER) AS networkK,
       {r("CASE WHEN event_type = 'error' THEN 0.05e0 ELSE value END")} AS networkP, 10.0e0 AS contentHalfLife, 'NONE' AS recommenderType, false AS useContinuousEmotions, 0.2e0 AS joyShare
FROM events
""")
def params_from_json(spark, sf_dir):
    text = F.to_json(F.struct(
        (F.col("event_id") + 100).alias("populationSize"),
        F.get_json_object("props", "$.k").cast("int").alias("networkK"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("networkP"),
        F.lit("ignored").alias("unknownKey"),
    ))
    rows = a.events(spark, sf_dir).select("event_id", text.alias("params"))
    return ex.params_from_json(rows, "params").select(
        "event_id", "seed", "populationSize", "networkK", "networkP", "contentHalfLife", "recommenderType",
        "useContinuousEmotions", F.col("initialMoodDistribution")[0].alias("joyShare"),
    )


def _report(fmt):
    sql = f"SELECT event_type, count(*) AS n, {r('sum(CAST(round(value * 100) AS BIGINT)) / 100.0e0')} AS total FROM events GROUP BY 1"

    @query(f"write_report_{fmt}", sql)
    def run(spark, sf_dir):
        path = scratch_path(spark, "report")
        rows = a.events(spark, sf_dir).groupBy("event_type").agg(
            F.count(F.lit(1)).alias("n"),
            (F.sum(F.round(F.col("value") * 100).cast("long")) / F.lit(100.0)).alias("total"),
        )
        if fmt == "csv":
            ex.write_report(rows, path, "csv")
            return spark.read.schema("event_type string, n long, total double").option("header", "true").csv(path)
        ex.write_report(rows.select("event_type", F.struct("n", "total").alias("stats")), path, "json")
        back = spark.read.schema("event_type string, stats struct<n:long,total:double>").json(path)
        return back.select("event_type", "stats.n", "stats.total")


_report("csv")
_report("json")


@query("nested_report", f"""
WITH days AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT (SELECT count(*) FROM events) AS n_events, (SELECT CAST(avg(value) * 100 AS BIGINT) FROM events) AS mean_cents,
       event_type, n, days FROM (SELECT event_type, CAST(sum(n) AS BIGINT) AS n, count(*) AS days FROM days GROUP BY 1)
""")
def nested_report(spark, sf_dir):
    """Totals and types written as one JSON object and read back."""
    df = a.events(spark, sf_dir)
    overall = df.agg(F.count(F.lit(1)).alias("n_events"), F.avg("value").alias("mean"))
    types = df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_date("ts")).alias("days"))
    path = scratch_path(spark, "nested-report")
    ex.write_nested_report({"overall": overall, "types": types}, path, ["overall"])
    schema = "overall struct<n_events:long,mean:double>, types array<struct<event_type:string,n:long,days:long>>"
    back = spark.read.schema(schema).json(path)
    return back.select("overall", F.explode("types").alias("t")).select(
        "overall.n_events", F.round(F.col("overall.mean") * 100).cast("long").alias("mean_cents"), "t.*")


@query("registry_lookup", """
SELECT o_orderkey AS id, o_orderpriority AS name, o_orderstatus AS status, o_orderdate AS createdAt FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '%urg%' ORDER BY createdAt DESC
""")
def registry_lookup(spark, sf_dir):
    runs = a.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("createdAt"),
    )
    return ex.registry_lookup(runs, "F", "urg")
