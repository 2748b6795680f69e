"""Queries: the two streaming operators over the events table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofield import schemas as S
from echofield.plans import adapters as a
from echofield.plans.registry import query, r
from echofield.plans.state import _GRID
from echofield.session import scratch_path
from echofield.streaming.events import stream_fold_events
from echofield.streaming.fold import stream_fold, stream_step_counts
from echofield.streaming.metrics import stream_step_metrics
from echofield.streaming.run import drain, drained, parquet_stream, rocksdb_state


def interaction_stream(spark, sf_dir):
    schema = a.events(spark, sf_dir).schema
    stream = parquet_stream(spark, sf_dir, schema, "events.parquet")
    return a.interactions_of(stream).withColumn("ts", F.col("ts").cast("timestamp"))


# A bucket is written once the watermark (latest event minus the delay) has passed its end.
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("stream_step_metrics", f"""
SELECT step, n, joyCount, neutralCount, rageCount, {r('abs(rageCount - joyCount) / n')} AS polarizationIndex,
       {r('(rageCount + joyCount) / n')} AS extremismRate, {r('1 - neutralCount / n')} AS fragmentationIndex
FROM (SELECT step, count(*) AS n, count(*) FILTER (emotionType = 'POSITIVE') AS joyCount, count(*) FILTER (emotionType = 'NEUTRAL') AS neutralCount,
             count(*) FILTER (emotionType = 'NEGATIVE') AS rageCount FROM interactions GROUP BY step)
WHERE TIMESTAMP '2024-01-01' + to_days(CAST(step + 1 AS INTEGER)) <= {_CLOSED}
""")
def stream_metrics(spark, sf_dir):
    kind = F.col("emotionType")
    label = F.when(kind == S.POSITIVE, S.JOY).when(kind == S.NEGATIVE, S.RAGE).otherwise(S.NEUTRAL)
    stream = interaction_stream(spark, sf_dir).withColumn("mood", label)
    out = drained(spark, stream_step_metrics(stream), "stream-metrics")
    step = F.datediff(F.to_date("bucket_start"), F.lit(a.EPOCH)).cast("long").alias("step")
    return out.select(step, *[c for c in out.columns if not c.startswith("bucket")])


_FOLDED = f"""
WITH {_GRID},
fold(humanId, step, n, seen, x) AS (
  SELECT humanId, step, n, seen, greatest(0.0e0, least(1.0e0, 0.3e0 + n * 0.02e0 - CASE WHEN n = 0 THEN 0.05e0 ELSE 0.0e0 END)) FROM grid WHERE step = 0
  UNION ALL
  SELECT g.humanId, g.step, g.n, g.seen, greatest(0.0e0, least(1.0e0, f.x + g.n * 0.02e0 - CASE WHEN g.n = 0 THEN 0.05e0 ELSE 0.0e0 END))
  FROM fold f JOIN grid g ON g.humanId = f.humanId AND g.step = f.step + 1)
SELECT humanId, step, n, {r('x')} AS fatigue FROM fold
WHERE seen AND TIMESTAMP '2024-01-01' + to_days(CAST(step + 1 AS INTEGER)) <= {_CLOSED}
"""


@query("stream_fold", _FOLDED)
def stream_fatigue(spark, sf_dir):
    base = scratch_path(spark, "stream-counts")
    counts = stream_step_counts(interaction_stream(spark, sf_dir), f"{a.EPOCH} 00:00:00")
    drain(counts, f"{base}/out", f"{base}/checkpoint")
    folded = stream_fold(parquet_stream(spark, f"{base}/out", counts.schema), start=0.3, recovery=0.05)
    return drained(spark, folded, "stream-fold")


@query("stream_fold_events", _FOLDED)
def stream_fatigue_events(spark, sf_dir):
    """The same rows from the events themselves; in one drain none of them is late."""
    folded = stream_fold_events(
        interaction_stream(spark, sf_dir), f"{a.EPOCH} 00:00:00", start=0.3, recovery=0.05
    )
    with rocksdb_state(spark):
        out = drained(spark, folded, "stream-fold-events", apart="late")
    return out.filter(~F.col("late")).drop("late")
