"""Operator inputs derived from the shared test tables, and the same tables in SQL.

events -> interactions (who touched which item on which day), people, items,
edges (who acted right after whom on an item) and states (entity by day).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofield import schemas as S
from echofield.functions.columns import ratio
from echofield.operators.edges import edges_from_sequence
from echofield.operators.sampling import draw_range, synth_entities
from echofield.plans.registry import CTES, r, sql_uni

EPOCH = "2024-01-01"
EVENT_TYPE = {"purchase": S.POSITIVE, "signup": S.POSITIVE, "error": S.NEGATIVE}
REACTING = ("click", "purchase", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def interactions_of(df: DataFrame) -> DataFrame:
    """Map events (batch or stream) to interactions."""
    kind = F.col("event_type")
    return df.select(
        F.col("event_id").alias("eventId"),
        "ts",
        F.col("user_id").alias("humanId"),
        F.get_json_object("props", "$.k").cast("long").alias("contentId"),
        F.datediff(F.to_date("ts"), F.lit(EPOCH)).cast("long").alias("step"),
        F.when(kind.isin("purchase", "signup"), S.POSITIVE)
        .when(kind == "error", S.NEGATIVE).otherwise(S.NEUTRAL).alias("emotionType"),
        F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("intensity"),
        kind.isin(*REACTING).alias("reacted"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions_of(events(spark, sf_dir))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = events(spark, sf_dir).select(F.col("user_id").alias("humanId")).distinct()
    return synth_entities(ids)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item: first step seen, most common type, keyed intensity and half-life."""
    kind = F.col("emotionType")
    seen = interactions(spark, sf_dir).groupBy("contentId").agg(
        F.min("step").alias("createdAtStep"),
        *[F.count_if(kind == t).alias(f"_{t}") for t in S.TYPES],
    )
    good, plain, bad = (F.col(f"_{t}") for t in S.TYPES)
    most = F.when((good >= plain) & (good >= bad), S.POSITIVE).when(plain >= bad, S.NEUTRAL).otherwise(S.NEGATIVE)
    seen = seen.select("contentId", most.alias("emotionType"), "createdAtStep")
    return draw_range(seen, S.ITEM_RANGES, ["contentId"])


def edges_of(acts: DataFrame) -> DataFrame:
    """Who touched an item right after whom."""
    return edges_from_sequence(acts, "contentId", "humanId", ["ts", "eventId"])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(interactions(spark, sf_dir))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity by day: intensity-weighted affect of the day's events and its class.

    A day whose events all have intensity 0 has the affect NaN, as in the SQL.
    """
    kind = F.col("emotionType")
    per_type = [
        F.when(kind == S.POSITIVE, S.TYPE_AFFECT[S.POSITIVE][i])
        .when(kind == S.NEGATIVE, S.TYPE_AFFECT[S.NEGATIVE][i]).otherwise(0.0)
        for i in (0, 1)
    ]
    day = interactions(spark, sf_dir).groupBy("humanId", "step").agg(
        F.round(ratio(F.sum(per_type[0] * F.col("intensity")), F.sum("intensity")) + 1e-9, 6).alias("valence"),
        F.round(ratio(F.sum(per_type[1] * F.col("intensity")), F.sum("intensity")) + 1e-9, 6).alias("arousal"),
        F.count(F.lit(1)).alias("n"),
    )
    mood = (
        F.when(F.col("valence") > 0.3, S.JOY).when(F.col("valence") < -0.3, S.RAGE).otherwise(S.NEUTRAL)
    )
    levels = {"attentionSpan": (0.0, 1.0), "fatigue": (0.0, 1.0)}
    return draw_range(day.withColumn("mood", mood), levels, ["humanId", "step"])


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run series: condition = event type, replicate = user mod 10, one value per day."""
    return (
        events(spark, sf_dir)
        .groupBy(
            F.col("event_type").alias("condition"),
            (F.col("user_id") % 10).cast("int").alias("replicate"),
            F.datediff(F.to_date("ts"), F.lit(EPOCH)).cast("long").alias("timeStep"),
        )
        .agg(
            F.count(F.lit(1)).alias("n"),
            (F.sum(F.round(F.col("value") * 100).cast("long")) / F.lit(100.0) / F.count(F.lit(1))).alias("value"),
        )
    )


CTES["interactions"] = """
SELECT event_id AS eventId, ts, user_id AS humanId,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS contentId,
       CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS step,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 'POSITIVE'
            WHEN event_type = 'error' THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS emotionType,
       least(value / 100.0e0, 1.0e0) AS intensity,
       event_type IN ('click', 'purchase', 'signup') AS reacted
FROM events
"""
CTES["people"] = f"""
SELECT humanId, mood,
       0.5e0 + {sql_uni(42, 'attentionSpan', 'humanId')} * 0.5e0 AS attentionSpan,
       0.3e0 + {sql_uni(42, 'addictionCoeff', 'humanId')} * (0.8e0 - 0.3e0) AS addictionCoeff,
       0.3e0 + {sql_uni(42, 'reactionProb', 'humanId')} * (0.7e0 - 0.3e0) AS reactionProb,
       0.0e0 + {sql_uni(42, 'fatigue', 'humanId')} * 0.1e0 AS fatigue,
       CASE mood WHEN 'JOY' THEN 0.7e0 WHEN 'RAGE' THEN -0.7e0 ELSE 0.0e0 END AS valence,
       CASE mood WHEN 'JOY' THEN 0.5e0 WHEN 'RAGE' THEN 0.8e0 ELSE 0.0e0 END AS arousal,
       -0.2e0 + {sql_uni(42, 'baselineValence', 'humanId')} * (0.2e0 - -0.2e0) AS baselineValence,
       -0.3e0 + {sql_uni(42, 'baselineArousal', 'humanId')} * (0.3e0 - -0.3e0) AS baselineArousal
FROM (SELECT humanId, CASE WHEN roll < 0.2e0 THEN 'JOY' WHEN roll < 0.2e0 + 0.6e0 THEN 'NEUTRAL' ELSE 'RAGE' END AS mood
      FROM (SELECT DISTINCT user_id AS humanId, {sql_uni(42, 'mood', 'user_id')} AS roll FROM events))
"""
CTES["items"] = f"""
SELECT contentId, emotionType, createdAtStep,
       0.3e0 + {sql_uni(42, 'intensity', 'contentId')} * (0.9e0 - 0.3e0) AS intensity,
       5.0e0 + {sql_uni(42, 'halfLife', 'contentId')} * (20.0e0 - 5.0e0) AS halfLife
FROM (SELECT contentId, emotionType, min(firstStep) OVER (PARTITION BY contentId) AS createdAtStep,
             row_number() OVER (PARTITION BY contentId ORDER BY n DESC, emotionType DESC) AS place
      FROM (SELECT contentId, emotionType, count(*) AS n, min(step) AS firstStep
            FROM interactions GROUP BY contentId, emotionType))
WHERE place = 1
"""
CTES["edges"] = """
SELECT source, target, CAST(n AS DOUBLE) AS weight
FROM (SELECT least(prev, humanId) AS a, greatest(prev, humanId) AS b, count(*) AS n
      FROM (SELECT humanId, lag(humanId) OVER (PARTITION BY contentId ORDER BY ts, eventId) AS prev
            FROM interactions)
      WHERE prev <> humanId GROUP BY 1, 2),
     LATERAL (VALUES (a, b), (b, a)) AS d(source, target)
"""
CTES["states"] = f"""
SELECT humanId, step, valence, arousal, n,
       CASE WHEN valence > 0.3e0 THEN 'JOY' WHEN valence < -0.3e0 THEN 'RAGE' ELSE 'NEUTRAL' END AS mood,
       {sql_uni(42, 'attentionSpan', 'humanId', 'step')} AS attentionSpan,
       {sql_uni(42, 'fatigue', 'humanId', 'step')} AS fatigue
FROM (SELECT humanId, step, count(*) AS n,
             {r("sum(CASE emotionType WHEN 'POSITIVE' THEN 0.7e0 WHEN 'NEGATIVE' THEN -0.7e0 ELSE 0.0e0 END * intensity) / sum(intensity)")} AS valence,
             {r("sum(CASE emotionType WHEN 'POSITIVE' THEN 0.5e0 WHEN 'NEGATIVE' THEN 0.8e0 ELSE 0.0e0 END * intensity) / sum(intensity)")} AS arousal
      FROM interactions GROUP BY humanId, step)
"""
CTES["run_metrics"] = """
SELECT event_type AS condition, CAST(user_id % 10 AS INTEGER) AS replicate,
       CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS timeStep,
       count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) / 100.0e0 / count(*) AS value
FROM events GROUP BY 1, 2, 3
"""
