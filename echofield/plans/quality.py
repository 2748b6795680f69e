"""Queries: data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofield.operators import quality as op
from echofield.operators.affect import affect_class
from echofield.plans import adapters as a
from echofield.plans.registry import CTES, query, r


@query("check_ranges", """
SELECT 'valence' AS "column", true AS present, count(*) FILTER (NOT valence BETWEEN -0.5 AND 0.5) AS violations FROM states
UNION ALL SELECT 'fatigue', true, count(*) FILTER (NOT fatigue BETWEEN 0 AND 0.9e0) FROM states
UNION ALL SELECT 'baselineValence', false, CAST(NULL AS BIGINT)
""")
def check_ranges(spark, sf_dir):
    bounds = {"valence": (-0.5, 0.5), "fatigue": (0.0, 0.9), "baselineValence": (-1.0, 1.0)}
    return op.check_ranges(a.states(spark, sf_dir), bounds)


@query("check_domain", """
SELECT event_type AS "value", count(*) AS "count" FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1
""")
def check_domain(spark, sf_dir):
    return op.check_domain(a.events(spark, sf_dir), "event_type", ["click", "view", "purchase"])


@query("check_class_consistency", f"""
SELECT humanId, step, {r('valence')} AS valence, mood, expected
FROM (SELECT humanId, step, valence, arousal, CASE WHEN valence > 0.5e0 THEN 'JOY' WHEN valence < -0.5e0 THEN 'RAGE' ELSE 'NEUTRAL' END AS mood,
             CASE WHEN valence > 0.3e0 THEN 'JOY' WHEN valence < -0.3e0 THEN 'RAGE' ELSE 'NEUTRAL' END AS expected FROM states)
WHERE mood <> expected AND NOT abs(abs(valence) - 0.3e0) < 0.1e0 AND NOT abs(abs(arousal) - 0.3e0) < 0.1e0
""")
def check_class_consistency(spark, sf_dir):
    stored = affect_class(a.states(spark, sf_dir), 0.5)  # classes stored under another cut
    return op.check_class_consistency(stored).select("humanId", "step", "valence", "mood", "expected")


def params(spark, sf_dir):
    """Parameter rows made from events, some of them out of range."""
    return a.events(spark, sf_dir).select(
        "event_id",
        (F.col("event_id") + 50).cast("int").alias("populationSize"),
        F.get_json_object("props", "$.k").cast("int").alias("networkK"),
        (F.col("value") / 400.0).alias("networkP"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("contentHalfLife"),
    )


CTES["param_rows"] = """
SELECT event_id, CAST(event_id + 50 AS INTEGER) AS populationSize, CAST(json_extract_string(props, '$.k') AS INTEGER) AS networkK,
       value / 400.0e0 AS networkP, CASE WHEN event_type <> 'error' THEN value END AS contentHalfLife FROM events
"""


@query("check_params", """
SELECT event_id, concat_ws(';', CASE WHEN populationSize < 100 THEN 'populationSize: below 100' END,
  CASE WHEN populationSize > 1000000 THEN 'populationSize: above 1000000' END,
  CASE WHEN contentHalfLife IS NULL THEN 'contentHalfLife: missing' END,
  CASE WHEN contentHalfLife < 1 THEN 'contentHalfLife: below 1.0' END, CASE WHEN contentHalfLife > 100 THEN 'contentHalfLife: above 100.0' END,
  CASE WHEN networkK < 2 THEN 'networkK: below 2' END, CASE WHEN networkK > 20 THEN 'networkK: above 20' END,
  CASE WHEN networkK % 2 <> 0 THEN 'networkK: odd' END,
  CASE WHEN networkP > 1 THEN 'networkP: above 1.0' END) AS failed FROM param_rows
""")
def check_params(spark, sf_dir):
    return op.check_params(params(spark, sf_dir)).select(
        "event_id", F.array_join("failed_rules", ";").alias("failed")
    )
