"""Queries: sampling and drawing."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofield.operators import sampling as op
from echofield.plans import adapters as a
from echofield.plans.registry import query, r, sql_uni


@query("bernoulli_filter", f"""
SELECT eventId, humanId, contentId, {r('intensity')} AS intensity FROM interactions
WHERE {sql_uni(42, 'roll', 'eventId')} < intensity
""")
def bernoulli_filter(spark, sf_dir):
    df = op.bernoulli_filter(a.interactions(spark, sf_dir), "intensity", ["eventId"])
    return df.select("eventId", "humanId", "contentId", "intensity")


@query("sample_rows", f"""
SELECT o_orderkey, o_orderstatus, {r('o_totalprice')} AS o_totalprice FROM orders
WHERE {sql_uni(42, 'sample', 'o_orderkey')} < 0.1e0
""")
def sample_rows(spark, sf_dir):
    orders = a.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return op.sample_rows(orders, 0.1, ["o_orderkey"])


@query("sample_keys", f"""
SELECT user_id FROM (SELECT DISTINCT user_id FROM events)
ORDER BY {sql_uni(42, 'keys', 'user_id')}, user_id LIMIT 20
""")
def sample_keys(spark, sf_dir):
    return op.sample_keys(a.events(spark, sf_dir), "user_id", 20)


@query("draw_category", f"""
SELECT c_custkey, CASE WHEN roll < 0.5e0 THEN 'a' WHEN roll < 0.5e0 + 0.3e0 THEN 'b' ELSE 'c' END AS grp
FROM (SELECT c_custkey, {sql_uni(42, 'category', 'c_custkey')} AS roll FROM customer)
""")
def draw_category(spark, sf_dir):
    df = a.table(spark, sf_dir, "customer").select("c_custkey")
    return op.draw_category(df, "grp", {"a": 0.5, "b": 0.3, "c": 0.2}, ["c_custkey"])


@query("draw_range", f"""
SELECT c_custkey, {r("-1.0e0 + " + sql_uni(42, 'x', 'c_custkey') + " * 2.0e0")} AS x,
       {r("5.0e0 + " + sql_uni(42, 'y', 'c_custkey') + " * 15.0e0")} AS y
FROM customer
""")
def draw_range(spark, sf_dir):
    df = a.table(spark, sf_dir, "customer").select("c_custkey")
    return op.draw_range(df, {"x": (-1.0, 1.0), "y": (5.0, 20.0)}, ["c_custkey"])


_PEOPLE = ("attentionSpan", "addictionCoeff", "reactionProb", "fatigue", "valence", "arousal",
           "baselineValence", "baselineArousal")


@query("synth_entities", f"""
SELECT humanId, mood, {', '.join(f'{r(c)} AS {c}' for c in _PEOPLE)} FROM people
""")
def synth_entities(spark, sf_dir):
    return a.people(spark, sf_dir)


@query("synth_items", f"""
SELECT contentId, CASE WHEN roll < 0.33e0 THEN 'POSITIVE' WHEN roll < 0.33e0 + 0.33e0 THEN 'NEUTRAL' ELSE 'NEGATIVE' END AS emotionType,
       {r("0.3e0 + " + sql_uni(42, 'intensity', 'contentId') + " * (0.9e0 - 0.3e0)")} AS intensity,
       {r("5.0e0 + " + sql_uni(42, 'halfLife', 'contentId') + " * 15.0e0")} AS halfLife,
       CAST(0 AS BIGINT) AS createdAtStep
FROM (SELECT p_partkey AS contentId, {sql_uni(42, 'type', 'p_partkey')} AS roll FROM part)
""")
def synth_items(spark, sf_dir):
    return op.synth_items(a.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("contentId")))


@query("prior_draws", f"""
SELECT event_id AS draw,
       {r("0.01e0 + " + sql_uni(42, 'emotionRegressionRate', 'event_id') + " * (0.2e0 - 0.01e0)")} AS emotionRegressionRate,
       {r("0.05e0 + " + sql_uni(42, 'contentInfluenceWeight', 'event_id') + " * (0.5e0 - 0.05e0)")} AS contentInfluenceWeight
FROM events
""")
def prior_draws(spark, sf_dir):
    ids = a.events(spark, sf_dir).select(F.col("event_id").alias("draw"))
    return op.prior_draws(
        ids, {"emotionRegressionRate": (0.01, 0.20), "contentInfluenceWeight": (0.05, 0.50)}
    )
