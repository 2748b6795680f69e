"""Queries: metrics per table and per step."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofield.functions.ranking import gini as gini_of
from echofield.functions.ranking import merge_sketches, quantile_sketches, quantiles_from
from echofield.operators import metrics as op
from echofield.operators.sampling import sample_keys
from echofield.plans import adapters as a
from echofield.plans.registry import CTES, query, r, sql_uni

_COUNTS = """count(*) FILTER (mood = 'JOY') AS joyCount, count(*) FILTER (mood = 'NEUTRAL') AS neutralCount,
       count(*) FILTER (mood = 'RAGE') AS rageCount"""
CTES["class_counts"] = f"SELECT step, count(*) AS n, {_COUNTS} FROM states GROUP BY step"


def _metric(name: str, fn, column: str, sql: str) -> None:
    @query(name, f"SELECT step, {r(sql)} AS {column} FROM class_counts")
    def run(spark, sf_dir):
        return fn(a.states(spark, sf_dir), ["step"])


_ENTROPY = " ".join(
    f"- CASE WHEN {c} > 0 THEN ({c} / n) * log2({c} / n) ELSE 0.0e0 END" for c in ("joyCount", "neutralCount", "rageCount")
)
_metric("polarization", op.polarization, "polarizationIndex", "abs(rageCount - joyCount) / n")
_metric("extremism", op.extremism, "extremismRate", "(rageCount + joyCount) / n")
_metric("fragmentation", op.fragmentation, "fragmentationIndex", "1.0e0 - neutralCount / n")
_metric("class_entropy", op.class_entropy, "moodEntropy", _ENTROPY)
_metric("dominance", op.dominance, "emotionDominanceRatio", "greatest(joyCount, neutralCount, rageCount) / n")


@query("class_distribution", """
SELECT step, joyCount AS JOY, neutralCount AS "NEUTRAL", rageCount AS RAGE,
       joyCount AS map_joy, neutralCount AS map_neutral, rageCount AS map_rage FROM class_counts
""")
def class_distribution(spark, sf_dir):
    df = op.class_distribution(a.states(spark, sf_dir), ["step"])
    return df.select("step", "JOY", "NEUTRAL", "RAGE", *[
        F.element_at("moodDistribution", c).alias(f"map_{c.lower()}") for c in ("JOY", "NEUTRAL", "RAGE")
    ])


_ACTS = """count(*) AS totalInteractions, count(*) FILTER (emotionType = 'POSITIVE') AS positiveInteractions,
       count(*) FILTER (emotionType = 'NEGATIVE') AS negativeInteractions"""


@query("interaction_counts", f"SELECT {_ACTS} FROM interactions")
def interaction_counts(spark, sf_dir):
    return op.interaction_counts(a.interactions(spark, sf_dir))


@query("avg_engagement", f"""
SELECT {r('(SELECT count(*) FROM interactions) / count(*)')} AS avgEngagement FROM people
""")
def avg_engagement(spark, sf_dir):
    return op.avg_engagement(a.people(spark, sf_dir), a.interactions(spark, sf_dir))


def _customers(spark, sf_dir):
    return a.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("humanId"))


def _orders(spark, sf_dir):
    return a.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("humanId"))


CTES["engaged"] = """
SELECT c_custkey AS humanId, count(o_orderkey) AS engagement FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
"""


@query("engagement_per_entity", "SELECT humanId, engagement FROM engaged")
def engagement_per_entity(spark, sf_dir):
    return op.engagement_per_entity(_customers(spark, sf_dir), _orders(spark, sf_dir))


def sql_gini(source: str, value: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""
SELECT {head}count(*) AS n, CASE WHEN sum({value}) <> 0 THEN sum((2 * i - n0 - 1) * CAST({value} AS DOUBLE)) / (count(*) * CAST(sum({value}) AS DOUBLE)) ELSE 0.0e0 END AS gini
FROM (SELECT *, row_number() OVER ({part}ORDER BY {value}) AS i, count(*) OVER ({part.strip()}) AS n0 FROM {source}){tail}"""


@query("engagement_gini", f"SELECT n, {r('gini')} AS gini FROM ({sql_gini('engaged', 'engagement')})")
def engagement_gini(spark, sf_dir):
    return op.engagement_gini(_customers(spark, sf_dir), _orders(spark, sf_dir))


@query("gini", f"SELECT o_orderpriority, n, {r('gini')} AS gini FROM ({sql_gini('orders', 'o_totalprice', 'o_orderpriority')})")
def gini(spark, sf_dir):
    orders = a.table(spark, sf_dir, "orders")
    return gini_of(orders, "o_totalprice", ["o_orderpriority"])


@query("level_means", f"""
SELECT step, {r('avg(attentionSpan)')} AS averageAttention, {r('avg(fatigue)')} AS averageFatigue FROM states GROUP BY step
""")
def level_means(spark, sf_dir):
    return op.level_means(a.states(spark, sf_dir), ["step"])


def sql_rank(source: str, value: str, q: str, by: str) -> str:
    return f"""SELECT {by}, max(CASE WHEN i = least(CAST(floor(n0 * {q}) AS BIGINT), n0 - 1) THEN {value} END) AS value
FROM (SELECT {by}, {value}, row_number() OVER (PARTITION BY {by} ORDER BY {value}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n0 FROM {source})
GROUP BY {by}"""


@query("rank_percentile", f"SELECT l_returnflag, {r('value')} AS value FROM ({sql_rank('lineitem', 'l_extendedprice', '0.95e0', 'l_returnflag')})")
def rank_percentile(spark, sf_dir):
    lineitem = a.table(spark, sf_dir, "lineitem")
    return op.rank_percentile(lineitem, "l_extendedprice", 0.95, ["l_returnflag"])


_Q3 = (0.05, 0.5, 0.95)


def _sql_quantiles(by: str) -> str:
    cols = ", ".join(r(f"quantile_cont(value, {p!r}e0)") + f" AS q{i}" for i, p in enumerate(_Q3))
    return f"SELECT {by}, count(*) AS n, {cols} FROM events GROUP BY {by}"


@query("quantiles_from_sketches", _sql_quantiles("event_type"))
def quantiles_from_sketches(spark, sf_dir):
    """Sketches per day and type, merged per type, bracket the exact quantiles."""
    df = a.events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    per_day = quantile_sketches(df, "value", ["event_type", "day"])
    return quantiles_from(df, "value", _Q3, merge_sketches(per_day, ["event_type"]), ["event_type"])


@query("collapsed_count", "SELECT step, count(*) FILTER (fatigue >= 0.95e0) AS collapsedCount FROM states GROUP BY step")
def collapsed_count(spark, sf_dir):
    return op.collapsed_count(a.states(spark, sf_dir), by=["step"])


_SUMMARY = f"""count(*) AS totalHumans, {_COUNTS}, {r('avg(attentionSpan)')} AS averageAttention,
       {r('avg(fatigue)')} AS averageFatigue, count(*) FILTER (fatigue >= 0.95e0) AS collapsedCount"""


@query("population_summary", f"SELECT {_SUMMARY} FROM states")
def population_summary(spark, sf_dir):
    return op.population_summary(a.states(spark, sf_dir))


CTES["day_engagement"] = """
SELECT s.step, s.humanId, coalesce(e.n, 0) AS engagement
FROM states s LEFT JOIN (SELECT step, humanId, count(*) AS n FROM interactions GROUP BY 1, 2) e ON e.step = s.step AND e.humanId = s.humanId
"""


@query("step_metrics", f"""
WITH acts AS (SELECT step, {_ACTS} FROM interactions GROUP BY step),
levels AS (SELECT step, avg(attentionSpan) AS att, avg(fatigue) AS fat, count(*) FILTER (fatigue >= 0.95e0) AS collapsedCount FROM states GROUP BY step),
eg AS ({sql_gini('day_engagement', 'engagement', 'step')}),
ag AS ({sql_gini('states', 'attentionSpan', 'step')}),
p95 AS ({sql_rank('states', 'fatigue', '0.95e0', 'step')})
SELECT c.step AS timeStep, joyCount, neutralCount, rageCount, {r('att')} AS averageAttention, {r('fat')} AS averageFatigue, collapsedCount,
       totalInteractions, positiveInteractions, negativeInteractions, {r('eg.gini')} AS engagementGini, {r('p95.value')} AS fatigueP95,
       {r('ag.gini')} AS attentionGini, {r('totalInteractions / c.n')} AS avgEngagement, {r('abs(rageCount - joyCount) / c.n')} AS polarizationIndex,
       {r('(rageCount + joyCount) / c.n')} AS extremismRate, {r('1.0e0 - neutralCount / c.n')} AS fragmentationIndex,
       {r(_ENTROPY.replace('/ n', '/ c.n'))} AS moodEntropy, {r('greatest(joyCount, neutralCount, rageCount) / c.n')} AS emotionDominanceRatio
FROM class_counts c JOIN acts USING (step) JOIN levels USING (step) JOIN eg USING (step) JOIN ag USING (step) JOIN p95 USING (step)
""")
def step_metrics(spark, sf_dir):
    return op.step_metrics(a.states(spark, sf_dir), a.interactions(spark, sf_dir))


@query("affect_by_step", f"""
SELECT step, {r('avg(valence)')} AS mean_valence, {r('stddev_samp(valence)')} AS std_valence, {r('avg(arousal)')} AS mean_arousal,
       {r('stddev_samp(arousal)')} AS std_arousal, {r("count(*) FILTER (mood = 'JOY') / count(*)")} AS joy_fraction,
       {r("count(*) FILTER (mood = 'NEUTRAL') / count(*)")} AS neutral_fraction, {r("count(*) FILTER (mood = 'RAGE') / count(*)")} AS rage_fraction
FROM states GROUP BY step
""")
def affect_by_step(spark, sf_dir):
    return op.affect_by_step(a.states(spark, sf_dir))


@query("affect_grid", f"""
SELECT CAST(least(floor((valence - -1.0e0) / {2.0 / 20!r}), 19) AS INTEGER) AS valence_bin,
       CAST(least(floor((arousal - -1.0e0) / {2.0 / 20!r}), 19) AS INTEGER) AS arousal_bin, count(*) AS "count"
FROM states WHERE valence BETWEEN -1 AND 1 AND arousal BETWEEN -1 AND 1 GROUP BY 1, 2
""")
def affect_grid(spark, sf_dir):
    return op.affect_grid(a.states(spark, sf_dir), bins=20)


CTES["updated_affect"] = """
SELECT humanId, step, valence, arousal - 0.3e0 AS arousal FROM states
"""
_Q = {"pos_pos": "valence > 0 AND arousal > 0", "neg_pos": "valence < 0 AND arousal > 0",
      "neg_neg": "valence < 0 AND arousal < 0", "pos_neg": "valence > 0 AND arousal < 0"}


@query("quadrant_counts", f"""
SELECT count(*) AS n, {', '.join(f'count(*) FILTER ({c}) AS {q}' for q, c in _Q.items())},
       {', '.join(f"{r(f'count(*) FILTER ({c}) / count(*)')} AS {q}_share" for q, c in _Q.items())} FROM updated_affect
""")
def quadrant_counts(spark, sf_dir):
    # Item affect has no negative arousal; a shift fills all four quadrants.
    return op.quadrant_counts(a.states(spark, sf_dir).withColumn("arousal", F.col("arousal") - 0.3))


@query("trajectories", f"""
SELECT humanId, step, {r('valence')} AS valence, {r('arousal')} AS arousal,
       CAST(row_number() OVER w AS INTEGER) AS position, lag(step) OVER w IS NULL AS is_start, lead(step) OVER w IS NULL AS is_end
FROM states WHERE humanId IN (SELECT humanId FROM (SELECT DISTINCT humanId FROM states) ORDER BY {sql_uni(42, 'keys', 'humanId')}, humanId LIMIT 10)
WINDOW w AS (PARTITION BY humanId ORDER BY step)
""")
def trajectories(spark, sf_dir):
    states = a.states(spark, sf_dir)
    return op.trajectories(states, sample_keys(states, "humanId", 10))


@query("affect_snapshot_stats", f"""
SELECT step, count(*) AS n, {r('avg(valence)')} AS mean_valence, {r('avg(arousal)')} AS mean_arousal,
       count(*) FILTER (mood = 'JOY') AS joy, count(*) FILTER (mood = 'NEUTRAL') AS neutral, count(*) FILTER (mood = 'RAGE') AS rage
FROM states GROUP BY step
""")
def affect_snapshot_stats(spark, sf_dir):
    df = op.affect_snapshot_stats(a.states(spark, sf_dir), ["step"])
    return df.select("step", "n", "mean_valence", "mean_arousal", *[
        F.element_at("mood_counts", c).alias(c.lower()) for c in ("JOY", "NEUTRAL", "RAGE")
    ])


@query("spread_convergence", f"""
WITH s AS (SELECT step, stddev_samp(valence) AS v, stddev_samp(arousal) AS w FROM states GROUP BY step)
SELECT {r('v0')} AS valence_first, {r('v1')} AS valence_last, {r('(v0 - v1) / v0')} AS valence_reduction,
       {r('w0')} AS arousal_first, {r('w1')} AS arousal_last, {r('(w0 - w1) / w0')} AS arousal_reduction
FROM (SELECT arg_min(v, step) AS v0, arg_max(v, step) AS v1, arg_min(w, step) AS w0, arg_max(w, step) AS w1 FROM s)
""")
def spread_convergence(spark, sf_dir):
    return op.spread_convergence(a.states(spark, sf_dir))


@query("transition_matrix", f"""
WITH m AS (SELECT lag(mood) OVER (PARTITION BY humanId ORDER BY step) AS f, mood AS t FROM states)
SELECT f.c AS from_class, t.c AS to_class, count(m.t) AS n,
       {r('coalesce(count(m.t) / nullif((SELECT count(*) FROM m x WHERE x.f = f.c), 0), 0)')} AS share
FROM (VALUES ('JOY'), ('NEUTRAL'), ('RAGE')) f(c)
CROSS JOIN (VALUES ('JOY'), ('NEUTRAL'), ('RAGE')) t(c) LEFT JOIN m ON m.f = f.c AND m.t = t.c
GROUP BY f.c, t.c
""")
def transition_matrix(spark, sf_dir):
    return op.transition_matrix(a.states(spark, sf_dir))


@query("distinct_counts", """
SELECT count(*) AS "rows", count(DISTINCT condition) AS distinct_condition, count(DISTINCT replicate) AS distinct_replicate FROM run_metrics
""")
def distinct_counts(spark, sf_dir):
    return op.distinct_counts(a.run_metrics(spark, sf_dir), ["condition", "replicate"])


def _describe(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS "count", {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, {r(f'min({c})', 4)} AS "min",
       {r(f'quantile_cont({c}, 0.25e0)', 4)} AS p25, {r(f'quantile_cont({c}, 0.5e0)', 4)} AS p50, {r(f'quantile_cont({c}, 0.75e0)', 4)} AS p75, {r(f'max({c})', 4)} AS "max" FROM lineitem"""


@query("describe_table", _describe("l_quantity") + " UNION ALL " + _describe("l_extendedprice"), digits=4)
def describe_table(spark, sf_dir):
    return op.describe_table(a.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
