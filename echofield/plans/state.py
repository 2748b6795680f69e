"""Queries: reactions, class changes, affect, attention and fatigue."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofield.operators import affect, graph, transitions, upkeep
from echofield.plans import adapters as a
from echofield.plans import exposure as ex
from echofield.plans.registry import CTES, query, r, sql_uni
from echofield.session import scratch_path
from echofield.sources import bucketed

# One entity-day as an entity of its own, so that one update covers the whole table.
def _day():
    return F.concat_ws(":", "humanId", "step").alias("stateId")


def day_states(spark, sf_dir):
    return a.states(spark, sf_dir).select(_day(), "*")


def day_interactions(spark, sf_dir):
    return transitions.emotion_delta(a.interactions(spark, sf_dir)).select(_day(), "*")


_DELTA = """CASE WHEN reacted THEN CASE emotionType WHEN 'POSITIVE' THEN 0.1e0 WHEN 'NEGATIVE' THEN -0.15e0 ELSE 0.0e0 END
     ELSE CASE emotionType WHEN 'POSITIVE' THEN 0.02e0 WHEN 'NEGATIVE' THEN -0.03e0 ELSE 0.0e0 END END"""
CTES["deltas"] = f"SELECT *, {_DELTA} AS emotionDelta, concat_ws(':', humanId, step) AS stateId FROM interactions"
CTES["totals"] = """
SELECT stateId, CAST(sum(CAST(emotionDelta AS DECIMAL(18, 6))) AS DOUBLE) AS totalEmotionDelta FROM deltas GROUP BY stateId
"""
CTES["day_states"] = "SELECT *, concat_ws(':', humanId, step) AS stateId FROM states"
CTES["pressure"] = """
SELECT (count(*) FILTER (mood = 'JOY') / count(*)) * 1.0e0 * 0.1e0 AS joy,
       (count(*) FILTER (mood = 'RAGE') / count(*)) * 1.2e0 * 0.1e0 AS rage FROM states
"""


@query("attach_item_affect", f"""
SELECT eventId, i.humanId, contentId, i.reacted, {r('t.intensity')} AS intensity,
       CASE t.emotionType WHEN 'POSITIVE' THEN 0.7e0 WHEN 'NEGATIVE' THEN -0.7e0 ELSE 0.0e0 END AS contentValence,
       CASE t.emotionType WHEN 'POSITIVE' THEN 0.5e0 WHEN 'NEGATIVE' THEN 0.8e0 ELSE 0.0e0 END AS contentArousal
FROM interactions i JOIN items t USING (contentId)
""")
def attach_item_affect(spark, sf_dir):
    return affect.attach_item_affect(a.interactions(spark, sf_dir), a.items(spark, sf_dir)).select(
        "eventId", "humanId", "contentId", "reacted", "intensity", "contentValence", "contentArousal"
    )


_P = "attentionSpan * intensity * 0.5e0"


@query("label_reactions", f"""
SELECT humanId, contentId, {r(_P)} AS reactionProb,
       {sql_uni(42, f'react.{ex.NOW}', 'humanId', 'contentId')} < {_P} AS reacted FROM network_exposed
""")
def label_reactions(spark, sf_dir):
    return transitions.label_reactions(ex.exposures(spark, sf_dir), step=ex.NOW).select(
        "humanId", "contentId", "reactionProb", "reacted"
    )


_P2 = "i.intensity * p.attentionSpan * 0.5e0 * (p.reactionProb * (1.0e0 - p.fatigue))"


@query("label_reactions_by_person", f"""
SELECT humanId, eventId AS contentId, {r(_P2)} AS reactionProb,
       {sql_uni(42, 'react.0', 'humanId', 'eventId')} < p.attentionSpan * i.intensity * 0.5e0 * p.reactionProb * (1.0e0 - p.fatigue) AS reacted
FROM interactions i JOIN people p USING (humanId)
""")
def label_reactions_by_person(spark, sf_dir):
    shown = a.interactions(spark, sf_dir).select("humanId", F.col("eventId").alias("contentId"), "intensity")
    traits = a.people(spark, sf_dir).select("humanId", "attentionSpan", "reactionProb", "fatigue")
    return transitions.label_reactions(shown.join(traits, "humanId"), mode="person").select(
        "humanId", "contentId", "reactionProb", "reacted"
    )


@query("emotion_delta", f"SELECT eventId, emotionType, reacted, {r('emotionDelta')} AS emotionDelta FROM deltas")
def emotion_delta(spark, sf_dir):
    return day_interactions(spark, sf_dir).select("eventId", "emotionType", "reacted", "emotionDelta")


@query("signal_totals", f"SELECT stateId, {r('totalEmotionDelta')} AS totalEmotionDelta FROM totals")
def signal_totals(spark, sf_dir):
    return transitions.signal_totals(day_interactions(spark, sf_dir), "stateId")


@query("class_pressure", f"SELECT {r('joy')} AS joyPressure, {r('rage')} AS ragePressure FROM pressure")
def class_pressure(spark, sf_dir):
    return transitions.class_pressure(a.states(spark, sf_dir), 1.0, 1.2)


@query("class_transition", f"""
SELECT stateId, humanId, step, CASE mood
  WHEN 'NEUTRAL' THEN CASE WHEN roll < rage THEN 'RAGE' WHEN roll < rage + joy THEN 'JOY'
                           WHEN delta > 0.2e0 THEN 'JOY' WHEN delta < -0.2e0 THEN 'RAGE' ELSE 'NEUTRAL' END
  WHEN 'JOY' THEN CASE WHEN roll < rage * 0.5e0 OR delta < -0.3e0 THEN 'NEUTRAL' ELSE 'JOY' END
  ELSE CASE WHEN roll < joy * 0.3e0 OR delta > 0.4e0 THEN 'NEUTRAL' ELSE 'RAGE' END END AS mood
FROM (SELECT s.*, coalesce(totalEmotionDelta, 0.0e0) AS delta, {sql_uni(42, 'class.0', 'stateId')} AS roll, joy, rage
      FROM day_states s LEFT JOIN totals USING (stateId), pressure)
""")
def class_transition(spark, sf_dir):
    state = day_states(spark, sf_dir)
    totals = transitions.signal_totals(day_interactions(spark, sf_dir), "stateId")
    pressure = transitions.class_pressure(state, 1.0, 1.2)
    return transitions.class_transition(state, totals, pressure, key="stateId").select(
        "stateId", "humanId", "step", "mood"
    )


@query("class_transition_by_pressure", f"""
SELECT humanId, CASE mood WHEN 'NEUTRAL' THEN CASE WHEN roll < rage THEN 'RAGE' WHEN roll < rage + joy THEN 'JOY' ELSE 'NEUTRAL' END
  WHEN 'JOY' THEN CASE WHEN roll < rage * 0.5e0 THEN 'NEUTRAL' ELSE 'JOY' END
  ELSE CASE WHEN roll < joy * 0.3e0 THEN 'NEUTRAL' ELSE 'RAGE' END END AS mood
FROM (SELECT humanId, mood, {sql_uni(42, 'class.0', 'humanId')} AS roll FROM people),
     (SELECT count(*) FILTER (mood = 'JOY') / count(*) * 0.1e0 AS joy, count(*) FILTER (mood = 'RAGE') / count(*) * 0.1e0 AS rage FROM people)
""")
def class_transition_by_pressure(spark, sf_dir):
    state = a.people(spark, sf_dir)
    return transitions.class_transition(state, None, transitions.class_pressure(state)).select("humanId", "mood")


CTES["content_affect"] = """
SELECT humanId, sum(v * intensity) / sum(intensity) AS content_valence, sum(w * intensity) / sum(intensity) AS content_arousal,
       sum(intensity) AS total_intensity
FROM (SELECT i.humanId, t.intensity,
             CASE t.emotionType WHEN 'POSITIVE' THEN 0.7e0 WHEN 'NEGATIVE' THEN -0.7e0 ELSE 0.0e0 END AS v,
             CASE t.emotionType WHEN 'POSITIVE' THEN 0.5e0 WHEN 'NEGATIVE' THEN 0.8e0 ELSE 0.0e0 END AS w
      FROM interactions i JOIN items t USING (contentId)) GROUP BY humanId
"""


def content_affect(spark, sf_dir):
    return affect.weighted_affect(
        affect.attach_item_affect(a.interactions(spark, sf_dir), a.items(spark, sf_dir))
    )


@query("weighted_affect", f"""
SELECT humanId, {r('content_valence')} AS content_valence, {r('content_arousal')} AS content_arousal,
       {r('total_intensity')} AS total_intensity FROM content_affect
""")
def weighted_affect(spark, sf_dir):
    return content_affect(spark, sf_dir)


_FRESH = {
    part: f"greatest(least({part} * {keep} + coalesce(content_{part}, 0.0e0) * 0.15e0 + coalesce(neighbor_{part}, 0.0e0) * 0.1e0"
          f" + baseline{part.capitalize()} * 0.05e0, 1.0e0), -1.0e0)"
    for part, keep in (("valence", "0.7e0"), ("arousal", "(0.7e0 * 0.9e0)"))
}


@query("affect_update", f"""
SELECT humanId, {r('v')} AS valence, {r('w')} AS arousal,
       CASE WHEN v > 0.3e0 THEN 'JOY' WHEN v < -0.3e0 THEN 'RAGE' ELSE 'NEUTRAL' END AS mood
FROM (SELECT humanId, {_FRESH['valence']} AS v, {_FRESH['arousal']} AS w
      FROM people LEFT JOIN neighbor_affect USING (humanId) LEFT JOIN content_affect USING (humanId))
""")
def affect_update(spark, sf_dir):
    state = a.people(spark, sf_dir)
    near = graph.neighbor_mean(a.edges(spark, sf_dir), state)
    return affect.affect_update(state, near, content_affect(spark, sf_dir)).select(
        "humanId", "valence", "arousal", "mood"
    )


@query("affect_class", f"""
SELECT humanId, step, CASE WHEN valence > 0.5e0 THEN 'JOY' WHEN valence < -0.5e0 THEN 'RAGE' ELSE 'NEUTRAL' END AS label FROM states
""")
def affect_class(spark, sf_dir):
    return affect.affect_class(a.states(spark, sf_dir), 0.5, "label").select("humanId", "step", "label")


@query("class_affect", """
SELECT humanId, step, mood, CASE mood WHEN 'JOY' THEN 0.7e0 WHEN 'RAGE' THEN -0.7e0 ELSE 0.0e0 END AS valence,
       CASE mood WHEN 'JOY' THEN 0.5e0 WHEN 'RAGE' THEN 0.8e0 ELSE 0.0e0 END AS arousal FROM states
""")
def class_affect(spark, sf_dir):
    return affect.class_affect(a.states(spark, sf_dir).select("humanId", "step", "mood"))


@query("map_codes", """
SELECT emotionType, CASE emotionType WHEN 'POSITIVE' THEN 'JOY' WHEN 'NEGATIVE' THEN 'RAGE' ELSE 'NEUTRAL' END AS mood,
       CAST(count(*) AS BIGINT) AS n FROM interactions GROUP BY 1, 2
""")
def map_codes(spark, sf_dir):
    from echofield.schemas import CLASS_OF_TYPE

    mapping = spark.createDataFrame(list(CLASS_OF_TYPE.items()), "code string, label string")
    mapped = affect.map_codes(a.interactions(spark, sf_dir), "emotionType", mapping, "mood")
    return mapped.groupBy("emotionType", "mood").agg(F.count(F.lit(1)).alias("n"))


CTES["edge_distance"] = """
SELECT e.source, e.target, sqrt((x.valence - y.valence) * (x.valence - y.valence) + (x.arousal - y.arousal) * (x.arousal - y.arousal)) AS distance
FROM edges e JOIN people x ON x.humanId = e.source JOIN people y ON y.humanId = e.target
"""


@query("edge_affect_distance", f"SELECT source, target, {r('distance')} AS distance FROM edge_distance")
def edge_affect_distance(spark, sf_dir):
    return affect.edge_affect_distance(a.edges(spark, sf_dir), a.people(spark, sf_dir)).select(
        "source", "target", "distance"
    )


@query("mean_affect_distance", f"""
SELECT source AS humanId, {r('avg(distance)')} AS mean_distance FROM edge_distance GROUP BY source
""")
def mean_affect_distance(spark, sf_dir):
    return affect.mean_affect_distance(a.edges(spark, sf_dir), a.people(spark, sf_dir))


@query("fill_missing_steps", f"""
SELECT humanId, pos AS step, pos = step AS recorded,
       {r('CASE WHEN pos = step THEN valence ELSE valence * (1 - alpha) + v * alpha END')} AS valence,
       {r('CASE WHEN pos = step THEN arousal ELSE arousal * (1 - alpha) + w * alpha END')} AS arousal
FROM (SELECT *, (pos - step) / (s - step) AS alpha
      FROM (SELECT *, unnest(generate_series(step, coalesce(s - 1, step))) AS pos
            FROM (SELECT humanId, step, valence, arousal, lead(step) OVER w1 AS s, lead(valence) OVER w1 AS v, lead(arousal) OVER w1 AS w
                  FROM states WINDOW w1 AS (PARTITION BY humanId ORDER BY step))))
""")
def fill_missing_steps(spark, sf_dir):
    return affect.fill_missing_steps(a.states(spark, sf_dir))


def _sql_decay(x: str, judged: str) -> str:
    return f"least(1.0e0, greatest(0.0e0, {x} * (1.0e0 - 0.05e0) + CASE WHEN {judged} < 0.5e0 THEN 0.02e0 ELSE 0.0e0 END))"


for _when, _judged in (("before", "attentionSpan"), ("after", "attentionSpan * (1.0e0 - 0.05e0)")):

    def _decay(spark, sf_dir, when=_when):
        return upkeep.decay_recover(a.states(spark, sf_dir), recover_on=when).select("humanId", "step", "attentionSpan")

    query(
        "decay_recover" if _when == "before" else "decay_recover_after",
        f"SELECT humanId, step, {r(_sql_decay('attentionSpan', _judged))} AS attentionSpan FROM states",
    )(_decay)


@query("fatigue_update", f"""
SELECT stateId, {r('least(1.0e0, greatest(0.0e0, fatigue + n * 0.02e0 - CASE WHEN n = 0 THEN 0.01e0 ELSE 0.0e0 END))')} AS fatigue
FROM (SELECT stateId, s.fatigue, coalesce(c.n, 0) AS n
      FROM day_states s LEFT JOIN (SELECT stateId, count(*) AS n FROM deltas WHERE reacted GROUP BY 1) c USING (stateId))
""")
def fatigue_update(spark, sf_dir):
    return upkeep.fatigue_update(
        day_states(spark, sf_dir), day_interactions(spark, sf_dir), key="stateId"
    ).select("stateId", "fatigue")


@query("fatigue_update_bucketed", f"""
SELECT humanId, {r('least(1.0e0, greatest(0.0e0, fatigue + n * 0.02e0 - CASE WHEN n = 0 THEN 0.01e0 ELSE 0.0e0 END))')} AS fatigue
FROM (SELECT s.humanId, s.fatigue, coalesce(c.n, 0) AS n
      FROM (SELECT * FROM states WHERE step = 12) s
      LEFT JOIN (SELECT humanId, count(*) AS n FROM interactions WHERE reacted AND step = 12 GROUP BY 1) c USING (humanId))
""")
def fatigue_update_bucketed(spark, sf_dir):
    """Step 12 of states and interactions, both stored in buckets by entity: the join moves no rows."""
    tables = {"state": a.states(spark, sf_dir), "acts": a.interactions(spark, sf_dir).drop("ts")}
    names = {}
    for what, df in tables.items():
        path = scratch_path(spark, what)
        names[what] = path.rsplit("/", 1)[1].replace("-", "_")
        bucketed.write_bucketed(df, names[what], path, buckets=8)
    state, acts = (bucketed.read_step(spark, names[what], 12) for what in ("state", "acts"))
    return upkeep.fatigue_update(state, acts).select("humanId", "fatigue")


@query("fatigue_by_propensity", f"""
SELECT humanId, {r(f"least(1.0e0, greatest(0.0e0, fatigue + CASE WHEN {sql_uni(42, 'fatigue.0', 'humanId')} < addictionCoeff THEN 0.02e0 ELSE -0.01e0 END))")} AS fatigue
FROM people
""")
def fatigue_by_propensity(spark, sf_dir):
    return upkeep.fatigue_by_propensity(a.people(spark, sf_dir)).select("humanId", "fatigue")


_GRID = """
grid AS (SELECT humanId, t.step, coalesce(n, 0) AS n, rows IS NOT NULL AS seen
         FROM (SELECT DISTINCT humanId FROM interactions) CROSS JOIN
              (SELECT unnest(generate_series((SELECT min(step) FROM interactions), (SELECT max(step) FROM interactions))) AS step) t
         LEFT JOIN (SELECT humanId, step, count(*) FILTER (reacted) AS n, count(*) AS rows FROM interactions GROUP BY 1, 2) c
           USING (humanId, step))"""


@query("fold_fatigue", f"""
WITH {_GRID},
fold(humanId, step, n, seen, x) AS (
  SELECT humanId, step, n, seen, greatest(0.0e0, least(1.0e0, 0.3e0 + n * 0.02e0 - CASE WHEN n = 0 THEN 0.05e0 ELSE 0.0e0 END))
  FROM grid WHERE step = (SELECT min(step) FROM interactions)
  UNION ALL
  SELECT g.humanId, g.step, g.n, g.seen, greatest(0.0e0, least(1.0e0, f.x + g.n * 0.02e0 - CASE WHEN g.n = 0 THEN 0.05e0 ELSE 0.0e0 END))
  FROM fold f JOIN grid g ON g.humanId = f.humanId AND g.step = f.step + 1)
SELECT humanId, step, n, {r('x')} AS fatigue FROM fold WHERE seen
""")
def fold_fatigue(spark, sf_dir):
    return upkeep.fold_by_step(a.interactions(spark, sf_dir), start=0.3, recovery=0.05, block=8)


@query("fold_attention", f"""
WITH {_GRID},
fold(step, x) AS (
  SELECT (SELECT min(step) FROM interactions), {_sql_decay('0.9e0', '0.9e0')}
  UNION ALL
  SELECT step + 1, {_sql_decay('x', 'x')} FROM fold WHERE step < (SELECT max(step) FROM interactions))
SELECT humanId, step, n, {r('x')} AS attentionSpan FROM grid JOIN fold USING (step) WHERE seen
""")
def fold_attention(spark, sf_dir):
    return upkeep.fold_by_step(a.interactions(spark, sf_dir), rule="attention", start=0.9)
