"""Queries: exposure candidates and probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofield.operators import exposure as op
from echofield.operators import graph
from echofield.plans import adapters as a
from echofield.plans.graph import sql_poisson
from echofield.plans.registry import CTES, query, r, sql_uni

NOW = 20


def visible_items(spark, sf_dir):
    return op.visibility(a.items(spark, sf_dir), NOW)


def inputs(spark, sf_dir):
    """People, visible items and neighbour candidates, each built once."""
    acts, people, items = a.interactions(spark, sf_dir), a.people(spark, sf_dir), visible_items(spark, sf_dir)
    activity = graph.neighbor_activity(a.edges_of(acts), acts)
    return people, items, op.neighbor_candidates(people, activity, items)


CTES["visible"] = """
SELECT *, CASE WHEN 20 < createdAtStep THEN 0.0e0
               ELSE pow(2.0e0, -CAST(20 - createdAtStep AS DOUBLE) / halfLife) END AS visibility
FROM items
"""
CTES["item_index"] = """
SELECT *, row_number() OVER (ORDER BY substr(md5(CAST(contentId AS VARCHAR)), 1, 3), contentId) - 1 AS idx,
       count(*) OVER () AS n, max(visibility) OVER () AS top
FROM visible
"""


@query("visibility", f"""
SELECT contentId, emotionType, createdAtStep, {r('visibility')} AS visibility FROM visible WHERE visibility >= 0.25e0
""")
def visibility(spark, sf_dir):
    return op.visibility(a.items(spark, sf_dir), NOW, 0.25).select(
        "contentId", "emotionType", "createdAtStep", "visibility"
    )


@query("pair_scores", f"""
SELECT humanId, contentId, {r('p.attentionSpan * p.addictionCoeff * v.visibility * 0.1e0')} AS exposureProb
FROM (SELECT DISTINCT humanId, contentId FROM interactions) JOIN people p USING (humanId) JOIN visible v USING (contentId)
""")
def pair_scores(spark, sf_dir):
    pairs = a.interactions(spark, sf_dir).select("humanId", "contentId").distinct()
    return op.pair_scores(pairs, a.people(spark, sf_dir), visible_items(spark, sf_dir)).select(
        "humanId", "contentId", "exposureProb"
    )


CTES["exposure_draws"] = sql_poisson(
    "(SELECT humanId, attentionSpan * addictionCoeff * 0.1e0 AS own, attentionSpan, mood, n, top, "
    "-ln(1.0e0 - least(attentionSpan * addictionCoeff * 0.1e0 * top, 1.0e0 - 1e-12)) AS rate "
    "FROM people, (SELECT DISTINCT n, top FROM item_index))",
    "rate * n", "exposure.count", ["humanId"],
)


@query("sampled_exposures", f"""
SELECT DISTINCT d.humanId, i.contentId, i.emotionType, {r('i.intensity')} AS intensity, d.mood AS currentMood,
       {r('d.attentionSpan')} AS attentionSpan, {r('d.own * i.visibility')} AS exposureProb
FROM exposure_draws d JOIN item_index i
  ON i.idx = CAST(floor({sql_uni(42, 'exposure.item', 'humanId', 'draw')} * d.n) AS BIGINT)
WHERE {sql_uni(42, 'exposure.thin', 'humanId', 'draw')} * d.rate < -ln(1.0e0 - least(d.own * i.visibility, 1.0e0 - 1e-12))
""")
def sampled_exposures(spark, sf_dir):
    return op.sampled_exposures(a.people(spark, sf_dir), visible_items(spark, sf_dir))


CTES["candidates"] = """
SELECT humanId, p.attentionSpan, p.addictionCoeff, p.mood, contentId, v.visibility, v.emotionType, v.intensity,
       c.neighbor_count
FROM activity c JOIN people p USING (humanId) JOIN visible v USING (contentId)
"""
_CAND = f"""humanId, {r('attentionSpan')} AS attentionSpan, {r('addictionCoeff')} AS addictionCoeff, mood, contentId,
       {r('visibility')} AS visibility, emotionType, {r('intensity')} AS intensity, neighbor_count"""


@query("neighbor_candidates", f"SELECT {_CAND} FROM candidates")
def neighbor_candidates(spark, sf_dir):
    return inputs(spark, sf_dir)[2]


def _sql_pairs(p: str, salt: str) -> str:
    draws = sql_poisson(
        f"(SELECT humanId, n FROM people, (SELECT DISTINCT n FROM item_index))",
        f"-ln(1.0e0 - {p}) * n", salt + ".count", ["humanId"],
    )
    return f"""
SELECT humanId, p.attentionSpan, p.addictionCoeff, p.mood, contentId, i.visibility, i.emotionType, i.intensity,
       CAST(0 AS BIGINT) AS neighbor_count
FROM (SELECT DISTINCT humanId, CAST(floor({sql_uni(42, salt + '.item', 'humanId', 'draw')} * n) AS BIGINT) AS idx
      FROM ({draws}))
JOIN item_index i USING (idx) JOIN people p USING (humanId)
"""


CTES["explored"] = _sql_pairs("0.005e0", "explore")
CTES["cold"] = _sql_pairs("0.1e0", "cold")
CTES["mixed"] = """
SELECT humanId, contentId, max(neighbor_count) AS neighbor_count, any_value(attentionSpan) AS attentionSpan,
       any_value(addictionCoeff) AS addictionCoeff, any_value(mood) AS mood, any_value(visibility) AS visibility,
       any_value(emotionType) AS emotionType, any_value(intensity) AS intensity
FROM (SELECT * FROM candidates UNION ALL SELECT * FROM explored) GROUP BY humanId, contentId
"""


@query("explore_mix", f"SELECT {_CAND} FROM mixed")
def explore_mix(spark, sf_dir):
    people, items, near = inputs(spark, sf_dir)
    return op.explore_mix(near, people, items)


@query("cold_start", f"SELECT {_CAND} FROM cold")
def cold_start(spark, sf_dir):
    return op.cold_start(a.people(spark, sf_dir), visible_items(spark, sf_dir))


@query("social_proof", f"""
SELECT humanId, contentId, neighbor_count, {r('1.0e0 - pow(0.5e0, neighbor_count)')} AS social_proof FROM activity
""")
def social_proof(spark, sf_dir):
    acts = a.interactions(spark, sf_dir)
    return op.social_proof(graph.neighbor_activity(a.edges_of(acts), acts))


CTES["item_scores"] = """
SELECT contentId, count(*) FILTER (reacted) / count(*) AS score FROM interactions GROUP BY contentId
"""


def item_scores(spark, sf_dir):
    """Share of interactions with the item that were reactions."""
    return a.interactions(spark, sf_dir).groupBy("contentId").agg(
        (F.count_if("reacted") / F.count(F.lit(1))).alias("score")
    )


_TRAITS = "attentionSpan * addictionCoeff * visibility"
CTES["blended"] = f"""
SELECT humanId, contentId, attentionSpan, mood, emotionType, intensity, 1.0e0 - pow(0.5e0, neighbor_count) AS proof,
       coalesce(score, 0.0e0) AS recommender_score,
       {_TRAITS} * ((1.0e0 - pow(0.5e0, neighbor_count)) * 0.5e0 + coalesce(score, 0.0e0) * 0.5e0) AS exposureProb
FROM mixed LEFT JOIN item_scores USING (contentId)
"""


@query("blend_scores", f"""
SELECT humanId, contentId, {r('proof')} AS social_proof, {r('recommender_score')} AS recommender_score,
       {r('exposureProb')} AS exposureProb FROM blended
""")
def blend_scores(spark, sf_dir):
    return op.blend_scores(explore_mix(spark, sf_dir), item_scores(spark, sf_dir)).select(
        "humanId", "contentId", "social_proof", "recommender_score", "exposureProb"
    )


@query("blend_without_scores", f"""
SELECT humanId, contentId, {r(_TRAITS + ' * greatest(1.0e0 - pow(0.5e0, neighbor_count), 0.05e0)')} AS exposureProb FROM cold
""")
def blend_without_scores(spark, sf_dir):
    return op.blend_scores(cold_start(spark, sf_dir), floor=0.05).select(
        "humanId", "contentId", "exposureProb"
    )


CTES["network_exposed"] = f"""
SELECT humanId, contentId, emotionType, intensity, mood AS currentMood, attentionSpan FROM blended
WHERE {sql_uni(42, f'expose.{NOW}', 'humanId', 'contentId')} < exposureProb
"""


def exposures(spark, sf_dir):
    scored = op.blend_scores(explore_mix(spark, sf_dir), item_scores(spark, sf_dir))
    return op.expose(scored, step=NOW)


@query("network_exposures", f"""
SELECT humanId, contentId, emotionType, {r('intensity')} AS intensity, currentMood, {r('attentionSpan')} AS attentionSpan
FROM network_exposed
""")
def network_exposures(spark, sf_dir):
    return exposures(spark, sf_dir)
