"""Queries: item scores, top items and agreement tests."""

from __future__ import annotations

from echofield.operators import bandit as op
from echofield.plans import adapters as a
from echofield.plans.registry import CTES, query, r, sql_gauss, sql_uni

CTES["arm_all"] = """
SELECT contentId, t.emotionType, CAST(count(i.eventId) AS DOUBLE) AS successes, 0.0e0 AS failures
FROM items t LEFT JOIN interactions i USING (contentId) GROUP BY 1, 2
"""
CTES["arms"] = """
SELECT contentId, t.emotionType, CAST(count(*) FILTER (reacted) AS DOUBLE) AS successes, CAST(count(*) FILTER (NOT reacted) AS DOUBLE) AS failures
FROM items t JOIN interactions i USING (contentId) GROUP BY 1, 2
"""


def arms(spark, sf_dir, failures=True):
    return op.item_engagement(a.items(spark, sf_dir), a.interactions(spark, sf_dir), failures)


@query("item_engagement", "SELECT * FROM arm_all")
def item_engagement(spark, sf_dir):
    return arms(spark, sf_dir, False)


@query("item_engagement_with_failures", "SELECT * FROM arms")
def item_engagement_with_failures(spark, sf_dir):
    return arms(spark, sf_dir)


_MEAN = "(successes + 1) / (successes + 1 + (failures + 1))"
_SD = "sqrt((successes + 1) * (failures + 1) / ((successes + failures + 2) * (successes + failures + 2) * (successes + failures + 3)))"
_NOISE = sql_gauss(42, "bandit", "contentId")


@query("bandit_scores", f"""
SELECT contentId, successes, failures, {r(f'{_MEAN} + sqrt(successes + 1 + (failures + 1)) * 0.1e0 * {_NOISE}')} AS score FROM arm_all
""")
def bandit_scores(spark, sf_dir):
    return op.bandit_scores(arms(spark, sf_dir, False)).select("contentId", "successes", "failures", "score")


@query("bandit_scores_beta", f"""
SELECT contentId, {r(f'{_MEAN} + {_SD} * {_NOISE}')} AS score FROM arms
""")
def bandit_scores_beta(spark, sf_dir):
    return op.bandit_scores(arms(spark, sf_dir), mode="beta_moments").select("contentId", "score")


def sql_beta(source: str, keys: list[str]) -> str:
    def gam(n: str, salt: str) -> str:
        d, x, u = f"({n} - 1.0e0 / 3.0e0)", sql_gauss(42, f"{salt}.n", *keys, "i"), sql_uni(42, f"{salt}.u", *keys, "i")
        root = f"(1.0e0 + x / (3.0e0 * sqrt({d})))"
        kept = (f"CASE WHEN v > 0 AND ln(1.0e0 - {u}) < x * x / 2.0e0 + {d} - {d} * v + {d} * ln(greatest(v, 1e-300)) "
                f"THEN {d} * v END")
        one = (f"list_transform([{x}], lambda x: list_transform([{root} * {root} * {root}], lambda v: {kept})[1])[1]")
        return f"list_filter(list_transform(generate_series(1, 32), lambda i: {one}), lambda y: y IS NOT NULL)[1]"
    return f"""SELECT *, ga / (ga + gb) AS draw
FROM (SELECT *, {gam('(successes + 1)', 'beta.ga')} AS ga, {gam('(failures + 1)', 'beta.gb')} AS gb FROM {source})"""


@query("beta_draws", f"SELECT contentId, {r('draw')} AS draw FROM ({sql_beta('arms', ['contentId'])})")
def beta_draws(spark, sf_dir):
    return op.beta_draws(arms(spark, sf_dir)).select("contentId", "draw")


_RANDOM = f"SELECT contentId, emotionType, {sql_uni(42, 'random.0', 'contentId')} AS score FROM items"


@query("random_scores", f"SELECT contentId, emotionType, {r('score')} AS score FROM ({_RANDOM})")
def random_scores(spark, sf_dir):
    return op.random_scores(a.items(spark, sf_dir)).select("contentId", "emotionType", "score")


CTES["scored_pairs"] = f"""
SELECT humanId, contentId, s.emotionType, s.score FROM (SELECT DISTINCT humanId, contentId FROM interactions) JOIN ({_RANDOM}) s USING (contentId)
"""


def scored(spark, sf_dir):
    pairs = a.interactions(spark, sf_dir).select("humanId", "contentId").distinct()
    return op.score_pairs(pairs, op.random_scores(a.items(spark, sf_dir)))


@query("score_pairs", f"SELECT humanId, contentId, emotionType, {r('score')} AS score FROM scored_pairs")
def score_pairs(spark, sf_dir):
    return scored(spark, sf_dir)


@query("top_k_items", f"""
SELECT humanId, contentId, emotionType, {r('score')} AS score, CAST(place AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY humanId ORDER BY score DESC, contentId) AS place FROM scored_pairs) WHERE place <= 5
""")
def top_k_items(spark, sf_dir):
    return op.top_k_items(scored(spark, sf_dir), 5)


@query("recommend_all", f"""
SELECT humanId, contentId, emotionType, {r('score')} AS score, CAST(place AS INTEGER) AS rank
FROM people, (SELECT *, row_number() OVER (ORDER BY score DESC, contentId) AS place FROM ({_RANDOM})) WHERE place <= 5
""")
def recommend_all(spark, sf_dir):
    return op.recommend_all(a.people(spark, sf_dir), op.random_scores(a.items(spark, sf_dir)), 5)


CTES["arm_trials"] = "SELECT *, unnest(generate_series(1, 20)) AS trial FROM arms"


@query("selection_agreement", f"""
WITH d AS (SELECT *, {_MEAN} + {_SD} * {sql_gauss(42, 'bandit', 'contentId', 'trial')} AS score FROM ({sql_beta('arm_trials', ['contentId', 'trial'])})),
p AS (SELECT trial, arg_max(contentId, score) AS x, arg_max(contentId, draw) AS y FROM d GROUP BY trial)
SELECT count(*) AS trials, count(*) FILTER (x = y) AS agreements, {r('count(*) FILTER (x = y) / count(*)')} AS agreement FROM p
""")
def selection_agreement(spark, sf_dir):
    return op.selection_agreement(arms(spark, sf_dir), 20, mode="beta_moments")


@query("ks_two_sample", f"""
WITH c AS (SELECT o_totalprice AS v, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b
           FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1),
n AS (SELECT sum(a) AS n1, sum(b) AS n2 FROM c),
d AS (SELECT max(abs(x)) AS d FROM (SELECT sum(a) OVER w / (SELECT n1 FROM n) - sum(b) OVER w / (SELECT n2 FROM n) AS x FROM c WINDOW w AS (ORDER BY v)))
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, {r('d')} AS statistic,
       {r("(SELECT least(1.0e0, greatest(0.0e0, sum(CASE WHEN j % 2 = 1 THEN 2.0e0 ELSE -2.0e0 END * exp(-2.0e0 * j * j * (CAST(n1 AS DOUBLE) * n2 / (n1 + n2)) * d * d)))) FROM range(1, 101) t(j))")} AS p_value
FROM n, d
""")
def ks_two_sample(spark, sf_dir):
    return op.ks_two_sample(a.table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", "F", "O")
