"""Queries: edge tables and graph statistics."""

from __future__ import annotations


from pyspark.sql import functions as F

from echofield.functions.columns import total
from echofield.operators import edges as make
from echofield.operators import graph as op
from echofield.operators import settled
from echofield.operators.shared import edges_from_shared as edges_from_items
from echofield.plans import adapters as a
from echofield.plans.registry import CTES, query, r, sql_uni


def nodes(spark, sf_dir):
    return a.events(spark, sf_dir).select(F.col("user_id").alias("id")).distinct()


CTES["nodes"] = "SELECT id, count(*) OVER () AS n FROM (SELECT DISTINCT user_id AS id FROM events)"


def sql_poisson(source: str, mean: str, salt: str, keys: list[str], seed: int = 42) -> str:
    """SQL text for ``functions.columns.poisson_draws``."""
    partials, factorial = "1.0e0", 1.0
    hits = []
    for i in range(18):
        if i:
            factorial *= i
            partials = f"{partials} + pow(mu, {float(i)!r}) / {factorial!r}"
        hits.append(f"CASE WHEN u >= exp(-mu) * ({partials}) THEN 1 ELSE 0 END")
    u = sql_uni(seed, salt, *keys, "cell")
    return f"""
      SELECT * EXCLUDE (mean, cells, cell, u, mu, k, i), concat_ws('.', cell, i) AS draw
      FROM (SELECT *, unnest(generate_series(1, k)) AS i
            FROM (SELECT *, {' + '.join(hits)} AS k
                  FROM (SELECT *, {u} AS u, mean / cells AS mu
                        FROM (SELECT *, unnest(generate_series(1, cells)) AS cell
                              FROM (SELECT *, CAST(ceil(mean) AS BIGINT) AS cells
                                    FROM (SELECT *, {mean} AS mean FROM {source}) WHERE mean > 0))))
            WHERE k > 0)
    """


_BOTH = "LATERAL (VALUES (a, b), (b, a)) AS d(source, target)"

@query("random_edges", f"""
SELECT source, target, 1.0e0 AS weight
FROM (SELECT DISTINCT id AS a, id + 1 + CAST(floor({sql_uni(42, 'random.target', 'id', 'draw')} * above) AS BIGINT) AS b
      FROM ({sql_poisson('(SELECT id, n, n - 1 - id AS above FROM nodes)', '-ln(1.0e0 - 6.0e0 / (n - 1)) * above', 'random.count', ['id'])})),
     {_BOTH}
""")
def random_edges(spark, sf_dir):
    return make.random_edges(nodes(spark, sf_dir), 6.0, dense=True)


CTES["lattice"] = """
SELECT DISTINCT least(id, (id + j) % n) AS a, greatest(id, (id + j) % n) AS b
FROM nodes, (VALUES (1), (2), (3)) AS t(j)
"""


@query("ring_lattice_edges", f"SELECT source, target, 1.0e0 AS weight FROM lattice, {_BOTH}")
def ring_lattice_edges(spark, sf_dir):
    return make.ring_lattice_edges(nodes(spark, sf_dir), 6, dense=True)


CTES["rewired"] = f"""
SELECT u, v, min(roll) AS roll, arg_min(a, t) AS a, arg_min(b, t) AS b
FROM (SELECT a AS u, b AS v, roll, t, least(a, x) AS a, greatest(a, x) AS b
      FROM (SELECT *, CAST(floor({sql_uni(42, 'rewire.target', 'a', 'b', 't')} * (SELECT count(*) FROM nodes)) AS BIGINT) AS x
            FROM (SELECT a, b, roll, unnest(generate_series(1, 100)) AS t
                  FROM (SELECT a, b, {sql_uni(42, 'rewire', 'a', 'b')} AS roll FROM lattice) WHERE roll < 0.2e0))
      WHERE x <> a) c
WHERE NOT EXISTS (SELECT 1 FROM lattice l WHERE l.a = c.a AND l.b = c.b)
GROUP BY u, v
"""


@query("rewire_edges", f"""
WITH won AS (SELECT u, v, a, b FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY roll, u, v) AS place FROM rewired) WHERE place = 1),
kept AS (SELECT a, b FROM lattice WHERE NOT EXISTS (SELECT 1 FROM won WHERE won.u = lattice.a AND won.v = lattice.b))
SELECT source, target, 1.0e0 AS weight FROM (SELECT a, b FROM kept UNION ALL SELECT a, b FROM won), {_BOTH}
""")
def rewire_edges(spark, sf_dir):
    ids = nodes(spark, sf_dir)
    lattice = make.ring_lattice_edges(ids, 6, dense=True)
    return make.rewire_edges(lattice, 0.2, total(ids, F.count(F.lit(1))))


_PICK = "CAST(floor({u} * ((6 + (CAST(floor(({e} - 6) / 3.0e0) AS BIGINT)) * 3) * 2)) AS BIGINT)"


def _pick(e: str) -> str:
    return _PICK.format(u=sql_uni(42, "attach", e), e=e)


def sql_preferential(nodes: str) -> str:
    """SQL of ``preferential_edges`` with m = 3 over (id): a node's first three different ends among its draws."""
    again = _PICK.format(u=sql_uni(42, "attach.again", "e", "i"), e="e")
    return f"""
grown AS (SELECT id AS b, 6 + (id - 4) * 3 AS e, i FROM {nodes}, range(0, 64) AS t(i) WHERE id > 3),
walk(b, i, slot) AS (
  SELECT b, i, CASE WHEN i < 3 THEN {_pick('(e + i)')} ELSE {again} END FROM grown
  UNION ALL
  SELECT b, i, {_pick('(slot // 2)')} FROM walk WHERE slot >= 12 AND slot % 2 = 1),
ends AS (SELECT CASE WHEN slot < 12 THEN slot // 3 ELSE (slot // 2 - 6) // 3 + 4 END AS a, b, i
         FROM walk WHERE slot < 12 OR slot % 2 = 0),
pairs AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY b ORDER BY min(i)) AS place FROM ends GROUP BY a, b) WHERE place <= 3
          UNION ALL SELECT x.id, y.id FROM {nodes} x, {nodes} y WHERE x.id <= 3 AND y.id <= 3 AND x.id < y.id)"""


@query("preferential_edges", f"WITH {sql_preferential('nodes')} SELECT source, target, 1.0e0 AS weight FROM pairs, {_BOTH}")
def preferential_edges(spark, sf_dir):
    return make.preferential_edges(nodes(spark, sf_dir), 3, dense=True)


# Customers have ids from 1 on: numbered inside the operators and mapped back.
CTES["shoppers"] = """
SELECT c_custkey AS name, count(*) OVER () AS n,
       row_number() OVER (ORDER BY substr(md5(CAST(c_custkey AS VARCHAR)), 1, 3), c_custkey) - 1 AS id FROM customer
"""
_NAMES = "JOIN shoppers x ON x.id = source JOIN shoppers y ON y.id = target"


def shoppers(spark, sf_dir):
    return a.table(spark, sf_dir, "customer").select("c_custkey")


@query("ring_lattice_edges_any_ids", f"""
SELECT x.name AS source, y.name AS target, 1.0e0 AS weight
FROM (SELECT DISTINCT least(id, (id + j) % n) AS a, greatest(id, (id + j) % n) AS b FROM shoppers, (VALUES (1), (2)) AS t(j)), {_BOTH} {_NAMES}
""")
def ring_lattice_edges_any_ids(spark, sf_dir):
    return make.ring_lattice_edges(shoppers(spark, sf_dir), 4, "c_custkey")


@query("random_edges_any_ids", f"""
SELECT x.name AS source, y.name AS target, 1.0e0 AS weight
FROM (SELECT DISTINCT id AS a, id + 1 + CAST(floor({sql_uni(42, 'random.target', 'id', 'draw')} * above) AS BIGINT) AS b
      FROM ({sql_poisson('(SELECT id, n, n - 1 - id AS above FROM shoppers)', '-ln(1.0e0 - 4.0e0 / (n - 1)) * above', 'random.count', ['id'])})),
     {_BOTH} {_NAMES}
""")
def random_edges_any_ids(spark, sf_dir):
    return make.random_edges(shoppers(spark, sf_dir), 4.0, "c_custkey")


@query("preferential_edges_any_ids", f"""
WITH {sql_preferential('shoppers')} SELECT x.name AS source, y.name AS target, 1.0e0 AS weight FROM pairs, {_BOTH} {_NAMES}
""")
def preferential_edges_any_ids(spark, sf_dir):
    return make.preferential_edges(shoppers(spark, sf_dir), 3, "c_custkey")


@query("symmetrize", f"""
SELECT source, target, {r('w')} AS weight
FROM (SELECT least(humanId, contentId) AS a, greatest(humanId, contentId) AS b, max(intensity) AS w
      FROM interactions WHERE humanId <> contentId GROUP BY 1, 2), {_BOTH}
""")
def symmetrize(spark, sf_dir):
    df = a.interactions(spark, sf_dir)
    return make.symmetrize(df.select(
        F.col("humanId").alias("source"), F.col("contentId").alias("target"), F.col("intensity").alias("weight")
    ))


@query("edges_from_sequence", "SELECT source, target, weight FROM edges")
def edges_from_sequence(spark, sf_dir):
    return a.edges(spark, sf_dir)


@query("graph_counts", f"""
SELECT (SELECT count(DISTINCT x) FROM (SELECT source AS x FROM edges UNION ALL SELECT target FROM edges)) AS num_nodes,
       count(*) AS num_edges,
       {r('count(*) / (SELECT count(DISTINCT x) FROM (SELECT source AS x FROM edges UNION ALL SELECT target FROM edges))')} AS average_degree
FROM edges
""")
def graph_counts(spark, sf_dir):
    return op.graph_counts(a.edges(spark, sf_dir))


CTES["degree_table"] = "SELECT source, count(target) AS degree FROM edges GROUP BY source"


@query("degrees", "SELECT source, degree FROM degree_table")
def degrees(spark, sf_dir):
    return op.degrees(a.edges(spark, sf_dir))


@query("degree_stats", f"""
SELECT max(degree) AS max_degree, min(degree) AS min_degree, {r('stddev_samp(degree)')} AS std_degree FROM degree_table
""")
def degree_stats(spark, sf_dir):
    return op.degree_stats(a.edges(spark, sf_dir))


@query("degree_histogram", 'SELECT degree, count(*) AS "count" FROM degree_table GROUP BY degree ORDER BY degree')
def degree_histogram(spark, sf_dir):
    return op.degree_histogram(a.edges(spark, sf_dir))


@query("power_law_exponent", f"""
SELECT count(*) AS points, {r('CASE WHEN count(*) >= 2 THEN -regr_slope(ln(n), ln(degree)) END')} AS exponent
FROM (SELECT degree, count(*) AS n FROM degree_table WHERE degree > 1 GROUP BY degree)
""")
def power_law_exponent(spark, sf_dir):
    return op.power_law_exponent(a.edges(spark, sf_dir))


CTES["closed"] = """
SELECT x.source AS node, count(*) // 2 AS triangles
FROM edges x JOIN edges y ON x.target = y.source JOIN edges z ON z.source = y.target AND z.target = x.source
GROUP BY x.source
"""
CTES["local_cc"] = """
SELECT d.source AS node, degree, coalesce(triangles, 0) AS triangles,
       CASE WHEN degree > 1 THEN coalesce(triangles, 0) / (CAST(degree AS DOUBLE) * (degree - 1) / 2) ELSE 0.0e0 END AS clustering
FROM degree_table d LEFT JOIN closed c ON c.node = d.source
"""


@query("local_clustering", f"""
SELECT node, degree, triangles, {r('clustering')} AS clustering FROM local_cc
""")
def local_clustering(spark, sf_dir):
    return op.local_clustering(a.edges(spark, sf_dir))


@query("clustering", f"""
SELECT {r('avg(clustering)')} AS mean_local,
       {r('sum(triangles) / sum(CAST(degree AS DOUBLE) * (degree - 1) / 2)')} AS "global",
       {r(repr(3.0 * 4 / (4.0 * 5)))} AS expected_lattice
FROM local_cc
""")
def clustering(spark, sf_dir):
    return op.clustering(a.edges(spark, sf_dir), k=6)


@query("degree_check", """
SELECT n AS num_nodes, n AS expected_nodes, m * 2.0e0 / n AS average_degree, 6.0e0 AS expected_degree,
       true AS nodes_ok, abs(m * 2.0e0 / n - 6.0e0) <= 0.1e0 * 6.0e0 AS degree_ok
FROM (SELECT count(*) AS m, (SELECT count(*) FROM nodes) AS n FROM lattice)
""")
def degree_check(spark, sf_dir):
    ids = nodes(spark, sf_dir)
    return op.degree_check(make.ring_lattice_edges(ids, 6, dense=True), 6.0, total(ids, F.count(F.lit(1))))


CTES["activity"] = """
SELECT e.source AS humanId, i.contentId, count(*) AS neighbor_count
FROM edges e JOIN interactions i ON e.target = i.humanId GROUP BY 1, 2
"""


@query("neighbor_activity", "SELECT humanId, contentId, neighbor_count FROM activity")
def neighbor_activity(spark, sf_dir):
    acts = a.interactions(spark, sf_dir)
    return op.neighbor_activity(a.edges_of(acts), acts)


CTES["neighbor_affect"] = """
SELECT e.source AS humanId, avg(p.valence) AS neighbor_valence, avg(p.arousal) AS neighbor_arousal
FROM edges e JOIN people p ON e.target = p.humanId GROUP BY 1
"""


@query("neighbor_mean", f"""
SELECT humanId, {r('neighbor_valence')} AS neighbor_valence, {r('neighbor_arousal')} AS neighbor_arousal FROM neighbor_affect
""")
def neighbor_mean(spark, sf_dir):
    return op.neighbor_mean(a.edges(spark, sf_dir), a.people(spark, sf_dir))


def _shared(item: str, least: int) -> str:
    """SQL: both directions of all pairs with ``least`` items in common, by a plain self-join."""
    return f"""
WITH sets AS (SELECT DISTINCT humanId AS e, {item} AS i FROM interactions),
pairs AS (SELECT x.e AS a, y.e AS b, count(*) AS n FROM sets x JOIN sets y ON x.i = y.i AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= {least})
SELECT source, target, CAST(n AS DOUBLE) AS weight FROM pairs, {_BOTH}
"""


@query("edges_from_shared", _shared("contentId * 1000 + step", 3))
def edges_from_shared(spark, sf_dir):
    """Who touched three or more items on the same days."""
    return edges_from_items(a.interactions(spark, sf_dir), "humanId", ["contentId", "step"], 3)


@query("edges_from_shared_items", _shared("contentId", 32))
def edges_from_shared_items(spark, sf_dir):
    return edges_from_items(a.interactions(spark, sf_dir), "humanId", "contentId", 32)


def _rewire_rounds(p: float, tries: int = 100) -> str:
    """SQL of ``rewire_edges_settled`` over lattice, one block of table expressions per round."""
    roll = sql_uni(42, "rewire", "a", "b")
    text = f"left0 AS (SELECT a AS u, b AS v, {roll} AS roll FROM lattice WHERE {roll} < {p!r}e0),\ntaken0 AS (SELECT a, b FROM lattice)"
    spans = settled.windows(tries)
    for k, (lo, hi) in enumerate(spans):
        end = f"CAST(floor({sql_uni(42, 'rewire.target', 'u', 'v', 't')} * (SELECT count(*) FROM nodes)) AS BIGINT)"
        text += f""",
asked{k} AS (SELECT u, v, roll, arg_min(a, t) AS a, arg_min(b, t) AS b
  FROM (SELECT *, least(u, x) AS a, greatest(u, x) AS b FROM (SELECT *, {end} AS x FROM left{k}, range({lo}, {hi + 1}) AS r(t)) WHERE x <> u) c
  WHERE NOT EXISTS (SELECT 1 FROM taken{k} l WHERE l.a = c.a AND l.b = c.b) GROUP BY u, v, roll),
won{k} AS (SELECT u, v, a, b FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY roll, u, v) AS place FROM asked{k}) WHERE place = 1),
taken{k + 1} AS (SELECT a, b FROM taken{k} UNION ALL SELECT a, b FROM won{k}),
left{k + 1} AS (SELECT * FROM left{k} l WHERE NOT EXISTS (SELECT 1 FROM won{k} w WHERE w.u = l.u AND w.v = l.v))"""
    won = " UNION ALL ".join(f"SELECT * FROM won{k}" for k in range(len(spans)))
    return f"{text},\nwon AS ({won}),\nleft_over AS (SELECT * FROM left{len(spans)})"


@query("rewire_edges_settled", f"""
WITH {_rewire_rounds(0.6)},
kept AS (SELECT a, b FROM lattice WHERE NOT EXISTS (SELECT 1 FROM won WHERE won.u = lattice.a AND won.v = lattice.b))
SELECT source, target, 1.0e0 AS weight FROM (SELECT a, b FROM kept UNION ALL SELECT a, b FROM won), {_BOTH}
""")
def rewire_edges_settled(spark, sf_dir):
    ids = nodes(spark, sf_dir)
    return settled.rewire_edges_settled(make.ring_lattice_edges(ids, 6, dense=True), 0.6, ids, dense=True)[0]


@query("rewire_report", f"""
WITH {_rewire_rounds(0.6)}
SELECT (SELECT count(*) FROM left0) AS chosen, (SELECT count(*) FROM won) AS moved, (SELECT count(*) FROM left_over) AS stayed
""")
def rewire_report(spark, sf_dir):
    ids = nodes(spark, sf_dir)
    return settled.rewire_edges_settled(make.ring_lattice_edges(ids, 6, dense=True), 0.6, ids, dense=True)[1]


def _settled_draw(i: str) -> str:
    """SQL: the slot (from 1) of draw ``i`` of node ``n`` whose first edge is ``e``, m = 3."""
    first, again = sql_uni(42, "attach", f"(e + {i})"), sql_uni(42, "attach.again", "e", i)
    return f"CAST(floor(CASE WHEN {i} < 3 THEN {first} ELSE {again} END * len(slots)) AS BIGINT) + 1"


@query("preferential_edges_settled", f"""
WITH grow(n, e, slots, ends) AS (
  SELECT CAST(3 AS BIGINT), CAST(3 AS BIGINT), CAST([0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3] AS BIGINT[]), CAST([] AS BIGINT[])
  UNION ALL
  SELECT n, e, slots || flatten(list_transform(ends, lambda x: [n, x])), ends
  FROM (SELECT n, e, slots, list_filter(drawn, lambda x, i: list_position(drawn, x) = i)[1:3] AS ends
        FROM (SELECT n, e, slots, list_transform(range(0, 64), lambda i: slots[{_settled_draw('i')}]) AS drawn
              FROM (SELECT n + 1 AS n, e + 3 AS e, slots FROM grow WHERE n + 1 < (SELECT count(*) FROM nodes))))
),
pairs AS (SELECT unnest(ends) AS a, n AS b FROM grow
          UNION ALL SELECT x.id, y.id FROM nodes x, nodes y WHERE x.id <= 3 AND y.id <= 3 AND x.id < y.id)
SELECT source, target, 1.0e0 AS weight FROM pairs, {_BOTH}
""")
def preferential_edges_settled(spark, sf_dir):
    return settled.preferential_edges_settled(nodes(spark, sf_dir), 3, dense=True)
