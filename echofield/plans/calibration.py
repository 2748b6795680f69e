"""Queries: run summaries, rejection sampling and sensitivity indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofield.functions.lowdiscrepancy import direction_numbers, shift
from echofield.operators import calibration as op
from echofield.plans import adapters as a
from echofield.plans.registry import CTES, query, r, sql_uni
from echofield.plans.stats import sql_poisson_one

CTES["run_stats"] = """
SELECT humanId, count(*) FILTER (mood = 'RAGE') / count(*) AS p0, count(*) FILTER (mood = 'NEUTRAL') / count(*) AS p1,
       count(*) FILTER (mood = 'JOY') / count(*) AS p2, abs(count(*) FILTER (mood = 'RAGE') - count(*) FILTER (mood = 'JOY')) / count(*) AS pol
FROM states GROUP BY humanId
"""
CTES["observed"] = """
SELECT count(*) FILTER (mood = 'RAGE') / count(*) AS q0, count(*) FILTER (mood = 'NEUTRAL') / count(*) AS q1,
       count(*) FILTER (mood = 'JOY') / count(*) AS q2, abs(count(*) FILTER (mood = 'RAGE') - count(*) FILTER (mood = 'JOY')) / count(*) AS qol
FROM states
"""
CTES["distances"] = """
SELECT humanId, 2.0e0 * sqrt((p0 - q0) * (p0 - q0) + (p1 - q1) * (p1 - q1) + (p2 - q2) * (p2 - q2)) + abs(pol - qol) AS distance FROM run_stats, observed
"""


def distances(spark, sf_dir):
    states = a.states(spark, sf_dir)
    return op.abc_distance(op.summary_stats(states, ["humanId"]), op.summary_stats(states))


@query("summary_stats", f"""
SELECT humanId, {r('p0')} AS negative, {r('p1')} AS neutral, {r('p2')} AS positive, {r('pol')} AS polarization_index FROM run_stats
""")
def summary_stats(spark, sf_dir):
    d = F.col("mood_distribution")
    return op.summary_stats(a.states(spark, sf_dir), ["humanId"]).select(
        "humanId", d[0].alias("negative"), d[1].alias("neutral"), d[2].alias("positive"), "polarization_index"
    )


@query("abc_distance", f"SELECT humanId, {r('distance')} AS distance FROM distances")
def abc_distance(spark, sf_dir):
    return distances(spark, sf_dir).select("humanId", "distance")


@query("abc_accept", f"""
SELECT humanId, {r('distance')} AS distance, (SELECT count(*) FROM distances) AS tried FROM distances WHERE distance < 0.3e0 ORDER BY humanId LIMIT 20
""")
def abc_accept(spark, sf_dir):
    return op.abc_accept(distances(spark, sf_dir), 0.3, 20, "humanId").select("humanId", "distance", "tried")


# Fixed bounds of the parameters varied here.
BOUNDS = {"rageStickiness": (0.1, 0.9), "socialProofBase": (0.2, 0.8), "attentionDecayRate": (0.01, 0.2)}
NAMES = list(BOUNDS)


def design(spark, sf_dir):
    ids = a.events(spark, sf_dir).select(F.col("user_id").alias("row")).distinct()
    return op.saltelli_design(ids, BOUNDS, "row")


def outcomes(spark, sf_dir):
    """Results of each design row: a response to its parameters at the user's activity level."""
    level = a.events(spark, sf_dir).groupBy(F.col("user_id").alias("row")).agg(
        (F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("_e")
    )
    x, y, z = (F.col(n) for n in NAMES)
    value = x * 2 + y * y + x * z * 5 + F.col("_e")
    return design(spark, sf_dir).join(level, "row").select(
        "row", "block", F.create_map(F.lit("polarizationIndex"), value).alias("metrics")
    )


def evaluated(spark, sf_dir):
    return op.attach_outcomes(design(spark, sf_dir), outcomes(spark, sf_dir), "polarizationIndex")


def _draw(side: str, n: str) -> str:
    lo, hi = BOUNDS[n]
    return f"{lo!r}e0 + {sql_uni(42, f'design.{side}.{n}', 'id')} * ({hi!r}e0 - {lo!r}e0)"


CTES["base_rows"] = "SELECT id, err, " + ", ".join(
    f"{_draw(s, n)} AS {s}_{n}" for s in "AB" for n in NAMES
) + " FROM (SELECT user_id AS id, count(*) FILTER (event_type = 'error') / count(*) AS err FROM events GROUP BY 1)"


def _block(label: str, base: str, swapped: str | None) -> str:
    other = "B" if base == "A" else "A"
    cols = ", ".join(f"{other if n == swapped else base}_{n} AS {n}" for n in NAMES)
    return f"SELECT id, err, '{label}' AS block, {cols} FROM base_rows"


CTES["design_rows"] = " UNION ALL ".join(
    [_block("A", "A", None), _block("B", "B", None)]
    + [_block(f"AB:{n}", "A", n) for n in NAMES] + [_block(f"BA:{n}", "B", n) for n in NAMES]
)
CTES["outcome_rows"] = """
SELECT *, rageStickiness * 2 + socialProofBase * socialProofBase + rageStickiness * attentionDecayRate * 5 + err AS y FROM design_rows
"""
CTES["wide_rows"] = "SELECT id, " + ", ".join(
    f"max(c) FILTER (block = '{label}') AS {name}" for label, name in
    [("A", "a"), ("B", "b")] + [(f"{k}:{n}", f"{k.lower()}_{i}") for i, n in enumerate(NAMES) for k in ("AB", "BA")]
) + " FROM (SELECT *, y - (SELECT avg(y) FROM outcome_rows) AS c FROM outcome_rows) GROUP BY id"

_COLS = ", ".join(f"{r(n)} AS {n}" for n in NAMES)


@query("saltelli_design", f'SELECT id AS "row", block, {_COLS} FROM design_rows')
def saltelli_design(spark, sf_dir):
    return design(spark, sf_dir)


@query("attach_outcomes", f"""
SELECT id AS "row", block, {r('y')} AS y, 0.0e0 AS missing FROM outcome_rows
""")
def attach_outcomes(spark, sf_dir):
    found = evaluated(spark, sf_dir).select("row", "block", "y")
    return op.attach_outcomes(
        found.withColumnRenamed("y", "found"), outcomes(spark, sf_dir), "unknownMetric"
    ).select("row", "block", F.col("found").alias("y"), F.col("y").alias("missing"))


def _sums(w: str) -> str:
    s1 = ", ".join(f"sum({w} * b * (ab_{i} - a)) / sum({w}) AS f{i}" for i in range(3))
    st = ", ".join(f"sum({w} * (a - ab_{i}) * (a - ab_{i})) / sum({w}) / 2 AS t{i}" for i in range(3))
    var = (f"sum({w} * (a * a + b * b)) / (2 * sum({w})) - (sum({w} * (a + b)) / (2 * sum({w}))) * (sum({w} * (a + b)) / (2 * sum({w}))) AS v")
    return f"{s1}, {st}, {var}"


def _index(name: str, fn, column: str, letter: str) -> None:
    body = " UNION ALL ".join(f"SELECT '{n}' AS parameter, {r(f'{letter}{i} / v')} AS {column} FROM s" for i, n in enumerate(NAMES))

    @query(name, f"WITH s AS (SELECT {_sums('1.0e0')} FROM wide_rows) {body}")
    def run(spark, sf_dir):
        return fn(evaluated(spark, sf_dir), NAMES)


_index("sobol_first", op.sobol_first, "S1", "f")
_index("sobol_total", op.sobol_total, "ST", "t")
_PAIRS = [(0, 1), (0, 2), (1, 2)]


@query("sobol_second", f"WITH s AS (SELECT {_sums('1.0e0')}, " + ", ".join(
    f"avg(ba_{i} * ab_{j} - a * b) AS j{i}{j}" for i, j in _PAIRS) + " FROM wide_rows) " + " UNION ALL ".join(
    f"SELECT '{NAMES[i]}' AS parameter1, '{NAMES[j]}' AS parameter2, {r(f'(j{i}{j} - f{i} - f{j}) / v')} AS S2 FROM s" for i, j in _PAIRS))
def sobol_second(spark, sf_dir):
    return op.sobol_second(evaluated(spark, sf_dir), NAMES)


# Sobol' points: ids are numbered by the first three digits of their md5, then by value.
_FIVE = {**BOUNDS, "contentHalfLife": (5.0, 50.0), "initialExposureRate": (0.05, 0.3)}


def _sobol_sql(dimension: int) -> str:
    value = str(shift(42, dimension))
    for bit, v in enumerate(direction_numbers(dimension)[:24]):
        value = f"xor({value}, CASE WHEN (gray >> {bit}) & 1 = 1 THEN {v} ELSE 0 END)"
    return f"({value}) / 4294967296.0e0"


def _sobol_cell(i: int, n: str, side: str) -> str:
    lo, hi = _FIVE[n]
    return f"{lo!r}e0 + {_sobol_sql(i + (len(_FIVE) if side == 'B' else 0))} * ({hi!r}e0 - {lo!r}e0) AS {side}_{n}"


def _sobol_block(label: str, base: str, swapped: str | None) -> str:
    other = "B" if base == "A" else "A"
    cols = ", ".join(f"{r(f'{other if n == swapped else base}_{n}')} AS {n}" for n in _FIVE)
    return f"""SELECT id AS "row", '{label}' AS block, {cols} FROM base"""


@query("saltelli_design_sobol", f"""
WITH numbered AS (SELECT id, CAST(row_number() OVER (ORDER BY substr(md5(CAST(id AS VARCHAR)), 1, 3), id) - 1 AS BIGINT) AS i FROM (SELECT DISTINCT user_id AS id FROM events)),
base AS (SELECT id, {', '.join(_sobol_cell(i, n, s) for i, n in enumerate(_FIVE) for s in 'AB')} FROM (SELECT id, xor(i, i >> 1) AS gray FROM numbered)) """
    + " UNION ALL ".join([_sobol_block("A", "A", None), _sobol_block("B", "B", None)]
                         + [_sobol_block(f"AB:{n}", "A", n) for n in _FIVE] + [_sobol_block(f"BA:{n}", "B", n) for n in _FIVE]))
def saltelli_design_sobol(spark, sf_dir):
    ids = a.events(spark, sf_dir).select(F.col("user_id").alias("row"))
    return op.saltelli_design(ids, _FIVE, "row", points="sobol")


@query("sobol_second_confidence", f"""
WITH w AS (SELECT *, {sql_poisson_one('u')} AS w FROM (SELECT *, {sql_uni(42, 'sobol', 'id', 'rep')} AS u FROM (SELECT *, unnest(generate_series(1, 50)) AS rep FROM wide_rows))),
s AS (SELECT rep, {_sums('w')}, """ + ", ".join(
    f"sum(w * (ba_{i} * ab_{j} - a * b)) / sum(w) AS j{i}{j}" for i, j in _PAIRS) + " FROM w GROUP BY rep) " + " UNION ALL ".join(
    f"SELECT '{NAMES[i]}' AS parameter1, '{NAMES[j]}' AS parameter2, {r(f'1.959963984540054e0 * stddev_samp((j{i}{j} - f{i} - f{j}) / v)')} AS S2_conf FROM s"
    for i, j in _PAIRS))
def sobol_second_confidence(spark, sf_dir):
    return op.sobol_second_confidence(evaluated(spark, sf_dir), NAMES, 50)


@query("sobol_confidence", f"""
WITH w AS (SELECT *, {sql_poisson_one('u')} AS w FROM (SELECT *, {sql_uni(42, 'sobol', 'id', 'rep')} AS u FROM (SELECT *, unnest(generate_series(1, 50)) AS rep FROM wide_rows))),
s AS (SELECT rep, {_sums('w')} FROM w GROUP BY rep) """ + " UNION ALL ".join(
    f"SELECT '{n}' AS parameter, {r(f'1.959963984540054e0 * stddev_samp(f{i} / v)')} AS S1_conf, {r(f'1.959963984540054e0 * stddev_samp(t{i} / v)')} AS ST_conf FROM s" for i, n in enumerate(NAMES)))
def sobol_confidence(spark, sf_dir):
    return op.sobol_confidence(evaluated(spark, sf_dir), NAMES, 50)
