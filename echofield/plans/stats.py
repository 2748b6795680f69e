"""Queries: experiment statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofield.operators import stats as op
from echofield.plans import adapters as a
from echofield.plans.registry import CTES, query, r, sql_uni


def sql_betainc(x: str, p: str, q: str, cells: int = 50_000) -> str:
    """Regularised incomplete beta: the integral over t = sin^2(angle), part by whole.

    Each cell is summed at its two Gauss points, so the error falls with the
    fourth power of the cell.
    """
    def area(top: str) -> str:
        def f(shift: str) -> str:
            angle = f"({top} * (i + 0.5e0 {shift}) / {cells})"
            return f"exp((2 * {p} - 1) * ln(sin{angle}) + (2 * {q} - 1) * ln(cos{angle}))"

        both = f"{f('- 0.28867513459481287e0')} + {f('+ 0.28867513459481287e0')}"
        return f"(SELECT sum({both}) * {top} FROM range({cells}) grid_points(i))"

    return f"({area(f'asin(sqrt({x}))')} / {area('(pi() / 2)')})"


def sql_t_tail(t: str, df: str) -> str:
    return sql_betainc(f"({df} / ({df} + {t} * {t}))", f"({df} / 2.0e0)", "0.5e0")


def runs(spark, sf_dir):
    return a.run_metrics(spark, sf_dir)


def customers(spark, sf_dir):
    return a.table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal")


@query("final_step", f"""
SELECT condition, replicate, timeStep, n, {r('value')} AS value FROM run_metrics WHERE timeStep = (SELECT max(timeStep) FROM run_metrics)
""")
def final_step(spark, sf_dir):
    return op.final_step(runs(spark, sf_dir))


@query("group_summary", f"""
SELECT o_orderpriority, count(*) AS n, {r('round(avg(o_totalprice), 3)')} AS mean, {r('round(stddev_samp(o_totalprice), 3)')} AS std,
       {r('round(stddev_samp(o_totalprice) / sqrt(count(*)), 3)')} AS sem FROM orders GROUP BY 1
""")
def group_summary(spark, sf_dir):
    return op.group_summary(a.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")


@query("anova_oneway", f"""
WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1),
s AS (SELECT count(*) - 1 AS df1, CAST(sum(n) AS BIGINT) - count(*) AS df2, sum((n - 1) * v) AS ssw,
             sum(n * (m - (SELECT avg(c_acctbal) FROM customer)) * (m - (SELECT avg(c_acctbal) FROM customer))) AS ssb FROM g),
f AS (SELECT df1, df2, (ssb / df1) / (ssw / df2) AS f FROM s)
SELECT {r('f')} AS f_stat, {r(sql_betainc('(df2 / (df2 + df1 * f))', '(df2 / 2.0e0)', '(df1 / 2.0e0)'))} AS p_value, df1, df2 FROM f
""")
def anova_oneway(spark, sf_dir):
    return op.anova_oneway(customers(spark, sf_dir), "c_mktsegment", "c_acctbal")


@query("pairwise_ttests", f"""
WITH g AS (SELECT c_mktsegment AS c, CAST(count(*) AS DOUBLE) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1),
p AS (SELECT x.c AS group1, y.c AS group2, x.m - y.m AS d, x.n + y.n - 2 AS dof,
             (x.m - y.m) / sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2) * (1 / x.n + 1 / y.n)) AS t FROM g x JOIN g y ON x.c < y.c),
q AS (SELECT *, {sql_t_tail('t', 'dof')} AS pv FROM p)
SELECT group1, group2, {r('t')} AS t_stat, {r('pv')} AS p_value, {r('d')} AS mean_diff, pv < 0.05e0 / (SELECT count(*) FROM p) AS significant FROM q
""")
def pairwise_ttests(spark, sf_dir):
    return op.pairwise_ttests(customers(spark, sf_dir), "c_mktsegment", "c_acctbal")


_TWO = """
g AS (SELECT count(*) FILTER (c_mktsegment = 'BUILDING') AS n1, avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS m1, var_samp(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS v1,
             count(*) FILTER (c_mktsegment = 'MACHINERY') AS n2, avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS m2, var_samp(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS v2 FROM customer)"""


def _two(name: str, equal: bool, t: str, dof: str) -> None:
    @query(name, f"""
    WITH {_TWO}, t AS (SELECT *, (m1 - m2) / ({t}) AS t, CAST({dof} AS DOUBLE) AS dof FROM g)
    SELECT n1, n2, {r('m1 - m2')} AS mean_diff, {r('t')} AS t_stat, {r('dof')} AS df, {r(sql_t_tail('t', 'dof'))} AS p_value FROM t
    """)
    def run(spark, sf_dir):
        return op.ttest(customers(spark, sf_dir), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY", equal)


_two("ttest_pooled", True, "sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0e0 / n1 + 1.0e0 / n2))", "n1 + n2 - 2")
_two("ttest_welch", False, "sqrt(v1 / n1 + v2 / n2)",
     "(v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1))")


def _band(kind: str, half: str) -> None:
    @query(f"mean_band_{kind}", f"""
    SELECT condition, timeStep, {r('m')} AS mean, {r(f'm - {half}')} AS lo, {r(f'm + {half}')} AS hi
    FROM (SELECT condition, timeStep, avg(value) AS m, coalesce(stddev_samp(value), 0.0e0) AS sd, count(*) AS n FROM run_metrics GROUP BY 1, 2)
    """)
    def run(spark, sf_dir):
        return op.mean_band(runs(spark, sf_dir), ["condition"], "timeStep", "value", kind)


_band("sem", "1.96e0 * sd / sqrt(n)")
_band("sd", "sd")


def sql_poisson_one(u: str) -> str:
    """SQL CASE inverting the Poisson(1) distribution function."""
    terms, parts, factorial = [], "1.0e0", 1.0
    for i in range(18):
        if i:
            factorial *= i
            parts += f" + 1.0e0 / {factorial!r}"
        terms.append(f"WHEN {u} < exp(-1.0e0) * ({parts}) THEN {i}")
    return "CASE " + " ".join(terms) + " ELSE 18 END"


@query("bootstrap_band", f"""
WITH d AS (SELECT *, {sql_uni(42, 'boot', 'condition', 'replicate', 'timeStep', 'rep')} AS u FROM (SELECT *, unnest(generate_series(1, 100)) AS rep FROM run_metrics)),
w AS (SELECT *, {sql_poisson_one('u')} AS w FROM d),
m AS (SELECT condition, timeStep, rep, sum(w * value) / nullif(sum(w), 0) AS m FROM w GROUP BY 1, 2, 3)
SELECT condition, timeStep, {r('quantile_cont(m, 0.025e0)')} AS lo, {r('quantile_cont(m, 0.975e0)')} AS hi FROM m GROUP BY 1, 2
""")
def bootstrap_band(spark, sf_dir):
    return op.bootstrap_band(
        runs(spark, sf_dir), ["condition"], "timeStep", "value", ["condition", "replicate", "timeStep"], 100
    )


@query("box_stats", f"""
WITH q AS (SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, 0.25e0) AS q1, quantile_cont(o_totalprice, 0.5e0) AS m, quantile_cont(o_totalprice, 0.75e0) AS q3 FROM orders GROUP BY 1),
x AS (SELECT q.*, o_totalprice AS x, o_totalprice BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) AS inside FROM q JOIN orders USING (o_orderpriority))
SELECT o_orderpriority, n, {r('q1')} AS q1, {r('m')} AS median, {r('q3')} AS q3, {r('min(x) FILTER (inside)')} AS whisker_lo, {r('max(x) FILTER (inside)')} AS whisker_hi,
       count(*) FILTER (NOT inside) AS outliers FROM x GROUP BY o_orderpriority, n, q1, m, q3
""")
def box_stats(spark, sf_dir):
    return op.box_stats(a.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")


def settings(spark, sf_dir):
    """One baseline per event type: mean size and share of the type."""
    df = a.events(spark, sf_dir)
    return df.groupBy("event_type").agg(
        (F.sum(F.round(F.col("value") * 100).cast("long")) / F.lit(100.0) / F.count(F.lit(1))).alias("halfLife"),
        (F.count(F.lit(1)) / F.lit(1000.0)).alias("rate"),
    )


CTES["settings"] = """
SELECT event_type, sum(CAST(round(value * 100) AS BIGINT)) / 100.0e0 / count(*) AS halfLife, count(*) / 1000.0e0 AS rate FROM events GROUP BY 1
"""


@query("condition_grid", f"""
SELECT event_type, setting, {r('h')} AS halfLife, {r('x')} AS rate, topology
FROM (SELECT event_type, 'baseline' AS setting, halfLife AS h, rate AS x FROM settings
      UNION ALL SELECT event_type, 'halfLife=5.0', 5.0e0, rate FROM settings UNION ALL SELECT event_type, 'halfLife=20.0', 20.0e0, rate FROM settings
      UNION ALL SELECT event_type, 'rate=0.05', halfLife, 0.05e0 FROM settings UNION ALL SELECT event_type, 'rate=0.2', halfLife, 0.2e0 FROM settings),
     (VALUES ('random'), ('ring'), ('scale_free')) t(topology)
""")
def condition_grid(spark, sf_dir):
    return op.condition_grid(
        settings(spark, sf_dir), {"halfLife": [5.0, 20.0], "rate": [0.05, 0.2]}, ["random", "ring", "scale_free"]
    )


@query("replicate_grid", f"""
SELECT event_type, {r('halfLife')} AS halfLife, {r('rate')} AS rate, CAST(i AS INTEGER) AS replicate,
       CAST(floor({sql_uni(42, 'run', 'event_type', 'i')} * 2147483648.0e0) AS BIGINT) AS seed
FROM settings, range(10) t(i)
""")
def replicate_grid(spark, sf_dir):
    return op.replicate_grid(settings(spark, sf_dir), 10, ["event_type"])


@query("rank_order_check", """
WITH o AS (SELECT string_agg(condition, '>' ORDER BY m DESC, condition) AS s FROM (SELECT condition, avg(value) AS m FROM run_metrics GROUP BY 1)),
e AS (SELECT replicate, string_agg(condition, '>' ORDER BY m DESC, condition) AS s FROM (SELECT replicate, condition, avg(value) AS m FROM run_metrics GROUP BY 1, 2) GROUP BY 1)
SELECT replicate, e.s AS condition_order, o.s AS overall_order, e.s = o.s AS holds FROM e, o
""")
def rank_order_check(spark, sf_dir):
    return op.rank_order_check(runs(spark, sf_dir), "replicate", "condition", "value")


CTES["bench_rows"] = """
SELECT event_type AS series, CASE WHEN event_type IN ('click', 'view') THEN 'weak' ELSE 'strong' END AS kind,
       CAST(user_id % 8 + 1 AS INTEGER) AS cores, count(DISTINCT user_id) AS population, CAST(30 AS INTEGER) AS steps,
       sum(CAST(round(value * 100) AS BIGINT)) / 100000.0e0 AS seconds FROM events GROUP BY 1, 2, 3
"""


@query("scaling_table", f"""
SELECT series, kind, cores, population, steps, {r('seconds')} AS seconds, {r('population * steps / seconds')} AS throughput, {r('seconds / steps * 1000.0e0')} AS ms_per_step,
       {r('t0 / seconds')} AS speedup, {r("CASE WHEN kind = 'weak' THEN t0 / seconds ELSE t0 / seconds / (cores / c0) END")} AS efficiency
FROM (SELECT *, first_value(seconds) OVER w AS t0, first_value(cores) OVER w AS c0 FROM bench_rows WINDOW w AS (PARTITION BY series ORDER BY cores))
""")
def scaling_table(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("click", "view"), "weak").otherwise("strong")
    df = a.events(spark, sf_dir).groupBy(
        F.col("event_type").alias("series"), kind.alias("kind"), (F.col("user_id") % 8 + 1).cast("int").alias("cores")
    ).agg(
        F.count_distinct("user_id").alias("population"), F.lit(30).alias("steps"),
        (F.sum(F.round(F.col("value") * 100).cast("long")) / F.lit(100000.0)).alias("seconds"),
    )
    return op.scaling_table(df)


@query("divergence_step", """
WITH d AS (SELECT timeStep, avg(value) FILTER (condition = 'purchase') - avg(value) FILTER (condition = 'view') AS d FROM run_metrics GROUP BY 1)
SELECT min(timeStep) AS divergence_step FROM d WHERE d IS NOT NULL AND timeStep > coalesce((SELECT max(timeStep) FROM d WHERE d <= 0), -1)
""")
def divergence_step(spark, sf_dir):
    return op.divergence_step(runs(spark, sf_dir), "condition", "timeStep", "value", "purchase", "view")
