"""Comparing conditions of an experiment: summaries, tests, bands and grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofield.functions.columns import require, total, uni
from echofield.functions.ranking import dense_index, quantiles
from echofield.functions.special import f_tail, t_two_sided
from echofield.functions.vectors import array_percentile, poisson_weights, weighted_sums

Z95 = 1.96


def final_step(df: DataFrame, step: str = "timeStep") -> DataFrame:
    """Rows of the last step in the table; the last step is a scalar, so the scan can be pruned."""
    return df.filter(F.col(step) == total(df, F.max(step)))


def _moments(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.var_samp(col).alias("var"),
    )


def group_summary(df: DataFrame, by: Sequence[str], col: str, digits: int = 3) -> DataFrame:
    """n, mean, sample deviation and standard error per group, rounded."""
    m = _moments(df, by, col).withColumn("sem", F.col("std") / F.sqrt("n"))
    return m.select(*by, "n", *[F.round(c, digits).alias(c) for c in ("mean", "std", "sem")])


def anova_oneway(df: DataFrame, by: str, col: str) -> DataFrame:
    """F statistic, p-value and degrees of freedom, from one (n, mean, variance) row per group."""
    m = _moments(df, [by], col).filter("n > 0")
    n, mean = F.col("n"), F.col("mean")
    # Group means are compared with their own average to keep the sums of squares accurate.
    grand = total(m, F.sum(n * mean) / F.sum("n"))
    off = mean - F.col("_grand")
    sums = m.withColumn("_grand", grand).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"), F.sum(n * off * off).alias("ssb"),
        F.sum((n - 1) * F.coalesce("var", F.lit(0.0))).alias("ssw"),
    )
    out = sums.withColumns({
        "df1": F.col("k") - 1, "df2": F.col("N") - F.col("k"),
    }).withColumn("f_stat", F.try_divide(
        F.col("ssb") * F.col("df2"), F.col("ssw") * F.col("df1")
    ))
    return out.select("f_stat", f_tail(F.col("f_stat"), F.col("df1"), F.col("df2")).alias("p_value"), "df1", "df2")


def _t_columns(equal_var: bool) -> tuple[Column, Column]:
    """t statistic and degrees of freedom from columns n1, m1, v1, n2, m2, v2."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    v1, v2 = F.col("v1"), F.col("v2")
    if equal_var:
        df = n1 + n2 - 2.0
        pooled = F.try_divide((n1 - 1.0) * v1 + (n2 - 1.0) * v2, df)
        se = F.sqrt(pooled * (n1 + n2) / (n1 * n2))
    else:
        a, b = v1 / n1, v2 / n2
        se = F.sqrt(a + b)
        df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, n1 - 1.0) + F.try_divide(b * b, n2 - 1.0))
    return F.try_divide(F.col("m1") - F.col("m2"), se), df


def pairwise_ttests(
    df: DataFrame, by: str, col: str, alpha: float = 0.05, equal_var: bool = True
) -> DataFrame:
    """t-test of every two conditions, with the Bonferroni flag p < alpha / number of pairs.

    Conditions are compared on their summaries.  The summaries are numbered and
    each is sent to those with a larger number, an equi-join: there is a row per
    pair, never one that holds all conditions.
    """
    m = _moments(df, [by], col).filter(F.col(by).isNotNull())
    row = F.struct(F.col(by).alias("c"), "n", F.col("mean").alias("m"), F.col("var").alias("v")).alias("_s")
    numbered = dense_index(m.select(by, row), by, "_i").select("_i", "_s")
    k = total(m, F.count(F.lit(1)))
    later = F.sequence(F.col("_i") + 1, F.col("_k") - 1)
    first = numbered.withColumn("_k", k).filter(F.col("_i") + 1 < F.col("_k")).select(
        F.col("_s").alias("_one"), "_k", F.explode(later).alias("_i"))
    pairs = first.join(numbered, "_i").select(F.least("_one", "_s").alias("_x"), F.greatest("_one", "_s").alias("_y"), "_k")
    flat = pairs.select(
        F.col("_x.c").alias("group1"), F.col("_y.c").alias("group2"), "_k",
        *[F.col(f"_{s}.{c}").alias(f"{c}{i}") for i, s in ((1, "x"), (2, "y")) for c in ("n", "m", "v")],
    )
    t, dof = _t_columns(equal_var)
    tested = flat.withColumns({"t_stat": t, "_df": dof}).withColumn(
        "p_value", t_two_sided(F.col("t_stat"), F.col("_df"))
    )
    tests = F.col("_k") * (F.col("_k") - 1) / 2
    return tested.select(
        "group1", "group2", "t_stat", "p_value", (F.col("m1") - F.col("m2")).alias("mean_diff"),
        (F.col("p_value") < F.try_divide(F.lit(alpha), tests)).alias("significant"),
    )


def ttest(
    df: DataFrame, by: str, col: str, first: str, second: str, equal_var: bool = True
) -> DataFrame:
    """Pooled or Welch t-test of two groups: one pass, one row."""
    aggs = []
    for i, g in ((1, first), (2, second)):
        x = F.when(F.col(by) == g, F.col(col))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_samp(x).alias(f"v{i}")]
    t, dof = _t_columns(equal_var)
    out = df.filter(F.col(by).isin(first, second)).agg(*aggs).withColumns({"t_stat": t, "df": dof})
    return out.select(
        "n1", "n2", (F.col("m1") - F.col("m2")).alias("mean_diff"), "t_stat", "df",
        t_two_sided(F.col("t_stat"), F.col("df")).alias("p_value"),
    )


def mean_band(df: DataFrame, by: Sequence[str], step: str, col: str, kind: str = "sem") -> DataFrame:
    """Mean per group and step with +-1.96 standard errors (kind "sem") or +-1 deviation ("sd")."""
    require(kind in ("sem", "sd"), f"unknown kind {kind}")
    m = _moments(df, [*by, step], col)
    spread = F.coalesce(F.col("std"), F.lit(0.0))
    half = F.lit(Z95) * spread / F.sqrt("n") if kind == "sem" else spread
    return m.select(*by, step, "mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def bootstrap_band(
    df: DataFrame, by: Sequence[str], step: str, col: str, keys: Sequence[str], b: int = 1000, seed: int = 42
) -> DataFrame:
    """95% percentile band of the resampled mean per group and step.

    Resampling with replacement is done with b keyed Poisson(1) weights per row,
    so every row is reweighted where it lies and only b sums per group and step
    are moved.  A repeat in which all weights of a group are 0 has no mean.
    """
    rows = df.filter(F.col(col).isNotNull())
    weights = poisson_weights(b, seed, "boot", *keys)
    sums = weighted_sums(rows, [*by, step], weights, [F.lit(1.0), F.col(col)], b)
    means = F.zip_with(F.col("sums")[1], F.col("sums")[0], F.try_divide)
    ranked = sums.select(*by, step, F.sort_array(F.filter(means, lambda m: m.isNotNull())).alias("_m"))
    return ranked.select(
        *by, step, array_percentile(F.col("_m"), 0.025).alias("lo"), array_percentile(F.col("_m"), 0.975).alias("hi")
    )


def box_stats(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 IQR, and the number beyond them."""
    marks = quantiles(df, col, [0.25, 0.5, 0.75], by)
    marks = marks.select(
        *by, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    rows = df.filter(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_x"))
    x, reach = F.col("_x"), (F.col("q3") - F.col("q1")) * 1.5
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.join(marks, list(by)).groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, x)).alias("whisker_lo"), F.max(F.when(inside, x)).alias("whisker_hi"),
        F.count_if(~inside).alias("outliers"),
    )


def condition_grid(
    settings: DataFrame, extremes: Mapping[str, Sequence[float]], topologies: Sequence[str]
) -> DataFrame:
    """For each baseline row: itself and one row per moved parameter, in every topology."""
    names = list(extremes)

    def variant(label: str, moved: str | None, value: float | None) -> Column:
        cols = [F.lit(float(value)).alias(n) if n == moved else F.col(n).cast("double").alias(n) for n in names]
        return F.struct(F.lit(label).alias("setting"), *cols)

    variants = [variant("baseline", None, None)] + [
        variant(f"{name}={value}", name, value) for name, values in extremes.items() for value in values
    ]
    rest = [c for c in settings.columns if c not in names]
    moved = settings.select(*rest, F.explode(F.array(*variants)).alias("_v")).select(*rest, "_v.*")
    return moved.withColumn("topology", F.explode(F.array(*map(F.lit, topologies))))


def replicate_grid(conditions: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Each condition n times, every replicate with a seed of its own from a hash."""
    runs = conditions.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    own = F.floor(uni(seed, "run", *keys, "replicate") * F.lit(float(2**31))).cast("long")
    return runs.withColumn("seed", own)


def rank_order_check(df: DataFrame, setting: str, condition: str, value: str) -> DataFrame:
    """Order of the conditions by mean within each setting, and whether it is the overall order.

    Ordering works on one mean per setting and condition.
    """
    def order(means: DataFrame, by: Sequence[str]) -> DataFrame:
        ranked = F.sort_array(F.collect_list(F.struct((-F.col("_m")).alias("_s"), F.col(condition).alias("_c"))))
        labels = F.transform(ranked, lambda x: x["_c"].cast("string"))
        return means.groupBy(*by).agg(F.array_join(labels, ">").alias("condition_order"))

    overall = order(df.groupBy(condition).agg(F.avg(value).alias("_m")), [])
    each = order(df.groupBy(setting, condition).agg(F.avg(value).alias("_m")), [setting])
    return each.withColumn("overall_order", overall.select("condition_order").scalar()).withColumn(
        "holds", F.col("condition_order") == F.col("overall_order")
    )


def scaling_table(df: DataFrame, series: str = "series") -> DataFrame:
    """Throughput, time per step, and speed-up and efficiency against the fewest cores of the series.

    Input: series, kind ("weak" or "strong"), cores, population, steps, seconds.
    Weak scaling keeps the work per core, so its ideal time is constant; strong
    scaling keeps the work, so its ideal time falls with the cores.
    """
    w = Window.partitionBy(series).orderBy("cores").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    t0, c0 = F.first("seconds").over(w), F.first("cores").over(w)
    seconds = F.col("seconds")
    out = df.withColumns({
        "throughput": F.try_divide(F.col("population") * F.col("steps"), seconds),
        "ms_per_step": seconds / F.col("steps") * 1000.0,
        "speedup": F.try_divide(t0, seconds),
        "_ratio": F.col("cores") / c0,
    })
    efficiency = F.when(F.col("kind") == "weak", F.col("speedup")).otherwise(F.col("speedup") / F.col("_ratio"))
    return out.withColumn("efficiency", efficiency).drop("_ratio")


def divergence_step(
    df: DataFrame, condition: str, step: str, value: str, above: str, below: str
) -> DataFrame:
    """First step from which the mean of ``above`` stays over that of ``below``; null if never.

    Equal to the first compared step after the last one where it does not.
    """
    hi = F.avg(F.when(F.col(condition) == above, F.col(value)))
    lo = F.avg(F.when(F.col(condition) == below, F.col(value)))
    steps = df.filter(F.col(condition).isin(above, below)).groupBy(step).agg((hi - lo).alias("_d"))
    steps = steps.filter(F.col("_d").isNotNull())
    last_bad = total(steps, F.max(F.when(F.col("_d") <= 0, F.col(step))))
    good = F.when(F.coalesce(F.col(step) > F.col("_bad"), F.lit(True)), F.col(step))
    return steps.withColumn("_bad", last_bad).agg(F.min(good).alias("divergence_step"))
