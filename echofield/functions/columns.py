"""Keyed randomness and small numeric column helpers.

``rand(seed)`` in Spark depends on how rows are spread over partitions, so the
same seed gives other numbers on another cluster or after a retry.  Here every
random number is a hash of a seed, a label and the row's own keys: it survives
repartitioning and task retries, and another SQL engine computes the same value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 13 hexadecimal digits of the md5 make a 52-bit integer, which a double holds exactly.
HEX_DIGITS = 13
SCALE = float(2 ** (4 * HEX_DIGITS))

# P(Poisson(1) > 18) is below 2**-52, the resolution of `uni`.
POISSON_MAX = 18
SPAN = 1 << 16  # cells held as one array while a row fans out


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uni(seed: int, salt: str, *keys: Column | str) -> Column:
    """Uniform number in [0, 1) that depends only on seed, salt and the keys."""
    parts = [F.lit(str(seed)), F.lit(salt), *(as_col(k).cast("string") for k in keys)]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long") / F.lit(SCALE)


def gauss(seed: int, salt: str, *keys: Column | str) -> Column:
    """Standard normal number per key (Box-Muller on two keyed uniforms)."""
    u = uni(seed, salt + ".a", *keys)
    v = uni(seed, salt + ".b", *keys)
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u)) * F.cos(F.lit(2.0 * math.pi) * v)


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Limit a column to [lo, hi]; null stays null."""
    x = as_col(c)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo))))


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE has it: 0 / 0 is NaN, x / 0 is infinite, where plain division would stop the query."""
    return F.when(b == 0, a * F.lit(math.inf)).otherwise(a / b)


def poisson_small(u: Column, mean: Column) -> Column:
    """Poisson variate for ``mean <= 1`` from one uniform, by inverting the CDF.

    A uniform with 52 bits can reach at most POISSON_MAX, so the inversion is
    complete, not cut off.
    """
    # The uniform and the mean ride along in the state: a column used inside a
    # lambda may be inlined by the optimizer and would be hashed again per step.
    start = F.struct(
        u.alias("u"), mean.alias("mean"), F.exp(-mean).alias("term"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k")
    )

    def climb(s: Column, i: Column) -> Column:
        term = s["term"] * s["mean"] / i
        higher = F.struct(
            s["u"].alias("u"), s["mean"].alias("mean"), term.alias("term"), (s["cdf"] + term).alias("cdf"), i.alias("k")
        )
        return F.when(s["u"] < s["cdf"], s).otherwise(higher)

    return F.aggregate(F.sequence(F.lit(1), F.lit(POISSON_MAX)), start, climb, lambda s: s["k"])


def poisson_unit(u: Column) -> Column:
    """Poisson variate of mean 1 from one uniform: the thresholds are constants."""
    weight, edge = math.exp(-1.0), math.exp(-1.0)
    k = F.when(u < F.lit(edge), F.lit(0))
    for i in range(1, POISSON_MAX):
        weight /= i
        edge += weight
        k = k.when(u < F.lit(edge), F.lit(i))
    return k.otherwise(F.lit(POISSON_MAX))


def poisson_draws(
    df: DataFrame, mean: Column, seed: int, salt: str, keys: Sequence[str], draw: str = "draw"
) -> DataFrame:
    """Repeat each row a Poisson(mean) number of times and number the copies.

    A Poisson count is the sum of counts over cells of mean at most one, so the
    row is first split into ``ceil(mean)`` cells and each cell inverts its own
    uniform.  The number of rows made is proportional to the number kept; a
    row with a very large mean fans out inside the task, a span of cells at a time.
    ``draw`` is a string unique within the row's keys.
    """
    zero = F.lit(0).cast("long")
    return (
        df.withColumn("_mean", mean)
        .filter(F.col("_mean") > 0)
        .withColumn("_cells", F.ceil("_mean").cast("long"))
        .withColumn("_span", F.explode(F.sequence(zero, F.floor((F.col("_cells") - 1) / F.lit(SPAN)))))
        .withColumn("_cell", F.explode(F.sequence(
            F.col("_span") * SPAN + 1, F.least(F.col("_cells"), (F.col("_span") + 1) * SPAN)
        )))
        .withColumn("_u", uni(seed, salt, *keys, "_cell"))
        .withColumn("_k", poisson_small(F.col("_u"), F.col("_mean") / F.col("_cells")))
        .filter(F.col("_k") > 0)
        .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_k"))))
        .withColumn(draw, F.concat_ws(".", F.col("_cell"), F.col("_i")))
        .drop("_mean", "_cells", "_span", "_cell", "_u", "_k", "_i")
    )


def total(df: DataFrame, expr: Column) -> Column:
    """A one-row aggregate of ``df`` as a scalar subquery.

    Spark runs it once and hands the value to the tasks, so nothing is
    collected by this library and no cross join appears in the plan.
    """
    return df.agg(expr.alias("_scalar")).select("_scalar").scalar()


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)
