"""Rejection sampling on run summaries, and variance-based sensitivity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofield.functions.columns import require, total, uni
from echofield.functions.lowdiscrepancy import sobol
from echofield.functions.ranking import dense_index
from echofield.functions.vectors import array_deviation, poisson_weights, weighted_sums
from echofield.operators.metrics import class_counts

Z95 = 1.959963984540054


def summary_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per run: shares [RAGE, NEUTRAL, JOY] as mood_distribution, and the polarization."""
    n = F.col("n")
    return class_counts(df, by).filter(n > 0).select(
        *by,
        F.array(*[F.col(c) / n for c in ("rageCount", "neutralCount", "joyCount")]).alias("mood_distribution"),
        (F.abs(F.col("rageCount") - F.col("joyCount")) / n).alias("polarization_index"),
    )


def abc_distance(runs: DataFrame, observed: DataFrame) -> DataFrame:
    """2 |p - q| + |difference of polarization| to the one observed row; missing parts are skipped."""
    packed = observed.select(F.struct("mood_distribution", "polarization_index").alias("_o")).scalar()
    df = runs.withColumn("_o", packed)
    squares = F.zip_with("mood_distribution", F.col("_o.mood_distribution"), lambda p, q: (p - q) * (p - q))
    spread = F.lit(2.0) * F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
    polar = F.abs(F.col("polarization_index") - F.col("_o.polarization_index"))
    zero = F.lit(0.0)
    return df.withColumn("distance", F.coalesce(spread, zero) + F.coalesce(polar, zero)).drop("_o")


def abc_accept(runs: DataFrame, eps: float, n: int, draw: str = "draw", max_draws: int | None = None) -> DataFrame:
    """The first ``n`` draws with distance below eps, and ``tried``, the number of draws looked at.

    All draws are looked at, or the first ``max_draws`` of them.  Fewer than n
    rows mean that these did not hold enough.  Each task keeps n rows at most.
    """
    looked = runs if max_draws is None else runs.orderBy(draw).limit(max_draws)
    tried = total(looked, F.count(F.lit(1)))
    return looked.filter(F.col("distance") < eps).orderBy(draw).limit(n).withColumn("tried", tried)


# --- Sensitivity: blocks A, B, AB:<p>, BA:<p> of one base row share its id ---


def saltelli_design(
    ids: DataFrame, bounds: Mapping[str, tuple[float, float]], key: str = "row", seed: int = 42, points: str = "uniform"
) -> DataFrame:
    """2 D + 2 parameter rows per id: A, B, A with one column of B, B with one column of A.

    ``points="sobol"`` takes A and B from the first and last D of 2 D dimensions
    of a shifted Sobol' sequence, whose estimates are closer by far; ids are
    numbered for it.  A power of two of them fills the space evenly.
    ``"uniform"`` draws every coordinate by itself.
    """
    require(points in ("uniform", "sobol"), f"unknown points {points}")
    names = list(bounds)
    drawn = ids.select(key)
    if points == "sobol":
        drawn = dense_index(drawn.distinct(), key, "_at")

    def coordinate(side: str, i: int) -> Column:
        if points == "uniform":
            return uni(seed, f"design.{side}.{names[i]}", key)
        return sobol(F.col("_at"), i + (len(names) if side == "B" else 0), seed)

    for i, (n, (lo, hi)) in enumerate(bounds.items()):
        for side in ("A", "B"):
            drawn = drawn.withColumn(f"_{side}_{n}", F.lit(float(lo)) + coordinate(side, i) * F.lit(float(hi) - float(lo)))

    def block(label: str, base: str, other: str, swapped: str | None) -> Column:
        return F.struct(
            F.lit(label).alias("block"),
            *[F.col(f"_{other if n == swapped else base}_{n}").alias(n) for n in names],
        )

    blocks = [block("A", "A", "B", None), block("B", "B", "A", None)]
    blocks += [block(f"AB:{n}", "A", "B", n) for n in names]
    blocks += [block(f"BA:{n}", "B", "A", n) for n in names]
    return drawn.select(key, F.explode(F.array(*blocks)).alias("_b")).select(key, "_b.*")


def attach_outcomes(design: DataFrame, results: DataFrame, metric: str, key: str = "row") -> DataFrame:
    """Outcome y of each design row from a results table (key, block, metrics map); 0 if missing."""
    found = results.select(key, "block", F.try_element_at("metrics", F.lit(metric)).alias("_y"))
    return design.join(found, [key, "block"], "left").withColumn(
        "y", F.coalesce(F.col("_y"), F.lit(0.0))
    ).drop("_y")


def _wide(design: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    """One row per base id with the outcome of each block: a, b, ab_<i>, ba_<i>."""
    def of(label: str) -> Column:
        return F.max(F.when(F.col("block") == label, F.col("y")))

    cols = {"a": of("A"), "b": of("B")}
    for i, n in enumerate(names):
        cols[f"ab_{i}"], cols[f"ba_{i}"] = of(f"AB:{n}"), of(f"BA:{n}")
    return design.groupBy(key).agg(*[c.alias(k) for k, c in cols.items()])


def _centred(design: DataFrame) -> DataFrame:
    """Subtract the overall mean: the estimators are less noisy around zero."""
    mean = design.agg(F.avg("y").alias("_m")).select("_m").scalar()
    return design.withColumn("y", F.col("y") - mean)


def _variance(w: Column) -> Column:
    """Population variance of the A and B outcomes together."""
    a, b = F.col("a"), F.col("b")
    n = 2 * F.sum(w)
    mean = F.try_divide(F.sum(w * (a + b)), n)
    return F.try_divide(F.sum(w * (a * a + b * b)), n) - mean * mean


def _first(i: int, w: Column) -> Column:
    return F.try_divide(F.sum(w * F.col("b") * (F.col(f"ab_{i}") - F.col("a"))), F.sum(w))


def _total(i: int, w: Column) -> Column:
    d = F.col("a") - F.col(f"ab_{i}")
    return F.try_divide(F.sum(w * d * d), F.sum(w) * 2)


def _unpivot(one: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    cells = F.explode(F.array(*[
        F.struct(F.lit(n).alias("parameter"), F.col(f"_{i}").alias("_x")) for i, n in enumerate(names)
    ]))
    return one.select(*keep, "_v", cells.alias("_c")).select(*keep, "_c.parameter", F.try_divide(F.col("_c._x"), F.col("_v")).alias("_x"))


def _index(design: DataFrame, names: Sequence[str], key: str, part, name: str) -> DataFrame:
    w = F.lit(1.0)
    one = _wide(_centred(design), names, key).agg(
        _variance(w).alias("_v"), *[part(i, w).alias(f"_{i}") for i in range(len(names))]
    )
    return _unpivot(one, names).withColumnRenamed("_x", name)


def sobol_first(design: DataFrame, names: Sequence[str], key: str = "row") -> DataFrame:
    """First-order index per parameter: mean(B (AB_i - A)) / variance (Saltelli et al. 2010)."""
    return _index(design, names, key, _first, "S1")


def sobol_total(design: DataFrame, names: Sequence[str], key: str = "row") -> DataFrame:
    """Total index per parameter: mean((A - AB_i)^2) / 2 / variance (Jansen 1999)."""
    return _index(design, names, key, _total, "ST")


def sobol_second(design: DataFrame, names: Sequence[str], key: str = "row") -> DataFrame:
    """Second-order index per pair: mean(BA_i AB_j - A B) / variance - S1_i - S1_j."""
    w = F.lit(1.0)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]

    def joint(i: int, j: int) -> Column:
        return F.avg(F.col(f"ba_{i}") * F.col(f"ab_{j}") - F.col("a") * F.col("b")) - _first(i, w) - _first(j, w)

    one = _wide(_centred(design), names, key).agg(
        _variance(w).alias("_v"), *[joint(i, j).alias(f"_{i}_{j}") for i, j in pairs]
    )
    cells = F.explode(F.array(*[
        F.struct(F.lit(names[i]).alias("parameter1"), F.lit(names[j]).alias("parameter2"), F.col(f"_{i}_{j}").alias("_x"))
        for i, j in pairs
    ]))
    return one.select("_v", cells.alias("_c")).select(
        "_c.parameter1", "_c.parameter2", F.try_divide(F.col("_c._x"), F.col("_v")).alias("S2")
    )


def _repeats(design: DataFrame, names: Sequence[str], b: int, key: str, seed: int, values: Sequence[Column]) -> DataFrame:
    """One row: arrays over b Poisson-weighted repeats of the base rows.

    ``_v`` is the variance, ``_0``, ``_1``, ... are the weighted means of ``values``.
    """
    wide = _wide(_centred(design), names, key)
    x, y = F.col("a"), F.col("b")
    moments = [F.lit(1.0), x + y, x * x + y * y, *values]
    sums = weighted_sums(wide, [], poisson_weights(b, seed, "sobol", key), moments, b)
    w = F.col("sums")[0]

    def mean(i: int) -> Column:
        return F.zip_with(F.col("sums")[i], w, F.try_divide)

    off, squares = mean(1), mean(2)
    # Each base row has an A and a B outcome.
    variance = F.zip_with(squares, off, lambda q, m: q / 2 - m * m / 4)
    return sums.select(variance.alias("_v"), *[mean(i + 3).alias(f"_{i}") for i in range(len(values))])


def _half_width(part: Column) -> Column:
    return F.lit(Z95) * array_deviation(F.zip_with(part, F.col("_v"), F.try_divide))


def _named_rows(one: DataFrame, cells: Sequence[tuple[Sequence[str], Mapping[str, Column]]], keys: Sequence[str]) -> DataFrame:
    """One row per cell (names, columns) of a one-row table."""
    packed = one.select(*[
        F.struct(*[F.lit(n).alias(k) for k, n in zip(keys, names)], *[c.alias(k) for k, c in columns.items()]).alias(f"_{i}")
        for i, (names, columns) in enumerate(cells)
    ])
    return packed.unpivot([], packed.columns, "_from", "_cell").select("_cell.*")


def _first_terms(names: Sequence[str]) -> list[Column]:
    return [F.col("b") * (F.col(f"ab_{i}") - F.col("a")) for i in range(len(names))]


def sobol_confidence(
    design: DataFrame, names: Sequence[str], b: int = 100, key: str = "row", seed: int = 42
) -> DataFrame:
    """95% half-widths S1_conf and ST_conf, from b Poisson-weighted repeats of the base rows."""
    gaps = [F.col("a") - F.col(f"ab_{i}") for i in range(len(names))]
    one = _repeats(design, names, b, key, seed, _first_terms(names) + [d * d / 2 for d in gaps])
    cells = [
        ([n], {"S1_conf": _half_width(F.col(f"_{i}")), "ST_conf": _half_width(F.col(f"_{i + len(names)}"))})
        for i, n in enumerate(names)
    ]
    return _named_rows(one, cells, ["parameter"])


def sobol_second_confidence(
    design: DataFrame, names: Sequence[str], b: int = 100, key: str = "row", seed: int = 42
) -> DataFrame:
    """95% half-width S2_conf per pair of parameters, from the same repeats as ``sobol_confidence``."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    first = _first_terms(names)
    joint = [F.col(f"ba_{i}") * F.col(f"ab_{j}") - F.col("a") * F.col("b") - first[i] - first[j] for i, j in pairs]
    one = _repeats(design, names, b, key, seed, joint)
    cells = [([names[i], names[j]], {"S2_conf": _half_width(F.col(f"_{k}"))}) for k, (i, j) in enumerate(pairs)]
    return _named_rows(one, cells, ["parameter1", "parameter2"])
