"""Sobol' points, sums of many weightings, and indices of a function with known ones."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofield.functions import lowdiscrepancy as ld
from echofield.functions import vectors
from echofield.functions.columns import uni
from echofield.operators import calibration, stats

BOUNDS = {n: (-math.pi, math.pi) for n in ("p", "q", "z")}


def points(spark, n, dimensions):
    df = spark.range(n).select(*[ld.sobol(F.col("id"), d).alias(f"d{d}") for d in dimensions])
    return df.toPandas().to_numpy()


def test_polynomials_are_the_first_primitive_ones():
    # x+1, x^2+x+1, the two of degree 3, the two of degree 4
    assert ld.primitive_polynomials(6) == [0b11, 0b111, 0b1011, 0b1101, 0b10011, 0b11001]
    by_degree = [sum(1 for p in ld.primitive_polynomials(60) if p.bit_length() - 1 == d) for d in range(1, 8)]
    assert by_degree == [1, 1, 2, 2, 6, 6, 18]
    assert all(m % 2 and m < 2 << i for row in ld.INITIAL for i, m in enumerate(row))
    assert [len(row) for row in ld.INITIAL] == [p.bit_length() - 1 for p in ld.primitive_polynomials(20)]


def test_every_dimension_is_stratified(spark):
    p = points(spark, 256, range(28))
    for k in (1, 4, 8):
        for d in range(p.shape[1]):
            assert sorted(np.floor(p[:1 << k, d] * (1 << k))) == list(range(1 << k))


def test_pairs_of_dimensions_are_more_even_than_uniforms(spark):
    def discrepancy(p):
        """Squared L2 star discrepancy by Warnock's formula."""
        n, d = p.shape
        one = np.prod(1 - p * p, axis=1).sum() * 2 ** (1 - d) / n
        two = np.prod(1 - np.maximum(p[:, None, :], p[None, :, :]), axis=2).sum() / n**2
        return 3.0 ** -d - one + two

    p = points(spark, 512, range(12))
    u = spark.range(512).select(*[uni(42, f"t{d}", "id") for d in range(12)]).toPandas().to_numpy()
    for pair in ([0, 1], [3, 4], [5, 11], [10, 11]):
        assert discrepancy(p[:, pair]) < discrepancy(u[:, pair]) / 5
    assert discrepancy(p) < discrepancy(u)


def test_indices_of_the_ishigami_function(spark):
    want = np.array([0.3139, 0.4424, 0.0, 0.5576, 0.4424, 0.2437])

    def error(kind):
        d = calibration.saltelli_design(spark.range(4096).withColumnRenamed("id", "row"), BOUNDS, points=kind)
        d = d.withColumn("y", F.sin("p") + 7 * F.sin("q") * F.sin("q") + F.lit(0.1) * F.pow("z", F.lit(4)) * F.sin("p"))
        s1 = {r.parameter: r.S1 for r in calibration.sobol_first(d, list(BOUNDS)).collect()}
        st = {r.parameter: r.ST for r in calibration.sobol_total(d, list(BOUNDS)).collect()}
        got = np.array([s1[n] for n in BOUNDS] + [st[n] for n in BOUNDS])
        return np.abs(got - want).max()

    assert error("sobol") < 0.01 and error("sobol") < error("uniform")


def test_second_order_confidence_covers_the_truth(spark):
    names = ["p", "q", "z"]
    d = calibration.saltelli_design(spark.range(512).withColumnRenamed("id", "row"), {n: (0.0, 1.0) for n in names}, points="sobol")
    d = d.withColumn("y", F.col("p") * F.col("q") + F.col("z"))
    found = {(r.parameter1, r.parameter2): r.S2 for r in calibration.sobol_second(d, names).collect()}
    half = {(r.parameter1, r.parameter2): r.S2_conf for r in calibration.sobol_second_confidence(d, names, 60).collect()}
    assert set(half) == {("p", "q"), ("p", "z"), ("q", "z")}
    true = (1 / 144) / (7 / 144 + 12 / 144)  # variance of pq beyond its parts, of pq + z in all
    assert abs(found["p", "q"] - true) < 2 * half["p", "q"] + 0.01 and all(0 < h < 0.5 for h in half.values())


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_weighted_sums(spark, monkeypatch, by):
    monkeypatch.setattr(vectors, "HELD", 40)
    b, rows = 6, [(i, None if i % 7 == 0 else f"g{i % 3}", i % 2, float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, h int, v double").repartition(7)
    weights = vectors.poisson_weights(b, 1, "t", "id")
    w = {r.id: list(r.w) for r in df.select("id", weights.alias("w")).collect()}
    got = {tuple(r[:-1]): np.array(r.sums) for r in vectors.weighted_sums(df, by, weights, [F.lit(1.0), F.col("v")], b).collect()}
    want = {}
    for i, g, h, v in rows:
        key = tuple({"g": g, "h": h}[c] for c in by)
        want.setdefault(key, np.zeros((2, b)))
        want[key] += np.outer([1.0, v], w[i])
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert vectors.weighted_sums(df.filter("false"), by, weights, [F.lit(1.0)], b).count() == 0


def test_no_row_is_repeated_for_a_band(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("t"), "id", uni(1, "x", "id").alias("v"))
    band = stats.bootstrap_band(df, ["g"], "t", "v", ["id"], 200)
    assert "Generate" not in band._jdf.queryExecution().toString()
    for r in band.collect():
        assert 0.4 < r.lo < 0.5 < r.hi < 0.6 and 0.04 < r.hi - r.lo < 0.09
    empty = stats.bootstrap_band(df.withColumn("v", F.lit(None).cast("double")), ["g"], "t", "v", ["id"], 10)
    assert empty.count() == 0


def test_percentiles_and_deviation_of_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 8.0],), ([3.0],), ([],), ([None, 1.0, 3.0],)], "x array<double>")
    got = df.select(
        vectors.array_percentile(F.sort_array(F.filter("x", lambda v: v.isNotNull())), 0.5).alias("m"), vectors.array_deviation(F.col("x")).alias("d")
    ).collect()
    assert [r.m for r in got] == [3.0, 3.0, None, 2.0]
    assert got[0].d == pytest.approx(np.std([1, 2, 4, 8], ddof=1)) and got[1].d is None and got[2].d is None
    assert got[3].d == pytest.approx(math.sqrt(2))
