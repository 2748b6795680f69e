"""Data-quality checks on tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofield import schemas as S
from echofield.operators.affect import class_of


def check_ranges(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """One row per bound: is the column there, and how many values lie outside (nulls do not)."""
    present = [c for c in bounds if c in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(~F.col(c).between(*bounds[c])).alias(c) for c in present],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.lit(c in present).alias("present"),
            (F.col(c) if c in present else F.lit(None).cast("long")).alias("violations"),
        )
        for c in bounds
    ]
    return counts.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def check_domain(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside the allowed set with their counts; null counts as outside."""
    bad = ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return df.filter(bad).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def check_class_consistency(
    df: DataFrame, tolerance: float = 0.1, cut: float = 0.3, label: str = "mood"
) -> DataFrame:
    """Rows whose stored class differs from the class of their valence and that are not near a cut."""
    def near(c: str) -> Column:
        return F.abs(F.abs(F.col(c)) - F.lit(cut)) < tolerance

    expected = class_of(F.col("valence"), cut)
    differs = ~F.coalesce(F.col(label) == expected, F.lit(False))
    return df.withColumn("expected", expected).filter(differs & ~near("valence") & ~near("arousal"))


def check_params(df: DataFrame, rules: Mapping[str, tuple] = S.PARAM_RULES) -> DataFrame:
    """Add failed_rules: names of parameters out of range or missing, and the k parity rule."""
    failed = []
    for name, (_, _, lo, hi) in rules.items():
        if name not in df.columns:
            continue
        c = F.col(name)
        failed.append(F.when(c.isNull(), F.lit(f"{name}: missing")))
        if lo is not None:
            failed.append(F.when(c < lo, F.lit(f"{name}: below {lo}")))
        if hi is not None:
            failed.append(F.when(c > hi, F.lit(f"{name}: above {hi}")))
        if name == "networkK":
            failed.append(F.when(c % 2 != 0, F.lit(f"{name}: odd")))
    empty = F.array().cast("array<string>")
    return df.withColumn("failed_rules", F.array_compact(F.array(*failed)) if failed else empty)
