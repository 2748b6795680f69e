"""Sampling rows and drawing columns; every choice is keyed (see functions.columns)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofield import schemas as S
from echofield.functions.columns import as_col, require, uni


def bernoulli_filter(
    df: DataFrame, p: Column | str | float, keys: Sequence[str], seed: int = 42, salt: str = "roll"
) -> DataFrame:
    """Keep a row when its keyed roll is below ``p`` (a number, a column or its name)."""
    prob = F.lit(float(p)) if isinstance(p, (int, float)) else as_col(p)
    return df.filter(uni(seed, salt, *keys) < prob)


def sample_rows(
    df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42, salt: str = "sample"
) -> DataFrame:
    """Keep about ``fraction`` of the rows; the same rows whatever the partitioning."""
    require(0.0 <= fraction <= 1.0, "fraction must be in [0, 1]")
    return bernoulli_filter(df, fraction, keys, seed, salt)


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` distinct random keys: a top-n by keyed roll, not a full sort."""
    return df.select(key).distinct().orderBy(uni(seed, "keys", key), key).limit(n)


def draw_category(
    df: DataFrame, name: str, shares: Mapping[str, float], keys: Sequence[str],
    seed: int = 42, salt: str = "category",
) -> DataFrame:
    """Add a category drawn by cumulative shares; the last one takes the remainder."""
    labels = list(shares)
    roll = uni(seed, salt, *keys)
    edge, choice = 0.0, None
    for label in labels[:-1]:
        edge += shares[label]
        hit = roll < F.lit(edge)
        choice = F.when(hit, label) if choice is None else choice.when(hit, label)
    last = F.lit(labels[-1])
    return df.withColumn(name, last if choice is None else choice.otherwise(last))


def draw_range(
    df: DataFrame, ranges: Mapping[str, tuple[float, float]], keys: Sequence[str], seed: int = 42
) -> DataFrame:
    """Add one uniform column in [lo, hi) per entry of ``ranges``."""
    return df.withColumns({
        name: F.lit(float(lo)) + uni(seed, name, *keys) * F.lit(float(hi) - float(lo))
        for name, (lo, hi) in ranges.items()
    })


def synth_entities(
    ids: DataFrame,
    key: str = "humanId",
    shares: Sequence[float] = S.INITIAL_SHARES,
    continuous: bool = True,
    seed: int = 42,
) -> DataFrame:
    """A population on the given ids: class by shares (JOY, NEUTRAL, rest RAGE) and traits."""
    joy, neutral = shares
    mix = {S.JOY: joy, S.NEUTRAL: neutral, S.RAGE: 1.0 - joy - neutral}
    people = draw_category(ids.select(key), "mood", mix, [key], seed, "mood")
    people = draw_range(people, S.TRAITS, [key], seed)
    if not continuous:
        return people
    affect = {
        part: F.when(F.col("mood") == S.JOY, S.CLASS_AFFECT[S.JOY][i])
        .when(F.col("mood") == S.RAGE, S.CLASS_AFFECT[S.RAGE][i])
        .otherwise(S.CLASS_AFFECT[S.NEUTRAL][i])
        for i, part in enumerate(("valence", "arousal"))
    }
    return draw_range(people.withColumns(affect), S.BASELINES, [key], seed)


def synth_items(ids: DataFrame, key: str = "contentId", seed: int = 42) -> DataFrame:
    """Items on the given ids: type in thirds, intensity and half-life ranges, created at 0."""
    items = draw_category(ids.select(key), "emotionType", S.ITEM_TYPE_SHARES, [key], seed, "type")
    return draw_range(items, S.ITEM_RANGES, [key], seed).withColumn(
        "createdAtStep", F.lit(0).cast("long")
    )


def prior_draws(
    ids: DataFrame, bounds: Mapping[str, tuple[float, float]], key: str = "draw", seed: int = 42
) -> DataFrame:
    """One draw from uniform boxes per id."""
    return draw_range(ids.select(key), bounds, [key], seed)
