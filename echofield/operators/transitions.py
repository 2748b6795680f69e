"""Reactions to exposures and the class changes they cause."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofield import schemas as S
from echofield.functions.columns import require, uni


def label_reactions(
    exposures: DataFrame, mode: str = "exposure", seed: int = 42, step: int = 0
) -> DataFrame:
    """Add reactionProb and the reacted flag.

    mode "exposure": attention x intensity / 2.  mode "person": the same times
    the person's reactionProb x (1 - fatigue), which the input must carry.
    """
    require(mode in ("exposure", "person"), f"unknown mode {mode}")
    p = F.col("attentionSpan") * F.col("intensity") * F.lit(S.REACTION_RATE)
    if mode == "person":
        p = p * F.col("reactionProb") * (F.lit(1.0) - F.col("fatigue"))
    roll = uni(seed, f"react.{step}", "humanId", "contentId")
    out = exposures.withColumn("_p", p)
    return out.withColumn("reacted", roll < F.col("_p")).withColumn("reactionProb", F.col("_p")).drop("_p")


def delta_of(kind: Column, reacted: Column) -> Column:
    """Signed effect of one interaction by its type and whether it was reacted to."""
    def side(i: int) -> Column:
        return (
            F.when(kind == S.POSITIVE, S.TYPE_DELTA[S.POSITIVE][i])
            .when(kind == S.NEGATIVE, S.TYPE_DELTA[S.NEGATIVE][i])
            .otherwise(F.lit(0.0))
        )
    return F.when(reacted, side(0)).otherwise(side(1))


def emotion_delta(df: DataFrame) -> DataFrame:
    """Add emotionDelta."""
    return df.withColumn("emotionDelta", delta_of(F.col("emotionType"), F.col("reacted")))


def signal_totals(df: DataFrame, key: str = "humanId") -> DataFrame:
    """Summed emotionDelta per entity.

    Deltas are hundredths and totals are compared with thresholds, so they are
    added as decimals: the sum does not depend on the order of the rows.
    """
    exact = F.sum(F.col("emotionDelta").cast("decimal(18,6)")).cast("double")
    return df.groupBy(key).agg(exact.alias("totalEmotionDelta"))


def class_pressure(
    state: DataFrame, joy_multiplier: float = 1.0, rage_multiplier: float = 1.0
) -> DataFrame:
    """One row: joyPressure and ragePressure, each class share x multiplier x base rate."""
    def share(label: str) -> Column:
        n = F.count(F.lit(1))
        return F.when(n > 0, F.count_if(F.col("mood") == label) / n).otherwise(F.lit(0.0))

    return state.agg(
        (share(S.JOY) * F.lit(joy_multiplier) * F.lit(S.BASE_RATE)).alias("joyPressure"),
        (share(S.RAGE) * F.lit(rage_multiplier) * F.lit(S.BASE_RATE)).alias("ragePressure"),
    )


# Totals that move a class on their own, and the rate at which JOY fades.
NEUTRAL_AT, JOY_LOST_AT, RAGE_LOST_AT = 0.2, -0.3, 0.4
JOY_FADE = 0.5


def class_transition(
    state: DataFrame,
    totals: DataFrame | None,
    pressure: DataFrame,
    stickiness: float = 0.3,
    seed: int = 42,
    step: int = 0,
    key: str = "humanId",
) -> DataFrame:
    """Move each entity between classes by one roll against the pressures, then by its total.

    Without ``totals`` only the pressures act.  The pressures are one row and
    enter the plan as scalar subqueries.
    """
    joy, rage = pressure.select("joyPressure").scalar(), pressure.select("ragePressure").scalar()
    if totals is None:
        df = state.withColumn("_delta", F.lit(0.0))
    else:
        df = state.join(totals.select(key, F.col("totalEmotionDelta").alias("_delta")), key, "left")
    df = df.withColumns({
        "_delta": F.coalesce(F.col("_delta"), F.lit(0.0)),
        "_roll": uni(seed, f"class.{step}", key), "_joy": joy, "_rage": rage,
    })
    roll, delta, joy, rage = (F.col(c) for c in ("_roll", "_delta", "_joy", "_rage"))
    mood = F.col("mood")
    after: Mapping[str, Column] = {
        S.NEUTRAL: F.when(roll < rage, S.RAGE).when(roll < rage + joy, S.JOY)
        .when(delta > NEUTRAL_AT, S.JOY).when(delta < -NEUTRAL_AT, S.RAGE).otherwise(S.NEUTRAL),
        S.JOY: F.when((roll < rage * F.lit(JOY_FADE)) | (delta < JOY_LOST_AT), S.NEUTRAL).otherwise(S.JOY),
        S.RAGE: F.when((roll < joy * F.lit(stickiness)) | (delta > RAGE_LOST_AT), S.NEUTRAL).otherwise(S.RAGE),
    }
    moved = mood
    for label, choice in after.items():
        moved = F.when(mood == label, choice).otherwise(moved)
    return df.withColumn("mood", moved).drop("_delta", "_roll", "_joy", "_rage")
