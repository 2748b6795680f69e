"""Running fatigue per entity over a stream of interactions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "step long, fatigue double"


def _advance(x: float, idle: int, n: int, accumulation: float, recovery: float) -> float:
    """The batch rule: ``idle`` steps of recovery, then one step with n reactions."""
    x = min(1.0, max(0.0, x - recovery * idle))
    return min(1.0, max(0.0, x + (n * accumulation if n > 0 else -recovery)))


def stream_step_counts(
    stream: DataFrame, origin: str, key: str = "humanId", ts: str = "ts",
    width: str = "1 day", delay: str = "1 hour",
) -> DataFrame:
    """(key, step, n reactions) once a step is closed; steps are ``width`` long from ``origin``.

    Partial counts in every task mean that a very active entity is shuffled as
    one row per task and step.
    """
    counts = (
        stream.withWatermark(ts, delay)
        .groupBy(F.col(key), F.window(F.col(ts), width).alias("_w"))
        .agg(F.count_if(F.col("reacted")).alias("n"))
    )
    begin = F.unix_micros(F.col("_w.start"))
    size = F.unix_micros(F.col("_w.end")) - begin
    first = F.unix_micros(F.lit(origin).cast("timestamp"))
    return counts.select(key, F.floor((begin - first) / size).cast("long").alias("step"), "n")


def stream_fold(
    counts: DataFrame,
    key: str = "humanId",
    start: float = 0.0,
    accumulation: float = 0.02,
    recovery: float = 0.01,
) -> DataFrame:
    """(key, step, n, fatigue) for each closed step in a stream of step counts.

    ``counts`` is the stream of the table that ``stream_step_counts`` writes
    (Spark allows no grouped state right after a streaming aggregate).  State
    is the last step and level of the entity; idle steps are caught up in
    closed form.  The result equals the batch fold over the same steps, however
    they are dealt to micro-batches.  Steps of an entity have to arrive in order
    from one micro-batch to the next: what has been written cannot be taken
    back, so a step at or before the last one is refused with an error.
    """
    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, level = state.get if state.exists else (-1, start)
        # One row per step of this entity: what has closed since the last batch.
        pdf = pd.concat(list(parts)).sort_values("step")
        levels = []
        for s, n in zip(pdf["step"], pdf["n"]):
            if int(s) <= at:
                raise ValueError(f"step {s} of {k[0]} arrived after step {at}")
            level = _advance(level, int(s) - at - 1, int(n), accumulation, recovery)
            at = int(s)
            levels.append(level)
        state.update((at, level))
        yield pd.DataFrame({key: k[0], "step": pdf["step"], "n": pdf["n"], "fatigue": levels})

    return counts.groupBy(key).applyInPandasWithState(
        fold, f"{key} long, step long, n long, fatigue double", STATE, "append", GroupStateTimeout.NoTimeout
    )
