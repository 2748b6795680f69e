"""Running fatigue per entity straight from a stream of interactions, with late steps set aside."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from echofield.streaming.fold import STATE, _advance

MICROS = 1_000_000


def combined(stream: DataFrame, origin: str, key: str, ts: str, seconds: int) -> DataFrame:
    """(key, step, n reactions, events) summed within each batch of rows that a task holds.

    A very active entity is then shuffled as one row per batch and step, not as
    one row per event.
    """
    first = F.unix_micros(F.lit(origin).cast("timestamp"))
    step = F.floor((F.unix_micros(F.col(ts)) - first) / F.lit(seconds * MICROS)).cast("long")
    rows = stream.select(
        F.col(key).alias(key), step.alias("step"), F.col("reacted").cast("long").alias("n"), F.lit(1).cast("long").alias("events")
    ).filter(F.col("step").isNotNull())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by([key, "step"]).aggregate([("n", "sum"), ("events", "sum")])
            yield from table.select([key, "step", "n_sum", "events_sum"]).rename_columns([key, "step", "n", "events"]).to_batches()

    return rows.mapInArrow(add_up, rows.schema)


class FoldSteps(StatefulProcessor):
    """Holds the open steps of an entity and folds each once the watermark has passed its end."""

    def __init__(self, key: str, first_ms: int, width_ms: int, start: float, accumulation: float, recovery: float) -> None:
        self.key, self.first_ms, self.width_ms = key, first_ms, width_ms
        self.start, self.accumulation, self.recovery = start, accumulation, recovery

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", STATE)
        self.open = handle.getMapState("open", "step long", "n long")

    def close(self) -> None:
        pass

    def _ends(self, step: int) -> int:
        return self.first_ms + (step + 1) * self.width_ms

    def _rows(self, key, steps: list[int], n: list[int], levels: list[float | None], late: bool) -> pd.DataFrame:
        return pd.DataFrame({
            self.key: pd.Series([key[0]] * len(steps), dtype=object if key[0] is None else None), "step": steps, "n": n,
            "fatigue": pd.Series(levels, dtype="float64"), "late": late,
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        counts: dict[int, int] = {}
        for pdf in rows:
            for step, n in pdf.groupby("step")["n"].sum().items():
                counts[int(step)] = counts.get(int(step), 0) + int(n)
        late = sorted(s for s in counts if self._ends(s) <= now)
        fresh = counts.keys() - set(late)
        held = {s: n for (s,), (n,) in self.open.iterator()} if fresh else {}
        for step in fresh:
            self.open.updateValue((step,), (counts[step] + held.get(step, 0),))
        # One timer, for the earliest open step; what it folds asks for the next one.
        if fresh and (not held or min(fresh) < min(held)):
            self.handle.registerTimer(self._ends(min(fresh)))
        if late:
            yield self._rows(key, late, [counts[s] for s in late], [None] * len(late), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = {s: n for (s,), (n,) in self.open.iterator()}
        ready = sorted(s for s in held if self._ends(s) <= now)
        if not ready:
            return
        at, level = self.level.get() if self.level.exists() else (-1, self.start)
        counts, levels = [], []
        for step in ready:
            n = held[step]
            level = _advance(level, step - at - 1, n, self.accumulation, self.recovery)
            at = step
            counts.append(n)
            levels.append(level)
            self.open.removeKey((step,))
        if len(ready) < len(held):
            self.handle.registerTimer(self._ends(min(held.keys() - set(ready))))
        self.level.update((at, level))
        yield self._rows(key, ready, counts, levels, False)


def stream_fold_events(
    stream: DataFrame, origin: str, key: str = "humanId", ts: str = "ts", seconds: int = 86_400, delay: str = "1 hour",
    start: float = 0.0, accumulation: float = 0.02, recovery: float = 0.01,
) -> DataFrame:
    """(key, step, n, fatigue, late) from a stream of events (key, ts, reacted).

    Steps are ``seconds`` long from ``origin``.  A step is folded and written
    once the watermark has passed its end; idle steps are caught up in closed
    form, so the levels equal the batch fold over the same events however they
    are dealt to micro-batches.  Events of a step that the watermark had passed
    when they came are rows of their own with ``late`` set, their number of
    reactions and no level; they change nothing else and the stream runs on.
    State is one level and the counts of the open steps per entity, kept in
    RocksDB (see ``rocksdb_state``); rows without a time are left out.
    """
    first_ms = int(stream.sparkSession.range(1).select(F.unix_millis(F.lit(origin).cast("timestamp"))).first()[0])
    fold = FoldSteps(key, first_ms, seconds * 1000, start, accumulation, recovery)
    kind = stream.schema[key].dataType.simpleString()
    rows = combined(stream.withWatermark(ts, delay), origin, key, ts, seconds)
    return rows.groupBy(key).transformWithStateInPandas(
        fold, f"{key} {kind}, step long, n long, fatigue double, late boolean", "Append", "EventTime"
    )
