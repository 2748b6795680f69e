"""Timers of the event fold, on stand-ins for the state of one entity."""

from __future__ import annotations

from types import SimpleNamespace

import pandas as pd

from echofield.streaming.events import FoldSteps


def test_one_timer_folds_all_closed_steps():
    timers, kept, level = [], {}, []
    fold = FoldSteps("who", 0, 10, 0.3, 0.02, 0.05)
    fold.handle = SimpleNamespace(registerTimer=timers.append)
    fold.open = SimpleNamespace(
        iterator=lambda: iter(list(kept.items())), containsKey=lambda k: k in kept, getValue=kept.get,
        keys=lambda: iter(list(kept)), updateValue=kept.__setitem__, removeKey=kept.pop)
    fold.level = SimpleNamespace(exists=lambda: bool(level), get=lambda: level[-1], update=level.append)
    rows = pd.DataFrame({"step": [0, 1, 3, 8], "n": [1, 0, 2, 1]})
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    assert not list(fold.handleInputRows((1,), iter([rows]), at(0))) and timers == [10]
    (out,) = fold.handleExpiredTimer((1,), at(50), SimpleNamespace(getExpiryTimeInMs=lambda: 10))
    assert list(out["step"]) == [0, 1, 3] and timers == [10, 90] and set(kept) == {(8,)}
