"""Local maxima of sequences that arrive as a stream, with state by sequence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_maxima(frames: DataFrame, key: str, order: str, value: str, idle_ms: int | None = None) -> DataFrame:
    """(key, at, height) of a stream's local maxima, as soon as a lower value follows; flat tops once at their middle (rounded down).

    The state of a sequence is its last level: where it began and ended, its value, and whether the sequence rose to it. Rows of a
    batch are put in order; rows that come no later than what a sequence has already shown are dropped. The result equals
    `operators.sequence.local_maxima` on the same rows, but for a level that the end of the data leaves open. idle_ms: a sequence that
    has shown nothing for so long is over; its state goes, and rows that come later begin anew. By default state stays.
    """
    kind = frames.schema[key].dataType.simpleString()

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last, level, rose = state.get if state.exists else (None, None, None, False)
        rows = pd.concat(list(batches)).sort_values(order)
        found = []
        for at, x in zip(rows[order].tolist(), rows[value].tolist(), strict=True):
            if last is not None and at <= last:
                continue
            if level is None:
                first, level, rose = at, x, False
            elif x != level:
                if x < level and rose:
                    found.append(((first + last) // 2, level))
                first, rose, level = at, x > level, x
            last = at
        if last is not None:
            state.update((first, last, level, rose))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [name[0]] * len(found), "at": [a for a, _ in found], "height": [h for _, h in found]})

    return frames.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at long, height double", "first long, last long, level double, rose boolean", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
