"""Whole beats of flights that arrive as a stream of frames.

A flight's state is what can still change: for each wing the level it is on and the peaks that a later, higher one may push out, and the frames
since the last boundary. A peak stays once every peak that could push it out is known and lower, so beats come out as those of the whole
recording would.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class Peaks:
    """Peaks of one wing, found one value at a time. `near` are those not decided on, `chosen` the decided ones behind one that isn't, and
    `settled` are final and in order."""

    spacing: int
    first: int = 0
    last: int = -1
    level: float | None = None
    rose: bool = False
    near: list[tuple[int, float]] = field(default_factory=list)
    chosen: list[int] = field(default_factory=list)
    settled: list[int] = field(default_factory=list)

    def push(self, at: int, x: float) -> None:
        if self.level is None:
            self.first, self.level, self.rose = at, x, False
        elif x != self.level:
            if x < self.level and self.rose:
                self.near.append(((self.first + self.last) // 2, self.level))
            self.first, self.rose, self.level = at, x > self.level, x
        self.last = at

    def decide(self, whole: bool = False) -> None:
        """A peak stays once all peaks that can lie within the spacing are known and it is the highest of those that may still stay (the later
        of equals); these then go. whole: no more peaks will come."""
        soonest = (self.first + self.last) // 2 if self.rose else self.last + 1
        going = True
        while going:
            going = False
            for at, height in self.near:
                if not whole and soonest - at < self.spacing:
                    break
                rivals = [p for p in self.near if abs(p[0] - at) < self.spacing]
                if max(rivals, key=lambda p: (p[1], p[0])) == (at, height):
                    self.chosen.append(at)
                    self.near = [p for p in self.near if p not in rivals]
                    going = True
                    break
        self.chosen.sort()
        while self.chosen and (not self.near or self.chosen[0] < self.near[0][0]):
            self.settled.append(self.chosen.pop(0))

    def soonest(self) -> int:
        """No peak that is to come out lies before this place."""
        known = [x[0] for x in (self.settled, self.chosen) if x] + [p[0] for p in self.near[:1]]
        return min([*known, self.first if self.rose else self.last + 1])


class Segmenter:
    """Beats of one flight: pushed frames give those that are settled, close() gives the rest."""

    def __init__(self, spacing: int):
        self.left, self.right = Peaks(spacing), Peaks(spacing)
        self.seen, self.begin, self.idx, self.newest = 0, 0, 0, None
        self.start: int | None = None  # place of the open beat's boundary
        self.orders: list[int] = []
        self.values: list[list[float]] = []

    def push(self, orders: list[int], values: list[list[float]], wings: tuple[int, int]) -> list[tuple]:
        """orders rising; values: a list of channels for each frame. Frames that come no later than what was seen are dropped."""
        for order, frame in zip(orders, values, strict=True):
            if self.newest is not None and order <= self.newest:
                continue
            self.newest = order
            self.orders.append(order)
            self.values.append(frame)
            self.left.push(self.seen, frame[wings[0]])
            self.right.push(self.seen, frame[wings[1]])
            self.seen += 1
        self.left.decide()
        self.right.decide()
        out = self._beats()
        self._forget()
        return out

    def close(self) -> list[tuple]:
        self.left.decide(whole=True)
        self.right.decide(whole=True)
        return self._beats()

    def _beats(self) -> list[tuple]:
        out = []
        while self.left.settled and self.right.settled:
            at = (self.left.settled.pop(0) + self.right.settled.pop(0)) // 2
            if self.start is not None:
                a, b = self.start - self.begin, at - self.begin
                seg = np.array(self.values[a:b]).T
                if b - a > 1:
                    out.append((self.idx, self.orders[a], self.orders[b], self.orders[b] - self.orders[a], seg.tolist()))
                self.idx += 1
            self.start = at
        return out

    def _forget(self) -> None:
        """Drops frames before the open beat; before the first boundary, those before any place where it can be."""
        keep = self.start if self.start is not None else min(self.left.soonest(), self.right.soonest(), self.seen)
        gone = keep - self.begin
        if gone > 0:
            del self.orders[:gone], self.values[:gone]
            self.begin = keep


def stream_beats(frames: DataFrame, columns: list[str], wings: tuple[str, str], key: str = "trajectory_id", order: str = "frame", time: str | None = None, spacing: int = 50, idle_ms: int = 60_000) -> DataFrame:
    """(key, idx, start, end, duration, seg) of a stream of frames: what operators.beats.segments gives of boundaries by both wings' strokes on
    the same frames.

    time: the event-time column, with a watermark. A flight whose newest frame the watermark has left `idle_ms` behind is over: its open
    beats come out and its state goes. Without `time` no flight ends, and its last peaks stay open. Frames of a batch are put in order;
    frames no later than what a flight has shown are dropped, as are frames with a null among the columns.
    """
    kind = frames.schema[key].dataType.simpleString()
    at = tuple(columns.index(w) for w in wings)

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, newest = pickle.loads(state.get[0]) if state.exists else (Segmenter(spacing), 0)
        if state.hasTimedOut:
            out = held.close()
            state.remove()
        else:
            rows = pd.concat(list(batches)).dropna(subset=columns).sort_values(order, kind="stable")
            out = held.push(rows[order].tolist(), rows[columns].to_numpy(float).tolist(), at)
            if time is not None and len(rows):
                newest = max(newest, int(rows[time].max().timestamp() * 1000))
            state.update((pickle.dumps((held, newest)),))
            if time is not None:
                state.setTimeoutTimestamp(max(newest + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(name[0], *o) for o in out], columns=[key, "idx", "start", "end", "duration", "seg"])

    fields = f"{key} {kind}, idx long, start long, end long, duration long, seg array<array<double>>"
    timeout = GroupStateTimeout.NoTimeout if time is None else GroupStateTimeout.EventTimeTimeout
    picked = frames.select(key, order, *columns, *([time] if time else []))
    return picked.groupBy(key).applyInPandasWithState(step, fields, "held binary", "append", timeout)
