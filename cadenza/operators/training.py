"""Training of many small networks at once, in mini-batches on the cluster, with restarts of stuck runs.

Rows are dealt to shards by a hash of their key. In a pass, each shard starts from the same weights and takes the optimiser's steps through
its rows in batches, in an order that the seed, the pass and the keys decide; weights and optimiser states of all shards are then averaged,
in the order of shards. So a pass is one job that takes many steps, whatever partitions or executors there are the weights come out alike,
and only one average a run reaches the driver. Which runs take part in the next pass depends on their results.
"""

from __future__ import annotations

import copy
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pandas as pd
from cadenza.functions.autoencoder import ConvolutionalAutoencoder, Losses
from cadenza.functions.layers import Optimiser, Plateau
from cadenza.functions.models import Regressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 20_000
BLOCK = 1 << 14  # numbers of a state that travel together
FAN = 32  # states that one group averages


class Task(Protocol):
    """What a network is trained on: columns, their arrays, sums of losses and gradients, and sums by which it is judged (the first is watched)."""

    model: Any
    columns: list[str]

    def arrays(self, rows: pd.DataFrame) -> tuple[np.ndarray, ...]: ...
    def begin(self, seed: int) -> None: ...
    def parameters(self) -> list[np.ndarray]: ...
    def gradient(self, arrays: tuple[np.ndarray, ...], drop: Callable | None) -> tuple[float, list[np.ndarray]]: ...
    def judged(self, arrays: tuple[np.ndarray, ...]) -> np.ndarray: ...
    def report(self, sums: np.ndarray, rows: int) -> list[float]: ...


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.stack([np.asarray(c, float) for c in b]) for b in column])


@dataclass
class BeatTask:
    """An autoencoder of the column `beat`. It is judged by the plain loss, and reports errors by channel in degrees."""

    model: ConvolutionalAutoencoder
    losses: Losses = Losses()
    columns: list[str] = field(default_factory=lambda: ["beat"])

    def arrays(self, rows):
        x = _stack(rows["beat"])
        if x.ndim != 3:
            raise ValueError(f"beats are (rows, channels, length), not {x.shape}")
        return (x,)

    def begin(self, seed):
        self.model.begin(seed)

    def parameters(self):
        return list(self.model.named.values())

    def gradient(self, arrays, drop):
        loss, grads = self.model.gradient(arrays[0], self.losses, drop if self.model.dropout else None)
        return loss, [grads[k] for k in self.model.named]

    def judged(self, arrays):
        plain, squares = self.model.squares(arrays[0])
        return np.concatenate([[plain], squares])

    def report(self, sums, rows):
        return self.model.degrees(sums[1:], rows)


@dataclass
class RegressionTask:
    """A regressor of `latent` and `duration` on `features`. It is judged by the loss that it is trained on."""

    model: Regressor
    inputs: int
    latents: int
    duration_mean: float
    duration_sd: float
    duration_weight: float = 1.0
    columns: list[str] = field(default_factory=lambda: ["features", "latent", "duration"])

    def arrays(self, rows):
        return np.stack(rows["features"].to_numpy()).astype(float), np.stack(rows["latent"].to_numpy()).astype(float), rows["duration"].to_numpy(float)

    def begin(self, seed):
        self.model.begin(self.inputs, self.latents, self.duration_mean, self.duration_sd, seed)

    def parameters(self):
        return self.model.weights + self.model.biases

    def gradient(self, arrays, drop):
        x, latent, duration = arrays
        return self.model.gradient(x, self.model.targets(latent, duration), self.duration_weight, drop if self.model.dropout else None)

    def judged(self, arrays):
        return np.array([self.gradient(arrays, None)[0]])

    def report(self, sums, rows):
        return []


@dataclass(frozen=True)
class Restart:
    """A run whose best loss lies over `threshold` when `check` passes are done is stuck; it starts anew with another seed, `attempts` times
    at most."""

    check: int
    threshold: float
    attempts: int = 3


@dataclass
class Run:
    """One configuration and how far it has come."""

    task: Task
    optimiser: Optimiser = field(default_factory=Optimiser)
    epochs: int = 100
    batch: int = 32
    seed: int = 42
    restart: Restart | None = None
    name: dict = field(default_factory=dict)

    attempt: int = 0
    epoch: int = 0
    steps: int = 0
    stuck: bool = False
    done: bool = False
    best: float = math.inf
    best_epoch: int = 0
    best_task: Task | None = None
    best_report: list[float] = field(default_factory=list)
    train_losses: list[float] = field(default_factory=list)
    val_losses: list[float] = field(default_factory=list)
    seconds: float = 0.0

    def start(self) -> None:
        """Fresh weights of the attempt's seed, and nothing known."""
        self.task.begin(self.sub_seed)
        self.size = sum(p.size for p in self.task.parameters())
        self.state = np.zeros((self.optimiser.slots, self.size))
        self.plateau = Plateau(self.optimiser.rate)
        self.epoch = self.steps = self.best_epoch = 0
        self.stuck, self.done, self.best, self.best_task, self.best_report, self.train_losses, self.val_losses = False, self.epochs < 1, math.inf, None, [], [], []

    @property
    def sub_seed(self) -> int:
        return self.seed if self.attempt == 0 else self.seed * 1000 + self.attempt

    def seen(self, train: float, val: float | None, report: list[float]) -> None:
        """Takes a pass's losses and decides what is next: another pass, another attempt, or the end."""
        self.epoch += 1
        watched = train if val is None else val
        self.train_losses.append(train)
        if val is not None:
            self.val_losses.append(val)
        self.plateau.see(watched)
        if watched < self.best:
            self.best, self.best_epoch, self.best_task, self.best_report = watched, self.epoch, copy.deepcopy(self.task), report
        if self.restart and self.epoch == self.restart.check and self.best > self.restart.threshold:
            self.stuck = True
            if self.attempt < self.restart.attempts:
                self.attempt += 1
                self.start()
                return
        self.done = self.stuck or self.epoch >= self.epochs


def _order(keys: np.ndarray, seed: int, epoch: int) -> np.ndarray:
    """A permutation that the keys, the seed and the pass decide."""
    salt = np.random.Generator(np.random.Philox(key=[seed, epoch])).integers(0, 1 << 63, dtype=np.uint64)
    h = (keys.astype(np.int64).view(np.uint64) ^ salt) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.lexsort([keys, h])


def _draws(keys: np.ndarray, seed: int, epoch: int) -> Callable:
    """Uniform numbers that belong to a row, a pass and a place in the network."""
    return lambda shape, place: np.stack([np.random.Generator(np.random.Philox(key=[(seed << 20) + epoch, int(k) & (1 << 63) - 1], counter=[place, 0, 0, 0])).random(shape[1:]) for k in keys])


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in parts])


def _put(task: Task, flat: np.ndarray) -> None:
    at = 0
    for p in task.parameters():
        p[...] = flat[at : at + p.size].reshape(p.shape)
        at += p.size


_STATES = "run int, block int, shard long, n long, steps long, loss double, data binary"


def _passed(shared) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """applyInPandas on a shard: every active run's state after its steps through the shard's rows."""

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = rows.sort_values("key", kind="stable")
        keys = rows["key"].to_numpy()
        for number, (task, optimiser, state, batch, seed, epoch, steps, rate) in shared.value.items():
            task, state = copy.deepcopy(task), state.copy()
            arrays = task.arrays(rows)
            p, t, loss = _flat(task.parameters()), steps, 0.0
            order = _order(keys, seed, epoch)
            for a in range(0, len(order), batch):
                at = order[a : a + batch]
                one, grads = task.gradient(tuple(x[at] for x in arrays), _draws(keys[at], seed, epoch))
                loss += one
                t += 1
                optimiser.step(p, _flat(grads) / len(at), state, t, rate)
                _put(task, p)
            whole = np.concatenate([p, state.ravel()])
            for block, low in enumerate(range(0, len(whole), BLOCK)):
                out.append((number, block, int(rows["shard"].iloc[0]), len(rows), t - steps, loss, whole[low : low + BLOCK].tobytes()))
        return pd.DataFrame(out, columns=["run", "block", "shard", "n", "steps", "loss", "data"])

    return go


def _averaged(rows: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas on states of one run and block: their average, weighted by rows, summed in the order of shards."""
    rows = rows.sort_values("shard")
    total, n = 0.0, int(rows["n"].sum())
    for data, weight in zip(rows["data"], rows["n"], strict=True):
        total = total + np.frombuffer(data) * (weight / n)
    first = rows.iloc[0]
    return pd.DataFrame([(first["run"], first["block"], first["shard"] // FAN, n, rows["steps"].max(), rows["loss"].sum(), total.tobytes())], columns=rows.columns)


def _pass(train: DataFrame, shards: int, runs: dict[int, Run]) -> dict[int, float]:
    """One pass of every run over all train rows; the mean loss on the way."""
    shared = train.sparkSession.sparkContext.broadcast({k: (r.task, r.optimiser, r.state, r.batch, r.sub_seed, r.epoch, r.steps, r.plateau.rate) for k, r in runs.items()})
    found = train.groupBy("shard").applyInPandas(_passed(shared), _STATES)
    while shards > 1:
        found = found.withColumn("group", F.floor(F.col("shard") / FAN)).groupBy("run", "block", "group").applyInPandas(lambda rows: _averaged(rows.drop(columns="group")), _STATES)
        shards = -(-shards // FAN)
    whole: dict[int, dict[int, Any]] = {}
    for r in found.collect():  # one state a run
        whole.setdefault(r["run"], {})[r["block"]] = r
    shared.destroy()
    losses = {}
    for k, blocks in whole.items():
        run, flat = runs[k], np.concatenate([np.frombuffer(blocks[b]["data"]) for b in sorted(blocks)])
        _put(run.task, flat[: run.size])
        run.state = flat[run.size :].reshape(run.optimiser.slots, run.size).copy()
        run.steps += blocks[0]["steps"]
        losses[k] = blocks[0]["loss"] / blocks[0]["n"]
    return losses


def _judge(rows: DataFrame, runs: dict[int, Run]) -> dict[int, tuple[float, list[float]]]:
    """Mean watched loss and report of every run on the rows. Sums of shards are added as decimals, so that their order doesn't matter."""
    shared = rows.sparkSession.sparkContext.broadcast({k: r.task for k, r in runs.items()})

    def go(part: pd.DataFrame) -> pd.DataFrame:
        part, out = part.sort_values("key", kind="stable"), []
        for k, task in shared.value.items():
            total = 0.0
            for a in range(0, len(part), 1024):
                total = total + task.judged(task.arrays(part.iloc[a : a + 1024]))
            out += [(k, place, len(part), float(s)) for place, s in enumerate(total)]
        return pd.DataFrame(out, columns=["run", "place", "n", "s"])

    sums = rows.groupBy("shard").applyInPandas(go, "run int, place int, n long, s double").groupBy("run", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,12)")).cast("double").alias("s"))
    found: dict[int, list] = {}
    for r in sums.orderBy("run", "place").collect():
        found.setdefault(r["run"], []).append(r)
    shared.destroy()
    return {k: (rs[0]["s"] / rs[0]["n"], runs[k].task.report(np.array([r["s"] for r in rs]), rs[0]["n"])) for k, rs in found.items()}


def train(rows: DataFrame, runs: list[Run], shard_rows: int = SHARD_ROWS) -> list[Run]:
    """Trains all runs in step until each has done its passes or is stuck for good; they come back with losses and the best pass's network.

    rows: key (long, unique), role ('train' or 'val') and the tasks' columns. Without val rows the loss on the way is watched. A shard holds
    about shard_rows rows and is one group; the number of rows has no bound.
    """
    columns = sorted({c for r in runs for c in r.task.columns})
    n = rows.where("role = 'train'").count()
    if not n:
        raise ValueError("no train rows")
    shards = max(1, -(-n // shard_rows))
    dealt = rows.select("key", "role", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), *columns).repartition(min(shards, 4096), "shard").persist()
    learn, held = dealt.where("role = 'train'"), dealt.where("role = 'val'")
    some_held = not held.isEmpty()
    for r in runs:
        r.attempt = 0
        r.start()
    while True:
        active = {k: r for k, r in enumerate(runs) if not r.done}
        if not active:
            break
        began = time.perf_counter()
        losses = _pass(learn, shards, active)
        judged = _judge(held, active) if some_held else {}
        took = (time.perf_counter() - began) / len(active)
        for k, r in active.items():
            r.seconds += took
            val, report = judged.get(k, (None, []))
            r.seen(losses[k], val, report)
    dealt.unpersist()
    return runs


def summary(spark, runs: list[Run]) -> DataFrame:
    """A row a run: its name as JSON, best loss, errors in degrees at the best pass, passes, attempts, whether it ended stuck, and time."""
    import json

    out = []
    for k, r in enumerate(runs):
        s = int(r.seconds)
        out.append((k, json.dumps(r.name, sort_keys=True), float(r.best), [float(x) for x in r.best_report] or None, r.best_epoch, r.epoch, r.attempt + 1, r.stuck, float(r.seconds), f"{s // 3600}:{s // 60 % 60:02d}:{s % 60:02d}"))
    return spark.createDataFrame(out, "run int, name string, best_val_loss double, best_val_rmse_deg array<double>, best_epoch int, epochs int, attempts int, final_was_stuck boolean, train_seconds double, train_time_hms string")


def attempts(losses: DataFrame, check: int, threshold: float, most: int, by: str = "run") -> DataFrame:
    """(run, attempts, final_was_stuck, best_val_loss): how the restart rule treats runs whose attempts' losses are known.

    losses: (run, attempt from 0, epoch from 1, val_loss). An attempt is stuck if its best loss by `check` lies over the threshold; the first
    attempt that isn't, or else attempt `most`, is the last; its losses count, to `check` only if it is stuck. Runs lacking an attempt that
    they would need end with the last one they have.
    """
    early = F.min(F.when(F.col("epoch") <= check, F.col("val_loss")))
    known = losses.where(F.col("attempt") <= most).groupBy(by, "attempt").agg(early.alias("early"), F.min("val_loss").alias("all"), F.max("epoch").alias("epochs"))
    judged = known.withColumn("stuck", (F.col("epochs") >= check) & (F.col("early") > threshold))
    fine = F.min(F.when(~F.col("stuck"), F.col("attempt")))
    last = judged.groupBy(by).agg(F.coalesce(fine, F.max("attempt")).alias("attempt"))
    return judged.join(last, [by, "attempt"]).select(by, (F.col("attempt") + 1).alias("attempts"), F.col("stuck").alias("final_was_stuck"), F.when(F.col("stuck"), F.col("early")).otherwise(F.col("all")).alias("best_val_loss"))
