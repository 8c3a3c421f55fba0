"""Configuration sweeps."""

from __future__ import annotations

import itertools

from cadenza.functions.autoencoder import ConvolutionalAutoencoder, Losses
from cadenza.functions.layers import Optimiser
from cadenza.functions.registry import REPRESENTATIONS
from cadenza.operators.training import SHARD_ROWS, BeatTask, Restart, Run, summary, train
from cadenza.sources import models
from pyspark.sql import DataFrame, SparkSession

#: Keys whose plain value is a list; only a list of lists sweeps them.
LIST_KEYS = ("hidden_dims", "channel_weights")


def expand(spark: SparkSession, config: dict, list_keys: tuple[str, ...] = LIST_KEYS) -> DataFrame:
    """A row for each combination of the listed values, in the order of the keys, numbered `run`."""
    def choices(key, value):
        if key in list_keys:
            return value if value and isinstance(value[0], list) else [value]
        return value if isinstance(value, list) else [value]

    rows = [(*combination, i) for i, combination in enumerate(itertools.product(*(choices(k, v) for k, v in config.items())))]
    kinds = {bool: "boolean", int: "int", float: "double", str: "string", list: "array<int>"}
    fields = ", ".join(f"{k} {kinds[type(v)]}" for k, v in zip(config, rows[0], strict=False))
    return spark.createDataFrame(rows, f"{fields}, run long")


def run_of(config: dict, representation: str = "sa") -> Run:
    """A training run of an autoencoder from one configuration; what it leaves out has the defaults that stand here."""
    c = config
    named = REPRESENTATIONS[representation]
    model = ConvolutionalAutoencoder(
        latent=int(c.get("latent_dim", 16)), channels=len(named.channels), length=int(c["fixed_len"]), activation=c.get("activation", "gelu"), dropout=float(c.get("dropout", 0.0)),
        base=int(c.get("base_channels", 128)), bottleneck=int(c.get("bottleneck_len", 12)), kernel=int(c.get("decoder_kernel_size", 5)), representation=representation,
    )
    pair = c.get("channel_loss_weight")
    if pair is not None and len(pair) != 2:
        raise ValueError(f"channel_loss_weight is a weight of the symmetric and one of the asymmetric channels, not {pair}")
    weights = tuple(float(w) for w in pair for _ in range(3)) if pair is not None and named.paired else None
    losses = Losses(weights, float(c.get("endpoint_weight", 1.0)), int(c.get("endpoint_samples", 3)), float(c.get("cycle_weight", 0.0)), float(c.get("derivative_weight", 0.0)))
    restart = Restart(int(c.get("restart_check_epoch", 25)), float(c.get("restart_threshold", 0.0015)), int(c.get("restart_max_attempts", 3))) if c.get("restart_on_plateau") else None
    optimiser = Optimiser(c.get("optimizer", "adam"), float(c.get("lr", 1e-3)), float(c.get("weight_decay", 0.0)))
    return Run(BeatTask(model, losses), optimiser, int(c.get("n_epochs", 100)), int(c.get("batch_size", 32)), int(c.get("random_seed", 42)), restart, dict(c))


def search(datasets: dict[int, DataFrame], configs: list[dict], path: str | None = None, representation: str = "sa", shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame, list[Run]]:
    """(summary, winners, runs) of a grid search over autoencoders. datasets: by beat length, rows of key, role and beat; configs: as run_of
    takes them, fixed_len among them.

    Runs of one length train in step, in the same jobs. winners: the best run of each pair of fixed_len and latent_dim; with a path, their
    models are stored under it, those of swept names in a folder each, and the best of all in path/best.
    """
    runs = [run_of(c, representation) for c in configs]
    for length in dict.fromkeys(int(c["fixed_len"]) for c in configs):
        train(datasets[length], [r for r in runs if int(r.name["fixed_len"]) == length], shard_rows)
    spark = next(iter(datasets.values())).sparkSession
    rows = summary(spark, runs)
    named = spark.createDataFrame([(k, int(r.name["fixed_len"]), int(r.name.get("latent_dim", 16))) for k, r in enumerate(runs)], "run int, fixed_len int, latent_dim int")
    found = models.winners(rows.join(named, "run"), ["fixed_len", "latent_dim"])
    if path is not None:
        models.save_winners(spark, path, found, {k: r.best_task.model for k, r in enumerate(runs)})
    return rows, found, runs
