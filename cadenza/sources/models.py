"""Stored models: weights as rows (name, shape, data) of a dataset whose metadata says what they are weights of."""

from __future__ import annotations

import json

import numpy as np
from cadenza.functions.autoencoder import ConvolutionalAutoencoder
from cadenza.functions.layers import Chain
from cadenza.functions.models import Composite, LinearEncoder, Regressor
from cadenza.operators.vectors import offset_and_scale
from cadenza.sources import tables
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(spark: SparkSession, path: str, kind: str, config: dict, named: dict[str, np.ndarray], notes: dict | None = None) -> None:
    """Replaces the model at path, as a dataset is replaced: whole or not at all."""
    rows = [(name, list(p.shape), np.ascontiguousarray(p, "<f8").tobytes()) for name, p in sorted(named.items())]
    tables.write_dataset(spark.createDataFrame(rows, "name string, shape array<long>, data binary"), path, {"kind": kind, "config": config, "notes": notes or {}})


def load(spark: SparkSession, path: str, kind: str, part: str = "") -> tuple[dict, dict[str, np.ndarray], dict]:
    """(config, weights by name, notes); part: only names that begin so are read."""
    found = tables.read_metadata(spark, path)
    if found is None:
        raise FileNotFoundError(f"no model at {path}")
    if found["kind"] != kind:
        raise ValueError(f"{path} holds a {found['kind']}, no {kind}")
    rows = tables.read_dataset(spark, path).where(F.col("name").startswith(part)).collect()  # a row a layer's weight
    return found["config"], {r["name"]: np.frombuffer(r["data"], "<f8").reshape(r["shape"]).copy() for r in rows}, found["notes"]


def save_autoencoder(spark: SparkSession, model: ConvolutionalAutoencoder, path: str, notes: dict | None = None) -> None:
    save(spark, path, "autoencoder", model.config, model.named, notes)


def load_autoencoder(spark: SparkSession, path: str) -> ConvolutionalAutoencoder:
    config, named, _ = load(spark, path, "autoencoder")
    return ConvolutionalAutoencoder(**config).load(named)


class Decoder:
    """An autoencoder's decoder alone."""

    def __init__(self, chain: Chain, config: dict):
        self.chain, self.config = chain, config

    def decode(self, latents: np.ndarray) -> np.ndarray:
        return self.chain.forward(np.asarray(latents, float))[0]


def load_decoder(spark: SparkSession, path: str) -> Decoder:
    """Only the decoder's weights are read."""
    config, named, _ = load(spark, path, "autoencoder", "decoder.")
    chain = ConvolutionalAutoencoder(**config).decoder
    chain.load({k.removeprefix("decoder."): v for k, v in named.items()})
    return Decoder(chain, config)


def save_linear_encoder(spark: SparkSession, model: LinearEncoder, path: str, notes: dict | None = None) -> None:
    save(spark, path, "linear", {"shape": list(model.shape)}, {"components": model.components, "mean": model.mean}, notes)


def load_linear_encoder(spark: SparkSession, path: str) -> LinearEncoder:
    config, named, _ = load(spark, path, "linear")
    return LinearEncoder(named["components"], named["mean"], tuple(config["shape"]))


def save_regressor(spark: SparkSession, model: Regressor, path: str, scaler: dict, with_next: bool = True, notes: dict | None = None) -> None:
    """scaler: the body scaler that its features were made with (vectors.fit_body_scaler)."""
    save(spark, path, "regressor", model.config | {"scaler": scaler, "with_next": with_next}, model.named, notes)


def load_regressor(spark: SparkSession, path: str) -> tuple[Regressor, dict, bool]:
    """(regressor, scaler, whether its features hold the next beat's)."""
    config, named, _ = load(spark, path, "regressor")
    scaler, with_next = config.pop("scaler"), config.pop("with_next")
    return Regressor(**(config | {"hidden": tuple(config["hidden"])})).load(named), scaler, with_next


def load_composite(spark: SparkSession, regressor: str, autoencoder: str, template: str | None = None) -> Composite:
    """The chain from body channels to a beat. Latents of different sizes are an error. template: a table (channel, phase, mean) that a single
    wing's residuals lie on; where there is none, residuals are what the chain gives."""
    model, scaler, with_next = load_regressor(spark, regressor)
    kind = (tables.read_metadata(spark, autoencoder) or {}).get("kind")
    decoder = load_linear_encoder(spark, autoencoder) if kind == "linear" else load_decoder(spark, autoencoder)
    size = len(decoder.components) if kind == "linear" else decoder.config["latent"]
    if size != model.latents:
        raise ValueError(f"the regressor gives latents of {model.latents}, the decoder takes {size}")
    indices, offset, scale = offset_and_scale(scaler)
    representation = "sa" if kind == "linear" else decoder.config["representation"]
    mean = None
    if representation != "sa" and template is not None and (rows := tables.template_or_none(spark, template)) is not None:
        from cadenza.operators.beats import template_matrix

        mean = template_matrix(rows)
    return Composite(model, decoder, indices, np.array(offset), np.array(scale), representation, with_next, mean)


def winners(runs: DataFrame, keys: list[str], loss: str = "best_val_loss", order: str = "run") -> DataFrame:
    """The run with the smallest loss of each combination of keys; of equal ones the first."""
    best = F.min_by(F.struct(*[c for c in runs.columns if c not in keys]), F.struct(loss, order)).alias("w")
    return runs.groupBy(*keys).agg(best).select(*keys, "w.*")


def winner_folder(key: dict[str, int], swept: set[str]) -> str:
    """Where the winner of a key lies under a run's folder: a level for each swept name, in the key's order; '' if none was swept."""
    return "/".join(f"{name}_{value}" for name, value in key.items() if name in swept)


def save_winners(spark: SparkSession, path: str, found: DataFrame, models: dict[int, ConvolutionalAutoencoder], keys: tuple[str, ...] = ("fixed_len", "latent_dim")) -> list[str]:
    """Stores the winner of each combination of keys, and the best of all at path/best. found: winners(); models by run. Returns the folders."""
    rows = sorted(found.collect(), key=lambda r: tuple(r[k] for k in keys))  # a row a combination
    swept = {k for k in keys if len({r[k] for r in rows}) > 1}
    out = []
    best = min(rows, key=lambda r: (r["best_val_loss"], r["run"]))
    for r, folder in [(r, winner_folder({k: r[k] for k in keys}, swept)) for r in rows] + [(best, "best")]:
        if folder:
            save_autoencoder(spark, models[r["run"]], f"{path}/{folder}", json.loads(json.dumps({c: r[c] for c in found.columns})))
            out.append(folder)
    return out
