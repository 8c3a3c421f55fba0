"""Encoding, decoding and predicting over DataFrames, a grid of fits, and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from cadenza.functions import arrays as A
from cadenza.functions import kernels as K
from cadenza.functions import registry as N
from cadenza.functions.models import Adam, Composite, LinearEncoder, Regressor
from cadenza.functions.registry import WING_SCALE
from cadenza.operators import vectors as V
from cadenza.operators.shapes import subsample as sampled
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_linear_encoder(beats: DataFrame, latent: int, column: str = "beat") -> LinearEncoder:
    """From moments summed on the executors; the covariance's size is bounded by the beat's fixed length."""
    flat = beats.select(F.flatten(column).alias("v"), F.size(column).alias("c"), F.size(F.col(column)[0]).alias("l"))
    shape = flat.select("c", "l").first()
    mean, covariance = V.mean_and_covariance(flat.select("v"), "v")
    return LinearEncoder.of(covariance, mean, latent, (shape["c"], shape["l"]))


def _stack(column) -> np.ndarray:
    return np.stack([np.stack([np.asarray(c, float) for c in b]) for b in column])


def encoded(beats: DataFrame, encoder, column: str = "beat", name: str = "latent") -> DataFrame:
    """Adds the latent of each beat. encoder: anything with encode(array of beats)."""
    shared = beats.sparkSession.sparkContext.broadcast(encoder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: shared.value.encode(_stack(b[column])).tolist() if len(b) else []})

    return beats.mapInPandas(run, _fields(beats) + f", {name} array<double>")


def decoded(rows: DataFrame, encoder, column: str = "latent", name: str = "recon") -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(encoder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: shared.value.decode(np.stack(b[column].to_numpy()).astype(float)).tolist() if len(b) else []})

    return rows.mapInPandas(run, _fields(rows) + f", {name} array<array<double>>")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def predicted(rows: DataFrame, regressor: Regressor, features: str = "features") -> DataFrame:
    """Adds pred_latent and pred_duration."""
    shared = rows.sparkSession.sparkContext.broadcast(regressor)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            latent, duration = shared.value.predict(np.stack(b[features].to_numpy()).astype(float)) if len(b) else ([], [])
            yield b.assign(pred_latent=list(map(list, latent)), pred_duration=duration)

    return rows.mapInPandas(run, _fields(rows) + ", pred_latent array<double>, pred_duration long")


def generated(rows: DataFrame, encoder, regressor: Regressor, features: str = "features") -> DataFrame:
    """One beat a row at its predicted duration: latent, then decoded, then resampled."""
    both = decoded(predicted(rows, regressor, features), encoder, "pred_latent", "recon")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            beats = [K.resample(np.stack([np.asarray(c, float) for c in x]).T, int(n)).T.tolist() for x, n in zip(b["recon"], b["pred_duration"], strict=True)]
            yield b.drop(columns="recon").assign(beat=beats)

    kept = both.drop("recon")
    return both.mapInPandas(run, _fields(kept) + ", beat array<array<double>>")


def passed_through(rows: DataFrame, chain, column: str, name: str) -> DataFrame:
    """Adds what a layer or a chain of layers makes of the column, channels by samples, as such."""
    shared = rows.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: shared.value.forward(_stack(b[column]))[0].tolist() if len(b) else []})

    return rows.mapInPandas(run, _fields(rows) + f", {name} array<array<double>>")


def composed(rows: DataFrame, composite: Composite, body: str = "body", following: str = "next_body") -> DataFrame:
    """Adds pred_latent, pred_duration, wings (both wings' normalised residuals at the decoder's length) and beat (channels by pred_duration
    samples): for a paired representation its own channels, else both wings' residuals in their units, on the template if there is one."""
    shared = rows.sparkSession.sparkContext.broadcast(composite)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for b in batches:
            if not len(b):
                yield b.assign(pred_latent=[], pred_duration=[], wings=[], beat=[])
                continue
            halves = [np.stack(b[x].to_numpy()).astype(float) for x in [body, following][: 1 + c.with_next]]
            latents, durations = c.predict(halves[0], halves[1] if c.with_next else None)
            wings = c.wings(latents)
            if c.representation == "sa":
                shapes = [K.resample(x.T, int(n)).T for x, n in zip(c.decoder.decode(latents), durations, strict=True)]
            else:
                scale = np.tile(WING_SCALE, 2)[:, None]
                shapes = [K.resample((x * scale).T, int(n)).T for x, n in zip(wings, durations, strict=True)]
                if c.template is not None:
                    shapes = [x + np.tile(K.resample(c.template[:3].T, x.shape[1]).T, (2, 1)) for x in shapes]
            yield b.assign(pred_latent=latents.tolist(), pred_duration=durations, wings=wings.tolist(), beat=[x.tolist() for x in shapes])

    return rows.mapInPandas(run, _fields(rows) + ", pred_latent array<double>, pred_duration long, wings array<array<double>>, beat array<array<double>>")


def background_cloud(beats: DataFrame, ident: str, mean: np.ndarray, representation: str = "sa", most: int = 4000, column: str = "beat") -> DataFrame:
    """(ident, wing, sample, phi, theta, psi) in radians: the angles that at most `most` beats' residuals stand for, on the template, a row a
    sample of a wing. Which beats, a digest of their ids decides. mean: the template at the beats' length, channels by samples."""
    named = N.REPRESENTATIONS[representation]
    picked = beats.select(F.col(ident).alias("_id"), F.col(column).alias("_b"))
    picked = sampled(picked, "_id", most)
    row = lambda c: F.transform(F.col("_b")[c], lambda x: x.cast("double") * F.lit(float(named.scale[c])))
    lit = lambda c: F.array(*[F.lit(float(x)) for x in mean[c]])
    on = lambda a, c: F.zip_with(a, lit(c), lambda x, m: x + m)
    if named.paired:
        sides = [[on(A.left_of(row(c), row(c + 3)), c) for c in range(3)], [on(A.right_of(row(c), row(c + 3)), c + 3) for c in range(3)]]
    else:
        sides = [[on(row(c), c) for c in range(3)]]
    loops = F.array(*[F.struct(F.lit(k).alias("wing"), F.arrays_zip(*[a.alias(n) for a, n in zip(s, ("phi", "theta", "psi"), strict=True)]).alias("points")) for k, s in enumerate(sides)])
    return picked.select(F.col("_id").alias(ident), F.explode(loops).alias("_l")).select(ident, "_l.wing", F.posexplode("_l.points").alias("sample", "_p")).select(ident, "wing", "sample", *[F.col("_p")[n].alias(n) for n in ("phi", "theta", "psi")])


def fit_grid(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """(run, val_loss, losses): one fit a configuration (run, hidden, rate, epochs, seed), all of them in step.

    rows: (role, features, latent, duration). In each epoch one job sums the gradients of every run over all train rows, where they lie;
    only sums of the weights' size reach the driver, which takes a step of Adam for each run. The number of rows has no bound. val_loss is
    the mean squared latent error on val rows, or on train rows if there are none.
    """
    fitted, losses = fit_all(rows, configs)
    held = rows.where("role = 'val'")
    held = rows if held.isEmpty() else held
    errors = _summed(held, {run: (m, "loss") for run, m in fitted.items()})
    out = [(run, float(errors[run][0]), [float(x) for x in losses[run]]) for run in fitted]
    return rows.sparkSession.createDataFrame(out, "run long, val_loss double, losses array<double>")


def fit_all(rows: DataFrame, configs: DataFrame) -> tuple[dict[int, Regressor], dict[int, list[float]]]:
    """The fitted regressors by run, and their losses by epoch."""
    train = rows.where("role = 'train'").select("features", "latent", "duration").persist()
    logs = train.agg(F.avg(F.log("duration")).alias("m"), F.stddev_pop(F.log("duration")).alias("s"), F.max(F.size("features")).alias("x"), F.max(F.size("latent")).alias("y"), F.count(F.lit(1)).alias("n")).first()
    if not logs["n"]:
        raise ValueError("no train rows")
    wanted = {r["run"]: r for r in configs.collect()}  # a row a configuration
    models = {run: Regressor(hidden=(int(c["hidden"]),)) for run, c in wanted.items()}
    steps, losses = {}, {run: [] for run in wanted}
    for run, m in models.items():
        m.begin(logs["x"], logs["y"], logs["m"], logs["s"], int(wanted[run]["seed"]))
        steps[run] = Adam(m, float(wanted[run]["rate"]))
    for epoch in range(max((int(c["epochs"]) for c in wanted.values()), default=0)):
        active = {run: m for run, m in models.items() if epoch < int(wanted[run]["epochs"])}
        for run, flat in _summed(train, {run: (m, "gradient") for run, m in active.items()}).items():
            losses[run].append(flat[0])
            at, grads = 1, []
            for p in steps[run].parameters:
                grads.append(flat[at : at + p.size].reshape(p.shape))
                at += p.size
            steps[run](grads)
    train.unpersist()
    return models, losses


def _summed(rows: DataFrame, models: dict[int, tuple[Regressor, str]]) -> dict[int, np.ndarray]:
    """For every run the mean over all rows of its loss, and with 'gradient' its gradients behind it; with 'loss' of the latents alone."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        n = 0
        for b in batches:
            if not len(b):
                continue
            x, latent = np.stack(b["features"].to_numpy()).astype(float), np.stack(b["latent"].to_numpy()).astype(float)
            n += len(b)
            for run, (m, what) in shared.value.items():
                if what == "gradient":
                    loss, grads = m.gradient(x, m.targets(latent, b["duration"].to_numpy(float)))
                    flat = np.concatenate([[loss], *[g.ravel() for g in grads]])
                else:
                    flat = np.array([((m.predict(x)[0] - latent) ** 2).mean(axis=1).sum()])
                sums[run] = sums[run] + flat if run in sums else flat
        for run, flat in sums.items():
            yield pd.DataFrame({"run": run, "place": np.arange(len(flat)), "s": flat, "n": n})

    found = rows.select("features", "latent", "duration").mapInPandas(add, "run long, place int, s double, n long").groupBy("run", "place").agg((F.sum("s") / F.sum("n")).alias("mean"))
    out: dict[int, list] = {}
    for r in found.orderBy("run", "place").collect():
        out.setdefault(r["run"], []).append(r["mean"])
    shared.destroy()
    return {run: np.array(v) for run, v in out.items()}


def end_to_end(rows: DataFrame, scale: list[float]) -> DataFrame:
    """(part, channel, rmse_deg): floor (decoded truth), added (decoded prediction against decoded truth) and e2e (against the beat).

    rows: beat, recon (of the true latent), recon_pred.
    """
    parts = [("floor", "recon", "beat"), ("added", "recon_pred", "recon"), ("e2e", "recon_pred", "beat")]
    out = None
    for name, a, b in parts:
        found = V.channel_rmse_degrees(rows, a, b, scale).withColumn("part", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out.select("part", "channel", "rmse_deg")


def traversal(spark, encoder, sd: np.ndarray, steps: int = 7, reach: float = 3.0) -> DataFrame:
    """(dim, step, value, recon): each latent dimension moved alone from -reach to reach deviations."""
    rows = [(d, s, float(v * sd[d]), [float(v * sd[d]) if k == d else 0.0 for k in range(len(sd))]) for d in range(len(sd)) for s, v in enumerate(np.linspace(-reach, reach, steps))]
    return decoded(spark.createDataFrame(rows, "dim int, step int, value double, latent array<double>"), encoder).drop("latent")


def component_traversal(latents: DataFrame, encoder, column: str = "latent", steps: int = 7, reach: float = 3.0) -> DataFrame:
    """(component, step, delta, recon): the mean latent moved along each principal component from -reach to reach of its deviations."""
    mean, _ = V.mean_and_covariance(latents, column)
    found = V.principal_components(latents, column)
    rows = [(c, s, float(d), (mean + d * found["sd"][c] * found["components"][c]).tolist()) for c in range(len(mean)) for s, d in enumerate(np.linspace(-reach, reach, steps))]
    return decoded(latents.sparkSession.createDataFrame(rows, "component int, step int, delta double, latent array<double>"), encoder).drop("latent")


def bootstrap_bands(latents: DataFrame, encoder, ident: str, column: str = "latent", draws: int = 200, seed: int = 0) -> DataFrame:
    """(dim, channel, phase, p10, p50, p90) of decoded beats whose latent is the mean but for one dimension, which is drawn with replacement
    from its values."""
    from cadenza.operators.statistics import drawn_with_replacement

    mean, _ = V.mean_and_covariance(latents, column)
    asked = None
    for d in range(len(mean)):
        drawn = drawn_with_replacement(latents.select(ident, F.col(column)[d].alias("x")), "x", ident, draws, seed + d)
        one = drawn.select(F.lit(d).alias("dim"), F.array(*[F.col("value") if k == d else F.lit(float(m)) for k, m in enumerate(mean)]).alias("latent"))
        asked = one if asked is None else asked.unionByName(one)
    flat = decoded(asked, encoder).select("dim", F.posexplode("recon").alias("channel", "_s")).select("dim", "channel", F.posexplode("_s").alias("phase", "x"))
    p = F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))  # `draws` values a group
    return flat.groupBy("dim", "channel", "phase").agg(p.alias("_p")).select("dim", "channel", "phase", *[F.col("_p")[i].alias(f"p{q}") for i, q in enumerate((10, 50, 90))])


def template_against_mean(latents: DataFrame, encoder, shape: tuple[int, int], column: str = "latent") -> DataFrame:
    """Where the encoded template (a beat without residual) and the zero latent lie against the mean latent of all beats."""
    template = encoder.encode(np.zeros((1, *shape)))[0]
    return V.compare_with_centre(latents, column, {"template": template.tolist(), "zero": [0.0] * len(template)})
