"""From frames to fixed-length beats: segmentation, templates, residuals and their inverses, by Arrow kernels a sequence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from cadenza.functions import kernels as K
from cadenza.functions.registry import PAIR_SCALE, WING_SCALE
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 69
WINGS = ["phi_l", "theta_l", "psi_l", "phi_r", "theta_r", "psi_r"]
BODY = ["v_x", "v_y", "v_z", "a_x", "a_y", "a_z", "w_x", "w_y", "w_z", "alpha_x", "alpha_y", "alpha_z"]


def boundaries(frames: DataFrame, key: str = "trajectory_id", order: str = "frame", spacing: int = 50, tool: str = "stroke") -> DataFrame:
    """(key, idx, at): boundaries of each flight's beats. tool: 'stroke' pairs both wings' peaks; 'min' and 'max' take the mean
    stroke's extrema with a prominence."""
    kind = frames.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        left, right = group["phi_l"].to_numpy(), group["phi_r"].to_numpy()
        at = K.stroke_boundaries(left, right, spacing) if tool == "stroke" else K.wingbeat_extrema(left, right, spacing, split_by=tool)
        return pd.DataFrame({key: group[key].iloc[0], "idx": np.arange(len(at)), "at": group[order].to_numpy()[at]})

    return frames.select(key, order, "phi_l", "phi_r").groupBy(key).applyInPandas(run, f"{key} {kind}, idx long, at long")


def segments(frames: DataFrame, spans: DataFrame, columns: list[str], key: str = "trajectory_id", order: str = "frame") -> DataFrame:
    """(key, idx, duration, seg): frames gathered by beat; seg holds an array for each column. A beat bounds the group."""
    joined = frames.select(key, order, *columns).join(spans, key).where((F.col(order) >= F.col("start")) & (F.col(order) < F.col("end")))
    rows = F.sort_array(F.collect_list(F.struct(order, *columns)))
    gathered = joined.groupBy(key, "idx", "duration").agg(rows.alias("_r"))
    return gathered.select(key, "idx", F.col("duration").cast("int").alias("duration"), F.array(*[F.col(f"_r.{c}").cast("array<double>") for c in columns]).alias("seg")).where(F.size(F.col("seg")[0]) > 1)


def _each(frame_columns: list[str], make) -> callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [make(np.stack([np.asarray(c, float) for c in seg]), *rest) for seg, *rest in zip(*(batch[c] for c in frame_columns), strict=True)]
            yield batch.drop(columns=frame_columns).assign(beat=values)

    return run


def resampled(beats: DataFrame, length: int = LENGTH, column: str = "seg") -> DataFrame:
    """`column` (channels x n) replaced by `beat` (channels x length)."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in beats.schema if f.name != column) + ", beat array<array<double>>"
    return beats.mapInPandas(_each([column], lambda seg: K.resample(seg.T, length).T.tolist()), fields)


def template(beats: DataFrame, column: str = "beat") -> DataFrame:
    """(channel, phase, mean, sd): over all beats; the population deviation. Its size is channels x phases."""
    flat = beats.select(F.posexplode(column).alias("channel", "_s")).select("channel", F.posexplode("_s").alias("phase", "x"))
    return flat.groupBy("channel", "phase").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def template_matrix(rows: DataFrame) -> np.ndarray:
    found = rows.select("channel", "phase", "mean").toPandas()
    out = np.zeros((int(found["channel"].max()) + 1, int(found["phase"].max()) + 1))
    out[found["channel"], found["phase"]] = found["mean"]
    return out


def to_symmetric(seg: np.ndarray, mean: np.ndarray, length: int | None = None, scale=PAIR_SCALE) -> np.ndarray:
    """Six channels (left and right) to symmetric and asymmetric residuals over their scales, resampled if asked."""
    hat = seg - K.resample(mean.T, seg.shape[1]).T
    out = np.concatenate([(hat[:3] + hat[3:]) / 2, (hat[:3] - hat[3:]) / 2])
    out = K.resample(out.T, length).T if length else out
    return out / np.asarray(scale)[:, None]


def from_symmetric(sa: np.ndarray, mean: np.ndarray, scale=PAIR_SCALE) -> np.ndarray:
    sa = np.asarray(sa, float) * np.asarray(scale)[:, None]
    return np.concatenate([sa[:3] + sa[3:], sa[:3] - sa[3:]]) + K.resample(mean.T, sa.shape[1]).T


def to_single(wing: np.ndarray, mean: np.ndarray, length: int | None = None, scale=WING_SCALE) -> np.ndarray:
    hat = wing - K.resample(mean.T, wing.shape[1]).T
    hat = K.resample(hat.T, length).T if length else hat
    return hat / np.asarray(scale)[:, None]


def from_single(residual: np.ndarray, mean: np.ndarray, scale=WING_SCALE) -> np.ndarray:
    residual = np.asarray(residual, float)
    return residual * np.asarray(scale)[:, None] + K.resample(mean.T, residual.shape[1]).T


def symmetric_beats(beats: DataFrame, mean: np.ndarray, length: int = LENGTH) -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in beats.schema if f.name != "seg") + ", beat array<array<double>>"
    return beats.mapInPandas(_each(["seg"], lambda seg: to_symmetric(seg, mean, length).tolist()), fields)


def single_beats(beats: DataFrame, mean: np.ndarray, length: int = LENGTH) -> DataFrame:
    """Two rows a beat, left (0) then right (1); per-beat columns repeat. Exploded last, so nothing is computed twice."""
    rest = [c for c in beats.columns if c != "seg"]
    both = beats.select(*rest, F.explode(F.array(F.struct(F.lit(0).cast("tinyint").alias("side"), F.slice("seg", 1, 3).alias("seg")), F.struct(F.lit(1).cast("tinyint").alias("side"), F.slice("seg", 4, 3).alias("seg")))).alias("_s")).select(*rest, "_s.side", "_s.seg")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema if f.name != "seg") + ", beat array<array<double>>"
    return both.mapInPandas(_each(["seg"], lambda seg: to_single(seg, mean, length).tolist()), fields)


def kinematics(frames: DataFrame, rate: float = 16000.0, window: int = 351, order: int = 2, key: str = "trajectory_id", at: str = "frame") -> DataFrame:
    """Adds the twelve body channels from position (com_x..z) and body axes (xb_x..z, yb_.., zb_..): velocity and acceleration by
    smoothing and its derivatives, turned into the body frame, and angular velocity and acceleration. Flights shorter than the window go."""
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(at)
        if len(group) < window:
            return group.iloc[:0].assign(**{c: 0.0 for c in BODY})
        com = group[["com_x", "com_y", "com_z"]].to_numpy(float)
        axes = [group[[f"{b}_{c}" for c in "xyz"]].to_numpy(float) for b in ("xb", "yb", "zb")]
        turn = lambda v: np.stack([(v * a).sum(axis=1) for a in axes], axis=1)
        v, a = (turn(np.stack([K.smooth(com[:, c], window, order, d, 1 / rate) for c in range(3)], axis=1)) for d in (1, 2))
        w = K.angular_velocity(*axes, rate)
        alpha = np.stack([K.smooth(w[:, c], window, order, 1, 1 / rate) for c in range(3)], axis=1)
        return group.assign(**dict(zip(BODY, np.concatenate([v, a, w, alpha], axis=1).T, strict=True)))

    return frames.groupBy(key).applyInPandas(run, ", ".join(f"{k} {v}" for k, v in kinds.items()) + "".join(f", {c} double" for c in BODY))


def continuous_symmetric(frames: DataFrame, mean: np.ndarray, key: str = "trajectory_id", order: str = "frame", spacing: int = 50) -> DataFrame:
    """(key, frame, beat array of 6): symmetric and asymmetric residuals of whole flights at every frame, from the first to the last peak of
    the left stroke. The template is stretched to each beat; values keep their units; flights with fewer than two peaks go."""
    kind = frames.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        wings = group[WINGS].to_numpy(float).T
        at = K.peaks(wings[0], spacing)
        parts = [to_symmetric(wings[:, a:b], mean, None, [1.0] * 6) for a, b in zip(at[:-1], at[1:], strict=True)]
        values = np.concatenate(parts, axis=1).T if parts else np.zeros((0, 6))
        place = group[order].to_numpy()[at[0] : at[-1]] if parts else np.zeros(0, np.int64)
        return pd.DataFrame({key: group[key].iloc[0], order: place, "residual": pd.Series(values.tolist(), dtype=object)})

    return frames.select(key, order, *WINGS).groupBy(key).applyInPandas(run, f"{key} {kind}, {order} long, residual array<double>")
