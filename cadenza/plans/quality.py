"""Checks of recordings before they are used: screening, frequencies, and whether a new batch is like an old one."""

from __future__ import annotations

import pandas as pd
from cadenza.functions import arrays as A
from cadenza.functions.kernels import ks_probability
from cadenza.functions.registry import FRAME_RATE, WING_SCALE
from cadenza.operators import beats as B
from cadenza.operators import sequence as S
from cadenza.operators import statistics as Q
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY, FRAME = "trajectory_id", "frame"
_PAIRS = [(f"{c}_l", f"{c}_r", s) for c, s in zip(("phi", "theta", "psi"), WING_SCALE, strict=True)]


def screen(frames: DataFrame, spacing: int = 50) -> DataFrame:
    """One row a flight: asymmetry, suspicion and its class, mean left-right differences, samples, peaks, beats and mean beat length (0 without beats)."""
    rated = Q.asymmetry_filter(Q.asymmetry(frames, KEY, _PAIRS), 0)
    differences = frames.groupBy(KEY).agg(*[F.avg(F.abs(F.col(a) - F.col(b))).alias(f"{a[:-2]}_lr_mean") for a, b, _ in _PAIRS])
    marks = B.boundaries(frames, KEY, FRAME, spacing)
    peaks = marks.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_peaks"))
    lengths = S.intervals(marks, KEY, "at").groupBy(KEY).agg(F.count(F.lit(1)).alias("n_beats"), F.avg("duration").alias("mean_beat"))
    joined = rated.join(differences, KEY).join(peaks, KEY, "left").join(lengths, KEY, "left")
    zero = {c: 0 for c in ("n_peaks", "n_beats", "mean_beat")}
    return joined.select(KEY, F.col("score").alias("asymmetry"), "suspicion", Q.suspicion_class(F.col("suspicion")).alias("class"), *[f"{a[:-2]}_lr_mean" for a, _, _ in _PAIRS], F.col("n").alias("n_samples"), "n_peaks", "n_beats", "mean_beat").fillna(zero)


def frequencies(frames: DataFrame, split_by: str = "min", distance: int = 20, rate: float = FRAME_RATE) -> DataFrame:
    """One row over all flights: beat lengths and frequencies. Frames with a missing angle are dropped and the rest joins up."""
    whole = S.valid_span(frames, KEY, FRAME, B.WINGS, "drop")
    spans = S.intervals(B.boundaries(whole, KEY, FRAME, distance, split_by), KEY, "at")
    return Q.duration_summary(spans, "duration", rate)


def beat_values(beats: DataFrame, seg: str = "seg", residual: str | None = None) -> DataFrame:
    """(metric, value): length, highest stroke of each wing and the reach of the left wing's other angles; with residuals their norm too."""
    at = lambda i: F.col(seg)[i]
    values = {"duration": F.col("duration").cast("double"), "phi_max_l": F.array_max(at(0)), "phi_max_r": F.array_max(at(3)), "theta_reach": A.spread(at(1)), "psi_reach": A.spread(at(2))}
    if residual:
        values["residual_norm"] = A.norm(F.flatten(residual))
    return beats.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()])).alias("_m")).select("_m.*")


def compare(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tests, verdict) of two tables (metric, value): d, p, effect by metric; and one row with what follows from the effects."""
    found = Q.two_sample_ks(old, new, "value", ["metric"])

    @F.pandas_udf("double")
    def probability(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([ks_probability(*x) for x in zip(d, n, m, strict=True)])

    tests = found.select("metric", "d", "n_a", "n_b", probability("d", "n_a", "n_b").alias("p"), Q.effect(F.col("d")).alias("effect"))
    return tests, Q.verdict(found)
