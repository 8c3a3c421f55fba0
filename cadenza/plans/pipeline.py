"""From raw frames to fixed-length beats and regressor rows, each step one DataFrame."""

from __future__ import annotations

from cadenza.operators import beats as B
from cadenza.operators import ranks as R
from cadenza.operators import sequence as S
from cadenza.operators import statistics as Q
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY, FRAME = "trajectory_id", "frame"


def condense(raw: DataFrame, window: int = 351, order: int = 2, rate: float = 16000.0) -> DataFrame:
    """Valid spans of every flight with their twelve body channels, and the mirrored flights beside them."""
    spans = S.valid_span(raw, KEY, FRAME, B.WINGS, "trim", window)
    moving = B.kinematics(spans, rate, window, order)
    swap = [(f"{c}_l", f"{c}_r") for c in ("phi", "theta", "psi")]
    flip = ["v_y", "a_y", "w_x", "w_z", "alpha_x", "alpha_z"]
    return S.mirrored(moving.select(KEY, FRAME, *B.WINGS, *B.BODY), swap, flip)


def without_garbage(frames: DataFrame, multiple: float = 10.0) -> DataFrame:
    """Flights whose left/right asymmetry is at most a multiple of the median, numbered anew by their old ids."""
    from cadenza.functions.registry import WING_SCALE

    pairs = [(f"{c}_l", f"{c}_r", s) for c, s in zip(("phi", "theta", "psi"), WING_SCALE, strict=True)]
    kept = Q.asymmetry_filter(Q.asymmetry(frames, KEY, pairs), multiple).select(KEY)
    return frames.join(R.ranked(kept, KEY, KEY, "_new"), KEY).drop(KEY).withColumnRenamed("_new", KEY)


def build_beats(frames: DataFrame, length: int = B.LENGTH, spacing: int = 50, representation: str = "sa") -> tuple[DataFrame, DataFrame]:
    """(beats, template): residuals to the mean beat at a fixed length, with duration, mean body channels and sustained-event scores."""
    marks = B.boundaries(frames, KEY, FRAME, spacing)
    spans = S.intervals(marks, KEY, "at")
    gathered = B.segments(frames, spans, B.WINGS)
    mean = B.template(B.resampled(gathered, length))
    matrix = B.template_matrix(mean)
    if representation == "sa":
        made = B.symmetric_beats(gathered, matrix, length)
    else:
        pooled = B.template(B.resampled(gathered, length).select(F.explode(F.array(F.slice("beat", 1, 3), F.slice("beat", 4, 3))).alias("beat")))
        mean, matrix = pooled, B.template_matrix(pooled)
        made = B.single_beats(gathered, matrix, length)
    body = S.interval_features(S.in_intervals(frames.select(KEY, FRAME, *B.BODY), spans, KEY, FRAME), KEY, FRAME, B.BODY)
    scored = body
    for axis, channel in (("yaw", "alpha_x"), ("pitch", "alpha_y"), ("roll", "alpha_z")):
        scored = S.sustained_scores(scored, KEY, "idx", f"mean_{channel}").withColumnRenamed("score", f"score_{axis}")
    features = scored.select(KEY, "idx", F.array(*[F.col(f"mean_{c}") for c in B.BODY], *[F.col(f"delta_w_{c}") for c in "xyz"]).alias("features"), "score_yaw", "score_pitch", "score_roll")
    return made.join(features, [KEY, "idx"]), mean


def regressor_rows(beats: DataFrame) -> DataFrame:
    """Adds next_features, those of the flight's next beat; its last beat has none and goes."""
    from pyspark.sql import Window

    return beats.withColumn("next_features", F.lead("features").over(Window.partitionBy(KEY).orderBy("idx"))).where("next_features is not null")
