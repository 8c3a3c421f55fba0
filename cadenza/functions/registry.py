"""Named feature sets, score buckets, scales and representations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME_RATE = 16000.0

# Channel names, feature sets, scales and bucket bounds.
BODY_CHANNELS = ["v_x", "v_y", "v_z", "a_x", "a_y", "a_z", "w_yaw", "w_pitch", "w_roll", "alpha_yaw", "alpha_pitch", "alpha_roll", "dwithin_yaw", "dwithin_pitch", "dwithin_roll"]
FEATURE_SETS = {
    "full": list(range(12)),
    "pitch": [7, 10],
    "pitch_accel": [10],
    "angular_accel": [9, 10, 11],
    "angular": [6, 7, 8, 9, 10, 11],
    "dwithin": [12, 13, 14],
    "pitch_dwithin": [13],
    "pitch_vel_dwithin": [7, 13],
    "angular_vel_dwithin": [6, 7, 8, 12, 13, 14],
    "full_dwithin": [0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 13, 14],
}
WING_SCALE = [pi, 0.5, pi]
PAIR_SCALE = WING_SCALE * 2
BUCKETS = ["zero", "low", "mid", "high", "peak"]
EDGE = 1e-6


def bucket_flags(score: Column) -> dict[str, Column]:
    """One flag a bucket. They aren't exclusive: scores just under 1 are both high and peak."""
    low, mid = 1 / 3 + EDGE, 2 / 3 + EDGE
    return {"zero": score == 0, "low": (score > 0) & (score <= low), "mid": (score > low) & (score <= mid), "high": (score > mid) & (score < 1), "peak": score >= 1 - EDGE}


def features(name: str = "full", indices: list[int] | None = None) -> list[int]:
    """Channel numbers: explicit ones before a named set; all must be known channels."""
    chosen = list(indices) if indices is not None else FEATURE_SETS.get(name)
    if chosen is None:
        raise KeyError(f"no feature set {name}: {sorted(FEATURE_SETS)}")
    if not chosen or any(not 0 <= i < len(BODY_CHANNELS) for i in chosen):
        raise ValueError(f"channel numbers must lie in 0..{len(BODY_CHANNELS) - 1}: {chosen}")
    return chosen


def score_axes(asked: list[str]) -> list[str]:
    """'all' stands for max, yaw, pitch and roll; repeated names keep their first place."""
    return list(dict.fromkeys(x for a in asked for x in (["max", "yaw", "pitch", "roll"] if a == "all" else [a])))


def score_of(axis: str, yaw: Column, pitch: Column, roll: Column) -> Column:
    if axis == "max":
        return F.greatest(yaw, pitch, roll)
    return {"yaw": yaw, "pitch": pitch, "roll": roll}[axis]


@dataclass(frozen=True)
class Representation:
    """How a beat is laid out: its channels, their scales and whether two wings share a row."""

    name: str
    channels: tuple[str, ...]
    scale: tuple[float, ...]
    paired: bool


REPRESENTATIONS = {
    "sa": Representation("sa", ("s_phi", "s_theta", "s_psi", "a_phi", "a_theta", "a_psi"), tuple(PAIR_SCALE), True),
    "single_wing": Representation("single_wing", ("phi", "theta", "psi"), tuple(WING_SCALE), False),
}


def component(spec: str) -> tuple[str, int]:
    """'pc:2', 'dim:3' or '2' (a principal component) as (kind, number)."""
    kind, _, number = spec.rpartition(":")
    kind = kind or "pc"
    if kind not in ("pc", "dim") or not number.isdigit():
        raise ValueError(f"not a component: {spec}")
    return kind, int(number)


def dataset_name(representation: str, length: int, latent: int | None = None) -> str:
    """Table name of a fixed-length dataset, or with `latent` of a regressor dataset."""
    tag = "" if representation == "sa" else f"_{representation}"
    return f"regressor_d{latent}_l{length}{tag}" if latent is not None else f"beats_l{length}{tag}"


@dataclass(frozen=True)
class Target:
    """A quantity that a beat's shape is related to: its label and its column, from this beat's and the next one's body channels."""

    label: str
    column: Callable[[str], Column]


TARGETS = {
    "accel": Target("acceleration of this beat", lambda axis: F.col(f"alpha_{axis}")),
    "dvel_next": Target("change of velocity to the next beat", lambda axis: F.col(f"next_w_{axis}") - F.col(f"w_{axis}")),
    "dvel_within": Target("change of velocity within the beat", lambda axis: F.col(f"w_{axis}_last") - F.col(f"w_{axis}_first")),
}


def target(name: str, axis: str) -> Column:
    if name not in TARGETS:
        raise KeyError(f"no target {name}: {sorted(TARGETS)}")
    return TARGETS[name].column(axis).cast("double")


def colour_columns(size: int) -> list[str]:
    """Names of a beat's body response, one a channel: by axis if there are three."""
    return [f"{a}_accel" for a in ("yaw", "pitch", "roll")] if size == 3 else [f"F{i}_accel" for i in range(size)]


def coloured(df, response: str, size: int):
    """df with a column for each channel of the response array."""
    return df.withColumns({name: F.col(response)[i] for i, name in enumerate(colour_columns(size))})


def checked_channels(base: int, groups: int = 8) -> int:
    """A layer width that its halves and quarters can be normalised in groups by: a positive multiple of four times the groups."""
    if base <= 0 or base % (4 * groups):
        raise ValueError(f"{base} is no positive multiple of {4 * groups}")
    return base
