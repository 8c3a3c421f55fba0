"""Column expressions on arrays: residuals, distances, norms, phases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def symmetric(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: (x + y) / 2)


def asymmetric(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: (x - y) / 2)


def left_of(s: Column, a: Column) -> Column:
    return F.zip_with(s, a, lambda x, y: x + y)


def right_of(s: Column, a: Column) -> Column:
    return F.zip_with(s, a, lambda x, y: x - y)


def spread(a: Column) -> Column:
    return F.array_max(a) - F.array_min(a)


def amplitude_degrees(residual: Column, template: Column, scale: float) -> Column:
    """Stroke amplitude of a residual: scale undone, template added, largest minus smallest, in degrees."""
    return F.degrees(spread(F.zip_with(residual, template, lambda r, t: r * scale + t)))


def clipped_mean(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values) / len(values)


def vector_norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def project3(velocity: list[Column], axes: list[list[Column]]) -> list[Column]:
    """A world vector in the body frame: its dot product with each body axis."""
    return [reduce(lambda a, b: a + b, [v * c for v, c in zip(velocity, axis, strict=True)]) for axis in axes]


def weighted_squares(recon: Column, target: Column, channel_weight: float, endpoint_weight: float, endpoints: int) -> Column:
    """Sum of weighted squared errors of one channel; the first and last samples weigh more."""
    errors = F.zip_with(recon, target, lambda x, y: (x - y) * (x - y))
    n = F.size(recon)
    return total(F.transform(errors, lambda e, i: e * F.when((i < endpoints) | (i >= n - endpoints), F.lit(endpoint_weight)).otherwise(F.lit(1.0)))) * F.lit(channel_weight)


def cycle_square(a: Column) -> Column:
    return F.pow(F.element_at(a, 1) - F.element_at(a, -1), 2)


def steps(a: Column) -> Column:
    """Differences of neighbours."""
    return F.zip_with(F.slice(a, F.lit(2), F.size(a) - 1), F.slice(a, F.lit(1), F.size(a) - 1), lambda x, y: x - y)
