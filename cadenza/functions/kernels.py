"""Signal kernels in NumPy, for Arrow tasks: peaks, splines, smoothing, test statistics."""

from __future__ import annotations

from functools import lru_cache
from math import exp

import numpy as np


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Places higher than both sides; a flat top counts once, at its middle (rounded down). Ends are none."""
    x = np.asarray(x, float)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    last = np.append(first[1:], len(x)) - 1
    level = x[first]
    inner = np.arange(1, len(first) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])]
    return (first[top] + last[top]) // 2


def spaced(x: np.ndarray, peaks: np.ndarray, distance: int) -> np.ndarray:
    """Peaks at least `distance` apart: higher ones stay first, of equal ones the later."""
    keep = np.ones(len(peaks), bool)
    for k in np.lexsort((peaks, x[peaks]))[::-1]:
        if keep[k]:
            near = np.abs(peaks - peaks[k]) < distance
            near[k] = False
            keep &= ~near
    return peaks[keep]


def prominence(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """How far each peak rises over the higher of the lowest points that part it from higher ground or the ends."""
    out = np.zeros(len(peaks))
    for k, p in enumerate(peaks):
        higher = np.flatnonzero(x > x[p])
        left, right = higher[higher < p], higher[higher > p]
        a = left[-1] + 1 if len(left) else 0
        b = right[0] if len(right) else len(x)
        out[k] = x[p] - max(x[a : p + 1].min(), x[p:b].min())
    return out


def peaks(x: np.ndarray, distance: int = 1, least_prominence: float = 0.0) -> np.ndarray:
    x = np.asarray(x, float)
    found = spaced(x, local_maxima(x), distance)
    return found[prominence(x, found) >= least_prominence] if least_prominence > 0 else found


def stroke_boundaries(left: np.ndarray, right: np.ndarray, distance: int = 50) -> np.ndarray:
    """Beat boundaries: peaks of both wings, paired in order and averaged, fractions dropped."""
    a, b = peaks(left, distance), peaks(right, distance)
    n = min(len(a), len(b))
    return (a[:n] + b[:n]) // 2


def wingbeat_extrema(left: np.ndarray, right: np.ndarray, distance: int = 20, least: float | None = None, split_by: str = "min") -> np.ndarray:
    """Beat boundaries of the mean stroke, at its minima or maxima."""
    mean = (np.asarray(left, float) + np.asarray(right, float)) / 2
    signal = -mean if split_by == "min" else mean
    return peaks(signal, distance, max(1e-6, 0.05 * float(mean.std())) if least is None else least)


@lru_cache(256)
def resample_matrix(n: int, length: int) -> np.ndarray:
    """The linear map from n samples to `length`: a cubic spline through them (not-a-knot ends), both ends kept."""
    if n == length:
        return np.eye(n)
    if n == 1:
        return np.ones((length, 1))
    at = np.linspace(0, n - 1, length)
    if n < 4:  # one polynomial goes through all points
        base = np.vander(np.arange(n), n)
        return np.vander(at, n) @ np.linalg.inv(base)
    # second derivatives m of the spline as a linear function of the samples
    system, right = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2] = 1, 4, 1
        right[i, i - 1 : i + 2] = 6, -12, 6
    system[0, :3] = 1, -2, 1
    system[-1, -3:] = 1, -2, 1
    m = np.linalg.solve(system, right)
    i = np.minimum(at.astype(int), n - 2)
    t = (at - i)[:, None]
    eye = np.eye(n)
    return (1 - t) * eye[i] + t * eye[i + 1] + ((1 - t) ** 3 - (1 - t)) / 6 * m[i] + (t**3 - t) / 6 * m[i + 1]


def resample(x: np.ndarray, length: int) -> np.ndarray:
    """(n, channels) to (length, channels)."""
    x = np.asarray(x, float)
    return resample_matrix(len(x), length) @ x


def smooth(x: np.ndarray, window: int, order: int, derivative: int = 0, delta: float = 1.0) -> np.ndarray:
    """Least-squares polynomial smoothing or its derivative. The ends use the polynomial of the first and last window."""
    x = np.asarray(x, float)
    half = window // 2
    if window % 2 == 0 or window > len(x) or order >= window or derivative > order:
        raise ValueError("the window must be odd, no longer than the signal and over the order")
    scale = np.arange(-half, half + 1) / max(half, 1)  # well conditioned
    fit = np.linalg.pinv(np.vander(scale, order + 1, increasing=True))
    unit = max(half, 1) * delta

    def value(coefficients: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), *coefficients.shape[1:]))
        for k in range(derivative, order + 1):
            factor = np.prod(np.arange(k - derivative + 1, k + 1)) if derivative else 1.0
            out += factor * np.power(at, k - derivative).reshape(-1, *[1] * (coefficients.ndim - 1)) * coefficients[k]
        return out / unit**derivative

    kernel = fit[derivative] * (np.prod(np.arange(1, derivative + 1)) if derivative else 1.0) / unit**derivative
    out = np.empty_like(x)
    out[half : len(x) - half] = np.convolve(x, kernel[::-1], mode="valid")
    out[:half] = value(fit @ x[:window], scale[:half])
    out[len(x) - half :] = value(fit @ x[-window:], scale[half + 1 :])
    return out


def gradient(x: np.ndarray) -> np.ndarray:
    """Central differences along the first axis, one-sided at the ends."""
    out = np.empty_like(np.asarray(x, float))
    out[1:-1] = (x[2:] - x[:-2]) / 2
    out[0], out[-1] = x[1] - x[0], x[-1] - x[-2]
    return out


def angular_velocity(x_body: np.ndarray, y_body: np.ndarray, z_body: np.ndarray, rate: float, body_frame: bool = True) -> np.ndarray:
    """Degrees a second of a rotating frame, from the skew part of R' R^T; in the body's frame or the laboratory's."""
    r = np.stack([x_body, y_body, z_body], axis=-1)
    m = gradient(r) @ np.swapaxes(r, 1, 2)
    lab = 0.5 * np.stack([m[:, 2, 1] - m[:, 1, 2], m[:, 0, 2] - m[:, 2, 0], m[:, 1, 0] - m[:, 0, 1]], axis=-1)
    lab = np.degrees(lab) * rate
    return np.einsum("tij,ti->tj", r, lab) if body_frame else lab


def ks_probability(d: float, n: int, m: int) -> float:
    """Asymptotic p-value of the two-sample statistic."""
    t = d * (n * m / (n + m)) ** 0.5
    if t < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * exp(-2 * k * k * t * t) for k in range(1, 101)))))
