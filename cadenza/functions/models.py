"""Encoders and regressors with one protocol: encode and decode beats, predict latents and durations. NumPy only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from cadenza.functions.layers import activation


@dataclass
class LinearEncoder:
    """Principal components as encoder and decoder of flattened beats."""

    components: np.ndarray
    mean: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, covariance: np.ndarray, mean: np.ndarray, latent: int, shape: tuple[int, int]) -> LinearEncoder:
        values, vectors = np.linalg.eigh(covariance)
        top = vectors[:, ::-1][:, :latent].T
        top = top * np.sign(top[np.arange(latent), np.abs(top).argmax(axis=1)])[:, None]
        return cls(top, mean, shape)

    def encode(self, beats: np.ndarray) -> np.ndarray:
        return (beats.reshape(len(beats), -1) - self.mean) @ self.components.T

    def decode(self, latents: np.ndarray) -> np.ndarray:
        return (latents @ self.components + self.mean).reshape(len(latents), *self.shape)


@dataclass
class Regressor:
    """A small network with two heads, latent and standardised log duration. `wings` latents stand end to end."""

    hidden: tuple[int, ...] = (128, 128)
    activation: str = "silu"
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)
    duration_mean: float = 0.0
    duration_sd: float = 1.0
    dropout: float = 0.0
    wings: int = 1

    def __post_init__(self):
        activation(self.activation)

    def _forward(self, x: np.ndarray, masks: dict[int, np.ndarray] | None = None) -> list[np.ndarray]:
        act = activation(self.activation)[0]
        outs = [x]
        for i, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            below = outs[-1] if i == 0 else act(outs[-1])
            outs.append((below if not masks or i == 0 else below * masks[i]) @ w + b)
        return outs

    @property
    def config(self) -> dict:
        return {"hidden": list(self.hidden), "activation": self.activation, "duration_mean": self.duration_mean, "duration_sd": self.duration_sd, "dropout": self.dropout, "wings": self.wings}

    @property
    def named(self) -> dict[str, np.ndarray]:
        return {f"{kind}.{i}": p for kind, parts in (("weight", self.weights), ("bias", self.biases)) for i, p in enumerate(parts)}

    def load(self, named: dict[str, np.ndarray]) -> Regressor:
        self.weights, self.biases = ([named[f"{kind}.{i}"] for i in range(len(named) // 2)] for kind in ("weight", "bias"))
        return self

    @property
    def latents(self) -> int:
        """Numbers of one wing's latent."""
        return (self.weights[-1].shape[1] - 1) // self.wings

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(latents, durations): durations are whole, rounded half to even, two at least."""
        out = self._forward(np.asarray(x, float))[-1]
        return out[:, :-1], np.maximum(np.rint(np.exp(out[:, -1] * self.duration_sd + self.duration_mean)), 2).astype(int)

    def begin(self, inputs: int, latents: int, duration_mean: float, duration_sd: float, seed: int = 0) -> None:
        """Fresh weights, from a seed."""
        random = np.random.default_rng(seed)
        self.duration_mean, self.duration_sd = duration_mean, duration_sd if duration_sd > 1e-8 else 1.0
        sizes = [inputs, *self.hidden, latents + 1]
        self.weights = [random.normal(size=(a, b)) * (2 / a) ** 0.5 for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        self.biases = [np.zeros(b) for b in sizes[1:]]

    def targets(self, latents: np.ndarray, durations: np.ndarray) -> np.ndarray:
        return np.concatenate([latents, ((np.log(durations) - self.duration_mean) / self.duration_sd)[:, None]], axis=1)

    def gradient(self, x: np.ndarray, y: np.ndarray, duration_weight: float = 1.0, drop: Callable | None = None) -> tuple[float, list[np.ndarray]]:
        """(loss, gradients of weights then biases), summed over the rows; the loss is the mean squared latent error plus the weighted
        one of the log duration. drop(shape, place) gives the draws of dropout behind each hidden layer."""
        act, slope = activation(self.activation)
        masks = {i: (drop((len(x), n), i) >= self.dropout) / (1 - self.dropout) for i, n in enumerate(self.hidden, 1)} if drop and self.dropout else None
        scale = np.concatenate([np.full(y.shape[1] - 1, 1 / (y.shape[1] - 1)), [duration_weight]])
        outs = self._forward(x, masks)
        error = outs[-1] - y
        grad = 2 * error * scale
        gw, gb = [None] * len(self.weights), [None] * len(self.weights)
        for i in range(len(self.weights) - 1, -1, -1):
            below = outs[i] if i == 0 else act(outs[i]) * (masks[i] if masks else 1)
            gw[i], gb[i] = below.T @ grad, grad.sum(axis=0)
            if i:
                grad = (grad @ self.weights[i].T) * slope(outs[i]) * (masks[i] if masks else 1)
        return float((error**2 * scale).sum()), gw + gb

    def fit(self, x: np.ndarray, latents: np.ndarray, durations: np.ndarray, epochs: int = 100, rate: float = 1e-3, batch: int = 32, seed: int = 0, duration_weight: float = 1.0) -> list[float]:
        """Adam in small batches on rows at hand; the rows' mean loss of every epoch."""
        logs = np.log(durations)
        self.begin(x.shape[1], latents.shape[1], float(logs.mean()), float(logs.std()), seed)
        y, step, random, losses = self.targets(latents, durations), Adam(self, rate), np.random.default_rng(seed + 1), []
        for _ in range(epochs):
            total = 0.0
            order = random.permutation(len(x))
            for a in range(0, len(x), batch):
                rows = order[a : a + batch]
                loss, grads = self.gradient(x[rows], y[rows], duration_weight)
                total += loss
                step([g / len(rows) for g in grads])
            losses.append(total / len(x))
        return losses


class Adam:
    """Adam's state for the parameters of a Regressor."""

    def __init__(self, model: Regressor, rate: float):
        self.parameters, self.rate, self.t = model.weights + model.biases, rate, 0
        self.first, self.second = [np.zeros_like(p) for p in self.parameters], [np.zeros_like(p) for p in self.parameters]

    def __call__(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.parameters, gradients, self.first, self.second, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


@dataclass
class Composite:
    """From body channels of this beat and the next one to a beat: scaled input, regressor, decoder, and a length of its own.

    decoder: anything with decode(latents). A paired representation has one latent a beat; else there are two, the left wing's first.
    """

    regressor: Regressor
    decoder: object
    indices: list[int]
    offset: np.ndarray
    scale: np.ndarray
    representation: str = "sa"
    with_next: bool = True
    template: np.ndarray | None = None

    def inputs(self, body: np.ndarray, following: np.ndarray | None) -> np.ndarray:
        """Chosen channels, scaled; those of the next beat behind them if the regressor was trained with them."""
        parts = [body, following] if self.with_next else [body]
        return np.concatenate([(np.asarray(p, float)[:, self.indices] - self.offset) / self.scale for p in parts], axis=1)

    def predict(self, body: np.ndarray, following: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(latents, durations)."""
        return self.regressor.predict(self.inputs(body, following))

    def wings(self, latents: np.ndarray) -> np.ndarray:
        """Both wings' normalised residuals (rows, 6, length), left before right."""
        if self.representation == "sa":
            x = self.decoder.decode(latents)
            return np.concatenate([x[:, :3] + x[:, 3:], x[:, :3] - x[:, 3:]], axis=1)
        d = latents.shape[1] // 2
        return np.concatenate([self.decoder.decode(latents[:, :d]), self.decoder.decode(latents[:, d:])], axis=1)
