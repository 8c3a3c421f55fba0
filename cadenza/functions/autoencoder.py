"""A convolutional autoencoder of fixed-length beats (rows, channels, length), with its losses and gradients. NumPy only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from cadenza.functions.layers import Activation, Chain, Convolution, Dense, Dropout, GroupNorm, Resize, Shape
from cadenza.functions.registry import REPRESENTATIONS, checked_channels

GROUPS = 8


@dataclass(frozen=True)
class Losses:
    """Weights of the training loss: the channels' own, of the first and last samples, of the gap between a beat's ends, and of slopes."""

    channels: tuple[float, ...] | None = None
    endpoint: float = 1.0
    endpoints: int = 3
    cycle: float = 0.0
    derivative: float = 0.0

    def of(self, recon: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
        """(loss, its gradient in recon), summed over the rows; each row's loss is a mean over its entries."""
        _, c, n = recon.shape
        weight = np.ones((c, n))
        if self.channels is not None:
            weight *= np.asarray(self.channels, float)[:, None]
        if self.endpoint != 1.0:
            k = min(self.endpoints, n)
            ends = np.zeros(n, bool)
            ends[:k] = ends[n - k :] = True
            weight[:, ends] *= self.endpoint
        error = recon - target
        loss, grad = float((error**2 * weight).sum() / (c * n)), 2 * error * weight / (c * n)
        if self.cycle:
            gap = recon[:, :, 0] - recon[:, :, -1]
            loss += self.cycle * float((gap**2).sum() / c)
            grad[:, :, 0] += 2 * self.cycle * gap / c
            grad[:, :, -1] -= 2 * self.cycle * gap / c
        if self.derivative and n > 1:
            slope = np.diff(error, axis=2)
            loss += self.derivative * float((slope**2).sum() / (c * (n - 1)))
            up = 2 * self.derivative * slope / (c * (n - 1))
            grad[:, :, 1:] += up
            grad[:, :, :-1] -= up
        return loss, grad


@dataclass
class ConvolutionalAutoencoder:
    """Encoder: three dilated convolutions, averages over `bottleneck` spans, one dense layer. Decoder: one dense layer, length doubled twice
    with a convolution each, linear interpolation to `length`, a refining convolution and three that take the channels back."""

    latent: int = 16
    channels: int = 6
    length: int = 80
    activation: str = "gelu"
    dropout: float = 0.0
    base: int = 128
    bottleneck: int = 12
    kernel: int = 5
    representation: str = "sa"
    encoder: Chain = field(init=False, repr=False)
    decoder: Chain = field(init=False, repr=False)

    def __post_init__(self):
        checked_channels(self.base)
        a, (c1, c2, c3), k = self.activation, (self.base // 4, self.base // 2, self.base), self.kernel
        block = lambda *conv: [Convolution(*conv), GroupNorm(GROUPS, conv[1]), Activation(a)]
        self.encoder = Chain(
            [*block(self.channels, c1, 5), *block(c1, c2, 5, 2), *block(c2, c3, 3, 4), Resize("average", self.bottleneck), Shape((c3 * self.bottleneck,)), Dropout(self.dropout, 0), Dense(c3 * self.bottleneck, self.latent)]
        )
        double = lambda n: [Resize("nearest", n), Convolution(c3, c3, 3), Activation(a)]
        self.decoder = Chain(
            [Dense(self.latent, c3 * self.bottleneck), Dropout(self.dropout, 1), Shape((c3, self.bottleneck)), *double(2 * self.bottleneck), *double(4 * self.bottleneck), Resize("linear", self.length)]
            + [*block(c3, c3, k), *block(c3, c2, k), *block(c2, c1, k), Convolution(c1, self.channels, k)]
        )

    @property
    def config(self) -> dict:
        """What the same network is made of again."""
        return {k: v for k, v in asdict(self).items() if k not in ("encoder", "decoder")}

    def begin(self, seed: int) -> ConvolutionalAutoencoder:
        random = np.random.default_rng(seed)
        self.encoder.begin(random)
        self.decoder.begin(random)
        return self

    @property
    def named(self) -> dict[str, np.ndarray]:
        return {f"{part}.{k}": v for part in ("encoder", "decoder") for k, v in getattr(self, part).named.items()}

    def load(self, named: dict[str, np.ndarray]) -> ConvolutionalAutoencoder:
        for part in ("encoder", "decoder"):
            getattr(self, part).load({k.removeprefix(f"{part}."): v for k, v in named.items() if k.startswith(f"{part}.")})
        return self

    def encode(self, beats: np.ndarray) -> np.ndarray:
        return self.encoder.forward(np.asarray(beats, float))[0]

    def decode(self, latents: np.ndarray) -> np.ndarray:
        return self.decoder.forward(np.asarray(latents, float))[0]

    def gradient(self, beats: np.ndarray, losses: Losses = Losses(), drop: Callable | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """(loss, gradients by name), summed over the rows."""
        latent, kept = self.encoder.forward(beats, drop)
        recon, more = self.decoder.forward(latent, drop)
        loss, g = losses.of(recon, beats)
        g, back = self.decoder.backward(g, more)
        _, front = self.encoder.backward(g, kept)
        return loss, {f"encoder.{k}": v for k, v in front.items()} | {f"decoder.{k}": v for k, v in back.items()}

    def squares(self, beats: np.ndarray) -> tuple[float, np.ndarray]:
        """(plain loss, squared errors by channel), summed over the rows; of a symmetric and asymmetric pair the channels are both wings'."""
        error = self.decode(self.encode(beats)) - beats
        plain = float((error**2).mean(axis=(1, 2)).sum())
        if REPRESENTATIONS[self.representation].paired:
            half = self.channels // 2
            error = np.concatenate([error[:, :half] + error[:, half:], error[:, :half] - error[:, half:]], axis=1)
        return plain, (error**2).sum(axis=(0, 2))

    def degrees(self, squares: np.ndarray, rows: int) -> list[float]:
        """Root mean squared errors by channel, in degrees."""
        scale = np.asarray(REPRESENTATIONS[self.representation].scale, float)
        return np.degrees(np.sqrt(squares / max(rows * self.length, 1)) * scale).tolist()
