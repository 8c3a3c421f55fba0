"""Layers of small networks over (rows, channels, length) arrays, with their gradients. NumPy only.

A layer holds parameters and nothing else: forward gives its output and what backward needs, backward the gradient of its input and those of
its parameters, summed over the rows. So one layer can serve many batches and be broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

_NODES = np.linspace(-8, 8, 16_385)
_ERF = np.array([math.erf(x) for x in _NODES])
_ERF_SLOPE = 2 / math.sqrt(math.pi) * np.exp(-(_NODES**2))


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, by cubic interpolation between tabulated values and slopes; within 1e-14."""
    x = np.clip(x, -8, 8)
    h = _NODES[1] - _NODES[0]
    i = np.minimum(((x + 8) / h).astype(np.int64), len(_NODES) - 2)
    t = (x - _NODES[i]) / h
    a, b, m, n = _ERF[i], _ERF[i + 1], _ERF_SLOPE[i] * h, _ERF_SLOPE[i + 1] * h
    return a + t * (m + t * (3 * (b - a) - 2 * m - n + t * (2 * (a - b) + m + n)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _mish(x: np.ndarray) -> np.ndarray:
    return x * np.tanh(np.logaddexp(0, x))


def _mish_slope(x: np.ndarray) -> np.ndarray:
    t = np.tanh(np.logaddexp(0, x))
    return t + x * (1 - t**2) * _logistic(x)


def _gelu_slope(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(x / math.sqrt(2))) + x * np.exp(-(x**2) / 2) / math.sqrt(2 * math.pi)


def _silu_slope(x: np.ndarray) -> np.ndarray:
    s = _logistic(x)
    return s * (1 + x * (1 - s))


#: name: (function, slope)
ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "gelu": (lambda x: 0.5 * x * (1 + erf(x / math.sqrt(2))), _gelu_slope),
    "silu": (lambda x: x * _logistic(x), _silu_slope),
    "swish": (lambda x: x * _logistic(x), _silu_slope),
    "elu": (lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))), lambda x: np.where(x > 0, 1.0, np.exp(np.minimum(x, 0)))),
    "relu": (lambda x: np.maximum(x, 0), lambda x: (x > 0).astype(float)),
    "leakyrelu": (lambda x: np.where(x > 0, x, 0.01 * x), lambda x: np.where(x > 0, 1.0, 0.01)),
    "mish": (_mish, _mish_slope),
    "tanh": (np.tanh, lambda x: 1 - np.tanh(x) ** 2),
}


def activation(name: str) -> tuple[Callable, Callable]:
    if name.lower() not in ACTIVATIONS:
        raise ValueError(f"no activation {name!r}: {', '.join(ACTIVATIONS)}")
    return ACTIVATIONS[name.lower()]


@dataclass
class Layer:
    """Base: no parameters, passes its input on."""

    parameters: dict[str, np.ndarray] = field(default_factory=dict, init=False)

    def begin(self, random: np.random.Generator) -> None:
        """Fresh parameters."""

    def forward(self, x: np.ndarray, drop: Callable | None = None) -> tuple[np.ndarray, object]:
        return x, None

    def backward(self, g: np.ndarray, kept: object) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        return g, {}


def _uniform(random: np.random.Generator, fan_in: int, *shape: int) -> np.ndarray:
    reach = 1 / math.sqrt(fan_in)
    return random.uniform(-reach, reach, shape)


@dataclass
class Convolution(Layer):
    """One-dimensional convolution with dilation and stride 1; ends are repeated so that the length stays. The kernel is odd."""

    inputs: int
    outputs: int
    kernel: int
    dilation: int = 1

    def __post_init__(self):
        if self.kernel < 1 or self.kernel % 2 == 0:
            raise ValueError(f"a kernel of {self.kernel} has no middle")

    def begin(self, random):
        fan = self.inputs * self.kernel
        self.parameters = {"weight": _uniform(random, fan, self.outputs, self.inputs, self.kernel), "bias": _uniform(random, fan, self.outputs)}

    def _places(self, length: int) -> np.ndarray:
        """(kernel, length): the input place of each tap of each output place."""
        reach = self.dilation * (self.kernel // 2)
        return np.clip(np.arange(length) + self.dilation * np.arange(self.kernel)[:, None] - reach, 0, length - 1)

    def forward(self, x, drop=None):
        taps = x[:, :, self._places(x.shape[2])]  # rows, inputs, kernel, length
        columns = taps.reshape(len(x), -1, x.shape[2])
        weight = self.parameters["weight"].reshape(self.outputs, -1)
        return weight @ columns + self.parameters["bias"][:, None], columns

    def backward(self, g, kept):
        weight = self.parameters["weight"].reshape(self.outputs, -1)
        own = {"weight": np.einsum("bol,bcl->oc", g, kept, optimize=True).reshape(self.parameters["weight"].shape), "bias": g.sum(axis=(0, 2))}
        back = (weight.T @ g).reshape(len(g), self.inputs, self.kernel, g.shape[2])
        out, length = np.zeros((len(g), self.inputs, g.shape[2])), g.shape[2]
        for tap, at in enumerate(self._places(length)):
            inside = np.flatnonzero(np.diff(at, prepend=-1))  # the first output place of each input place
            out[:, :, at[inside]] += np.add.reduceat(back[:, :, tap], inside, axis=2)
        return out, own


@dataclass
class GroupNorm(Layer):
    """Each row's channels are scaled group by group to mean 0 and variance 1, then by a factor and a shift a channel."""

    groups: int
    channels: int
    epsilon: float = 1e-5

    def __post_init__(self):
        if self.channels % self.groups:
            raise ValueError(f"{self.channels} channels don't make {self.groups} groups")

    def begin(self, random):
        self.parameters = {"weight": np.ones(self.channels), "bias": np.zeros(self.channels)}

    def forward(self, x, drop=None):
        grouped = x.reshape(len(x), self.groups, -1)
        deviation = grouped - grouped.mean(axis=2, keepdims=True)
        scale = 1 / np.sqrt((deviation**2).mean(axis=2, keepdims=True) + self.epsilon)
        normal = (deviation * scale).reshape(x.shape)
        return normal * self.parameters["weight"][:, None] + self.parameters["bias"][:, None], (normal, scale)

    def backward(self, g, kept):
        normal, scale = kept
        own = {"weight": (g * normal).sum(axis=(0, 2)), "bias": g.sum(axis=(0, 2))}
        up, flat = (g * self.parameters["weight"][:, None]).reshape(len(g), self.groups, -1), normal.reshape(len(g), self.groups, -1)
        back = (up - up.mean(axis=2, keepdims=True) - flat * (up * flat).mean(axis=2, keepdims=True)) * scale
        return back.reshape(g.shape), own


@dataclass
class Activation(Layer):
    name: str

    def __post_init__(self):
        activation(self.name)

    def forward(self, x, drop=None):
        return activation(self.name)[0](x), x

    def backward(self, g, kept):
        return g * activation(self.name)[1](kept), {}


@dataclass
class Resize(Layer):
    """Another length by a fixed linear map: averages over spans, neighbours' repetition, or linear interpolation."""

    kind: str
    length: int

    def matrix(self, n: int) -> np.ndarray:
        """(n, length)."""
        i, m = np.arange(self.length), self.length
        out = np.zeros((n, m))
        if self.kind == "average":
            for j in i:
                low, high = j * n // m, -(-(j + 1) * n // m)
                out[low:high, j] = 1 / (high - low)
        elif self.kind == "nearest":
            out[i * n // m, i] = 1
        elif self.kind == "linear":
            at = np.maximum((i + 0.5) * n / m - 0.5, 0)
            low = np.minimum(at.astype(int), n - 1)
            high = np.minimum(low + 1, n - 1)
            np.add.at(out, (low, i), 1 - (at - low))
            np.add.at(out, (high, i), at - low)
        else:
            raise ValueError(f"no kind {self.kind!r}")
        return out

    def forward(self, x, drop=None):
        if x.shape[2] == self.length:
            return x, None
        matrix = self.matrix(x.shape[2])
        return x @ matrix, matrix

    def backward(self, g, kept):
        return (g if kept is None else g @ kept.T), {}


@dataclass
class Dense(Layer):
    inputs: int
    outputs: int

    def begin(self, random):
        self.parameters = {"weight": _uniform(random, self.inputs, self.inputs, self.outputs), "bias": _uniform(random, self.inputs, self.outputs)}

    def forward(self, x, drop=None):
        return x @ self.parameters["weight"] + self.parameters["bias"], x

    def backward(self, g, kept):
        return g @ self.parameters["weight"].T, {"weight": kept.T @ g, "bias": g.sum(axis=0)}


@dataclass
class Shape(Layer):
    """Each row in another shape."""

    to: tuple[int, ...]

    def forward(self, x, drop=None):
        return x.reshape(len(x), *self.to), x.shape

    def backward(self, g, kept):
        return g.reshape(kept), {}


@dataclass
class Dropout(Layer):
    """Leaves out values while training. drop(shape, place) gives each row's draws, so that they belong to the row and not to its batch."""

    share: float
    place: int = 0

    def forward(self, x, drop=None):
        if drop is None or not self.share:
            return x, None
        mask = (drop(x.shape, self.place) >= self.share) / (1 - self.share)
        return x * mask, mask

    def backward(self, g, kept):
        return (g if kept is None else g * kept), {}


@dataclass
class Chain(Layer):
    """Layers one behind the other; parameters are named by place."""

    layers: list[Layer]

    def begin(self, random):
        for layer in self.layers:
            layer.begin(random)

    @property
    def named(self) -> dict[str, np.ndarray]:
        return {f"{k}.{name}": p for k, layer in enumerate(self.layers) for name, p in layer.parameters.items()}

    def load(self, named: dict[str, np.ndarray]) -> None:
        for k, layer in enumerate(self.layers):
            layer.parameters = {name.split(".", 1)[1]: p for name, p in named.items() if name.split(".", 1)[0] == str(k)}

    def forward(self, x, drop=None):
        kept = []
        for layer in self.layers:
            x, k = layer.forward(x, drop)
            kept.append(k)
        return x, kept

    def backward(self, g, kept):
        own = {}
        for k in range(len(self.layers) - 1, -1, -1):
            g, grads = self.layers[k].backward(g, kept[k])
            own |= {f"{k}.{name}": v for name, v in grads.items()}
        return g, own


# --- optimisers: each step takes the parameters, their gradients and the state that it keeps, all as one flat vector -------------------------


@dataclass
class Optimiser:
    """One of adam, adamw, sgd (momentum 0.9) and rmsprop, with weight decay. Its state is `slots` vectors as long as the parameters."""

    name: str = "adam"
    rate: float = 1e-3
    decay: float = 0.0

    SLOTS = {"adam": 2, "adamw": 2, "sgd": 1, "rmsprop": 1}

    def __post_init__(self):
        self.name = self.name.lower()
        if self.name not in self.SLOTS:
            raise ValueError(f"no optimiser {self.name!r}: {', '.join(self.SLOTS)}")

    @property
    def slots(self) -> int:
        return self.SLOTS[self.name]

    def step(self, p: np.ndarray, g: np.ndarray, state: np.ndarray, t: int, rate: float) -> None:
        """Changes p and state in place; t counts steps from 1."""
        if self.name == "adamw":
            p *= 1 - rate * self.decay
        elif self.decay:
            g = g + self.decay * p
        if self.name in ("adam", "adamw"):
            first, second = state
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            p -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        elif self.name == "sgd":
            state[0] *= 0.9
            state[0] += g
            p -= rate * state[0]
        else:
            state[0] += 0.01 * (g * g - state[0])
            p -= rate * g / (np.sqrt(state[0]) + 1e-8)


@dataclass
class Plateau:
    """Halves the rate when the watched loss has not fallen by a ten-thousandth for more than `patience` epochs."""

    rate: float
    patience: int = 4
    factor: float = 0.5
    best: float = math.inf
    idle: int = 0

    def see(self, loss: float) -> float:
        if loss < self.best * (1 - 1e-4):
            self.best, self.idle = loss, 0
        else:
            self.idle += 1
            if self.idle > self.patience:
                self.rate, self.idle = self.rate * self.factor, 0
        return self.rate
