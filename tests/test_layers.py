"""Layers against plain loops and differences, optimisers against their definitions; no Spark."""

import math

import numpy as np
import pytest
from cadenza.functions import layers as L
from cadenza.functions.autoencoder import ConvolutionalAutoencoder, Losses
from cadenza.functions.models import Regressor

RANDOM = np.random.default_rng(4)


def begun(layer, seed=1):
    layer.begin(np.random.default_rng(seed))
    return layer


def differences(f, x, h=1e-6):
    out = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        old = x[i]
        x[i] = old + h
        up = f()
        x[i] = old - h
        out[i] = (up - f()) / (2 * h)
        x[i] = old
    return out


def test_erf_and_activations():
    x = np.linspace(-9, 9, 4001)
    assert np.abs(L.erf(x) - [math.erf(v) for v in x]).max() < 1e-13
    assert L.activation("Swish") == L.ACTIVATIONS["swish"]
    for name, (f, slope) in L.ACTIVATIONS.items():
        at = np.array([-3.1, -0.7, -0.01, 0.02, 0.5, 2.2])
        assert np.allclose(slope(at), (f(at + 1e-6) - f(at - 1e-6)) / 2e-6, atol=1e-6), name
    assert np.allclose(L.ACTIVATIONS["gelu"][0](np.array([1.0, -2.0])), [0.8413447461, -0.0455002639])
    assert np.allclose(L.ACTIVATIONS["mish"][0](np.array([1.0])), [0.8650983883])
    with pytest.raises(ValueError):
        L.activation("none")


@pytest.mark.parametrize(("kernel", "dilation", "length"), [(5, 1, 11), (3, 4, 11), (5, 2, 4), (1, 1, 3)])
def test_convolution_as_loops(kernel, dilation, length):
    layer, x = begun(L.Convolution(3, 2, kernel, dilation)), RANDOM.normal(size=(2, 3, length))
    got, _ = layer.forward(x)
    w, b = layer.parameters["weight"], layer.parameters["bias"]
    for r in range(2):
        for o in range(2):
            for t in range(length):
                want = b[o] + sum(w[o, c, k] * x[r, c, min(max(t + dilation * (k - kernel // 2), 0), length - 1)] for c in range(3) for k in range(kernel))
                assert abs(got[r, o, t] - want) < 1e-12
    with pytest.raises(ValueError):
        L.Convolution(1, 1, 4)


def test_resizing():
    x = np.arange(10.0).reshape(1, 1, 10)
    assert np.allclose(L.Resize("average", 4).forward(x)[0], [[[1, 3, 6, 8]]])  # spans 0-3, 2-5, 5-8, 7-10
    assert L.Resize("nearest", 4).forward(x[:, :, :2])[0].tolist() == [[[0, 0, 1, 1]]]
    assert np.allclose(L.Resize("linear", 4).forward(x[:, :, :2])[0], [[[0, 0.25, 0.75, 1]]])
    assert L.Resize("linear", 10).forward(x)[0] is x


LAYERS = [
    (L.Convolution(3, 4, 5, 2), (2, 3, 9)), (L.Convolution(2, 2, 3, 4), (2, 2, 5)), (L.GroupNorm(2, 4), (2, 4, 5)), (L.Activation("gelu"), (2, 3, 4)),
    (L.Resize("average", 3), (2, 2, 7)), (L.Resize("linear", 9), (2, 2, 6)), (L.Resize("nearest", 8), (1, 2, 4)), (L.Dense(5, 3), (4, 5)), (L.Shape((6,)), (2, 2, 3)),
]


@pytest.mark.parametrize(("layer", "shape"), LAYERS)
def test_gradients(layer, shape):
    begun(layer)
    for p in layer.parameters.values():
        p += RANDOM.normal(size=p.shape) * 0.1
    x = RANDOM.normal(size=shape)
    y, kept = layer.forward(x)
    weight = RANDOM.normal(size=y.shape)
    loss = lambda: float((layer.forward(x)[0] * weight).sum())
    g, own = layer.backward(weight, kept)
    assert np.allclose(g, differences(loss, x), atol=1e-6)
    for name, p in layer.parameters.items():
        assert np.allclose(own[name], differences(loss, p), atol=1e-6), name


def small(**more):
    return ConvolutionalAutoencoder(**({"latent": 3, "channels": 6, "length": 13, "base": 32, "bottleneck": 3, "kernel": 3} | more)).begin(5)


def test_autoencoder_gradients():
    model, beats = small(), RANDOM.normal(size=(2, 6, 13)) * 0.3
    losses = Losses(channels=(1, 1, 1, 2, 2, 2), endpoint=3.0, endpoints=2, cycle=0.5, derivative=0.7)
    _, grads = model.gradient(beats, losses)
    assert set(grads) == set(model.named)
    run = lambda: losses.of(model.decode(model.encode(beats)), beats)[0]
    for name, p in model.named.items():
        for at in [tuple(RANDOM.integers(0, n) for n in p.shape) for _ in range(3)]:
            old = p[at]
            p[at] = old + 1e-5
            up = run()
            p[at] = old - 1e-5
            assert abs((up - run()) / 2e-5 - grads[name][at]) < 1e-5, name
            p[at] = old


def test_autoencoder_shapes_and_protocol():
    for length in (12, 13, 80):
        model = small(length=length)
        x = RANDOM.normal(size=(3, 6, length))
        assert model.encode(x).shape == (3, 3) and model.decode(model.encode(x)).shape == x.shape
    again = ConvolutionalAutoencoder(**model.config).load({k: v.copy() for k, v in model.named.items()})
    assert (again.decode(again.encode(x)) == model.decode(model.encode(x))).all()
    for wrong in ({"base": 48}, {"kernel": 4}, {"activation": "x"}):
        with pytest.raises(ValueError):
            small(**wrong)
    plain, squares = model.squares(x)
    error = model.decode(model.encode(x)) - x
    assert abs(plain - (error**2).mean(axis=(1, 2)).sum()) < 1e-9
    assert np.allclose(squares[:3], ((error[:, :3] + error[:, 3:]) ** 2).sum(axis=(0, 2)))


def test_dropout_belongs_to_rows():
    model, x = small(dropout=0.4), RANDOM.normal(size=(4, 6, 13))
    draw = lambda keys: lambda shape, place: np.stack([np.random.default_rng([k, place]).random(shape[1:]) for k in keys])
    whole = model.gradient(x, drop=draw([1, 2, 3, 4]))
    parts = [model.gradient(x[i : i + 2], drop=draw([i + 1, i + 2])) for i in (0, 2)]
    assert abs(whole[0] - sum(p[0] for p in parts)) < 1e-9
    assert all(np.allclose(whole[1][k], parts[0][1][k] + parts[1][1][k]) for k in whole[1])
    assert model.gradient(x)[0] == small().gradient(x)[0]


def test_regressor_dropout_gradient():
    model = Regressor(hidden=(7, 5), activation="tanh", dropout=0.3)
    model.begin(4, 2, 0.0, 1.0)
    x, y, drop = RANDOM.normal(size=(6, 4)), RANDOM.normal(size=(6, 3)), lambda shape, place: np.random.default_rng(place).random(shape)
    _, grads = model.gradient(x, y, 0.5, drop)
    for p, g in zip(model.weights + model.biases, grads, strict=True):
        assert np.allclose(g, differences(lambda: model.gradient(x, y, 0.5, drop)[0], p), atol=1e-5)


@pytest.mark.parametrize("name", L.Optimiser.SLOTS)
def test_optimisers(name):
    """Two steps by hand, and a bowl's bottom."""
    for decay in (0.0, 0.1):
        step, p, q = L.Optimiser(name, 0.1, decay), np.array([1.0, -2.0]), np.array([1.0, -2.0])
        state, m, v, buf = np.zeros((step.slots, 2)), 0.0, 0.0, 0.0
        for t in (1, 2):
            g = 2 * p
            step.step(p, g.copy(), state, t, 0.1)
            h = 2 * q
            if name == "adamw":
                q = q * (1 - 0.1 * decay)
            else:
                h = h + decay * q
            if name in ("adam", "adamw"):
                m, v = 0.9 * m + 0.1 * h, 0.999 * v + 0.001 * h * h
                q = q - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            elif name == "sgd":
                buf = 0.9 * buf + h
                q = q - 0.1 * buf
            else:
                v = 0.99 * v + 0.01 * h * h
                q = q - 0.1 * h / (np.sqrt(v) + 1e-8)
            assert np.allclose(p, q)
    with pytest.raises(ValueError):
        L.Optimiser("lion")


def test_plateau():
    rule = L.Plateau(1.0, patience=2)
    assert [rule.see(x) for x in (5, 4, 4, 4, 4, 3.99, 4, 4, 4)] == [1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5, 0.25]
