import numpy as np
import pytest
from cadenza.functions import kernels as K
from cadenza.functions import registry as R
from hypothesis import given, settings
from hypothesis import strategies as st


def stroke(n=700, shift=0):
    return np.cos(2 * np.pi * (np.arange(n) - 10 - shift) / 70)


def test_cosine_peaks():
    assert K.peaks(stroke(), 50).tolist() == list(range(10, 700, 70))
    assert K.stroke_boundaries(stroke(), stroke(shift=4)).tolist() == [12 + 70 * i for i in range(10)]


def test_small_bumps_are_pruned():
    x = stroke()
    for p in range(30, 700, 70):
        x[p] += 0.5
    assert K.peaks(x, 50).tolist() == list(range(10, 700, 70))


def test_flat_top_and_ends():
    assert K.local_maxima([0, 1, 1, 1, 0, 2, 2, 0, 3]).tolist() == [2, 5]
    assert K.local_maxima([1, 1]).tolist() == [] and K.local_maxima([]).tolist() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=3, max_size=60), st.integers(1, 9))
def test_spaced_keeps_highest_and_distance(values, distance):
    x = np.array(values, float)
    found = K.spaced(x, K.local_maxima(x), distance)
    assert all(b - a >= distance for a, b in zip(found, found[1:], strict=False))
    for p in set(K.local_maxima(x)) - set(found):
        assert any(abs(p - q) < distance and (x[q], q) > (x[p], p) for q in found)


def test_prominence():
    x = np.array([0.0, 3, 1, 2, 0.5, 5, 0])
    assert K.prominence(x, np.array([1, 3, 5])).tolist() == [2.5, 1.0, 5.0]


@pytest.mark.parametrize("n", [4, 5, 61, 69, 75])
def test_resample_is_exact_on_cubics(n):
    t = np.linspace(-1, 1, n)
    poly = np.stack([2 * t**3 - t, 1 + t**2], axis=1)
    u = np.linspace(-1, 1, 69)
    assert np.allclose(K.resample(poly, 69), np.stack([2 * u**3 - u, 1 + u**2], axis=1), atol=1e-11)
    m = K.resample_matrix(n, 69)
    assert np.allclose(m.sum(axis=1), 1) and np.allclose(m[0], np.eye(n)[0]) and np.allclose(m[-1], np.eye(n)[-1])


def test_resample_keeps_equal_length():
    x = np.random.default_rng(0).normal(size=(69, 3))
    assert (K.resample(x, 69) == x).all()
    assert np.allclose(K.resample(np.array([[1.0], [3.0]]), 3).ravel(), [1, 2, 3])


def test_smoothing_is_exact_on_parabolas():
    t = np.arange(1000) / 16000
    x = 3 + 2 * t - 5 * t**2
    for derivative, want in enumerate([x, 2 - 10 * t, np.full(1000, -10.0)]):
        assert np.allclose(K.smooth(x, 351, 2, derivative, 1 / 16000), want, rtol=1e-6, atol=1e-6)
    with pytest.raises(ValueError):
        K.smooth(x[:100], 351, 2)


def test_rotation_about_z():
    rate, speed = 16000.0, 1000.0
    a = np.radians(speed) * np.arange(400) / rate
    zero, one = np.zeros(400), np.ones(400)
    axes = [np.stack(v, axis=1) for v in ((np.cos(a), np.sin(a), zero), (-np.sin(a), np.cos(a), zero), (zero, zero, one))]
    w = K.angular_velocity(*axes, rate)
    delta = np.radians(speed) / rate
    assert np.allclose(w[1:-1], [0, 0, np.sin(delta) / delta * speed], atol=1e-6)


def test_ks_probability():
    assert K.ks_probability(0.0, 100, 100) == 1.0 and K.ks_probability(0.9, 100, 100) < 1e-10
    assert 0.04 < K.ks_probability(1.358 * (2 / 1000) ** 0.5, 1000, 1000) < 0.06


def test_registry():
    assert R.features("pitch") == [7, 10] and R.features("pitch", [3]) == [3]
    with pytest.raises(ValueError):
        R.features(indices=[15])
    assert R.score_axes(["roll", "all", "max"]) == ["roll", "max", "yaw", "pitch"]
    assert R.component("3") == ("pc", 3) and R.component("dim:2") == ("dim", 2)
    with pytest.raises(ValueError):
        R.component("x:1")
    assert R.dataset_name("sa", 69) == "beats_l69" and R.dataset_name("single_wing", 69, 8) == "regressor_d8_l69_single_wing"


def test_network_learns():
    from cadenza.functions.models import Regressor

    r = np.random.default_rng(1)
    x = r.normal(size=(400, 3))
    y = np.stack([x[:, 0] * x[:, 1], np.tanh(x[:, 2])], axis=1)
    d = np.rint(np.exp(4 + 0.1 * x[:, 0]))
    model = Regressor(hidden=(32,))
    losses = model.fit(x, y, d, epochs=60, rate=5e-3)
    assert losses[-1] < 0.2 * losses[0]
    latent, duration = model.predict(x)
    assert 1 - ((latent - y) ** 2).sum() / ((y - y.mean(0)) ** 2).sum() > 0.8 and duration.min() >= 2
    model.weights, model.biases, model.duration_mean, model.duration_sd = [np.zeros((3, 3))], [np.array([0, 0, 1.0])], 0.0, float(np.log(2.5))
    assert model.predict(x[:1])[1].tolist() == [2]
