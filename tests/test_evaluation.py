"""Operators that SQL can't hold: ranks in cells, diffusion on the executors, fits in step, encoders, scalers, sinks."""

import numpy as np
import pandas as pd
import pytest
from cadenza.functions import registry as N
from cadenza.functions.models import LinearEncoder, Regressor
from cadenza.operators import beats as B
from cadenza.operators import graph as G
from cadenza.operators import models as M
from cadenza.operators import ranks as R
from cadenza.operators import shapes as H
from cadenza.operators import statistics as Q
from cadenza.operators import vectors as V
from cadenza.sources import tables as T
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def mixed(spark):
    """A third of the rows share a value, and some are null."""
    r = np.random.default_rng(1)
    values = [None if i % 50 == 0 else 7.0 if i % 3 == 0 else float(np.rint(r.normal() * 300)) for i in range(3000)]
    return values, spark.createDataFrame([(i, v, f"p/{(i * 7919) % 3000:05d}") for i, v in enumerate(values)], "id long, v double, path string").repartition(5).persist()


@pytest.mark.parametrize("sample", [4096, 64])
def test_ranks(mixed, monkeypatch, sample):
    monkeypatch.setattr(R, "SAMPLE", sample)
    values, df = mixed
    order = sorted(range(3000), key=lambda i: (values[i] is not None, values[i] or 0.0, i))
    got = {r["id"]: r["pos"] for r in R.ranked(df, "v", "id").collect()}
    assert [got[i] for i in order] == list(range(3000))
    paths = {r["path"]: r["n"] for r in R.ranked(df, "path", "id", "n").collect()}
    assert [paths[p] for p in sorted(paths)] == list(range(3000))
    known = sorted(v for v in values if v is not None)
    below = {r["v"]: r["below"] for r in R.counted_below(df, "v").select("v", "below").distinct().collect()}
    assert below == {v: known.index(v) for v in set(known)}
    at = [0.0, 0.01, 0.25, 0.5, 0.777, 1.0]
    assert np.allclose(R.quantiles(df, "v", at), np.quantile(known, at))
    assert R.quantiles(df.where("id < 0"), "v", [0.5]) == [None]
    assert R.ranked(df.where("id < 0"), "v", "id").count() == 0


def test_quantiles_narrow_down(spark, monkeypatch):
    monkeypatch.setattr(R, "SAMPLE", 16)
    x = np.random.default_rng(2).normal(size=5000)
    df = spark.createDataFrame(pd.DataFrame({"v": x}))
    assert np.allclose(R.quantiles(df, "v", [0.003, 0.5, 0.998]), np.quantile(x, [0.003, 0.5, 0.998]))


def test_covariance(spark):
    x = np.random.default_rng(3).normal(size=(200, 5)) @ np.random.default_rng(4).normal(size=(5, 5)) + 1e3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(7)
    mean, c = V.mean_and_covariance(df, "v")
    assert np.allclose(mean, x.mean(0)) and np.allclose(c, np.cov(x.T))
    inverse = np.linalg.pinv(c)
    got = V.mahalanobis(df, "v", mean, inverse).orderBy("id").toPandas()["distance"]
    off = x - x.mean(0)
    assert np.allclose(got, np.sqrt(np.einsum("ni,ij,nj->n", off, inverse, off)))
    found = V.compare_with_centre(df, "v", {"zero": [0.0] * 5}).first()
    assert np.isclose(found.l2, np.sqrt((x.mean(0) ** 2).sum())) and np.isclose(found.full, np.sqrt(x.mean(0) @ inverse @ x.mean(0))) and found.percentile == 100


def test_diffusion_as_dense(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(150, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    near = V.exact_neighbours(df, df, 40).persist()
    found = G.diffusion(near, G.Diffusion(components=4, accuracy=1e-8))
    operator = G.normalized(G.affinity(near, G.bandwidth(near)))
    nodes, vectors, values = G.dense_vectors(operator, 5)
    assert np.allclose(found.values, values[1:], atol=1e-7) and abs(found.trivial - 1) < 1e-7
    got = np.stack(found.vectors.orderBy("i").toPandas()["x"])
    assert np.allclose(np.abs(got), np.abs(vectors[:, 1:]), atol=1e-4)
    degree = {q.i: q.degree for q in G.degrees(G.affinity(near, G.bandwidth(near))).collect()}
    at = np.stack(found.coordinates.orderBy("i").toPandas()["coordinates"])
    assert np.allclose(at, got * found.values / np.sqrt([degree[i] for i in nodes])[:, None])


def test_diffusion_of_beats(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(40, 3, 5)) * np.array([1, 10, 0.1])[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, beat array<array<double>>")
    rows = V.channel_features(df, "beat", [1.0, 4.0, 9.0], equalize=True).orderBy("id").toPandas()
    want = x / x.std(axis=(0, 2), ddof=1)[:, None] * np.array([1, 2, 3])[:, None]
    assert np.allclose(np.stack(rows["features"]), want.reshape(40, 15))
    found = G.diffusion_of_beats(df, G.Diffusion(weights=(1.0, 4.0, 9.0), equalize=True, k=39, components=2))
    assert found.coordinates.count() == 40 and (found.values < 1).all()
    with pytest.raises(Exception, match="channels"):
        V.channel_features(df, "beat", [1.0]).collect()


def test_fits_in_step(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(90, 3))
    latent, duration = x @ r.normal(size=(3, 2)), np.rint(np.exp(4 + 0.1 * x[:, 0]))
    rows = [("val" if i % 5 == 0 else "train", x[i].tolist(), latent[i].tolist(), float(duration[i])) for i in range(90)]
    df = spark.createDataFrame(rows, "role string, features array<double>, latent array<double>, duration double").repartition(3)
    configs = spark.createDataFrame([(0, 6, 0.02, 12, 0), (1, 6, 0.02, 3, 1)], "run long, hidden int, rate double, epochs int, seed int")
    found = {q.run: q for q in M.fit_grid(df, configs).collect()}
    assert len(found[0].losses) == 12 and len(found[1].losses) == 3 and found[0].losses[-1] < found[0].losses[0]
    train = [i for i in range(90) if i % 5]
    one = Regressor(hidden=(6,))
    logs = np.log(duration[train])
    one.begin(3, 2, float(logs.mean()), float(logs.std()), 0)
    from cadenza.functions.models import Adam

    step, losses = Adam(one, 0.02), []
    for _ in range(12):
        loss, grads = one.gradient(x[train], one.targets(latent[train], duration[train]))
        losses.append(loss / len(train))
        step([g / len(train) for g in grads])
    assert np.allclose(found[0].losses, losses)
    held = [i for i in range(90) if i % 5 == 0]
    assert np.isclose(found[0].val_loss, ((one.predict(x[held])[0] - latent[held]) ** 2).mean())


def test_gradient():
    r = np.random.default_rng(8)
    m = Regressor(hidden=(4, 3), activation="tanh")
    m.begin(2, 2, 0.0, 1.0, 1)
    x, y = r.normal(size=(5, 2)), r.normal(size=(5, 3))
    _, grads = m.gradient(x, y)
    for p, g in zip(m.weights + m.biases, grads, strict=True):
        at = tuple(0 for _ in p.shape)
        p[at] += 1e-6
        high = m.gradient(x, y)[0]
        p[at] -= 2e-6
        low = m.gradient(x, y)[0]
        p[at] += 1e-6
        assert np.isclose((high - low) / 2e-6, g[at], rtol=1e-4, atol=1e-6)


def test_ladder_with_ridge(spark):
    r = np.random.default_rng(9)
    x, y = r.normal(size=(60, 3)), r.normal(size=(60, 2))
    y += x[:, :2]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y array<double>")
    found = {q.predictor: q for q in V.predictor_ladder(df.where("id >= 20"), df.where("id < 20"), (10.0,), (3,)).collect()}
    assert set(found) == {"mean", "ridge 10", "nearest 3"}
    xt, yt = x[20:], y[20:]
    w = np.linalg.solve((xt - xt.mean(0)).T @ (xt - xt.mean(0)) + 10 * np.eye(3), (xt - xt.mean(0)).T @ (yt - yt.mean(0)))
    p = (x[:20] - xt.mean(0)) @ w + yt.mean(0)
    assert np.isclose(found["ridge 10"].mse, ((p - y[:20]) ** 2).mean())
    assert np.isclose(found["ridge 10"].mean_r2, (1 - ((p - y[:20]) ** 2).sum(0) / ((y[:20] - y[:20].mean(0)) ** 2).sum(0)).mean())


def encoder_of(components=3):
    return LinearEncoder(np.eye(6)[:components], np.arange(6.0), (2, 3))


def test_traversals_and_bands(spark):
    r = np.random.default_rng(10)
    z = r.normal(size=(50, 3)) * [3, 2, 1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, latent array<double>")
    steps = M.component_traversal(df, encoder_of(), steps=3, reach=2.0).toPandas()
    assert len(steps) == 9
    values, vectors = np.linalg.eigh(np.cov(z.T))
    first = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
    want = encoder_of().decode((z.mean(0) + 2 * values[-1] ** 0.5 * first)[None])[0]
    assert np.allclose(np.stack(steps[(steps.component == 0) & (steps.step == 2)]["recon"].iloc[0]), want)
    bands = M.bootstrap_bands(df, encoder_of(), "id", draws=40).toPandas()
    assert len(bands) == 3 * 6 and (bands["p10"] <= bands["p50"]).all() and (bands["p50"] <= bands["p90"]).all()
    still = bands[(bands["dim"] == 0) & (bands["channel"] == 0) & (bands["phase"] == 1)]
    assert np.isclose(still["p10"], z.mean(0)[1] + 1).all() and np.isclose(still["p90"], z.mean(0)[1] + 1).all()
    found = {q.name: q for q in M.template_against_mean(df, encoder_of(), (2, 3)).collect()}
    assert np.isclose(found["template"].l2, np.linalg.norm(-np.arange(3.0) - z.mean(0))) and np.isclose(found["zero"].l2, np.linalg.norm(z.mean(0)))


def test_draws_are_the_same_again(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "id long, x double")
    a, b = ([(q.draw, q.value) for q in Q.drawn_with_replacement(df.repartition(n), "x", "id", 60).orderBy("draw").collect()] for n in (1, 4))
    assert a == b and len(a) == 60 and len({v for _, v in a}) < 21
    picked = H.consecutive_rows(spark.createDataFrame([(k, i) for k in range(3) for i in range(4 + 4 * k)], "k long, i long"), "k", "i", 5).orderBy("i").collect()
    assert len(picked) == 5 and len({q.k for q in picked}) == 1 and picked[-1].i - picked[0].i == 4


def test_scalers(spark):
    df = spark.createDataFrame([(0, [float(3 * i) for i in range(15)], [1.0] * 15), (1, [float(i * i) for i in range(15)], [0.0] * 15)], "id long, b array<double>, n array<double>")
    assert V.default_scaler(list(range(12))) == "vector_norm" and V.default_scaler([0, 1]) == "standardize"
    x = np.array(df.toPandas()["b"].tolist())
    s = V.fit_body_scaler(df, "b", N.features("full"))
    norms = np.sqrt((x[:, :12].reshape(2, 4, 3) ** 2).sum(2)).mean(0)
    got = np.stack(V.scaled_input(df, "b", "n", s).orderBy("id").toPandas()["x"])
    assert got.shape == (2, 24) and np.allclose(got[:, :12], x[:, :12] / np.repeat(norms, 3))
    assert np.stack(V.scaled_input(df, "b", "n", s, with_next=False).toPandas()["x"]).shape == (2, 12)
    assert V.offset_and_scale({"type": "vector_norm", "scale_factors": [2.0, 4.0]}) == ([0, 1], [0.0, 0.0], [2.0, 4.0])
    for bad in ({"type": "other"}, {}):
        with pytest.raises(ValueError):
            V.offset_and_scale(bad)


def test_registries(spark):
    assert set(N.TARGETS) == {"accel", "dvel_next", "dvel_within"} and N.colour_columns(2) == ["F0_accel", "F1_accel"]
    assert N.checked_channels(64) == 64
    for bad in (0, 48, -32):
        with pytest.raises(ValueError):
            N.checked_channels(bad)
    with pytest.raises(KeyError):
        N.target("other", "yaw")
    row = spark.createDataFrame([(1.0, 4.0)], "w_yaw_first double, w_yaw_last double").select(N.target("dvel_within", "yaw").alias("x")).first()
    assert row.x == 3.0
    bad = spark.createDataFrame([([[1.0, 2.0]],)], "a array<array<double>>")
    with pytest.raises(Exception, match="array of angles"):
        bad.select(H.degrees("a", "rad")).collect()
    with pytest.raises(ValueError):
        H.degrees("a", "grad")


def test_continuous_residuals(spark):
    t = np.arange(400)
    phase = 2 * np.pi * (t - 10) / 70
    f = pd.DataFrame({"trajectory_id": 1, "frame": t, **{c: a * np.cos(phase) for c, a in zip(B.WINGS, (1, 0.2, 0.5, 0.9, 0.3, 0.5), strict=True)}})
    short = f.assign(trajectory_id=2)[:60]
    mean = np.zeros((6, 100))
    got = B.continuous_symmetric(spark.createDataFrame(pd.concat([f, short])), mean).orderBy("frame").toPandas()
    assert set(got["trajectory_id"]) == {1} and list(got["frame"]) == list(range(10, 360))
    r = np.stack(got["residual"])
    c = np.cos(phase[10:360])
    assert np.allclose(r[:, 0], 0.95 * c) and np.allclose(r[:, 3], 0.05 * c) and np.allclose(r[:, 4], -0.05 * c)


def test_bucket_rows(spark):
    rows = [(0.0, [[1.0, 1.0]], [[0.0, 0.0]]), (0.5, [[2.0, 0.0]], [[0.0, 0.0]])]
    df = spark.createDataFrame(rows, "s double, p array<array<double>>, t array<array<double>>")
    found = {q.bucket: q for q in Q.bucket_evaluation(df, "s", "p", "t", None, [np.pi]).collect()}
    assert found["zero"].norm_mse == 1 and np.isclose(found["zero"].rmse_deg[0], 180) and found["mid"].norm_mse == 2 and np.isclose(found["mid"].mean_rmse_deg, 180 * 2**0.5)
    assert found["peak"].n == 0 and found["peak"].norm_mse is None and found["peak"].mean_rmse_deg is None


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "e")
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "i long, coordinates array<double>")
    colours = rows.select("i", (F.col("i") * 2).alias("score"))
    T.write_embedding(rows, at, {"k": 5}, colours)
    found, names, meta = T.read_embedding(spark, at)
    assert names == ["score"] and meta["k"] == 5 and {q.i: q.colour_score for q in found.collect()} == {i: 2 * i for i in range(4)}
    with pytest.raises(ValueError):
        T.write_embedding(rows, at, {}, colours.where("i > 0"))
    assert T.template_or_none(spark, str(tmp_path / "none")) is None
    T.write_report(spark.createDataFrame([(1, 0.5)], "n int, d double"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first().value == '{"n":1,"d":0.5}'
    keys = spark.createDataFrame([(i,) for i in range(10)], "k long")
    made, stale = T.validation_keys(keys, "k", None, 0.2)
    assert made.count() == 2 and not stale
    saved = spark.createDataFrame([(3, 9), (4, 9)], "k long, n_total long")
    kept, stale = T.validation_keys(keys, "k", saved)
    assert sorted(q.k for q in kept.collect()) == [3, 4] and stale
