import numpy as np
import pandas as pd
import pytest
from cadenza.functions.registry import PAIR_SCALE
from cadenza.operators import beats as B
from cadenza.operators import graph as G
from cadenza.operators import models as M
from cadenza.operators import sequence as S
from cadenza.operators import statistics as Q
from cadenza.operators import vectors as V
from cadenza.plans import pipeline as P
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def raw(spark):
    r = np.random.default_rng(2)
    flights = []
    for k in range(4):
        n = 1400
        t = np.arange(n)
        phase = 2 * np.pi * (t - 10) / 70 + 0.1 * np.sin(t / 200 + k)
        wing = lambda a, k=k, phase=phase: a * np.cos(phase) + 0.05 * np.cos(2 * phase + k)
        spin = np.radians(300) * t / 16000
        f = pd.DataFrame({"trajectory_id": k, "frame": t, "phi_l": wing(1.0), "theta_l": wing(0.1), "psi_l": wing(0.5), "phi_r": wing(0.98), "theta_r": wing(0.11), "psi_r": wing(0.49)})
        f["com_x"], f["com_y"], f["com_z"] = 0.1 * t / 16000, 0.5 * (t / 16000) ** 2, 0.01 * r.normal() * np.ones(n)
        axes = {"xb": (np.cos(spin), np.sin(spin), 0 * spin), "yb": (-np.sin(spin), np.cos(spin), 0 * spin), "zb": (0 * spin, 0 * spin, 0 * spin + 1)}
        for name, v in axes.items():
            for c, x in zip("xyz", v, strict=True):
                f[f"{name}_{c}"] = x
        f.loc[:4, "phi_l"] = np.nan
        flights.append(f)
    return spark.createDataFrame(pd.concat(flights))


def test_condense_and_mirror(raw):
    frames = P.condense(raw).toPandas()
    assert len(frames) == 2 * 4 * 1395 and frames["frame"].min() == 5
    plain, image = (frames[frames["is_mirrored"] == m].sort_values(["trajectory_id", "frame"]).reset_index() for m in (False, True))
    assert (plain["phi_l"] == image["phi_r"]).all() and np.allclose(plain["w_z"], -image["w_z"])
    inner = plain[(plain["frame"] > 300) & (plain["frame"] < 1000)]
    assert np.allclose(inner["w_z"], 300, rtol=1e-3) and np.allclose(inner["alpha_z"], 0, atol=1)


def test_beats_to_evaluation(spark, raw):
    frames = P.condense(raw).where("not is_mirrored").drop("is_mirrored")
    beats, mean = P.build_beats(P.without_garbage(frames), length=69)
    beats = beats.persist()
    rows = beats.toPandas()
    assert len(rows) > 60 and rows["duration"].between(60, 80).all()
    assert all(np.shape(np.stack([np.stack(c) for c in [b]])) == (1, 6) or len(b) == 6 for b in rows["beat"])
    assert B.template_matrix(mean).shape == (6, 69)
    encoder = M.fit_linear_encoder(beats, 4)
    both = M.decoded(M.encoded(beats, encoder), encoder)
    rmse = V.channel_rmse_degrees(both, "recon", "beat", PAIR_SCALE).toPandas()
    assert len(rmse) == 6 and (rmse["rmse_deg"] < 2).all()
    assert (M.end_to_end(both.withColumn("recon_pred", F.col("recon")), PAIR_SCALE).where("part = 'added'").toPandas()["rmse_deg"] == 0).all()
    ready = P.regressor_rows(M.encoded(beats, encoder))
    assert ready.count() == len(rows) - rows["trajectory_id"].nunique()
    roles = Q.split_by_key(beats, "trajectory_id", 0.25)
    assert roles.where("role = 'val'").count() == 1
    table = ready.join(roles, "trajectory_id").select("role", "features", "latent", "duration")
    configs = spark.createDataFrame([(0, 8, 1e-3, 3, 0), (1, 8, 1e-3, 3, 1)], "run long, hidden int, rate double, epochs int, seed int")
    fits = M.fit_grid(table, configs).toPandas()
    assert set(fits["run"]) == {0, 1} and all(len(x) == 3 for x in fits["losses"])
    assert M.traversal(spark, encoder, np.ones(4), 3).count() == 12
    from cadenza.functions.models import Regressor

    data = table.toPandas()
    net = Regressor(hidden=(4,))
    net.fit(np.stack(data["features"]), np.stack(data["latent"]), data["duration"].to_numpy(float), 2)
    made = M.generated(ready.select("features"), encoder, net).toPandas()
    assert all(len(b[0]) == n for b, n in zip(made["beat"], made["pred_duration"], strict=True))
    single, _ = P.build_beats(frames, length=40, representation="single_wing")
    sides = single.groupBy("trajectory_id", "idx").agg(F.collect_set("side").alias("s")).toPandas()
    assert all(sorted(s) == [0, 1] for s in sides["s"])


def test_residuals_invert():
    r = np.random.default_rng(0)
    seg, mean = r.normal(size=(6, 71)), r.normal(size=(6, 69))
    assert np.allclose(B.from_symmetric(B.to_symmetric(seg, mean), mean), seg)
    assert np.allclose(B.from_single(B.to_single(seg[:3], mean[:3]), mean[:3]), seg[:3])


def scored(spark, values, **options):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "k long, i long, x double")
    return [r.score for r in S.sustained_scores(df, "k", "i", "x", **options).orderBy("i").collect()]


def test_sustained_scores(spark):
    assert scored(spark, [5, 5, 5, 5, -5], percentile=0) == [1, 0.5, 0.5, 0.5, 0]
    assert scored(spark, [5, 5, 5], percentile=0) == [0, 0, 0]
    assert scored(spark, [0, 0, 0, 0], percentile=0) == [0, 0, 0, 0]


def test_buckets(spark):
    scores = [0.0, 0.25, 1 / 3, 0.5, 2 / 3, 0.75, 1.0, 1 - 5e-7]
    df = spark.createDataFrame([(s, 1.0) for s in scores], "score double, e double")
    assert [r.n for r in Q.bucket_errors(df, "score", "e").orderBy("position").collect()] == [1, 2, 2, 2, 2]
    empty = Q.bucket_errors(df.where("score = 0"), "score", "e").orderBy("position").collect()
    assert [r.n for r in empty] == [1, 0, 0, 0, 0] and empty[4].mse is None


def test_garbage_filter_edge(spark):
    for last, kept in ((11.0, 9), (10.0, 10)):
        df = spark.createDataFrame([(i, 1.0) for i in range(9)] + [(9, last)], "k long, score double")
        assert Q.asymmetry_filter(df).count() == kept
    zero = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 3.0)], "k long, score double")
    assert [r.suspicion for r in Q.asymmetry_filter(zero).collect()] == [0, 0, 0]


def test_ks_extremes(spark):
    one = spark.createDataFrame([(float(x),) for x in (1, 2, 3)], "v double")
    other = spark.createDataFrame([(float(x),) for x in (4, 5, 6)], "v double")
    assert Q.two_sample_ks(one, other, "v").first().d == 1 and Q.two_sample_ks(one, one, "v").first().d == 0


def test_retrieval_extremes(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0], [float(i), 1.0]) for i in range(6)], "id long, p array<double>, t array<double>")
    s = V.retrieval_summary(V.retrieval_ranks(v), (1, 5, 10)).first()
    assert s.median_rank == 0 and s.top_1 == 1 and "top_10" not in s.asDict()
    assert {r.r2 for r in V.r2_by_dimension(v, "p", "t").collect()} == {1.0}


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 20)
    r = np.random.default_rng(3)
    x = np.rint(4 * r.normal(size=(90, 3)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for q in V.exact_neighbours(df, df, 5).orderBy("query", "rank").collect():
        got.setdefault(q["query"], []).append(q["neighbour"])
    for i in range(90):
        assert got[i] == sorted(range(90), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:5]


def test_lower_median(spark):
    near = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (0, 2, 2.0), (1, 0, 3.0), (1, 2, 4.0)], "query long, neighbour long, d2 double")
    assert G.bandwidth(near).first().epsilon == 2.0


def test_diffusion_maps(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(30, 2)), r.normal(size=(30, 2)) + 100])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    near = V.exact_neighbours(df, df, 5)
    with pytest.raises(ValueError):
        G.diffusion_map(near, 2)
    whole = V.exact_neighbours(df.where("id < 30"), df.where("id < 30"), 12).persist()
    found, values = G.diffusion_map(whole, 2)
    assert found.count() == 30 and (values < 1).all()
    edges = G.affinity(whole, G.bandwidth(whole))
    operator = G.normalized(edges)
    _, iterated = G.leading_vectors(operator, operator.select("i").distinct(), 2)
    assert np.allclose(iterated, G.dense_vectors(operator, 2)[2], atol=1e-8)


def test_ridge_is_the_closed_form(spark):
    r = np.random.default_rng(6)
    x, noise = r.normal(size=(80, 3)), 0.01 * r.normal(size=(80, 2))
    y = x @ r.normal(size=(3, 2)) + 5 + noise
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y array<double>")
    for alpha in (0.0, 10.0):
        w, mx, my = V.ridge(df, "x", "y", alpha)
        xc = x - x.mean(0)
        assert np.allclose(w, np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ (y - y.mean(0))), atol=1e-8)
        assert np.allclose(np.stack(V.ridge_predict(df, "x", (w, mx, my)).orderBy("id").toPandas()["pred"]), xc @ w + y.mean(0))


def test_gap_policies(spark):
    rows = [(0, i, None if i in (0, 3, 9) else float(i)) for i in range(10)] + [(1, i, float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "k long, i long, x double")
    n = lambda policy, least=1: sorted((r.k, r.i) for r in S.valid_span(df, "k", "i", ["x"], policy, least).collect())
    assert n("trim") == [(0, i) for i in range(1, 9)] + [(1, i) for i in range(4)]
    assert n("trim_strict") == [(1, i) for i in range(4)] and n("trim", 5) == [(0, i) for i in range(1, 9)]
    assert n("drop") == [(0, i) for i in range(7)] + [(1, i) for i in range(4)]
    with pytest.raises(ValueError):
        n("other")


def test_quality(spark, raw):
    from cadenza.plans import quality as C

    frames = S.valid_span(raw, "trajectory_id", "frame", B.WINGS)
    rows = C.screen(frames).toPandas()
    assert len(rows) == 4 and (rows["n_beats"] == rows["n_peaks"] - 1).all() and rows["mean_beat"].between(60, 80).all() and set(rows["class"]) == {"low"}
    summary = C.frequencies(raw).first()
    assert 60 < summary.mean < 80 and abs(summary.hz_mean - 16000 / summary.mean) < 1e-9
    gathered = B.segments(frames, S.intervals(B.boundaries(frames), "trajectory_id", "at"), B.WINGS)
    values = C.beat_values(gathered).persist()
    tests, verdict = C.compare(values, values)
    assert {r.d for r in tests.collect()} == {0.0} and verdict.first().verdict == "COMPATIBLE"
    shifted = values.withColumn("value", F.when(F.col("metric") == "duration", F.col("value") + 100).otherwise(F.col("value")))
    tests, verdict = C.compare(values, shifted)
    assert verdict.first().asDict() == {"verdict": "INCOMPATIBLE", "drivers": "duration"}
    assert {r.metric: r.p < 1e-6 for r in tests.collect()}["duration"]


def test_nearest_of_all_others(spark, tmp_path, monkeypatch):
    from cadenza.plans import catalog

    monkeypatch.setattr(V, "BLOCK", 17)
    r = np.random.default_rng(4)
    # twelve vectors a label close together, the first label's all alike: the eight nearest are all of the own label
    label = np.repeat(np.arange(4), 12)
    x = r.normal(size=(4, 1, 64)) * 5 + r.normal(size=(4, 12, 64)) * 0.1
    x[0] = x[0, 0]
    x = x.reshape(48, 64)
    rows = [(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x, strict=True))]
    rows.append((52, None, x[0].tolist()))
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    d2 = np.where(label[:, None] == label, np.inf, ((x[:, None] - x) ** 2).sum(axis=2))
    found = catalog.QUERIES["nearest_of_other_group"](spark, str(tmp_path)).collect()
    assert {q.query: q.neighbour for q in found} == {q: int(d2[q].argmin()) for q in range(0, 48, 4)} and len(found) == 12
    y = r.normal(size=48)
    v = spark.createDataFrame([(i, k, v, float(z)) for (i, k, v), z in zip(rows, y, strict=False)], "id long, label int, v array<double>, y double")
    got = V.ceiling(V.exact_neighbours(v, v, 1, apart="label"), v).first()
    assert got.n == 48 and np.isclose(got.ceiling, 1 - 0.5 * ((y - y[d2.argmin(axis=1)]) ** 2).mean() / y.var())
    pairs = spark.createDataFrame([(i, [float(i // 2)]) for i in range(6)], "id long, v array<double>")
    assert {(q.query, q.neighbour) for q in V.exact_neighbours(pairs, pairs, 1, apart="id").collect()} == {(i, i ^ 1) for i in range(6)}
    assert V.exact_neighbours(v.where("label = 1"), v.where("label = 1"), 3, apart="label").count() == 0
