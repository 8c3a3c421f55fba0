"""Training on the cluster, stored models, array files and datasets that are replaced whole."""

import io
import math

import numpy as np
import pytest
from cadenza.functions.autoencoder import ConvolutionalAutoencoder, Losses
from cadenza.functions.layers import Optimiser
from cadenza.functions.models import LinearEncoder, Regressor
from cadenza.operators import models as M
from cadenza.operators import training as R
from cadenza.sources import arrays, models, tables
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

RANDOM = np.random.default_rng(11)


def regression_rows(spark, n=400):
    x = RANDOM.normal(size=(n, 3))
    y = np.stack([np.sin(x[:, 0]), x[:, 1] * x[:, 2]], axis=1)
    rows = [(i, "val" if i % 5 == 0 else "train", x[i].tolist(), y[i].tolist(), float(np.exp(4 + 0.1 * x[i, 0]))) for i in range(n)]
    return spark.createDataFrame(rows, "key long, role string, features array<double>, latent array<double>, duration double").cache()


def regression_run(**more):
    return R.Run(R.RegressionTask(Regressor(hidden=(16,), activation="tanh"), 3, 2, 4.0, 0.1), **({"optimiser": Optimiser("adam", 0.01), "epochs": 4, "batch": 16, "seed": 3} | more))


def weights(run):
    return np.concatenate([p.ravel() for p in run.best_task.parameters()])


def test_weights_do_not_depend_on_partitions(spark):
    rows = regression_rows(spark)
    first = R.train(rows.repartition(7), [regression_run(), regression_run(seed=5, optimiser=Optimiser("sgd", 0.01))], shard_rows=50)
    second = R.train(rows.coalesce(1).orderBy(F.desc("key")), [regression_run(), regression_run(seed=5, optimiser=Optimiser("sgd", 0.01))], shard_rows=50)
    for a, b in zip(first, second, strict=True):
        assert (weights(a) == weights(b)).all() and a.val_losses == b.val_losses and a.steps == b.steps
    assert (weights(first[0]) != weights(first[1])).any()


def test_batches_need_fewer_passes(spark):
    rows = regression_rows(spark)
    small, whole = R.train(rows, [regression_run(epochs=8, batch=16), regression_run(epochs=8, batch=10**6)], shard_rows=100)
    assert next(k for k, x in enumerate(small.val_losses) if x <= whole.best) < 5, small.val_losses
    assert small.best == min(small.val_losses) and small.best_epoch == small.val_losses.index(small.best) + 1


def test_shards_of_shards_average(spark, monkeypatch):
    """More shards than one group averages give the average of all, weighted by rows."""
    rows = regression_rows(spark, 120)
    monkeypatch.setattr(R, "FAN", 2)
    run = R.train(rows, [regression_run(epochs=1, batch=8, optimiser=Optimiser("sgd", 0.05))], shard_rows=15)[0]
    train = rows.where("role = 'train'").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(7))).toPandas()  # 96 rows, 15 a shard
    total, n = 0.0, 0
    for _, part in train.groupby("shard"):
        task = regression_run().task
        task.begin(3)
        p, state = np.concatenate([x.ravel() for x in task.parameters()]), None
        state = np.zeros((1, len(p)))
        part = part.sort_values("key")
        keys, xs = part["key"].to_numpy(), task.arrays(part)
        order = R._order(keys, 3, 0)
        for t, a in enumerate(range(0, len(order), 8), 1):
            at = order[a : a + 8]
            _, g = task.gradient(tuple(x[at] for x in xs), None)
            Optimiser("sgd", 0.05).step(p, np.concatenate([x.ravel() for x in g]) / len(at), state, t, 0.05)
            R._put(task, p)
        total, n = total + p * len(part), n + len(part)
    assert np.allclose(weights(run), total / n, atol=1e-12)


def test_stuck_runs_start_anew(spark):
    rows = regression_rows(spark, 100)
    never = regression_run(epochs=5, restart=R.Restart(2, -1.0, 2))
    always = regression_run(epochs=3, restart=R.Restart(2, math.inf, 2))
    R.train(rows, [never, always])
    assert (never.attempt, never.stuck, never.epoch, never.sub_seed) == (2, True, 2, 3002) and (always.attempt, always.stuck, always.epoch) == (0, False, 3)
    got = {r.run: r for r in R.summary(spark, [never, always]).collect()}
    assert got[0].attempts == 3 and got[0].final_was_stuck and got[0].epochs == 2 and got[1].attempts == 1 and got[1].best_val_loss == always.best
    between = regression_run(epochs=3, restart=R.Restart(2, (never.best + always.best) / 2, 5))
    R.train(rows, [between])
    table = [(0, a, e, x) for a, xs in enumerate([[3.0, 2.0, 0.1], [2.5, 0.5, 0.4]]) for e, x in enumerate(xs, 1)] + [(1, 0, 1, 9.0), (1, 0, 2, 8.0), (2, 0, 1, 9.0)]
    found = R.attempts(spark.createDataFrame(table, "run int, attempt int, epoch int, val_loss double"), 2, 1.0, 3)
    assert sorted(map(tuple, found.collect())) == [(0, 2, False, 0.4), (1, 1, True, 8.0), (2, 1, False, 9.0)]


def test_autoencoder_learns(spark):
    phase = np.linspace(0, 2 * np.pi, 16)
    beats = [(i, "val" if i % 4 == 0 else "train", (a * np.sin(phase + np.arange(6)[:, None])).tolist()) for i, a in enumerate(RANDOM.normal(size=120) * 0.5)]
    rows = spark.createDataFrame(beats, "key long, role string, beat array<array<double>>")
    model = lambda: ConvolutionalAutoencoder(latent=2, channels=6, length=16, base=32, bottleneck=4, kernel=3, dropout=0.05)
    run = R.train(rows, [R.Run(R.BeatTask(model(), Losses(derivative=0.1)), Optimiser("adamw", 3e-3, 1e-4), epochs=6, batch=8, seed=1)])[0]
    assert run.best < 0.6 * run.val_losses[0] and len(run.best_report) == 6 and all(0 < d < 90 for d in run.best_report)
    encoded = M.encoded(rows, run.best_task.model)
    assert {len(r.latent) for r in encoded.collect()} == {2}
    with pytest.raises(PySparkException):
        R.train(rows.withColumn("beat", F.slice("beat", 1, 1)), [R.Run(R.BeatTask(model()), epochs=1)])


def test_stored_models(spark, tmp_path):
    at = str(tmp_path)
    model = ConvolutionalAutoencoder(latent=3, channels=3, length=10, base=32, bottleneck=2, representation="single_wing").begin(1)
    models.save_autoencoder(spark, model, f"{at}/ae", {"val_loss": 0.5})
    again = models.load_autoencoder(spark, f"{at}/ae")
    x = RANDOM.normal(size=(4, 3, 10))
    assert (again.decode(again.encode(x)) == model.decode(model.encode(x))).all() and again.config == model.config
    z = RANDOM.normal(size=(4, 3))
    assert (models.load_decoder(spark, f"{at}/ae").decode(z) == model.decode(z)).all()
    regressor = Regressor(hidden=(5,), wings=2, activation="gelu")
    regressor.begin(4, 6, 4.2, 0.1, 2)
    scaler = {"type": "standardize", "indices": [1, 3], "mean": [0.5, 1.0], "std": [2.0, 4.0]}
    models.save_regressor(spark, regressor, f"{at}/r", scaler)
    template = spark.createDataFrame([(c, p, float(c + p)) for c in range(3) for p in range(10)], "channel int, phase int, mean double")
    template.write.parquet(f"{at}/template")
    for where in (None, f"{at}/template", f"{at}/nothing"):
        chain = models.load_composite(spark, f"{at}/r", f"{at}/ae", where)
        assert (chain.template is None) == (where != f"{at}/template")
        body = RANDOM.normal(size=(5, 4))
        rows = spark.createDataFrame([(i, body[i].tolist(), body[-i].tolist()) for i in range(5)], "id long, body array<double>, next_body array<double>")
        scaled = (body[:, [1, 3]] - [0.5, 1.0]) / [2.0, 4.0]
        latents, durations = regressor.predict(np.concatenate([scaled, scaled[[-i for i in range(5)]]], axis=1))
        for r in M.composed(rows, chain).collect():
            assert np.allclose(r.pred_latent, latents[r.id]) and r.pred_duration == durations[r.id] == len(r.beat[0]) and len(r.beat) == 6
            assert np.allclose(r.wings, np.concatenate([model.decode(latents[r.id : r.id + 1, :3])[0], model.decode(latents[r.id : r.id + 1, 3:])[0]]))
    models.save_linear_encoder(spark, LinearEncoder(np.ones((2, 12)), np.zeros(12), (6, 2)), f"{at}/linear")
    with pytest.raises(ValueError, match="latents of 3"):
        models.load_composite(spark, f"{at}/r", f"{at}/linear")
    with pytest.raises(ValueError, match="no regressor"):
        models.load_regressor(spark, f"{at}/ae")
    with pytest.raises(FileNotFoundError):
        models.load_autoencoder(spark, f"{at}/none")


def test_winners_are_stored(spark, tmp_path):
    rows = [(0, 8, 2, 0.5), (1, 8, 2, 0.4), (2, 10, 2, 0.4), (3, 10, 2, 0.4)]
    found = models.winners(spark.createDataFrame(rows, "run int, fixed_len int, latent_dim int, best_val_loss double"), ["fixed_len", "latent_dim"])
    made = {k: ConvolutionalAutoencoder(latent=2, length=n, base=32, bottleneck=2).begin(k) for k, n, _, _ in rows}
    assert models.save_winners(spark, str(tmp_path), found, made) == ["fixed_len_8", "fixed_len_10", "best"]
    assert models.load_autoencoder(spark, f"{tmp_path}/fixed_len_10").named.keys() == made[2].named.keys()
    assert models.load(spark, f"{tmp_path}/best", "autoencoder")[2]["run"] == 1
    assert models.winner_folder({"fixed_len": 8, "latent_dim": 2}, set()) == "" and models.winner_folder({"fixed_len": 8, "latent_dim": 2}, {"fixed_len", "latent_dim"}) == "fixed_len_8/latent_dim_2"


# datasets that are replaced whole


def test_failed_write_leaves_the_dataset(spark, tmp_path):
    at = str(tmp_path / "set")
    tables.write_dataset(spark.range(5), at, {"length": 69})
    bad = spark.range(100).repartition(4).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id")))
    with pytest.raises(PySparkException):
        tables.write_dataset(bad, at, {"length": 70})
    assert tables.dataset_is_valid(spark, at, {"length": 69}) == (True, "ok") and tables.read_dataset(spark, at).count() == 5
    tables.write_dataset(spark.range(7), at, {"length": 70})
    tables.write_dataset(spark.range(8), at, {"length": 71})
    assert tables.read_metadata(spark, at) == {"length": 71, "n_rows": 8}
    commits = sorted(p.name for p in (tmp_path / "set/commits").glob("*.json"))
    assert len(commits) == 2 and len(list((tmp_path / "set/versions").iterdir())) == 3  # the failed one's folder stays unnamed
    (tmp_path / "set/commits/000000000009.json").write_text('{"version": ')  # a writer that died
    assert tables.read_metadata(spark, at)["length"] == 71
    for p in (tmp_path / "set/versions").iterdir():
        for f in p.glob("*.parquet"):
            f.unlink()
    assert tables.dataset_is_valid(spark, at, {"length": 71})[0] is False
    with pytest.raises(FileNotFoundError):
        tables.read_dataset(spark, str(tmp_path / "none"))


# array files


def saved(path, compressed=False, **named):
    (np.savez_compressed if compressed else np.savez)(path, **named)


def test_array_files(spark, tmp_path):
    a, b = RANDOM.normal(size=(50, 3, 4)), np.arange(50, dtype=np.int32)
    saved(tmp_path / "a.npz", x=a, n=b, flag=b % 2 == 0, name=np.array([f"n{i}" for i in b]), half=b.astype("<f2"), big=a.astype(">f4"), scalar=np.float64(3))
    saved(tmp_path / "b.npz", compressed=True, x=a + 1, n=b, flag=b % 2 == 0, name=np.array(["z"] * 50), half=b.astype("<f2"), big=a.astype(">f4"))
    df = arrays.read(spark, str(tmp_path), partitionBytes=1000)
    assert dict(df.dtypes) | {"x": "array<array<double>>", "n": "int", "flag": "boolean", "name": "string", "half": "float", "big": "array<array<float>>"} == dict(df.dtypes)
    rows = df.collect()
    assert len(rows) == 100
    for r in rows:
        one = r.path.endswith("a.npz")
        assert np.array_equal(r.x, a[r.row] + (not one)) and r.n == r.row and r.flag == (r.row % 2 == 0) and r.name == (f"n{r.row}" if one else "z") and np.allclose(r.big, a[r.row])
    assert arrays.read(spark, f"file://{tmp_path}/a.npz", ["n"]).columns == ["path", "row", "n"]
    np.save(tmp_path / "c.npy", np.asfortranarray(a[:, 0]))
    assert [r.value for r in arrays.read(spark, str(tmp_path / "c.npy")).orderBy("row").collect()] == a[:, 0].tolist()
    for wrong in ({"columns": ["y"]}, {}):
        with pytest.raises((PySparkException, ValueError)):
            arrays.read(spark, str(tmp_path / "none") if not wrong else str(tmp_path / "a.npz"), **wrong).collect()


def test_only_the_bytes_of_a_partition_are_read(tmp_path, monkeypatch):
    """Planning reads headers; a task reads its rows of the asked columns, and no more."""
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    saved(tmp_path / "a.npz", x=RANDOM.normal(size=(1000, 20)), y=np.zeros((1000, 100)))
    seen = []

    class Counting(io.BytesIO):
        def read(self, n=-1):
            out = super().read(n)
            seen.append(len(out))
            return out

    class System:
        def open_input_file(self, path):
            return Counting((tmp_path / "a.npz").read_bytes())

    listed = arrays.listed(str(tmp_path))
    monkeypatch.setattr(arrays, "listed", lambda path: listed)
    monkeypatch.setattr(arrays, "opened", lambda path: (System(), path))
    schema = StructType([StructField("row", LongType()), StructField("x", ArrayType(DoubleType()))])
    reader = arrays.ArrayReader(schema, {"path": str(tmp_path), "partitionbytes": "16000"})
    parts = reader.partitions()
    assert [(p.low, p.high) for p in parts] == [(k, k + 100) for k in range(0, 1000, 100)] and sum(seen) < 20_000
    seen.clear()
    assert sum(b.num_rows for b in reader.read(parts[3])) == 100 and sum(seen) == 16_000


def test_object_arrays_and_refusals(spark, tmp_path):
    ragged = np.empty(3, object)
    ragged[:] = [np.ones((2, 4)), np.zeros((1, 4)), np.arange(5.0)]
    np.save(tmp_path / "r.npy", ragged, allow_pickle=True)
    with pytest.raises(PySparkException):
        arrays.read(spark, str(tmp_path / "r.npy")).collect()
    got = arrays.read(spark, str(tmp_path / "r.npy"), allowPickle="true").orderBy("row").collect()
    assert [np.shape(r.value) for r in got] == [(2, 4), (1, 4), (1, 5)]
    saved(tmp_path / "u.npz", a=np.zeros(3), b=np.zeros(4))
    with pytest.raises(PySparkException):
        arrays.read(spark, str(tmp_path / "u.npz")).collect()


def test_write_and_read_back(spark, tmp_path):
    at = str(tmp_path / "out")
    df = spark.range(40).repartition(3).select("id", F.array(F.array(F.col("id") * 0.5, F.lit(1.0)), F.array(F.lit(2.0), F.lit(3.0))).alias("sa_wingbeats"), F.concat(F.lit("n"), "id").alias("name"))
    arrays.write(df, at)
    beats, kind = arrays.read_beats(spark, at, ["id"])
    assert kind == "sa" and sorted((r.id, r.beat) for r in beats.collect()) == [(i, [[i * 0.5, 1.0], [2.0, 3.0]]) for i in range(40)]
    arrays.write(df.limit(2), at)
    assert arrays.read(spark, at).count() == 2
    arrays.write(df.limit(3), at, overwrite=False)
    assert arrays.read(spark, at).count() == 5
    with pytest.raises(PySparkException):
        arrays.write(spark.range(4).select(F.when(F.col("id") > 1, F.col("id")).alias("id")), at)
    assert arrays.read(spark, at).count() == 5  # what a task wrote that ended after the job is hidden and never read
    with pytest.raises(PySparkException):
        arrays.read_beats(spark, str(tmp_path / "out"), ["nothing"])[0].collect()


def test_grid_search(spark, tmp_path):
    from cadenza.plans.grid import run_of, search

    phase = lambda n: np.linspace(0, 2 * np.pi, n)
    data = {n: spark.createDataFrame([(i, "val" if i % 3 == 0 else "train", (a * np.sin(phase(n) + np.arange(3)[:, None])).tolist()) for i, a in enumerate(RANDOM.normal(size=30))], "key long, role string, beat array<array<double>>") for n in (8, 10)}
    configs = [{"fixed_len": n, "latent_dim": d, "base_channels": 32, "bottleneck_len": 2, "decoder_kernel_size": 3, "n_epochs": 2, "batch_size": 8, "random_seed": s, "restart_on_plateau": n == 10, "restart_check_epoch": 1, "restart_threshold": -1.0, "restart_max_attempts": 1} for n in (8, 10) for d in (1, 2) for s in (1, 2)]
    rows, found, runs = search(data, configs, str(tmp_path), "single_wing")
    got = {r.run: r for r in rows.collect()}
    assert len(got) == 8 and all(got[k].best_val_loss == r.best and got[k].attempts == (2 if r.name["fixed_len"] == 10 else 1) and got[k].final_was_stuck == (r.name["fixed_len"] == 10) for k, r in enumerate(runs))
    best = {(r.fixed_len, r.latent_dim): r for r in found.collect()}
    for (n, d), r in best.items():
        mine = [k for k, c in enumerate(configs) if (c["fixed_len"], c["latent_dim"]) == (n, d)]
        assert r.run == min(mine, key=lambda k: (runs[k].best, k))
        stored = models.load_autoencoder(spark, f"{tmp_path}/fixed_len_{n}/latent_dim_{d}")
        assert all((stored.named[k] == v).all() for k, v in runs[r.run].best_task.model.named.items())
    assert models.load(spark, f"{tmp_path}/best", "autoencoder")[2]["best_val_loss"] == min(r.best for r in runs)
    with pytest.raises(ValueError):
        run_of({"fixed_len": 8, "channel_loss_weight": [1]})
    assert run_of({"fixed_len": 8, "channel_loss_weight": [1, 2]}).task.losses.channels == (1, 1, 1, 2, 2, 2)


def test_kept_tables_go_at_the_end(tmp_path):
    """A program that has written its result leaves nothing of kept() in the shared folder."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
from pyspark.sql import SparkSession
from cadenza.sources import tables
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/c").getOrCreate()
kept = tables.kept(spark.range(5))
tables.dropped(tables.kept(kept))
import os
assert kept.count() == 5 and len([d for d in os.listdir("{tmp_path}/c") if "-" not in d]) == 1
"""
    subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root}, check=True, timeout=120)
    assert not [d for d in os.listdir(tmp_path / "c") if "-" not in d]
