import numpy as np
import pytest
from cadenza.functions import kernels as K
from cadenza.operators.sequence import local_maxima
from cadenza.plans.common import beats
from cadenza.streaming.maxima import stream_maxima
from cadenza.streaming.segments import Segmenter, stream_beats
from pyspark.sql import functions as F


@pytest.mark.parametrize("idle", [None, 3_600_000])
def test_stream_equals_batch(spark, small, tmp_path, idle):
    rows = beats(spark, small).select("traj", "beat", "value").where("traj < 6").cache()
    for k in range(3):
        rows.where(f"beat >= {k * 25} and beat < {(k + 1) * 25}" if k < 2 else "beat >= 50").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        query = stream_maxima(stream, "traj", "beat", "value", idle).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = {(r.traj, r.at, r.height) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.traj, r.at, r.height) for r in local_maxima(rows, "traj", "beat", "value").collect()}
    assert got == want and want


def strokes(seed, n):
    """Two wings with noisy strokes, flat tops among them."""
    r = np.random.default_rng(seed)
    phase = np.cumsum(r.uniform(0.05, 0.12, n))
    wing = lambda shift: np.round(np.sin(phase + shift) + 0.3 * np.sin(7 * phase + shift) + r.normal(0, 0.05, n), 1)
    return wing(0.0), wing(0.1)


@pytest.mark.parametrize("seed", range(8))
def test_segmenter_as_whole_recording(seed):
    """However the frames are cut into batches, beats are those of the whole recording."""
    left, right = strokes(seed, 900)
    r = np.random.default_rng(seed)
    spacing = [20, 50, 1, 35][seed % 4]
    at = K.stroke_boundaries(left, right, spacing)
    want = [(k, int(a) + 10, int(b) + 10, int(b - a), [left[a:b].tolist(), right[a:b].tolist()]) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b - a > 1]
    held, got, low = Segmenter(spacing), [], 0
    while low < 900:
        high = low + int(r.integers(1, 60))
        part = slice(low, min(high, 900))
        got += held.push(list(range(part.start + 10, part.stop + 10)), np.stack([left[part], right[part]], axis=1).tolist(), (0, 1))
        assert len(held.orders) <= 4 * max(spacing, 80)
        low = high
    early = len(got)
    got += held.close()
    assert got == want and len(want) > 5 and early > len(want) - 5


def test_stream_of_beats(spark, tmp_path):
    from cadenza.operators import beats as B
    from cadenza.operators import sequence as S

    rows = []
    for flight in range(3):
        left, right = strokes(flight, 400 + 50 * flight)
        rows += [(flight, i, float(a), float(b), 1000.0 + i / 100) for i, (a, b) in enumerate(zip(left, right, strict=True))]
    frames = spark.createDataFrame(rows, "trajectory_id long, frame long, phi_l double, phi_r double, t double").withColumn("t", F.timestamp_seconds("t")).cache()
    end = spark.createDataFrame([(99, 0, 0.0, 0.0, 5000.0)], "trajectory_id long, frame long, phi_l double, phi_r double, t double").withColumn("t", F.timestamp_seconds("t"))
    for k in range(4):
        part = frames.where(f"frame >= {k * 170} and frame < {(k + 1) * 170}") if k < 3 else end
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in")).withWatermark("t", "1 second")
        query = stream_beats(stream, ["phi_l", "phi_r"], ("phi_l", "phi_r"), time="t", idle_ms=10_000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(200)
        assert query.exception() is None
    plain = frames.drop("t")
    want = B.segments(plain, S.intervals(B.boundaries(plain), "trajectory_id", "at"), ["phi_l", "phi_r"])
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.trajectory_id, r.idx, r.duration, r.seg) for r in got.collect()) == sorted((r.trajectory_id, r.idx, r.duration, r.seg) for r in want.collect())
    assert want.count() > 10
