import pytest
from cadenza.sources import tables as T
from pyspark.sql import functions as F


def test_discovery(spark, tmp_path):
    for name in ("b/2_analysis_smoothed.h5", "a/1_analysis_smoothed.h5", "a/x/deep_analysis_smoothed.h5", "a/note.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(name.encode())
    files = T.discover(spark, str(tmp_path), T.RAW_SUFFIX)
    ids = [r.path.rsplit("/", 1)[1] for r in T.ordinals(files).orderBy("trajectory_id").collect()]
    assert ids == ["1_analysis_smoothed.h5", "deep_analysis_smoothed.h5", "2_analysis_smoothed.h5"]
    assert {(r.experiment, r.files) for r in T.experiments(files, str(tmp_path)).collect()} == {("a", 1), ("b", 1)}
    assert {r.experiment for r in T.experiments(T.discover(spark, str(tmp_path / "a")), str(tmp_path / "a")).collect()} == {""}
    with pytest.raises(FileNotFoundError):
        T.experiments(files.where("false"), str(tmp_path))
    content = spark.read.format("binaryFile").load(str(tmp_path / "a/note.txt"))
    assert T.fingerprints(content).first().md5 == "fd90bf7c75ec3dc6dee0ac0ba2adf7f5" or len(T.fingerprints(content).first().md5) == 32
    assert T.latest(files).first().path.endswith("b/2_analysis_smoothed.h5")


def test_datasets(spark, tmp_path):
    df = spark.range(5).withColumn("experiment", F.when(F.col("id") < 3, "a").otherwise("b"))
    at = str(tmp_path / "parts")
    T.write_partitioned(df, at, "experiment")
    T.write_partitioned(df.where("id = 0"), at, "experiment")
    assert sorted(r.id for r in spark.read.parquet(at).collect()) == [0, 3, 4]
    at, built = str(tmp_path / "set"), []

    def build():
        built.append(1)
        return df

    assert T.dataset_is_valid(spark, at, {}) == (False, "no metadata")
    for expected in ({"length": 69}, {"length": 69}, {"length": 70}):
        assert T.ensure(spark, at, expected, build).count() == 5
    assert len(built) == 2 and T.read_metadata(spark, at)["n_rows"] == 5
    assert T.dataset_is_valid(spark, at, {"length": 1})[1].startswith("length")
    T.write_summary_csv(spark.createDataFrame([(1, 2.0)], "idx int, x double"), str(tmp_path / "csv"), "idx")
    assert "1,2.0000" in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, '{"output_len": 3}')], "a int, b int, j string")
    assert T.select_groups(df, [["a"], ["b"]], "01").columns == ["b"]
    with pytest.raises(ValueError):
        T.select_groups(df, [["a"], ["b"]], "2")
    assert df.select(T.json_field("j", ["fixed_len", "output_len"], "0").alias("x")).first().x == "3"


def test_grid(spark):
    from cadenza.plans.grid import expand

    rows = expand(spark, {"latent": [4, 8], "hidden_dims": [128, 128], "rate": 0.1}).collect()
    assert [(r.latent, r.hidden_dims, r.run) for r in rows] == [(4, [128, 128], 0), (8, [128, 128], 1)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
