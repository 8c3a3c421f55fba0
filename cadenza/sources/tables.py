"""Sources and sinks: discovery, fingerprints, datasets with metadata, and whether they are still valid."""

from __future__ import annotations

import atexit
import gc
import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_SUFFIX = "_analysis_smoothed.h5"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written as Parquet to the shared folder in spark.checkpoint.dir and read back; held in memory where none is set."""
    at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not at:
        return df.persist()
    path = f"{at.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    # lets Spark's cleaner drop shuffle files of finished jobs; it acts on what the driver's JVM has collected as garbage
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    if not _kept:
        atexit.unregister(_clear)
        atexit.register(_clear)
    _kept.add(path)
    return out


#: What kept() has written and nothing has dropped.
_kept: set[str] = set()


def _clear() -> None:
    """When the driver's program ends, what results were read from goes as well: by then they are written."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in list(_kept):
            at, files = _files(spark, path)
            files.delete(at, True)


def dropped(df: DataFrame) -> None:
    """Deletes what kept() has written for df; all that is made of it must have been computed."""
    if (path := getattr(df, "kept_at", None)) is None:
        df.unpersist()
        return
    at, files = _files(df.sparkSession, path)
    files.delete(at, True)
    _kept.discard(path)


def discover(spark: SparkSession, root: str, suffix: str = "", recursive: bool = True) -> DataFrame:
    """(path, length, modified): files under a folder whose names end in `suffix`; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def ordinals(files: DataFrame, path: str = "path", name: str = "trajectory_id") -> DataFrame:
    """A 0-based ordinal by full path, in byte order."""
    from cadenza.operators.ranks import ranked

    return ranked(files, path, path, name)


def experiments(files: DataFrame, root: str, suffix: str = RAW_SUFFIX) -> DataFrame:
    """(experiment, files): the folder itself if it holds raw files, else each folder right under it that does; none is an error."""
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rows = files.where(F.col("path").endswith(suffix)).withColumn("inner", F.substr(plain, F.lit(len(root.rstrip("/")) + 2)))
    depth = F.size(F.split("inner", "/"))
    direct = rows.where(depth == 1).agg(F.count(F.lit(1)).alias("files")).where("files > 0").select(F.lit("").alias("experiment"), "files")
    if not direct.isEmpty():
        return direct
    found = rows.where(depth == 2).groupBy(F.split("inner", "/")[0].alias("experiment")).agg(F.count(F.lit(1)).alias("files"))
    if found.isEmpty():
        raise FileNotFoundError(f"no files *{suffix} in {root} or right under it")
    return found


def fingerprints(files: DataFrame) -> DataFrame:
    return files.withColumn("md5", F.md5("content")).drop("content")


def latest(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row: the last path in byte order (null if there is none)."""
    return paths.agg(F.max(path).alias(path))


def select_groups(df: DataFrame, groups: list[list[str]], bits: str) -> DataFrame:
    """Columns of the groups whose bit is 1; the others aren't read from columnar files."""
    if len(bits) != len(groups) or set(bits) - {"0", "1"}:
        raise ValueError(f"{bits!r} doesn't name {len(groups)} groups")
    return df.select(*[c for g, b in zip(groups, bits, strict=True) if b == "1" for c in g])


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that df holds and leaves others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _files(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> list[int]:
    at, files = _files(spark, f"{path}/commits")
    return sorted(int(f.getPath().getName().split(".")[0]) for f in files.listStatus(at) if f.getPath().getName().endswith(".json")) if files.exists(at) else []


def _commit_text(spark: SparkSession, path: str, number: int) -> dict | None:
    """A commit's entry; None if its writer died while it wrote it, for then it isn't one."""
    at, files = _files(spark, f"{path}/commits/{number:012d}.json")
    stream = files.open(at)
    try:
        found = json.loads(bytes(stream.readAllBytes()).decode())
    except ValueError:
        return None
    finally:
        stream.close()
    return found if found.get("version") else None


def _current(spark: SparkSession, path: str) -> dict | None:
    return next((c for n in reversed(_commits(spark, path)) if (c := _commit_text(spark, path, n))), None)


def write_dataset(df: DataFrame, path: str, metadata: dict) -> None:
    """A new version of the dataset at path; readers see the one before until it is whole.

    Rows go to a folder of their own. One small file then names the folder and holds the metadata: creating it, which fails if another
    writer has taken the number, is the commit. A write that fails on the way leaves what was there. Of older versions the last one stays
    for those who still read it.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    last = _commits(spark, path)
    at = f"{path}/versions/{version}"
    df.write.parquet(at)
    n = spark.read.parquet(at).count()
    entry = {"version": version, "metadata": metadata | {"n_rows": n}, "built_at": datetime.now(UTC).isoformat(timespec="seconds")}
    to, files = _files(spark, f"{path}/commits/{(last[-1] if last else 0) + 1:012d}.json")
    stream = files.create(to, False)
    stream.write(json.dumps(entry, sort_keys=True).encode())
    stream.close()
    known = [(k, _commit_text(spark, path, k)) for k in last]
    for k, old in known[:-1]:
        for gone in (f"commits/{k:012d}.json", *([f"versions/{old['version']}"] if old else [])):
            here, _ = _files(spark, f"{path}/{gone}")
            files.delete(here, True)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last whole version."""
    found = _current(spark, path)
    if found is None:
        raise FileNotFoundError(f"no dataset at {path}")
    return spark.read.parquet(f"{path}/versions/{found['version']}")


def read_metadata(spark: SparkSession, path: str) -> dict | None:
    """The last whole version's metadata, n_rows among them."""
    found = _current(spark, path)
    return None if found is None else found["metadata"]


def dataset_is_valid(spark: SparkSession, path: str, expected: dict) -> tuple[bool, str]:
    """(valid, reason): a whole version must be there, its rows readable, and its metadata agree with every expected entry; the first that
    doesn't is the reason."""
    found = read_metadata(spark, path)
    if found is None:
        return False, "no metadata"
    for key, value in expected.items():
        if found.get(key) != value:
            return False, f"{key}: {found.get(key)!r} is not {value!r}"
    from pyspark.errors import AnalysisException

    try:
        n = read_dataset(spark, path).count()
    except AnalysisException:
        return False, "no rows to read"
    return (True, "ok") if n == found["n_rows"] else (False, f"n_rows: {n} is not {found['n_rows']}")


def ensure(spark: SparkSession, path: str, expected: dict, build) -> DataFrame:
    """The dataset at path, built by build() if it isn't there or is stale."""
    if not dataset_is_valid(spark, path, expected)[0]:
        write_dataset(build(), path, expected)
    return read_dataset(spark, path)


def write_summary_csv(df: DataFrame, path: str, order: str) -> None:
    """One CSV with a header, in order, floating numbers with four digits."""
    shown = [F.format_string("%.4f", F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema]
    df.orderBy(order).select(*shown).write.mode("overwrite").option("header", True).csv(path)


def json_field(column: str, names: list[str], default) -> Column:
    """The first of the names that a JSON text has, as text, or the default."""
    return F.coalesce(*[F.get_json_object(column, f"$.{n}") for n in names], F.lit(default))


def write_embedding(coordinates: DataFrame, path: str, metadata: dict, colours: DataFrame | None = None, ident: str = "i") -> None:
    """Coordinates with a colour_<name> column for each of the colours, and metadata. Colours for other rows than the coordinates' are an error."""
    out = coordinates
    if colours is not None:
        named = colours.select(ident, *[F.col(c).alias(f"colour_{c}") for c in colours.columns if c != ident])
        lacking = coordinates.select(ident).exceptAll(colours.select(ident)).count(), colours.select(ident).exceptAll(coordinates.select(ident)).count()
        if any(lacking):
            raise ValueError(f"{lacking[0]} rows have no colour, {lacking[1]} colours no row")
        out = coordinates.join(named, ident)
    write_dataset(out, path, metadata)


def read_embedding(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], dict | None]:
    """(rows, names of the colours, metadata)."""
    rows = read_dataset(spark, path)
    return rows, [c.removeprefix("colour_") for c in rows.columns if c.startswith("colour_")], read_metadata(spark, path)


def template_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_report(row: DataFrame, path: str) -> None:
    """A one-row table as one JSON text."""
    row.select(F.to_json(F.struct(*row.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def validation_keys(keys: DataFrame, key: str, saved: DataFrame | None, share: float = 0.15, seed: int = 0) -> tuple[DataFrame, bool]:
    """(keys of the validation split, stale): those that were saved with the number of keys then (key, n_total), or the split made anew as
    it is made for training. stale: the number of keys has changed since."""
    from cadenza.operators.statistics import split_by_key

    if saved is None:
        return split_by_key(keys, key, share, seed).where("role = 'val'").select(key), False
    total = keys.select(key).distinct().count()
    then = saved.agg(F.max("n_total").alias("n")).first()["n"]
    return keys.select(key).distinct().join(saved.select(key), key, "left_semi"), then is not None and then != total


def with_beats(stats: DataFrame, beats: str = "n_beats", least: int = 2) -> DataFrame:
    """Recordings of which enough beats were found."""
    return stats.where(F.col(beats) >= least)
