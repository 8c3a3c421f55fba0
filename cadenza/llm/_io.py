"""Tables in, and materialisation that survives a lost executor."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one for each application only where it is unset and the master is local (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of finished jobs; it acts on what the driver's JVM has collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder as Parquet and read back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return _named(spark.read.schema(df.schema).parquet(path), path)


#: What written() and bucketed() have made and nothing has dropped: folders, and the tables' names (None: no table).
_made: dict[str, str | None] = {}


def _named(df: DataFrame, path: str, name: str | None = None) -> DataFrame:
    if not _made:
        atexit.unregister(_clear)
        atexit.register(_clear)
    _made[path] = name
    df.written_at = path
    return df


def _clear() -> None:
    """When the driver's program ends, what results were read from goes as well: by then they are written."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        drop_since(spark, set())


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*frames: DataFrame) -> None:
    """Deletes what written() or bucketed() made for these; what is computed from them must have been written."""
    for df in frames:
        name = _made.pop(df.written_at, None)
        if name:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        delete(df.sparkSession, df.written_at)


def made() -> set[str]:
    return set(_made)


def drop_since(spark: SparkSession, before: set[str]) -> None:
    """Deletes all that was made since before = made(); for use once a result is written."""
    for path in made() - before:
        name = _made.pop(path)
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by sort and merge, for sides that grow with the input.

    Spark judges a written table by its files. These hold compressed keys and spans: what is under its limit for broadcasts there can be
    millions of rows, and their hash table goes through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def text_key(text: str = "text") -> list:
    """128 bits of the text's SHA-256 as two long columns key_a and key_b (a null counts as empty): no two texts can be made to share them."""
    digest = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "key_a"), (17, "key_b"))]


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named _0, _1, ..., and these by the old names: no column that a stage adds can clash with them."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key_a, key_b, text, copies): equal texts merge in the map tasks before anything is shuffled."""
    return (
        docs.select(*text_key(text), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .groupBy("key_a", "key_b")
        .agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    )


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """df, written once to the shared folder in buckets of the keys: later joins on them move the other side only."""
    spark = df.sparkSession
    name = f"t_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    release(spark)
    return _named(spark.table(name), path, name)
