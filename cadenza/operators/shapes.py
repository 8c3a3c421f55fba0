"""Per-beat shapes, phase errors, references and samples."""

from __future__ import annotations

from cadenza.functions import arrays as A
from cadenza.operators import ranks as R
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_vector(df: DataFrame, vector: str, by: list[str] | None = None) -> DataFrame:
    """(by.., centre): the mean of a vector column, one array a group."""
    by = by or []
    flat = df.select(*by, F.posexplode(vector).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return flat.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centre"))


def point_cloud(df: DataFrame, keep: list[str], vector: str) -> DataFrame:
    """One row a sample, with its phase from 0 to 1."""
    return df.select(*keep, F.size(vector).alias("_n"), F.posexplode(vector).alias("sample", "x")).withColumn("phase", F.col("sample") / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_n")


def phase_errors(df: DataFrame, predicted: str, true: str, by: list[str] | None = None) -> DataFrame:
    """(by.., phase, mean, sd): signed errors by phase; the population deviation."""
    by = by or []
    flat = df.select(*by, F.posexplode(F.arrays_zip(F.col(predicted).alias("p"), F.col(true).alias("t"))).alias("phase", "_z"))
    d = F.col("_z.p").cast("double") - F.col("_z.t").cast("double")
    return flat.groupBy(*by, "phase").agg(F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"))


def distance_percentile(distances: DataFrame, value: str, query: Column) -> DataFrame:
    """Adds `percentile` to the rows that `query` picks: percent of all rows that are strictly nearer."""
    n = distances.agg(F.count(F.lit(1)).alias("_n"))
    ranked = R.counted_below(distances, value, "_below").crossJoin(F.broadcast(n)).withColumn("percentile", F.col("_below") / F.col("_n") * 100)
    return ranked.drop("_below", "_n").where(query)


def comparison_record(distances: DataFrame, value: str) -> DataFrame:
    moments = distances.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return moments.crossJoin(R.quantile_row(distances, value, {"p5": 0.05, "p50": 0.5, "p95": 0.95}))


def subsample(df: DataFrame, ident: str, n: int) -> DataFrame:
    """n rows in the order of a digest of their id: the same rows in every run, whatever the partitions."""
    return df.orderBy(F.md5(F.col(ident).cast("string")), ident).limit(n)


def sample_by_group(df: DataFrame, group: str, ident: str, n: int) -> DataFrame:
    """n rows of each group, picked likewise."""
    by = Window.partitionBy(group).orderBy(F.md5(F.col(ident).cast("string")), ident)
    return df.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= n).drop("_k")


def same_rows(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """One row: matched, only_left, only_right and whether the keys agree."""
    a, b = left.select(*key).withColumn("_l", F.lit(1)), right.select(*key).withColumn("_r", F.lit(1))
    both = a.join(b, key, "full")
    count = lambda c: F.count_if(c)
    out = both.agg(count(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"), count(F.col("_r").isNull()).alias("only_left"), count(F.col("_l").isNull()).alias("only_right"))
    return out.withColumn("aligned", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def lacking_sides(df: DataFrame, key: str) -> DataFrame:
    """Keys whose sides aren't exactly 0 and 1."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set("side")).alias("sides")).where(F.col("sides") != F.array(F.lit(0), F.lit(1)))


def run_metric(best: Column, errors: Column) -> Column:
    """A run's best loss, or the mean of its error list; null if it has neither."""
    return F.coalesce(best, F.when(F.size(errors) > 0, A.total(errors) / F.size(errors)))


def rmse_text(errors: Column, labels: list[str]) -> Column:
    return F.array_join(F.transform(errors, lambda e, i: F.format_string("%s=%.2f", F.element_at(F.array(*[F.lit(x) for x in labels]), i + 1), e)), " | ")


def degrees(column: str, units: str) -> Column:
    """An (n, 3) array of angles in degrees; another shape or unit is an error."""
    if units not in ("rad", "deg"):
        raise ValueError(f"units must be rad or deg: {units}")
    shaped = F.when(F.forall(column, lambda a: F.size(a) == 3), F.col(column)).otherwise(F.raise_error(F.lit("not an (n, 3) array of angles")))
    return F.transform(shaped, lambda a: F.transform(a, lambda x: F.degrees(x) if units == "rad" else x.cast("double")))


def consecutive_rows(df: DataFrame, key: str, order: str, n: int, seed: int = 0) -> DataFrame:
    """n neighbouring rows of one sequence, both picked by a digest: the sequence among those with n rows or more, and the place where
    the stretch begins. Order must count from 0 in each sequence."""
    digest = lambda *c: F.md5(F.concat_ws(":", F.lit(str(seed)), *[x.cast("string") for x in c]))
    longest = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    one = longest.orderBy(digest(F.col(key)), key).limit(1)
    begin = F.conv(F.substring(digest(F.col(key), F.lit("start")), 1, 12), 16, 10).cast("long") % (F.col("_n") - n + 1)
    return df.join(F.broadcast(one.withColumn("_begin", begin)), key).where((F.col(order) >= F.col("_begin")) & (F.col(order) < F.col("_begin") + n)).drop("_n", "_begin")
