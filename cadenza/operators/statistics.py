"""Distribution, comparison and error statistics."""

from __future__ import annotations

from cadenza.operators import ranks as R
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asymmetry(df: DataFrame, key: str, pairs: list[tuple[str, str, float]]) -> DataFrame:
    """(key, score, n): the largest mean |left - right| over its scale among the pairs."""
    means = [F.avg(F.abs(F.col(a) - F.col(b))) / scale for a, b, scale in pairs]
    return df.groupBy(key).agg((F.greatest(*means) if len(means) > 1 else means[0]).alias("score"), F.count(F.lit(1)).alias("n"))


def asymmetry_filter(scores: DataFrame, multiple: float = 10.0) -> DataFrame:
    """Keeps scores up to `multiple` times their median and adds the ratio to it (suspicion; 0 if the median isn't positive).

    The filter is off if the multiple or the median isn't positive.
    """
    median = R.quantile_row(scores, "score", {"median": 0.5})
    suspicion = F.when(F.col("median") <= 0, 0.0).otherwise(F.col("score") / F.col("median"))
    rated = scores.crossJoin(F.broadcast(median)).withColumn("suspicion", suspicion)
    return rated if multiple <= 0 else rated.where((F.col("median") <= 0) | (F.col("score") <= multiple * F.col("median")))


def suspicion_class(suspicion: Column) -> Column:
    return F.when(suspicion >= 6, "high").when(suspicion >= 3, "medium").otherwise("low")


def robust_band(df: DataFrame, value: str, k: float = 5.0, by: list[str] | None = None) -> DataFrame:
    """(by.., centre, low, high): median -+ k * 1.4826 * MAD; the population deviation where the MAD is 0."""
    by = by or []
    if not by:
        centre = R.quantile_row(df, value, {"centre": 0.5}).crossJoin(df.agg(F.stddev_pop(value).alias("_sd")))
        middle = centre.first()["centre"]
        mad = centre.crossJoin(R.quantile_row(df, F.abs(F.col(value) - F.lit(middle)), {"_mad": 0.5}))
        width = k * F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).otherwise(F.col("_sd"))
        return mad.select("centre", (F.col("centre") - width).alias("low"), (F.col("centre") + width).alias("high"))
    centre = R.group_quantiles(df, value, by, {"centre": 0.5})
    same = lambda other: [df[c].eqNullSafe(other[c]) for c in by]
    off = df.join(centre, same(centre)).select(*[df[c] for c in by], F.abs(df[value] - centre["centre"]).alias("_off"))
    mad = R.group_quantiles(off, "_off", by, {"_mad": 0.5})
    sd = df.groupBy(*by).agg(F.stddev_pop(value).alias("_sd"))
    width = k * F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).otherwise(F.col("_sd"))
    joined = sd.join(centre, [sd[c].eqNullSafe(centre[c]) for c in by]).join(mad, [sd[c].eqNullSafe(mad[c]) for c in by])
    return joined.select(*[sd[c] for c in by], "centre", (F.col("centre") - width).alias("low"), (F.col("centre") + width).alias("high"))


def tail_share(df: DataFrame, band: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Percent of the rows strictly outside their band."""
    by = by or []
    joined = df.join(band, by) if by else df.crossJoin(F.broadcast(band))
    outside = (F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))
    return joined.groupBy(*by).agg((F.avg(outside.cast("double")) * 100).alias("tail_percent"), F.sum(outside.cast("long")).alias("outside"))


def equal_count_trend(df: DataFrame, x: str, y: str, tie: str, bins: int = 12) -> DataFrame:
    """(bin, n, mean_x, mean_y, se): rows sorted by x, then tie, in bins whose edges are floor(i * n / bins); se is 0 for one row."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    placed = R.ranked(df.select(x, y, tie), x, tie, "_i").crossJoin(F.broadcast(total)).withColumn("bin", F.floor((bins * (F.col("_i") + 1) - 1) / F.col("_n")).cast("long"))
    n = F.count(F.lit(1))
    return placed.groupBy("bin").agg(n.alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.when(n > 1, F.stddev_samp(y) / F.sqrt(n)).otherwise(0.0).alias("se"))


def relation(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by.., n, pearson, spearman, slope, intercept)."""
    by = by or []
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = R.mean_rank(R.mean_rank(rows, x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def correlation_table(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(left, right, r) for all pairs of columns in one aggregate; 0 where a column is constant."""
    def pair(a: str, b: str) -> Column:
        flat = (F.coalesce(F.var_pop(a), F.lit(0.0)) < 1e-24) | (F.coalesce(F.var_pop(b), F.lit(0.0)) < 1e-24)
        return F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.when(flat, 0.0).otherwise(F.corr(a, b)).alias("r"))

    return df.agg(F.array(*[pair(a, b) for a in left for b in right]).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def two_sample_ks(a: DataFrame, b: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by.., d, n_a, n_b): largest distance of the two distribution functions over their distinct values."""
    by = by or []
    both = a.select(*by, F.col(value).alias("_v"), F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*by, F.col(value).alias("_v"), F.lit(0).alias("_a"), F.lit(1).alias("_b"))).where(F.col("_v").isNotNull())
    steps = both.groupBy(*by, "_v").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    whole = steps.groupBy(*by).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))
    gap = F.abs((F.col("_below_a") + F.col("_a")) / F.col("n_a") - (F.col("_below_b") + F.col("_b")) / F.col("n_b"))
    run = R.running(steps, "_v", {"_below_a": "_a", "_below_b": "_b"}, by)
    run = run.join(whole, by) if by else run.crossJoin(F.broadcast(whole))
    return run.groupBy(*by).agg(F.max(gap).alias("d"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def effect(d: Column) -> Column:
    return F.when(d < 0.1, "negligible").when(d < 0.2, "small").when(d < 0.35, "moderate").otherwise("large")


def verdict(tests: DataFrame) -> DataFrame:
    """One row: INCOMPATIBLE with any large effect, BORDERLINE with any moderate one, else COMPATIBLE; what drives it, largest d first."""
    marked = tests.withColumn("effect", effect(F.col("d")))
    drivers = F.sort_array(F.collect_list(F.when(F.col("effect").isin("large", "moderate"), F.struct("d", "metric"))), asc=False)
    summed = marked.agg(F.bool_or(F.col("effect") == "large").alias("_l"), F.bool_or(F.col("effect") == "moderate").alias("_m"), drivers.alias("_d"))
    return summed.select(F.when(F.col("_l"), "INCOMPATIBLE").when(F.col("_m"), "BORDERLINE").otherwise("COMPATIBLE").alias("verdict"), F.array_join(F.transform("_d", lambda x: x["metric"]), ",").alias("drivers"))


def equal_width_histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """(bin, by.., n): bins of one width from the smallest to the largest value over all groups; the last one holds its end. Empty bins count 0."""
    spark, by = df.sparkSession, by or []
    edges = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    at = F.when(F.col("_high") == F.col("_low"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("_low")) / ((F.col("_high") - F.col("_low")) / bins)), F.lit(bins - 1)))
    counts = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).withColumn("bin", at.cast("long")).groupBy("bin", *by).agg(F.count(F.lit(1)).alias("n"))
    frame = spark.range(bins).withColumnRenamed("id", "bin")
    if by:
        frame = df.select(*by).distinct().crossJoin(F.broadcast(frame))
    return frame.join(counts, ["bin", *by], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def clipped_density(df: DataFrame, value: str, bins: int, low: float = 0.5, high: float = 99.5) -> DataFrame:
    """(bin, n, density): bins between two percentiles; values outside are left out of counts and density."""
    spark = df.sparkSession
    edges = R.quantile_row(df, value, {"_low": low / 100, "_high": high / 100})
    inside = df.crossJoin(F.broadcast(edges)).where(F.col(value).between(F.col("_low"), F.col("_high")))
    width = (F.col("_high") - F.col("_low")) / bins
    counts = inside.withColumn("bin", F.least(F.floor((F.col(value) - F.col("_low")) / width), F.lit(bins - 1)).cast("long")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"))
    frame = spark.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(edges)).crossJoin(F.broadcast(whole))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return frame.join(counts, "bin", "left").select("bin", n.alias("n"), (n / (F.col("_all") * width)).alias("density"))


def kernel_density(df: DataFrame, value: str, points: int = 200) -> DataFrame:
    """(point, x, density): Gaussian kernels of width sd * n**(-1/5) on an even grid over the range.

    The grid is a fixed number of points; each row meets all of them once, and sums merge in the map tasks.
    """
    fixed = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.stddev_samp(value).alias("_sd"), F.count(value).alias("_n"))
    grid = df.sparkSession.range(points).withColumnRenamed("id", "point").crossJoin(F.broadcast(fixed))
    grid = grid.withColumns({"x": F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("point") / (points - 1), "_w": F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2))})
    z = (F.col("x") - F.col(value)) / F.col("_w")
    summed = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(grid)).groupBy("point", "x", "_w", "_n").agg(F.sum(F.exp(-z * z / 2)).alias("_s"))
    return summed.select("point", "x", (F.col("_s") / (F.col("_n") * F.col("_w") * 2.5066282746310002)).alias("density"))


def duration_summary(df: DataFrame, duration: str, rate: float, by: list[str] | None = None) -> DataFrame:
    d = F.col(duration)
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.min(d).alias("least"), F.max(d).alias("most"), F.avg(d).alias("mean"), F.median(d).alias("median"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_pop(d)).alias("sd"), (rate / F.avg(d)).alias("hz_mean"), (rate / F.median(d)).alias("hz_median"),
    )


def shift_report(df: DataFrame, role: str, values: list[str]) -> DataFrame:
    """(feature, shift): |mean of val - mean of train| over the train deviation (at least 1e-8)."""
    def one(v: str) -> Column:
        train, val = (F.when(F.col(role) == r, F.col(v)) for r in ("train", "val"))
        return F.struct(F.lit(v).alias("feature"), (F.abs(F.avg(val) - F.avg(train)) / F.greatest(F.stddev_pop(train), F.lit(1e-8))).alias("shift"))

    return df.agg(F.array(*[one(v) for v in values]).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")


def split_by_key(keys: DataFrame, key: str, share: float = 0.15, seed: int = 0) -> DataFrame:
    """(key, role): whole keys go to val, the share rounded down but one at least, in the order of a seeded hash."""
    distinct = keys.select(key).distinct()
    n = distinct.count()
    hashed = distinct.withColumn("_h", F.xxhash64(F.lit(seed), key))
    held = F.col("_nth") < max(1, int(n * share))
    return R.ranked(hashed, "_h", key, "_nth").select(key, F.when(held, F.lit("val")).otherwise(F.lit("train")).alias("role"))


def bucket_errors(df: DataFrame, score: str, error: str) -> DataFrame:
    """(bucket, n, mse, rmse) in the buckets' order; an empty bucket stays with nulls. A row may be in two buckets."""
    from cadenza.functions.registry import BUCKETS, bucket_flags

    flags = bucket_flags(F.col(score))
    names = F.filter(F.array(*[F.when(flags[b], F.lit(b)) for b in BUCKETS]), lambda b: b.isNotNull())
    sums = df.select(F.explode(names).alias("bucket"), F.col(error).alias("_e")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("_e").alias("mse"))
    order = df.sparkSession.createDataFrame(list(enumerate(BUCKETS)), "position int, bucket string")
    return order.join(sums, "bucket", "left").select("position", "bucket", F.coalesce("n", F.lit(0)).alias("n"), "mse", F.sqrt("mse").alias("rmse"))


def winners(runs: DataFrame, by: list[str], loss: str, order: str) -> DataFrame:
    """The run of the smallest loss in each group, the earliest of equals."""
    kept = [c for c in runs.columns if c not in by]
    return runs.groupBy(*by).agg(F.min_by(F.struct(*kept), F.struct(loss, order)).alias("_w")).select(*by, "_w.*")


def bucket_evaluation(df: DataFrame, score: str, predicted: str, true: str, residual: str | None, scale: list[float]) -> DataFrame:
    """(position, bucket, n, norm_mse, rmse_deg array, mean_rmse_deg) of beats (channels x samples) by their score's bucket.

    norm_mse compares the beats as they are, or `residual`, an array column of errors, if they are compared in another space; channel
    errors are undone by the scale and given in degrees. A row may be in two buckets; an empty bucket stays, with nulls.
    """
    from cadenza.functions.registry import BUCKETS, bucket_flags

    flags = bucket_flags(F.col(score))
    names = F.filter(F.array(*[F.when(flags[b], F.lit(b)) for b in BUCKETS]), lambda b: b.isNotNull())
    square = lambda a, b: F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    channels = F.zip_with(F.col(predicted).cast("array<array<double>>"), F.col(true).cast("array<array<double>>"), lambda a, b: mean(square(a, b)))
    rows = df.select(names.alias("_b"), channels.alias("_c")).withColumn("_m", mean(F.col("_c"))) if residual is None else df.select(names.alias("_b"), channels.alias("_c"), mean(F.transform(residual, lambda x: x * x)).alias("_m"))
    flat = rows.select(F.explode("_b").alias("bucket"), "_c", "_m")
    sums = flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("_m").alias("norm_mse"), F.array(*[F.degrees(F.sqrt(F.avg(F.col("_c")[k])) * s) for k, s in enumerate(scale)]).alias("rmse_deg"))
    order = df.sparkSession.createDataFrame(list(enumerate(BUCKETS)), "position int, bucket string")
    return order.join(F.broadcast(sums), "bucket", "left").select("position", "bucket", F.coalesce("n", F.lit(0)).alias("n"), "norm_mse", "rmse_deg", mean(F.col("rmse_deg")).alias("mean_rmse_deg"))


def drawn_with_replacement(values: DataFrame, column: str, ident: str, draws: int, seed: int = 0) -> DataFrame:
    """(draw, value): rows drawn with replacement. A draw's row number comes from a digest of the seed and the draw, so every run draws
    the same; rows are numbered in the order of `ident`."""
    n = values.count()
    numbers = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long") % max(n, 1)
    asked = values.sparkSession.range(draws).select(F.col("id").alias("draw"), numbers.alias("_pos"))
    return R.ranked(values.select(ident, column), ident, column, "_pos").join(F.broadcast(asked), "_pos").select("draw", F.col(column).alias("value"))
