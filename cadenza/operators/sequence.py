"""Ordered-sequence operators: runs, deltas, window scores, intervals, smoothing.

Every operator takes the key columns of a sequence and its order column; rows have no order of their own.
"""

from __future__ import annotations

from cadenza.operators.ranks import quantile_row
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, order: list[str], name: str = "beat") -> DataFrame:
    """A 0-based ordinal within each sequence."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def magnitude_threshold(df: DataFrame, value: str, percentile: float) -> DataFrame:
    """One row: the corpus percentile of |value|, interpolated."""
    return quantile_row(df, F.abs(F.col(value)), {"threshold": percentile / 100})


def sustained_scores(df: DataFrame, key: str, order: str, value: str, *, width: int = 4, coherence: float = 0.75, percentile: float = 75.0) -> DataFrame:
    """Adds `score`: of the windows of `width` rows that cover a row, the share that is flagged.

    A window is flagged if all of its values are at least the corpus percentile in size and they agree in sign well enough:
    |sum| / sum of sizes reaches `coherence` (0 if that sum is 0). Rows that no whole window covers score 0. Both windows share one sort.
    """
    by = Window.partitionBy(key).orderBy(order)
    ahead, behind = by.rowsBetween(0, width - 1), by.rowsBetween(-(width - 1), 0)
    x = F.col(value)
    size = F.sum(F.abs(x)).over(ahead)
    agree = F.when(size == 0, 0.0).otherwise(F.abs(F.sum(x).over(ahead)) / size)
    whole = F.count(F.lit(1)).over(ahead) == width
    flagged = whole & (F.min(F.abs(x)).over(ahead) >= F.col("threshold")) & (agree >= coherence)
    marked = df.crossJoin(F.broadcast(magnitude_threshold(df, value, percentile))).withColumns({"_whole": whole.cast("int"), "_flag": flagged.cast("int")})
    covering = F.sum("_whole").over(behind)
    score = F.when(covering == 0, 0.0).otherwise(F.sum("_flag").over(behind) / covering)
    return marked.withColumn("score", score).drop("_whole", "_flag", "threshold")


def runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, run, value, first, last, n): maximal runs of equal values."""
    by = Window.partitionBy(key).orderBy(order)
    change = F.when(F.lag(value).over(by).eqNullSafe(F.col(value)) & (F.row_number().over(by) > 1), 0).otherwise(1)
    marked = df.withColumn("_change", change).withColumn("run", F.sum("_change").over(by))
    return marked.groupBy(key, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def local_maxima(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, at, height): places higher than both neighbours, flat tops once at their middle (rounded down)."""
    plateaus = runs(df, key, order, value)
    by = Window.partitionBy(key).orderBy("run")
    around = plateaus.withColumns({"_left": F.lag(value).over(by), "_right": F.lead(value).over(by)})
    return around.where((F.col(value) > F.col("_left")) & (F.col(value) > F.col("_right"))).select(key, F.floor((F.col("first") + F.col("last")) / 2).cast("long").alias("at"), F.col(value).alias("height"))


def intervals(marks: DataFrame, key: str, at: str) -> DataFrame:
    """(key, idx, start, end, duration): half-open stretches between neighbouring marks."""
    by = Window.partitionBy(key).orderBy(at)
    spans = marks.select(key, F.col(at).alias("start"), F.lead(at).over(by).alias("end"), (F.row_number().over(by) - 1).cast("long").alias("idx"))
    return spans.where("end is not null").withColumn("duration", F.col("end") - F.col("start"))


def in_intervals(rows: DataFrame, spans: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with the interval they lie in: equal keys and start <= order < end, so a hash join with a residual."""
    return rows.join(spans, key).where((F.col(order) >= F.col("start")) & (F.col(order) < F.col("end")))


def interval_features(joined: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Means of the values in every interval, and last minus first."""
    aggs = [F.avg(v).alias(f"mean_{v}") for v in values] + [(F.max_by(v, order) - F.min_by(v, order)).alias(f"delta_{v}") for v in values]
    return joined.groupBy(key, "idx", "start", "end").agg(F.count(F.lit(1)).alias("n"), *aggs)


def next_values(df: DataFrame, key: str, order: str, values: list[str], drop_last: bool = True) -> DataFrame:
    """Adds next_<v> and step_<v> (next minus this); a sequence's last row has none and is dropped if asked."""
    by = Window.partitionBy(key).orderBy(order)
    out = df.withColumns({f"next_{v}": F.lead(v).over(by) for v in values} | {f"step_{v}": F.lead(v).over(by) - F.col(v) for v in values} | {"_more": F.lead(F.lit(1)).over(by)})
    return (out.where("_more is not null") if drop_last else out).drop("_more")


def centre_times(df: DataFrame, key: str, order: str, duration: str, rate: float) -> DataFrame:
    """Adds centre_ms: the middle of every stretch on its sequence's time axis."""
    running = F.sum(duration).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("centre_ms", (running - F.col(duration) / 2) * 1000.0 / rate)


def central_difference(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    by = Window.partitionBy(key).orderBy(order)
    before, after, x = F.lag(value).over(by), F.lead(value).over(by), F.col(value)
    return df.withColumn("gradient", F.coalesce((after - before) / 2, after - x, x - before))


def smoothed(df: DataFrame, key: str, order: str, value: str, half: int) -> DataFrame:
    """Adds smooth_0 .. smooth_2: value, slope and curvature of the least-squares parabola over 2*half+1 rows, where all are there.

    Moments come from one row frame. The order must count in steps of one; it is taken from the current row, which keeps sums small.
    """
    n = 2 * half + 1
    frame = Window.partitionBy(key).orderBy(order).rowsBetween(-half, half)
    i, x = F.col(order), F.col(value)
    s2 = sum(k * k for k in range(-half, half + 1))
    s4 = sum(k**4 for k in range(-half, half + 1))
    m0, m1, m2 = F.sum(x).over(frame), F.sum(x * i).over(frame), F.sum(x * i * i).over(frame)
    t1, t2 = m1 - i * m0, m2 - 2 * i * m1 + i * i * m0
    curve = (n * t2 - s2 * m0) / (n * s4 - s2 * s2)
    level = (m0 - curve * s2) / n
    whole = F.count(F.lit(1)).over(frame) == n
    return df.withColumns({"smooth_0": F.when(whole, level), "smooth_1": F.when(whole, t1 / s2), "smooth_2": F.when(whole, 2 * curve)})


def valid_span(df: DataFrame, key: str, order: str, values: list[str], policy: str = "trim", least: int = 1) -> DataFrame:
    """Rows of each sequence by how missing values count.

    trim: first to last row with all values, gaps inside stay. trim_strict: the same, but a sequence with a gap goes. drop: every
    row with a gap goes and `order` is numbered anew. Sequences of fewer than `least` rows go.
    """
    good = None
    for v in values:
        ok = F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))
        good = ok if good is None else good & ok
    all_rows = Window.partitionBy(key)
    if policy == "drop":
        kept = df.where(good).withColumn(order, (F.row_number().over(all_rows.orderBy(order)) - 1).cast("long"))
    elif policy in ("trim", "trim_strict"):
        marked = df.withColumn("_good", good)
        span = marked.withColumns({"_a": F.min(F.when(F.col("_good"), F.col(order))).over(all_rows), "_b": F.max(F.when(F.col("_good"), F.col(order))).over(all_rows)}).where(F.col(order).between(F.col("_a"), F.col("_b")))
        if policy == "trim_strict":
            span = span.withColumn("_all", F.bool_and("_good").over(all_rows)).where("_all").drop("_all")
        kept = span.drop("_good", "_a", "_b")
    else:
        raise ValueError(f"no policy {policy}")
    return kept.withColumn("_n", F.count(F.lit(1)).over(all_rows)).where(F.col("_n") >= least).drop("_n")


def mirrored(df: DataFrame, swap: list[tuple[str, str]], flip: list[str]) -> DataFrame:
    """The rows and their mirror images, told apart by is_mirrored: paired columns swap, flipped ones change sign."""
    other = {a: b for a, b in swap} | {b: a for a, b in swap}
    image = df.select(*[(-F.col(c) if c in flip else F.col(other.get(c, c))).alias(c) for c in df.columns])
    return df.withColumn("is_mirrored", F.lit(False)).unionByName(image.withColumn("is_mirrored", F.lit(True)))


def sides(df: DataFrame, left: str, right: str, value: str = "value") -> DataFrame:
    """Two rows for each: side 0 with the left value, side 1 with the right."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(left).alias(value)), F.struct(F.lit(1).alias("side"), F.col(right).alias(value))))
    return df.withColumn("_s", both).select(*[c for c in df.columns if c not in (left, right)], "_s.side", f"_s.{value}")


def paired(df: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Back to one row a key: left, right, their difference and sum; keys that lack a side go."""
    wide = df.groupBy(*key).agg(F.max(F.when(F.col("side") == 0, F.col(value))).alias("left"), F.max(F.when(F.col("side") == 1, F.col(value))).alias("right"), F.count_distinct("side").alias("_sides"))
    return wide.where("_sides = 2").drop("_sides").withColumns({"difference": F.col("left") - F.col("right"), "total": F.col("left") + F.col("right")})


def zip_by_ordinal(left: DataFrame, right: DataFrame, key: str, order_left: Column, order_right: Column, names: tuple[str, str]) -> DataFrame:
    """The n-th row of the left with the n-th of the right, as far as both go."""
    a = left.withColumn("ordinal", (F.row_number().over(Window.partitionBy(key).orderBy(order_left)) - 1).cast("long")).select(key, "ordinal", order_left.alias(names[0]))
    b = right.withColumn("ordinal", (F.row_number().over(Window.partitionBy(key).orderBy(order_right)) - 1).cast("long")).select(key, "ordinal", order_right.alias(names[1]))
    return a.join(b, [key, "ordinal"])
