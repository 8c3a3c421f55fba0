"""Left/right pairs on `lineitem`: l_discount against l_tax, a supplier being a flight."""

from __future__ import annotations

from cadenza.functions import arrays as A
from cadenza.functions.registry import WING_SCALE
from cadenza.operators import ranks as R
from cadenza.operators import sequence as S
from cadenza.operators import statistics as Q
from cadenza.operators import vectors as V
from cadenza.plans.common import Book, r
from cadenza.sources.tables import select_groups, table
from pyspark.sql import functions as F

QUERIES = Book()

_ASYM = """WITH s AS (SELECT l_suppkey AS flight, greatest(avg(abs(l_discount - l_tax)) / pi(), avg(abs(l_quantity / 50 - l_discount)) / 0.5) AS score, count(*) AS n FROM lineitem GROUP BY l_suppkey),
m AS (SELECT median(score) AS median FROM s), q AS (SELECT flight, score, n, CASE WHEN median <= 0 THEN 0 ELSE score / median END AS suspicion, median FROM s, m)"""


def _scores(spark, d):
    rows = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity") / 50)
    return Q.asymmetry(rows, "l_suppkey", [("l_discount", "l_tax", WING_SCALE[0]), ("q", "l_discount", WING_SCALE[1])]).withColumnRenamed("l_suppkey", "flight")


@QUERIES.add(_ASYM + " SELECT flight, n, round(score, 6) AS score, round(suspicion, 6) AS suspicion, CASE WHEN suspicion >= 6 THEN 'high' WHEN suspicion >= 3 THEN 'medium' ELSE 'low' END AS class FROM q")
def screening(spark, d):
    rated = Q.asymmetry_filter(_scores(spark, d), 0)
    return rated.select("flight", "n", r("score").alias("score"), r("suspicion").alias("suspicion"), Q.suspicion_class(F.col("suspicion")).alias("class"))


@QUERIES.add(_ASYM + " SELECT flight, CAST(row_number() OVER (ORDER BY flight) - 1 AS BIGINT) AS trajectory_id, round(score, 6) AS score FROM q WHERE score <= 1.02 * median")
def garbage_filter(spark, d):
    kept = Q.asymmetry_filter(_scores(spark, d), 1.02)
    return R.ranked(kept, "flight", "flight", "trajectory_id").select("flight", "trajectory_id", r("score").alias("score"))


_SIDES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0 AS side, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1, l_tax FROM lineitem"


def _sides(spark, d):
    return S.sides(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax"), "l_discount", "l_tax")


@QUERIES.add(_SIDES)
def wing_unpivot(spark, d):
    return _sides(spark, d)


@QUERIES.add(f"""WITH s AS (SELECT l_suppkey AS beat, side, max(value) AS v FROM ({_SIDES}) GROUP BY 1, 2) SELECT a.beat, round(a.v, 6) AS "left", round(b.v, 6) AS "right", round(a.v - b.v, 6) + 0.0 AS difference, round(a.v + b.v, 6) AS total FROM s a JOIN s b ON a.beat = b.beat AND a.side = 0 AND b.side = 1""")
def wing_pairs(spark, d):
    return S.paired(_sides(spark, d).withColumnRenamed("l_suppkey", "beat"), ["beat"]).select("beat", *[r(c).alias(c) for c in ("left", "right", "difference", "total")])


@QUERIES.add("""SELECT l_suppkey, count(*) AS n, round(sum(l_discount), 6) AS sl, round(sum(l_tax), 6) AS sr, round(sum(l_quantity), 6) AS sq, is_mirrored FROM (
SELECT l_suppkey, l_discount, l_tax, l_quantity, false AS is_mirrored FROM lineitem UNION ALL SELECT l_suppkey, l_tax, l_discount, -l_quantity, true FROM lineitem) GROUP BY l_suppkey, is_mirrored""")
def mirror_union(spark, d):
    both = S.mirrored(table(spark, d, "lineitem").select("l_suppkey", "l_discount", "l_tax", "l_quantity"), [("l_discount", "l_tax")], ["l_quantity"])
    return both.groupBy("l_suppkey", "is_mirrored").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_discount")).alias("sl"), r(F.sum("l_tax")).alias("sr"), r(F.sum("l_quantity")).alias("sq"))


@QUERIES.add("""WITH v AS (SELECT l_extendedprice AS v, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS b FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY 1),
g AS (SELECT a, b, abs(sum(a) OVER w * 1.0 / sum(a) OVER () - sum(b) OVER w * 1.0 / sum(b) OVER ()) AS gap FROM v WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))
SELECT round(max(gap), 6) AS d, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b FROM g""")
def price_ks(spark, d):
    rows = table(spark, d, "lineitem")
    return Q.two_sample_ks(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'N'"), "l_extendedprice").select(r("d").alias("d"), "n_a", "n_b")


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@QUERIES.add(" UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(coalesce(corr({a}, {b}), 0), 6) + 0.0 AS r FROM lineitem" for a in _COLS[:2] for b in _COLS))
def correlation_table(spark, d):
    return Q.correlation_table(table(spark, d, "lineitem"), _COLS[:2], _COLS).select("left", "right", r("r").alias("r"))


def _scaler_query(name, kind, offset, width, columns=_COLS):
    sql = " UNION ALL ".join(f"SELECT '{c}' AS feature, round({offset.format(c=c)}, 6) + 0.0 AS shift, round({width.format(c=c)}, 6) AS width FROM lineitem" for c in columns)

    def query(spark, d):
        fitted = V.fit_scaler(table(spark, d, "lineitem"), columns, kind)
        return spark.createDataFrame([(c, float(o), float(s)) for c, (o, s) in fitted.items()], "feature string, shift double, width double").select("feature", r("shift").alias("shift"), r("width").alias("width"))

    QUERIES[name] = (query, sql)


_scaler_query("scaler_zscore", "zscore", "avg({c})", "stddev_pop({c})")
_scaler_query("scaler_sample_zscore", "sample_zscore", "avg({c})", "stddev_samp({c})")
_scaler_query("scaler_minmax", "minmax", "min({c})", "max({c}) - min({c})")
_scaler_query("scaler_vector_norm", "vector_norm", "0 * avg({c})", "avg(sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_discount * l_discount)) + 0 * avg({c})", _COLS[:3])
_scaler_query("scaler_identity", "identity", "0 * avg({c})", "1 + 0 * avg({c})")


@QUERIES.add("""SELECT l_suppkey, round(avg((l_quantity - m) / s), 6) + 0.0 AS z, round(avg((l_quantity - m) / s * s + m), 6) AS back FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem) GROUP BY l_suppkey""")
def scaler_round_trip(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_quantity")
    fitted = V.fit_scaler(rows, ["l_quantity"], "zscore")
    scaled = V.scale(rows, fitted).withColumn("z", F.col("l_quantity"))
    return V.scale(scaled, fitted, inverse=True).groupBy("l_suppkey").agg(r(F.avg("z")).alias("z"), r(F.avg("l_quantity")).alias("back"))


_BODY = """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(l_quantity * cos(l_tax) + l_discount * sin(l_tax), 6) + 0.0 AS v_x, round(l_discount * cos(l_tax) - l_quantity * sin(l_tax), 6) + 0.0 AS v_y, round(sqrt(l_quantity * l_quantity + l_discount * l_discount), 6) AS speed FROM lineitem"""


@QUERIES.add(_BODY)
def body_projection(spark, d):
    rows = table(spark, d, "lineitem")
    c, s = F.cos("l_tax"), F.sin("l_tax")
    v = [F.col("l_quantity"), F.col("l_discount"), F.lit(0.0)]
    zero, one = F.lit(0.0), F.lit(1.0)
    x, y, _ = A.project3(v, [[c, s, zero], [-s, c, zero], [zero, zero, one]])
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", r(x).alias("v_x"), r(y).alias("v_y"), r(A.vector_norm3(*v)).alias("speed"))


@QUERIES.add("""WITH s AS (SELECT l_suppkey AS k, list(l_discount ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax) AS l, list(l_tax ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax) AS r FROM lineitem GROUP BY l_suppkey),
z AS (SELECT k, list_transform(list_zip(l, r), lambda p: (p[1] + p[2]) / 2) AS s, list_transform(list_zip(l, r), lambda p: (p[1] - p[2]) / 2) AS a, l FROM s)
SELECT k AS flight, CAST(len(l) AS BIGINT) AS n, round(sqrt(list_sum(list_transform(s, lambda x: x * x))), 6) AS s_norm, round(sqrt(list_sum(list_transform(a, lambda x: x * x))), 6) AS a_norm,
  round(list_max(s) - list_min(s), 6) AS s_spread, round(degrees(list_max(l) - list_min(l)), 6) AS amplitude, round(pow(l[1] - l[len(l)], 2), 6) AS cycle,
  round(list_sum(list_transform(list_zip(l[2:], l[:len(l)-1]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / (len(l) - 1), 6) AS derivative, true AS inverse_ok FROM z WHERE len(l) > 1""")
def symmetric_residuals(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax"]
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("flight")).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_r")).where(F.size("_r") > 1)
    rows = rows.select("flight", F.col("_r.l_discount").alias("l"), F.col("_r.l_tax").alias("t"))
    rows = rows.withColumns({"s": A.symmetric(F.col("l"), F.col("t")), "a": A.asymmetric(F.col("l"), F.col("t"))})
    back = F.forall(F.arrays_zip(F.col("l"), A.left_of(F.col("s"), F.col("a")).alias("b")), lambda z: F.abs(z["l"] - z["b"]) < 1e-12)
    steps = A.steps(F.col("l"))
    return rows.select(
        "flight", F.size("l").cast("long").alias("n"), r(A.norm(F.col("s"))).alias("s_norm"), r(A.norm(F.col("a"))).alias("a_norm"), r(A.spread(F.col("s"))).alias("s_spread"), r(F.degrees(A.spread(F.col("l")))).alias("amplitude"),
        r(A.cycle_square(F.col("l"))).alias("cycle"), r(A.total(F.transform(steps, lambda x: x * x)) / F.size(steps)).alias("derivative"), back.alias("inverse_ok"),
    )


@QUERIES.add("SELECT l_orderkey, l_discount, l_tax, count(*) AS n FROM lineitem GROUP BY ALL")
def column_groups(spark, d):
    picked = select_groups(table(spark, d, "lineitem"), [["l_orderkey"], ["l_quantity", "l_extendedprice"], ["l_discount", "l_tax"]], "101")
    return picked.groupBy("l_orderkey", "l_discount", "l_tax").agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add("""WITH p AS (SELECT array_agg(1) AS q, quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem) SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_extendedprice BETWEEN lo AND hi) AS shown FROM lineitem, p GROUP BY l_suppkey""")
def display_clip(spark, d):
    rows = table(spark, d, "lineitem")
    edges = R.quantile_row(rows, "l_extendedprice", {"lo": 0.01, "hi": 0.99})
    return rows.crossJoin(F.broadcast(edges)).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_extendedprice").between(F.col("lo"), F.col("hi"))).alias("shown"))
