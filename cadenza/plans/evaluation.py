"""Evaluation queries: an embedding is a latent, or a beat of 4 channels by 16 samples, and its label is its flight."""

from __future__ import annotations

from math import pi

import numpy as np
from cadenza.functions import registry as N
from cadenza.operators import beats as B
from cadenza.operators import graph as G
from cadenza.operators import models as M
from cadenza.operators import pruned as P
from cadenza.operators import shapes as H
from cadenza.operators import statistics as Q
from cadenza.operators import vectors as V
from cadenza.plans.common import EV, Book, beats, r
from cadenza.sources import tables as T
from cadenza.sources.tables import table
from pyspark.sql import functions as F

QUERIES = Book()

_V = "WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_FLAT = _V + ", x AS (SELECT id, label, CAST(i - 1 AS INT) AS dim, e[i] AS x FROM v, range(1, 65) t(i))"


def _v(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def _floats(spark, d):
    """As they are stored: searches move half the bytes."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))


def _beat(column, channels=4, samples=16):
    return F.array(*[F.slice(column, 1 + c * samples, samples) for c in range(channels)])


# distances


@QUERIES.add(_V + " SELECT CAST((count(*) - 1) * 64 AS DOUBLE) AS total FROM v")
def mahalanobis_total(spark, d):
    """Squared full distances from the mean add up to (n - 1) times the number of dimensions."""
    v = _v(spark, d)
    mean, c = V.mean_and_covariance(v, "v")
    return V.mahalanobis(v, "v", mean, np.linalg.pinv(c)).agg(F.round(F.sum(F.pow("distance", 2)), 3).alias("total"))


@QUERIES.add()
def full_mahalanobis(spark, d):
    v = _v(spark, d)
    mean, c = V.mean_and_covariance(v, "v")
    return V.mahalanobis(v, "v", mean, np.linalg.pinv(c)).select("id", r("distance").alias("distance"))


@QUERIES.add(_FLAT + """, s AS (SELECT dim, avg(x) AS m, stddev_samp(x) AS sd FROM x GROUP BY dim), dd AS (SELECT id, sqrt(sum(pow(x - m, 2))) AS dist FROM x JOIN s USING (dim) GROUP BY id),
q AS (SELECT 'zero' AS name, sqrt(sum(m * m)) AS l2, sqrt(sum(pow(m / greatest(sd, 1e-12), 2))) AS diagonal FROM s UNION ALL SELECT 'unit', sqrt(sum(pow(1 - m, 2))), sqrt(sum(pow((1 - m) / greatest(sd, 1e-12), 2))) FROM s)
SELECT name, round(l2, 6) AS l2, round(diagonal, 6) AS diagonal, round((SELECT avg(CASE WHEN dist < l2 THEN 100.0 ELSE 0 END) FROM dd), 6) AS percentile FROM q""")
def reference_comparison(spark, d):
    found = V.compare_with_centre(_v(spark, d), "v", {"zero": [0.0] * 64, "unit": [1.0] * 64})
    return found.select("name", *[r(c).alias(c) for c in ("l2", "diagonal", "percentile")])


@QUERIES.add(_FLAT + " SELECT round(sum(va), 6) AS total, CAST(1 AS DOUBLE) AS cumulative FROM (SELECT var_samp(x) AS va FROM x GROUP BY dim)")
def component_total(spark, d):
    """Components' variances add up to the dimensions', and their shares to one."""
    found = V.principal_components(_v(spark, d), "v")
    return spark.createDataFrame([(float((found["sd"] ** 2).sum()), float(found["cumulative"][-1]))], "total double, cumulative double").select(r("total").alias("total"), r("cumulative").alias("cumulative"))


@QUERIES.add("SELECT CAST(i AS INT) AS i, CAST(k AS INT) AS k, CAST(0 AS DOUBLE) AS moment FROM range(60) a(i), range(4) b(k)")
def ridge_residual_moments(spark, d):
    """Without a penalty residuals don't depend on any input: the normal equations."""
    v = _v(spark, d).select("id", F.slice("v", 1, 60).alias("x"), F.slice("v", 61, 4).alias("y"))
    fitted = V.ridge(v, "x", "y", 0.0)
    rows = V.ridge_predict(v, "x", fitted).withColumn("e", F.zip_with("y", "pred", lambda a, b: a - b))
    flat = rows.select("e", F.posexplode("x").alias("i", "xi")).select("i", "xi", F.posexplode("e").alias("k", "ek"))
    return flat.groupBy("i", "k").agg(r(F.sum(F.col("xi") * F.col("ek"))).alias("moment"))


# features and scaled inputs


@QUERIES.add(_FLAT + """, s AS (SELECT dim // 16 AS c, greatest(stddev_samp(x), 1e-8) AS sd FROM x GROUP BY 1)
SELECT id, dim, round(x / sd * sqrt(CASE c WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 10 ELSE 0.5 END), 6) + 0.0 AS x FROM x JOIN s ON c = dim // 16""")
def weighted_features(spark, d):
    rows = V.channel_features(_v(spark, d).select("id", _beat("v").alias("beat")), "beat", [1.0, 3.0, 10.0, 0.5], equalize=True)
    return rows.select("id", F.posexplode("features").alias("dim", "x")).select("id", "dim", r("x").alias("x"))


_INPUT = _FLAT + """, n AS (SELECT id, lead(id) OVER (PARTITION BY label ORDER BY id) AS nid FROM v), s AS (SELECT dim, avg(x) AS m, CASE WHEN stddev_pop(x) > 1e-8 THEN stddev_pop(x) ELSE 1 END AS sd FROM x WHERE dim IN (6, 7, 8, 12, 13, 14) GROUP BY dim),
k AS (SELECT dim, m, sd, CAST(row_number() OVER (ORDER BY dim) - 1 AS INT) AS pos FROM s)"""


def _with_next(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("id")
    return _v(spark, d).withColumn("following", F.lead("v").over(w))


@QUERIES.add(_INPUT + """ SELECT n.id, CAST(pos AS INT) AS place, round((x - m) / sd, 6) + 0.0 AS x FROM n JOIN x ON x.id = n.id JOIN k USING (dim) WHERE nid IS NOT NULL UNION ALL
SELECT n.id, CAST(pos + 6 AS INT), round((x - m) / sd, 6) + 0.0 FROM n JOIN x ON x.id = n.nid JOIN k USING (dim)""")
def scaled_input(spark, d):
    """Angular velocity channels of each beat and of its flight's next one, by a z-score fitted on all beats."""
    rows = _with_next(spark, d)
    scaler = V.fit_body_scaler(rows, "v", N.features("angular_vel_dwithin"))
    found = V.scaled_input(rows.where("following is not null"), "v", "following", scaler)
    return found.select("id", F.posexplode("x").alias("place", "x")).select("id", "place", r("x").alias("x"))


@QUERIES.add(_FLAT + """, w AS (SELECT CAST(i AS INT) AS dim, avg(sqrt(pow(e[i - i % 3 + 1], 2) + pow(e[i - i % 3 + 2], 2) + pow(e[i - i % 3 + 3], 2))) AS f FROM v, range(12) t(i) GROUP BY 1)
SELECT id, dim AS place, round(x / f, 6) + 0.0 AS x FROM x JOIN w USING (dim)""")
def vector_norm_input(spark, d):
    """The default scaler of the twelve core channels, on this beat alone."""
    rows = _v(spark, d)
    scaler = V.fit_body_scaler(rows, "v", N.features("full"))
    found = V.scaled_input(rows, "v", "v", scaler, with_next=False)
    return found.select("id", F.posexplode("x").alias("place", "x")).select("id", "place", r("x").alias("x"))


@QUERIES.add(_V + " SELECT id, round(e[1], 6) + 0.0 AS yaw_accel, round(e[2], 6) + 0.0 AS pitch_accel, round(e[3], 6) + 0.0 AS roll_accel FROM v")
def colour_columns(spark, d):
    named = N.coloured(_v(spark, d), "v", 3)
    return named.select("id", *[r(c).alias(c) for c in N.colour_columns(3)])


_TARGETS = EV + """, t AS (SELECT traj, x, lead(value) OVER w - value AS dvel_next, value AS accel, lead(x) OVER w AS more FROM ev WINDOW w AS (PARTITION BY traj ORDER BY beat))"""


@QUERIES.add(_TARGETS + " SELECT 'accel' AS target, count(*) AS n, round(corr(x, accel), 6) AS pearson, round(regr_slope(accel, x), 6) AS slope FROM t UNION ALL SELECT 'dvel_next', count(dvel_next), round(corr(x, dvel_next), 6), round(regr_slope(dvel_next, x), 6) FROM t WHERE dvel_next IS NOT NULL")
def target_relations(spark, d):
    """How a beat's signed channel relates to each registered target of one axis."""
    from pyspark.sql import Window

    w = Window.partitionBy("traj").orderBy("beat")
    rows = beats(spark, d).select("x", F.col("value").alias("alpha_yaw"), F.col("value").alias("w_yaw"), F.lead("value").over(w).alias("next_w_yaw"))
    out = None
    for name in ("accel", "dvel_next"):
        y = rows.select("x", N.target(name, "yaw").alias("y")).where("y is not null")
        one = y.agg(F.count(F.lit(1)).alias("n"), r(F.corr("x", "y")).alias("pearson"), r(F.regr_slope("y", "x")).alias("slope")).select(F.lit(name).alias("target"), "n", "pearson", "slope")
        out = one if out is None else out.unionByName(one)
    return out


# sampling


@QUERIES.add(_FLAT + """, o AS (SELECT dim, x, row_number() OVER (PARTITION BY dim ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY dim) AS n FROM x WHERE dim < 4),
k AS (SELECT CAST(g AS INT) AS dim, CAST(('0x' || substr(md5(CAST(g AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 12)) AS BIGINT) AS h FROM range(4) a(g), range(200) b(i)),
s AS (SELECT o.dim, x FROM k JOIN o ON o.dim = k.dim AND o.pos = h % o.n)
SELECT dim, count(*) AS n, round(quantile_cont(x, 0.1), 6) + 0.0 AS p10, round(quantile_cont(x, 0.5), 6) + 0.0 AS p50, round(quantile_cont(x, 0.9), 6) + 0.0 AS p90 FROM s GROUP BY dim""")
def bootstrap_quantiles(spark, d):
    """200 draws with replacement from each of the first four dimensions."""
    out = None
    for k in range(4):
        drawn = Q.drawn_with_replacement(_v(spark, d).select("id", F.col("v")[k].alias("x")), "x", "id", 200, k)
        p = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
        one = drawn.agg(F.count(F.lit(1)).alias("n"), p.alias("p")).select(F.lit(k).alias("dim"), "n", *[r(F.col("p")[i]).alias(c) for i, c in enumerate(("p10", "p50", "p90"))])
        out = one if out is None else out.unionByName(one)
    return out


@QUERIES.add(EV + """, l AS (SELECT traj, count(*) AS n FROM ev GROUP BY traj HAVING count(*) >= 5), p AS (SELECT traj, n FROM l ORDER BY md5('0:' || CAST(traj AS VARCHAR)), traj LIMIT 1),
b AS (SELECT traj, CAST(('0x' || substr(md5('0:' || CAST(traj AS VARCHAR) || ':start'), 1, 12)) AS BIGINT) % (n - 4) AS begin FROM p) SELECT ev.traj, beat, event_id FROM ev JOIN b USING (traj) WHERE beat >= begin AND beat < begin + 5""")
def consecutive_beats(spark, d):
    return H.consecutive_rows(beats(spark, d), "traj", "beat", 5).select("traj", "beat", "event_id")


# predictors


def _split(spark, d):
    rows = _floats(spark, d).select("id", "label", F.slice("v", 1, 60).alias("x"), F.slice("v", 61, 4).alias("y"))
    return rows.where("id % 5 > 0"), rows.where("id % 5 = 0")


_LADDER = _V + f""", tr AS (SELECT id, e[1:60] AS x, e[61:64] AS y FROM v WHERE id % 5 > 0), va AS (SELECT id, e[1:60] AS x, e[61:64] AS y FROM v WHERE id % 5 = 0),
d AS (SELECT va.id, tr.y, row_number() OVER (PARTITION BY va.id ORDER BY {_D2.format(a="va.x", b="tr.x")}, tr.id) AS rank FROM va, tr),
p AS (SELECT 'mean' AS predictor, va.id, list(m ORDER BY i) AS p FROM va, (SELECT i, avg(y[i]) AS m FROM tr, range(1, 5) t(i) GROUP BY i) GROUP BY va.id
  UNION ALL SELECT 'nearest ' || kk, id, list(m ORDER BY i) FROM (SELECT kk, id, i, avg(y[i]) AS m FROM d, (SELECT unnest([1, 5]) AS kk), range(1, 5) t(i) WHERE rank <= kk GROUP BY 1, 2, 3) GROUP BY 1, 2),
pt AS (SELECT predictor, p.id, p, y AS t FROM p JOIN va USING (id)),
e AS (SELECT predictor, avg({_D2.format(a="p", b="t")} / 4) AS mse FROM pt GROUP BY 1),
r AS (SELECT predictor, avg(CASE WHEN tot <= 1e-12 THEN 1 ELSE 1 - res / tot END) AS mean_r2 FROM (SELECT predictor, i, sum(pow(p[i] - t[i], 2)) AS res, var_pop(t[i]) * count(*) AS tot FROM pt, range(1, 5) u(i) GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT a.predictor, a.id, count(*) FILTER (WHERE {_D2.format(a="a.p", b="b.t")} < {_D2.format(a="a.p", b="a.t")}) AS rank, count(*) AS n FROM pt a JOIN pt b ON a.predictor = b.predictor GROUP BY 1, 2),
k AS (SELECT predictor, median(rank * 1.0 / greatest(n - 1, 1)) AS median_percentile, avg(CASE WHEN rank < 10 THEN 1.0 ELSE 0 END) AS top_10 FROM w GROUP BY 1)"""


@QUERIES.add(_LADDER + " SELECT predictor, round(mse, 6) AS mse, round(mean_r2, 6) + 0.0 AS mean_r2, round(median_percentile, 6) AS median_percentile, round(top_10, 6) AS top_10 FROM e JOIN r USING (predictor) JOIN k USING (predictor)")
def predictor_ladder(spark, d):
    """What the mean and the nearest rows predict of the last four dimensions; ridge rows are held against the closed form in a test."""
    train, val = _split(spark, d)
    return V.predictor_ladder(train, val, (), (1, 5)).select("predictor", *[r(c).alias(c) for c in ("mse", "mean_r2", "median_percentile", "top_10")])


@QUERIES.add(_V + f""", s AS (SELECT id, label, e[1:60] AS x, e[61:64] AS y FROM v), d AS (SELECT a.id, a.y AS ya, b.y AS yb, {_D2.format(a="a.x", b="b.x")} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_D2.format(a="a.x", b="b.x")}, b.id) AS rank FROM s a, s b WHERE a.label <> b.label),
z AS (SELECT sum(va) AS variance FROM (SELECT var_pop(y[i]) AS va FROM s, range(1, 5) t(i) GROUP BY i)), n AS (SELECT median(sqrt(list_sum(list_transform(x, lambda q: q * q)))) AS median_norm FROM s)
SELECT count(*) AS n, round(avg({_D2.format(a="ya", b="yb")}) / 2, 6) AS noise, round(median(sqrt(d2)), 6) AS median_distance, round(any_value(variance), 6) AS variance, round(any_value(median_norm), 6) AS median_norm,
  round(1 - avg({_D2.format(a="ya", b="yb")}) / 2 / greatest(any_value(variance), 1e-12), 6) AS ceiling FROM d, z, n WHERE rank = 1""")
def achievable_ceiling(spark, d):
    rows = _floats(spark, d).select("id", "label", F.slice("v", 1, 60).alias("x"), F.slice("v", 61, 4).alias("y"))
    return V.achievable(rows).select("n", *[r(c).alias(c) for c in ("noise", "median_distance", "variance", "median_norm", "ceiling")])


# beats


_SCALE = [pi, 0.5, pi, 1.0]
_MEANS = _FLAT + ", m AS (SELECT label, dim, avg(x) AS m FROM x GROUP BY 1, 2)"


def _reconstructed(spark, d):
    v = _v(spark, d)
    return v.join(H.mean_vector(v, "v", ["label"]), "label").select("id", "label", _beat("centre").alias("p"), _beat("v").alias("t"), (F.pmod(F.col("id"), F.lit(13)) / 12).alias("score"))


@QUERIES.add(_MEANS + f" SELECT CAST(dim // 16 AS INT) AS channel, round(degrees(sqrt(avg(pow(x - m, 2))) * any_value(CASE dim // 16 WHEN 1 THEN 0.5 WHEN 3 THEN 1.0 ELSE {pi} END)), 6) AS rmse_deg FROM x JOIN m USING (label, dim) GROUP BY 1")
def channel_rmse(spark, d):
    return V.channel_rmse_degrees(_reconstructed(spark, d), "p", "t", _SCALE).select("channel", r("rmse_deg").alias("rmse_deg"))


_BUCKET = {"zero": "s = 0", "low": "s > 0 AND s <= 1/3.0 + 1e-6", "mid": "s > 1/3.0 + 1e-6 AND s <= 2/3.0 + 1e-6", "high": "s > 2/3.0 + 1e-6 AND s < 1", "peak": "s >= 1 - 1e-6"}
_CHANNELS = ", ".join(f"round(degrees(sqrt(avg(CASE WHEN dim // 16 = {c} THEN pow(x - m, 2) END)) * {s}), 6) AS rmse_{c}" for c, s in enumerate(_SCALE))
_CHANNEL_MEAN = " + ".join(f"degrees(sqrt(avg(CASE WHEN dim // 16 = {c} THEN pow(x - m, 2) END)) * {s})" for c, s in enumerate(_SCALE))


@QUERIES.add(_MEANS + ", j AS (SELECT id, (id % 13) / 12.0 AS s, dim, x, m FROM x JOIN m USING (label, dim)) " + " UNION ALL ".join(f"SELECT {i} AS position, '{b}' AS bucket, count(DISTINCT id) AS n, round(avg(pow(x - m, 2)), 6) AS norm_mse, {_CHANNELS}, round(({_CHANNEL_MEAN}) / 4, 6) AS mean_rmse_deg FROM j WHERE {c}" for i, (b, c) in enumerate(_BUCKET.items())))
def bucket_evaluation(spark, d):
    """Errors of a beat's reconstruction (its flight's mean) by bucket and channel."""
    rows = Q.bucket_evaluation(_reconstructed(spark, d), "score", "p", "t", None, _SCALE)
    return rows.select("position", "bucket", "n", r("norm_mse").alias("norm_mse"), *[r(F.col("rmse_deg")[c]).alias(f"rmse_{c}") for c in range(4)], r("mean_rmse_deg").alias("mean_rmse_deg"))


@QUERIES.add(_FLAT + " SELECT id, dim, round(x, 6) + 0.0 AS x FROM x")
def encoded_round_trip(spark, d):
    """An encoder that keeps every component decodes what it encoded."""
    rows = _v(spark, d).select("id", _beat("v").alias("beat"))
    encoder = M.fit_linear_encoder(rows, 64)
    back = M.decoded(M.encoded(rows, encoder), encoder).select("id", F.posexplode(F.flatten("recon")).alias("dim", "x"))
    return back.select("id", "dim", r("x").alias("x"))


@QUERIES.add("""SELECT p_partkey AS part, CAST(i AS INT) AS phase, round(p_size * pow(i / 68.0, 3) - p_retailprice / 1017 * pow(i / 68.0, 2) + i / 68.0, 6) + 0.0 AS x FROM part, range(69) t(i)""")
def resampled_polynomials(spark, d):
    """Cubics sampled at 61 to 75 places come back exactly at 69."""
    n = F.lit(61) + F.col("p_partkey") % 15
    at = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: k / (n - 1))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.array(F.transform(at, lambda t: F.col("p_size") * F.pow(t, 3) - F.col("p_retailprice") / 1017 * F.pow(t, 2) + t)).alias("seg"))
    return B.resampled(rows, 69).select("part", F.posexplode(F.col("beat")[0]).alias("phase", "x")).select("part", "phase", r("x").alias("x"))


_PERIOD = "60 + s_suppkey % 16"


@QUERIES.add(f"SELECT s_suppkey AS flight, CAST(k - 1 AS BIGINT) AS idx, CAST(10 + k * ({_PERIOD}) AS BIGINT) AS \"at\" FROM supplier, range(1, 30) t(k) WHERE 10 + k * ({_PERIOD}) < 700 - 1".replace("range(1, 30)", "range(0, 30)").replace("k - 1", "k"))
def stroke_boundaries(spark, d):
    """Peaks of a stroke of known period, both wings in step."""
    t = F.explode(F.sequence(F.lit(0), F.lit(699)))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("flight"), (60 + F.col("s_suppkey") % 16).alias("p"), t.alias("frame"))
    phase = F.cos(2 * pi * (F.col("frame") - 10) / F.col("p"))
    frames = rows.select("flight", F.col("frame").cast("long").alias("frame"), phase.alias("phi_l"), (phase * 0.9).alias("phi_r"))
    return B.boundaries(frames, "flight", "frame", 50)


@QUERIES.add("""SELECT s_suppkey AS flight, CAST(i AS BIGINT) AS frame, round(s_acctbal / 997 * (i / 100.0) + s_nationkey * pow(i / 100.0, 2) / 2, 6) + 0.0 AS position, round(s_acctbal / 997 + s_nationkey * (i / 100.0), 6) + 0.0 AS velocity, round(CAST(s_nationkey AS DOUBLE), 6) AS acceleration FROM supplier, range(60) t(i)""")
def smoothed_motion(spark, d):
    """Position, velocity and acceleration of a quadratic path are exact, the ends too."""
    import pandas as pd
    from cadenza.functions import kernels as K

    t = F.explode(F.sequence(F.lit(0), F.lit(59)))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("flight"), "s_acctbal", "s_nationkey", t.alias("frame"))
    s = F.col("frame") / 100
    rows = rows.select("flight", F.col("frame").cast("long").alias("frame"), (F.col("s_acctbal") / 997 * s + F.col("s_nationkey") * s * s / 2).alias("x"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("frame")
        x = group["x"].to_numpy()
        return pd.DataFrame({"flight": group["flight"], "frame": group["frame"], "position": K.smooth(x, 21, 2, 0, 0.01), "velocity": K.smooth(x, 21, 2, 1, 0.01), "acceleration": K.smooth(x, 21, 2, 2, 0.01)})

    found = rows.groupBy("flight").applyInPandas(run, "flight long, frame long, position double, velocity double, acceleration double")
    return found.select("flight", "frame", *[r(c).alias(c) for c in ("position", "velocity", "acceleration")])


@QUERIES.add("""SELECT s_suppkey AS flight, CAST(i AS BIGINT) AS frame, round(sin(radians(300 + s_suppkey % 50) / 16000) / (radians(1) / 16000), 6) AS spin FROM supplier, range(1, 49) t(i)""")
def spin_rates(spark, d):
    """Angular velocity of a body that turns evenly about one axis, where both neighbours are there."""
    import pandas as pd
    from cadenza.functions import kernels as K

    t = F.explode(F.sequence(F.lit(0), F.lit(49)))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("flight"), F.radians(300 + F.col("s_suppkey") % 50).alias("rate"), t.alias("frame"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("frame")
        a = group["rate"].to_numpy() * group["frame"].to_numpy() / 16000
        zero = 0 * a
        w = K.angular_velocity(np.stack([np.cos(a), np.sin(a), zero], 1), np.stack([-np.sin(a), np.cos(a), zero], 1), np.stack([zero, zero, zero + 1], 1), 16000)
        return pd.DataFrame({"flight": group["flight"], "frame": group["frame"], "spin": w[:, 2]})[1:-1]

    found = rows.groupBy("flight").applyInPandas(run, "flight long, frame long, spin double")
    return found.select("flight", "frame", r("spin").alias("spin"))


@QUERIES.add("SELECT l_orderkey, round(sum(degrees(l_discount)), 6) AS a, round(sum(degrees(l_tax)), 6) AS b, round(sum(degrees(l_quantity)), 4) AS c FROM lineitem GROUP BY 1")
def angles_in_degrees(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.array("l_discount", "l_tax", "l_quantity"))).alias("angles"))  # an order's few lines
    turned = rows.select("l_orderkey", H.degrees("angles", "rad").alias("a"))
    total = lambda k: F.aggregate("a", F.lit(0.0), lambda s, x: s + x[k])
    return turned.select("l_orderkey", r(total(0)).alias("a"), r(total(1)).alias("b"), r(total(2), 4).alias("c"))


# sources and sinks


@QUERIES.add("SELECT s_suppkey, s_nationkey, round(s_acctbal, 2) AS s_acctbal, 69 AS length FROM supplier")
def dataset_round_trip(spark, d):
    """Rows and metadata as a dataset gives them back."""
    import uuid

    path = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{uuid.uuid4().hex}"
    expected = {"length": 69}
    rows = T.ensure(spark, path, expected, lambda: table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"))
    ok, _ = T.dataset_is_valid(spark, path, expected)
    return rows.withColumn("s_acctbal", F.round("s_acctbal", 2)).withColumn("length", F.lit(T.read_metadata(spark, path)["length"] if ok else None).cast("int"))


_HELD = EV + ", k AS (SELECT DISTINCT traj FROM ev), s AS (SELECT traj, (SELECT count(*) FROM k) AS n_total FROM k WHERE traj % 6 = 0)"


@QUERIES.add(_HELD + " SELECT k.traj, false AS stale FROM k JOIN s USING (traj)")
def validation_keys(spark, d):
    """The split that was saved at training."""
    keys = beats(spark, d).select("traj")
    saved = keys.distinct().where("traj % 6 = 0").withColumn("n_total", F.lit(keys.distinct().count()))
    found, stale = T.validation_keys(keys, "traj", saved)
    return found.withColumn("stale", F.lit(stale))


@QUERIES.add("SELECT user_id AS flight, count(*) AS n_beats FROM events GROUP BY 1 HAVING count(*) >= 2")
def recordings_with_beats(spark, d):
    return T.with_beats(table(spark, d, "events").groupBy(F.col("user_id").alias("flight")).agg(F.count(F.lit(1)).alias("n_beats")))


@QUERIES.add("SELECT count(*) AS n_val, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_all FROM range(CAST((SELECT greatest(1, CAST(floor(count(DISTINCT o_custkey) * 0.15) AS BIGINT)) FROM orders) AS BIGINT))")
def split_sizes(spark, d):
    """A new split keeps the rounded share of all keys, whole."""
    roles = Q.split_by_key(table(spark, d, "orders"), "o_custkey", 0.15)
    return roles.agg(F.count_if(F.col("role") == "val").alias("n_val"), F.count(F.lit(1)).alias("n_all"))


@QUERIES.add(_V + f""", k AS (SELECT a.id AS query, b.id AS neighbour, {_D2.format(a="a.e", b="b.e")} AS d2 FROM v a, v b),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, neighbour) AS rank FROM k) SELECT query, CAST(rank AS INT) AS rank, neighbour, round(d2, 6) + 0.0 AS d2 FROM o WHERE rank <= 6""")
def pruned_neighbours(spark, d):
    """The six nearest of every vector among all, itself included, by lists and bounds."""
    v = _floats(spark, d)
    return P.nearest(v, v, 6).neighbours.select("query", "rank", "neighbour", r("d2").alias("d2"))


@QUERIES.add("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(min(o_totalprice), 2) AS least FROM orders GROUP BY 1")
def report_texts(spark, d):
    """Reports written as JSON texts, one for each group, and read back from them."""
    import uuid

    at = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{uuid.uuid4().hex}"
    rows = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_totalprice").alias("least"))
    T.write_report(rows, at)
    back = spark.read.text(at).select(F.from_json("value", "status string, n long, total double, least double").alias("r")).select("r.*")
    return back.select("status", "n", F.round("total", 2).alias("total"), F.round("least", 2).alias("least"))


_MAX = """, ru AS (SELECT traj, beat, value, CASE WHEN lag(value) OVER w IS NOT DISTINCT FROM value AND beat > 0 THEN 0 ELSE 1 END AS c FROM ev WINDOW w AS (PARTITION BY traj ORDER BY beat)),
rn AS (SELECT *, sum(c) OVER (PARTITION BY traj ORDER BY beat) AS run FROM ru), pl AS (SELECT traj, run, any_value(value) AS value, min(beat) AS first, max(beat) AS last FROM rn GROUP BY traj, run),
ar AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM pl WINDOW w AS (PARTITION BY traj ORDER BY run)),
mx AS (SELECT traj, min((first + last) // 2) AS low, max((first + last) // 2) AS high FROM ar WHERE value > a AND value > b GROUP BY traj HAVING count(*) >= 2)"""


@QUERIES.add(EV + _MAX + """ SELECT traj, beat, round((value + x) / 2 - 0.25, 6) + 0.0 AS s_phi, round((x - value) / 2, 6) + 0.0 AS a_psi, round((value - x) / 2, 6) + 0.0 AS a_phi FROM ev JOIN mx USING (traj) WHERE beat >= low AND beat < high""")
def continuous_residuals(spark, d):
    """Symmetric and asymmetric residuals at every frame between a flight's first and last peak; the template is flat."""
    frames = beats(spark, d).select("traj", "beat", F.col("value").cast("double").alias("phi_l"), F.col("x").alias("psi_l"), F.lit(0.0).alias("theta_l"), F.col("x").alias("phi_r"), F.col("value").cast("double").alias("psi_r"), F.lit(0.0).alias("theta_r"))
    mean = np.zeros((6, 5))
    mean[[0, 3]] = 0.25
    found = B.continuous_symmetric(frames, mean, "traj", "beat", 1)
    return found.select("traj", "beat", r(F.col("residual")[0]).alias("s_phi"), r(F.col("residual")[5]).alias("a_psi"), r(F.col("residual")[3]).alias("a_phi"))


@QUERIES.add(_V + f""", k AS (SELECT a.id AS q, b.id AS n, {_D2.format(a="a.e", b="b.e")} AS d2 FROM v a, v b), o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, n) AS rank FROM k),
m AS (SELECT d2, row_number() OVER (ORDER BY d2) AS i, count(*) OVER () AS c FROM o WHERE rank <= 20 AND q <> n)
SELECT (SELECT count(*) FROM v) AS n, round(2 * d2, 6) AS epsilon, CAST(1 AS DOUBLE) AS trivial, CAST(0 AS DOUBLE) AS off FROM m WHERE i = (c - 1) // 2 + 1""")
def diffusion_invariants(spark, d):
    """A diffusion map's run: rows, twice the median squared neighbour distance, the constant mode's value, and how far the found vectors are
    from lengths of one and right angles, among each other and to the operator's image of them."""
    v = _floats(spark, d).select("id", "v")
    run = G.diffusion(V.exact_neighbours(v, v, 20), G.Diffusion(epsilon_scale=2.0, k=20, components=3, strict=False))
    g = G._gram(run.vectors, "x", 3)
    off = float(np.abs(g - np.eye(3)).max())
    n = run.coordinates.count()
    return spark.createDataFrame([(n, run.epsilon, run.trivial, off)], "n long, epsilon double, trivial double, off double").select("n", r("epsilon").alias("epsilon"), r("trivial", 5).alias("trivial"), r("off", 4).alias("off"))
