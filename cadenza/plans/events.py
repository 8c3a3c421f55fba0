"""Ordered-sequence queries on `events`."""

from __future__ import annotations

from cadenza.functions.registry import BUCKETS
from cadenza.operators import ranks as R
from cadenza.operators import sequence as S
from cadenza.operators import statistics as Q
from cadenza.plans.common import EV, Book, beats, r
from cadenza.sources.tables import json_field, table
from pyspark.sql import Window
from pyspark.sql import functions as F

QUERIES = Book()

_SCORED = """, th AS (SELECT quantile_cont(abs(x), 0.5) AS t FROM ev),
fl AS (SELECT ev.*, CASE WHEN count(*) OVER w = 4 THEN 1 ELSE 0 END AS whole,
  CASE WHEN count(*) OVER w = 4 AND min(abs(x)) OVER w >= t AND CASE WHEN sum(abs(x)) OVER w = 0 THEN 0 ELSE abs(sum(x) OVER w) / sum(abs(x)) OVER w END >= 0.75 THEN 1 ELSE 0 END AS flag
  FROM ev, th WINDOW w AS (PARTITION BY traj ORDER BY beat ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
sc AS (SELECT traj, beat, value, x, CASE WHEN sum(whole) OVER b = 0 THEN 0.0 ELSE sum(flag) OVER b * 1.0 / sum(whole) OVER b END AS score
  FROM fl WINDOW b AS (PARTITION BY traj ORDER BY beat ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""
_MAXIMA = """, ru AS (SELECT traj, beat, value, CASE WHEN beat > 0 AND lag(value) OVER w IS NOT DISTINCT FROM value THEN 0 ELSE 1 END AS c FROM ev WINDOW w AS (PARTITION BY traj ORDER BY beat)),
rn AS (SELECT *, sum(c) OVER (PARTITION BY traj ORDER BY beat) AS run FROM ru),
pl AS (SELECT traj, run, any_value(value) AS value, min(beat) AS first, max(beat) AS last FROM rn GROUP BY traj, run),
ar AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM pl WINDOW w AS (PARTITION BY traj ORDER BY run)),
mx AS (SELECT traj, CAST(floor((first + last) / 2.0) AS BIGINT) AS "at", value AS height FROM ar WHERE value > a AND value > b),
sp AS (SELECT traj, CAST(row_number() OVER w - 1 AS BIGINT) AS idx, "at" AS start, lead("at") OVER w AS stop FROM mx WINDOW w AS (PARTITION BY traj ORDER BY "at"))"""


def _scores(spark, d):
    return S.sustained_scores(beats(spark, d), "traj", "beat", "x", width=4, coherence=0.75, percentile=50)


def _spans(spark, d):
    return S.intervals(S.local_maxima(beats(spark, d), "traj", "beat", "value"), "traj", "at")


@QUERIES.add(EV + _SCORED + " SELECT traj, beat, round(score, 6) + 0.0 AS score FROM sc")
def maneuver_scores(spark, d):
    return _scores(spark, d).select("traj", "beat", r("score").alias("score"))


_CASES = {"zero": "score = 0", "low": "score > 0 AND score <= 1/3.0 + 1e-6", "mid": "score > 1/3.0 + 1e-6 AND score <= 2/3.0 + 1e-6", "high": "score > 2/3.0 + 1e-6 AND score < 1", "peak": "score >= 1 - 1e-6"}


@QUERIES.add(EV + _SCORED + " " + " UNION ALL ".join(f"SELECT {i} AS position, '{b}' AS bucket, count(*) AS n, round(avg(x*x), 6) + 0.0 AS mse, round(sqrt(avg(x*x)), 6) + 0.0 AS rmse FROM sc WHERE {_CASES[b]}" for i, b in enumerate(BUCKETS)))
def bucket_report(spark, d):
    errors = _scores(spark, d).withColumn("e", F.col("x") * F.col("x"))
    return Q.bucket_errors(errors, "score", "e").select("position", "bucket", "n", r("mse").alias("mse"), r("rmse").alias("rmse"))


@QUERIES.add(EV + " SELECT round(quantile_cont(abs(x), 0.75), 6) AS p75, round(quantile_cont(abs(x), 0.5), 6) AS p50 FROM ev")
def magnitude_thresholds(spark, d):
    found = R.quantile_row(beats(spark, d), F.abs("x"), {"p75": 0.75, "p50": 0.5})
    return found.select(r("p75").alias("p75"), r("p50").alias("p50"))


@QUERIES.add(EV + _MAXIMA + " SELECT traj, \"at\", round(height, 6) AS height FROM mx")
def local_maxima(spark, d):
    return S.local_maxima(beats(spark, d), "traj", "beat", "value").select("traj", "at", r("height").alias("height"))


@QUERIES.add(EV + _MAXIMA + " SELECT traj, idx, start, stop AS \"end\", stop - start AS duration FROM sp WHERE stop IS NOT NULL")
def beat_intervals(spark, d):
    return _spans(spark, d).select("traj", "idx", "start", "end", "duration")


@QUERIES.add(EV + _MAXIMA + """ SELECT sp.traj, idx, start, stop AS "end", count(*) AS n, round(avg(x), 9) + 0.0 AS mean_x, round(arg_max(x, beat) - arg_min(x, beat), 9) + 0.0 AS delta_x
  FROM sp JOIN ev ON ev.traj = sp.traj AND beat >= start AND beat < stop WHERE stop IS NOT NULL GROUP BY sp.traj, idx, start, stop""")
def interval_features(spark, d):
    joined = S.in_intervals(beats(spark, d), _spans(spark, d), "traj", "beat")
    return S.interval_features(joined, "traj", "beat", ["x"]).select("traj", "idx", "start", "end", "n", r("mean_x", 9).alias("mean_x"), r("delta_x", 9).alias("delta_x"))


@QUERIES.add(EV + _MAXIMA + """ SELECT traj, count(*) AS n, min(d) AS least, max(d) AS most, round(avg(d), 6) AS mean, round(median(d), 6) AS median,
  round(CASE WHEN count(*) > 1 THEN stddev_pop(d) END, 6) AS sd, round(16000 / avg(d), 6) AS hz_mean, round(16000 / median(d), 6) AS hz_median
  FROM (SELECT traj, stop - start AS d FROM sp WHERE stop IS NOT NULL) GROUP BY traj""")
def duration_summary(spark, d):
    out = Q.duration_summary(_spans(spark, d), "duration", 16000.0, ["traj"])
    return out.select("traj", "n", "least", "most", *[r(c).alias(c) for c in ("mean", "median", "sd", "hz_mean", "hz_median")])


@QUERIES.add(EV + _MAXIMA + """ SELECT traj, idx, round((sum(dur) OVER (PARTITION BY traj ORDER BY start ROWS UNBOUNDED PRECEDING) - dur / 2.0) * 1000.0 / 16000, 6) AS centre_ms
  FROM (SELECT traj, idx, start, stop - start AS dur FROM sp WHERE stop IS NOT NULL)""")
def centre_times(spark, d):
    return S.centre_times(_spans(spark, d), "traj", "start", "duration", 16000.0).select("traj", "idx", r("centre_ms").alias("centre_ms"))


@QUERIES.add(EV + " SELECT * FROM (SELECT traj, beat, round(x, 9) + 0.0 AS x, round(lead(x) OVER w, 9) + 0.0 AS next_x, round(lead(x) OVER w - x, 9) + 0.0 AS step_x FROM ev WINDOW w AS (PARTITION BY traj ORDER BY beat)) WHERE next_x IS NOT NULL")
def next_steps(spark, d):
    return S.next_values(beats(spark, d), "traj", "beat", ["x"]).select("traj", "beat", r("x", 9).alias("x"), r("next_x", 9).alias("next_x"), r("step_x", 9).alias("step_x"))


@QUERIES.add(EV + " SELECT traj, beat, round(coalesce((lead(x) OVER w - lag(x) OVER w) / 2, lead(x) OVER w - x, x - lag(x) OVER w), 9) + 0.0 AS gradient FROM ev WINDOW w AS (PARTITION BY traj ORDER BY beat)")
def central_difference(spark, d):
    return S.central_difference(beats(spark, d), "traj", "beat", "x").select("traj", "beat", r("gradient", 9).alias("gradient"))


_HALF, _N, _S2, _S4 = 3, 7, 28, 196
QUERIES["smoothed"] = (
    lambda spark, d: S.smoothed(beats(spark, d), "traj", "beat", "x", _HALF).where("smooth_0 is not null").select("traj", "beat", *[r(f"smooth_{k}", 5).alias(f"smooth_{k}") for k in range(3)]),
    EV + f""", m AS (SELECT traj, beat, count(*) OVER w AS n, sum(x) OVER w AS m0, sum(x*beat) OVER w AS m1, sum(x*beat*beat) OVER w AS m2 FROM ev
  WINDOW w AS (PARTITION BY traj ORDER BY beat ROWS BETWEEN {_HALF} PRECEDING AND {_HALF} FOLLOWING)),
t AS (SELECT *, m1 - beat*m0 AS t1, m2 - 2*beat*m1 + beat*beat*m0 AS t2 FROM m WHERE n = {_N}),
c AS (SELECT *, ({_N}*t2 - {_S2}*m0) / ({_N}*{_S4} - {_S2}*{_S2}) AS k FROM t)
SELECT traj, beat, round((m0 - k*{_S2}) / {_N}, 5) + 0.0 AS smooth_0, round(t1 / {_S2}, 5) + 0.0 AS smooth_1, round(2*k, 5) + 0.0 AS smooth_2 FROM c""",
)


@QUERIES.add(EV + """, c AS (SELECT traj, beat, event_type, CASE WHEN beat > 0 AND lag(event_type) OVER (PARTITION BY traj ORDER BY beat) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS f FROM ev),
g AS (SELECT *, sum(f) OVER (PARTITION BY traj ORDER BY beat) AS run FROM c)
SELECT traj, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, min(beat) AS first, max(beat) AS last, count(*) AS n FROM g GROUP BY traj, run""")
def runs(spark, d):
    return S.runs(beats(spark, d), "traj", "beat", "event_type").select("traj", F.col("run").cast("long").alias("run"), "event_type", "first", "last", "n")


_BAND = EV + """, c AS (SELECT event_type, median(x) AS m, stddev_pop(x) AS sd FROM ev GROUP BY event_type),
b AS (SELECT event_type, any_value(m) AS m, median(abs(x - m)) AS mad, any_value(sd) AS sd FROM ev JOIN c USING (event_type) GROUP BY event_type),
bd AS (SELECT event_type, m, 1.5 * CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END AS w FROM b)"""


@QUERIES.add(_BAND + " SELECT event_type, round(m, 6) + 0.0 AS centre, round(m - w, 6) + 0.0 AS low, round(m + w, 6) + 0.0 AS high FROM bd")
def robust_band(spark, d):
    return Q.robust_band(beats(spark, d), "x", 1.5, ["event_type"]).select("event_type", *[r(c).alias(c) for c in ("centre", "low", "high")])


@QUERIES.add(_BAND + " SELECT event_type, round(avg(CASE WHEN x < m - w OR x > m + w THEN 100.0 ELSE 0 END), 6) AS tail_percent, count(*) FILTER (WHERE x < m - w OR x > m + w) AS outside FROM ev JOIN bd USING (event_type) GROUP BY event_type")
def tail_share(spark, d):
    b = beats(spark, d)
    return Q.tail_share(b, Q.robust_band(b, "x", 1.5, ["event_type"]), "x", ["event_type"]).select("event_type", r("tail_percent").alias("tail_percent"), "outside")


@QUERIES.add(EV + """, o AS (SELECT *, row_number() OVER (ORDER BY x, event_id) AS i, count(*) OVER () AS n FROM ev)
SELECT CAST(floor((12 * i - 1) * 1.0 / n) AS BIGINT) AS bin, count(*) AS n, round(avg(x), 6) + 0.0 AS mean_x, round(avg(value), 6) AS mean_y, round(CASE WHEN count(*) > 1 THEN stddev_samp(value) / sqrt(count(*)) ELSE 0 END, 6) AS se
FROM o GROUP BY 1""")
def binned_trend(spark, d):
    return Q.equal_count_trend(beats(spark, d), "x", "value", "event_id").select("bin", "n", r("mean_x").alias("mean_x"), r("mean_y").alias("mean_y"), r("se").alias("se"))


@QUERIES.add(EV + """, k AS (SELECT event_type, x, beat, rank() OVER (PARTITION BY event_type ORDER BY x) + (count(*) OVER (PARTITION BY event_type, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY event_type ORDER BY beat) + (count(*) OVER (PARTITION BY event_type, beat) - 1) / 2.0 AS ry FROM ev)
SELECT event_type, count(*) AS n, round(corr(x, beat), 6) + 0.0 AS pearson, round(corr(rx, ry), 6) + 0.0 AS spearman, round(regr_slope(beat, x), 6) + 0.0 AS slope, round(regr_intercept(beat, x), 6) AS intercept FROM k GROUP BY event_type""")
def relations(spark, d):
    out = Q.relation(beats(spark, d), "x", "beat", ["event_type"])
    return out.select("event_type", "n", *[r(c).alias(c) for c in ("pearson", "spearman", "slope", "intercept")])


@QUERIES.add(EV + """, e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
c AS (SELECT least(floor((value - lo) / ((hi - lo) / 50)), 49) AS bin, count(*) AS n FROM events, e GROUP BY 1)
SELECT CAST(g.bin AS BIGINT) AS bin, coalesce(n, 0) AS n FROM range(50) AS g(bin) LEFT JOIN c ON c.bin = g.bin""")
def equal_width_histogram(spark, d):
    return Q.equal_width_histogram(table(spark, d, "events"), "value", 50)


@QUERIES.add("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
t AS (SELECT DISTINCT event_type FROM events),
c AS (SELECT least(floor((value - lo) / ((hi - lo) / 39)), 38) AS bin, event_type, count(*) AS n FROM events, e GROUP BY 1, 2)
SELECT CAST(g.bin AS BIGINT) AS bin, t.event_type, coalesce(n, 0) AS n FROM range(39) AS g(bin) CROSS JOIN t LEFT JOIN c ON c.bin = g.bin AND c.event_type = t.event_type""")
def shared_edge_histograms(spark, d):
    return Q.equal_width_histogram(table(spark, d, "events"), "value", 39, ["event_type"])


@QUERIES.add(EV + """, e AS (SELECT quantile_cont(x, 0.005) AS lo, quantile_cont(x, 0.995) AS hi FROM ev),
c AS (SELECT least(floor((x - lo) / ((hi - lo) / 40)), 39) AS bin, count(*) AS n FROM ev, e WHERE x BETWEEN lo AND hi GROUP BY 1), a AS (SELECT sum(n) AS total FROM c)
SELECT CAST(g.bin AS BIGINT) AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / (total * ((hi - lo) / 40)), 6) AS density FROM range(40) AS g(bin) CROSS JOIN e CROSS JOIN a LEFT JOIN c ON c.bin = g.bin""")
def clipped_density(spark, d):
    return Q.clipped_density(beats(spark, d), "x", 40).select("bin", "n", r("density").alias("density"))


@QUERIES.add("""WITH s AS (SELECT min(value) AS lo, max(value) AS hi, stddev_samp(value) * pow(count(value), -0.2) AS w, count(value) AS n FROM events),
g AS (SELECT i AS point, lo + (hi - lo) * i / 49 AS x, w, n FROM range(50) AS t(i), s)
SELECT point, round(any_value(x), 6) AS x, round(sum(exp(-(x - value) * (x - value) / (w * w) / 2)) / (any_value(n) * any_value(w) * 2.5066282746310002), 6) AS density FROM g, events GROUP BY point""")
def kernel_density(spark, d):
    return Q.kernel_density(table(spark, d, "events"), "value", 50).select("point", r("x").alias("x"), r("density").alias("density"))


_SPLIT = """WITH k AS (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'val' ELSE 'train' END AS role FROM (SELECT DISTINCT user_id FROM events))"""


def _roles(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    return users.withColumn("role", F.when(F.col("user_id") % 7 == 0, "val").otherwise("train"))


@QUERIES.add(_SPLIT + " SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM k WHERE role = 'val')")
def split_val(spark, d):
    return table(spark, d, "events").join(_roles(spark, d).where("role = 'val'"), "user_id", "left_semi").select("event_id", "user_id")


@QUERIES.add(_SPLIT + " SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM k WHERE role = 'val')")
def split_train(spark, d):
    return table(spark, d, "events").join(_roles(spark, d).where("role = 'val'"), "user_id", "left_anti").select("event_id", "user_id")


@QUERIES.add(_SPLIT + """, j AS (SELECT value, CAST(user_id AS DOUBLE) AS u, role FROM events JOIN k USING (user_id))
SELECT 'value' AS feature, round(abs(avg(value) FILTER (WHERE role = 'val') - avg(value) FILTER (WHERE role = 'train')) / greatest(stddev_pop(value) FILTER (WHERE role = 'train'), 1e-8), 6) AS shift FROM j
UNION ALL SELECT 'u', round(abs(avg(u) FILTER (WHERE role = 'val') - avg(u) FILTER (WHERE role = 'train')) / greatest(stddev_pop(u) FILTER (WHERE role = 'train'), 1e-8), 6) FROM j""")
def shift_report(spark, d):
    joined = table(spark, d, "events").join(_roles(spark, d), "user_id").withColumn("u", F.col("user_id").cast("double"))
    return Q.shift_report(joined, "role", ["value", "u"]).select("feature", r("shift").alias("shift"))


@QUERIES.add(EV + """, ks AS (SELECT event_type AS metric, x, traj % 2 AS side FROM ev), v AS (SELECT metric, x, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS b FROM ks GROUP BY metric, x),
g AS (SELECT metric, a, b, abs(sum(a) OVER w * 1.0 / sum(a) OVER p - sum(b) OVER w * 1.0 / sum(b) OVER p) AS gap FROM v WINDOW w AS (PARTITION BY metric ORDER BY x ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY metric))
SELECT metric, round(max(gap), 6) AS d, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b,
  CASE WHEN max(gap) < 0.1 THEN 'negligible' WHEN max(gap) < 0.2 THEN 'small' WHEN max(gap) < 0.35 THEN 'moderate' ELSE 'large' END AS effect FROM g GROUP BY metric""")
def two_sample_ks(spark, d):
    b = beats(spark, d).withColumnRenamed("event_type", "metric")
    tests = Q.two_sample_ks(b.where("traj % 2 = 0"), b.where("traj % 2 = 1"), "x", ["metric"])
    return tests.select("metric", r("d").alias("d"), "n_a", "n_b", Q.effect(F.col("d")).alias("effect"))


@QUERIES.add(EV + """, v AS (SELECT event_type AS metric, value, sum(CASE WHEN traj % 2 = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN traj % 2 = 1 THEN 1 ELSE 0 END) AS b FROM ev GROUP BY 1, 2),
g AS (SELECT metric, abs(sum(a) OVER w * 1.0 / sum(a) OVER p - sum(b) OVER w * 1.0 / sum(b) OVER p) AS gap FROM v WINDOW w AS (PARTITION BY metric ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY metric)),
t AS (SELECT metric, max(gap) AS d FROM g GROUP BY metric)
SELECT CASE WHEN bool_or(d >= 0.35) THEN 'INCOMPATIBLE' WHEN bool_or(d >= 0.2) THEN 'BORDERLINE' ELSE 'COMPATIBLE' END AS verdict, coalesce(string_agg(metric, ',' ORDER BY d DESC, metric DESC) FILTER (WHERE d >= 0.2), '') AS drivers FROM t""")
def comparison_verdict(spark, d):
    b = beats(spark, d).withColumnRenamed("event_type", "metric")
    return Q.verdict(Q.two_sample_ks(b.where("traj % 2 = 0"), b.where("traj % 2 = 1"), "value", ["metric"]))


@QUERIES.add("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.key'), 'none') AS field, length(props) AS size FROM events""")
def json_defaults(spark, d):
    return table(spark, d, "events").select("event_id", json_field("props", ["k", "key"], "none").alias("field"), F.length("props").cast("long").alias("size"))


@QUERIES.add("""SELECT user_id AS traj, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ORDER BY n DESC, user_id LIMIT 6""")
def longest_groups(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("traj")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "traj").limit(6)


@QUERIES.add(EV + """, v AS (SELECT *, CASE WHEN event_type = 'click' THEN NULL ELSE x END AS y FROM ev), s AS (SELECT *, min(CASE WHEN y IS NOT NULL THEN beat END) OVER w AS a, max(CASE WHEN y IS NOT NULL THEN beat END) OVER w AS b FROM v WINDOW w AS (PARTITION BY traj)),
k AS (SELECT traj, beat, count(*) OVER (PARTITION BY traj) AS n FROM s WHERE beat BETWEEN a AND b) SELECT traj, beat FROM k WHERE n >= 20""")
def trimmed_spans(spark, d):
    b = beats(spark, d).withColumn("y", F.when(F.col("event_type") != "click", F.col("x")))
    return S.valid_span(b, "traj", "beat", ["y"], "trim", 20).select("traj", "beat")


@QUERIES.add(EV + """, v AS (SELECT traj, CAST(row_number() OVER (PARTITION BY traj ORDER BY beat) - 1 AS BIGINT) AS beat, event_id FROM ev WHERE event_type <> 'click') SELECT * FROM v""")
def dropped_gaps(spark, d):
    b = beats(spark, d).withColumn("y", F.when(F.col("event_type") != "click", F.col("x")))
    return S.valid_span(b, "traj", "beat", ["y"], "drop").select("traj", "beat", "event_id")


@QUERIES.add(EV + """, a AS (SELECT traj, beat AS left_at, row_number() OVER (PARTITION BY traj ORDER BY beat) AS o FROM ev WHERE event_type = 'click'), b AS (SELECT traj, beat AS right_at, row_number() OVER (PARTITION BY traj ORDER BY beat) AS o FROM ev WHERE event_type <> 'click')
SELECT traj, CAST(o - 1 AS BIGINT) AS ordinal, CAST(floor((left_at + right_at) / 2.0) AS BIGINT) AS boundary FROM a JOIN b USING (traj, o)""")
def ordinal_pairs(spark, d):
    b = beats(spark, d)
    z = S.zip_by_ordinal(b.where("event_type = 'click'"), b.where("event_type <> 'click'"), "traj", F.col("beat"), F.col("beat"), ("left_at", "right_at"))
    return z.select("traj", "ordinal", F.floor((F.col("left_at") + F.col("right_at")) / 2).cast("long").alias("boundary"))


@QUERIES.add(EV + """, p AS (SELECT traj, beat, x, beat * 1.0 / greatest(max(beat) OVER (PARTITION BY traj), 1) AS phase FROM ev), w AS (SELECT k AS window_no, k * 0.2 AS lo, (k + 1) * 0.2 AS hi FROM range(5) AS t(k))
SELECT window_no, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS sd FROM p JOIN w ON phase BETWEEN lo - 1e-9 AND hi + 1e-9 GROUP BY window_no""")
def phase_windows(spark, d):
    w = Window.partitionBy("traj")
    phased = beats(spark, d).withColumn("phase", F.col("beat") / F.greatest(F.max("beat").over(w), F.lit(1)))
    windows = spark.range(5).select(F.col("id").alias("window_no"), (F.col("id") * 0.2).alias("lo"), ((F.col("id") + 1) * 0.2).alias("hi"))
    joined = phased.join(F.broadcast(windows), F.col("phase").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9))
    return joined.groupBy("window_no").agg(F.count(F.lit(1)).alias("n"), r(F.avg("x")).alias("mean"), r(F.stddev_pop("x")).alias("sd"))
