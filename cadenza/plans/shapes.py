"""Shape queries: an embedding is taken as a beat of 64 samples."""

from __future__ import annotations

from math import pi

from cadenza.functions import arrays as A
from cadenza.operators import shapes as H
from cadenza.operators import statistics as Q
from cadenza.operators import vectors as V
from cadenza.plans.common import Book, r
from cadenza.sources.tables import table
from pyspark.sql import functions as F

QUERIES = Book()

_V = """WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), gm AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(e[i]) AS m FROM v, range(1, 65) t(i) GROUP BY i)),
lm AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(e[i]) AS m FROM v, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY label),
d AS (SELECT id, label, sqrt(list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance FROM v, gm)"""


def _v(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("e"))


def _with_means(spark, d):
    v = _v(spark, d)
    return v.join(H.mean_vector(v, "e", ["label"]), "label")


def _distances(spark, d):
    v = _v(spark, d)
    return v.crossJoin(F.broadcast(H.mean_vector(v, "e"))).select("id", "label", F.sqrt(A.squared_distance(F.col("e"), F.col("centre"))).alias("distance"))


@QUERIES.add(_V + f""" SELECT id, round(list_max(e[1:20]), 6) AS top_left, round(list_max(e[21:40]), 6) AS top_right, round(list_max(e[41:64]) - list_min(e[41:64]), 6) AS reach,
  round(degrees(list_max(list_transform(list_zip(e, c), lambda p: p[1] * {pi} + p[2])) - list_min(list_transform(list_zip(e, c), lambda p: p[1] * {pi} + p[2]))), 6) AS amplitude FROM v, gm""")
def beat_metrics(spark, d):
    v = _v(spark, d)
    part = lambda a, n: F.slice("e", a, n)
    rows = v.crossJoin(F.broadcast(H.mean_vector(v, "e")))
    return rows.select("id", r(F.array_max(part(1, 20))).alias("top_left"), r(F.array_max(part(21, 20))).alias("top_right"), r(A.spread(part(41, 24))).alias("reach"), r(A.amplitude_degrees(F.col("e"), F.col("centre"), pi)).alias("amplitude"))


@QUERIES.add(_V + " SELECT v.label, CAST(i - 1 AS INT) AS phase, round(avg(c[i] - e[i]), 6) + 0.0 AS mean, round(stddev_pop(c[i] - e[i]), 6) AS sd FROM v JOIN lm ON lm.label = v.label, range(1, 65) t(i) GROUP BY 1, 2")
def phase_errors(spark, d):
    return H.phase_errors(_with_means(spark, d), "centre", "e", ["label"]).select("label", "phase", r("mean").alias("mean"), r("sd").alias("sd"))


@QUERIES.add(_V + " SELECT id, CAST(i - 1 AS INT) AS sample, round(e[i], 6) + 0.0 AS x, round((i - 1) / 63.0, 6) AS phase FROM v, range(1, 65) t(i)")
def point_cloud(spark, d):
    return H.point_cloud(_v(spark, d), ["id"], "e").select("id", "sample", r("x").alias("x"), r("phase").alias("phase"))


@QUERIES.add(_V + ", k AS (SELECT id, distance, (rank() OVER (ORDER BY distance) - 1) * 100.0 / count(*) OVER () AS percentile FROM d) SELECT id, round(distance, 6) AS distance, round(percentile, 6) AS percentile FROM k WHERE id % 10 = 0")
def distance_percentiles(spark, d):
    return H.distance_percentile(_distances(spark, d), "distance", F.col("id") % 10 == 0).select("id", r("distance").alias("distance"), r("percentile").alias("percentile"))


@QUERIES.add(_V + " SELECT count(*) AS n, round(avg(distance), 6) AS mean, round(stddev_samp(distance), 6) AS sd, round(quantile_cont(distance, 0.05), 6) AS p5, round(quantile_cont(distance, 0.5), 6) AS p50, round(quantile_cont(distance, 0.95), 6) AS p95 FROM d")
def comparison_record(spark, d):
    return H.comparison_record(_distances(spark, d), "distance").select("n", *[r(c).alias(c) for c in ("mean", "sd", "p5", "p50", "p95")])


@QUERIES.add(_V + """, w AS (SELECT id, list_sum(list_transform(range(1, 65), lambda i: pow(c[i] - e[i], 2) * CASE WHEN i <= 5 OR i > 59 THEN 5.0 ELSE 1.0 END)) * 3 / 64 AS loss FROM v JOIN lm ON lm.label = v.label) SELECT id, round(loss, 6) AS loss FROM w""")
def weighted_losses(spark, d):
    return _with_means(spark, d).select("id", r(A.weighted_squares(F.col("centre"), F.col("e"), 3.0, 5.0, 5) / 64).alias("loss"))


@QUERIES.add(_V + " SELECT id, label FROM v ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 40")
def subsample(spark, d):
    return H.subsample(_v(spark, d), "id", 40).select("id", "label")


@QUERIES.add(_V + " SELECT id, label FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR)), id) <= 3")
def bucket_samples(spark, d):
    return H.sample_by_group(_v(spark, d), "label", "id", 3).select("id", "label")


@QUERIES.add(_V + """, m AS (SELECT list_sum(list_transform(list_zip(e, c), lambda p: pow(p[1] - p[2], 2))) AS s FROM v, gm), g AS (SELECT list_sum(list_transform(list_zip(e, c), lambda p: pow(p[1] - p[2], 2))) AS s FROM v JOIN lm ON lm.label = v.label)
SELECT 'mean' AS predictor, round(avg(s) / 64, 6) AS mse FROM m UNION ALL SELECT 'group mean', round(avg(s) / 64, 6) FROM g""")
def predictor_report(spark, d):
    v = _v(spark, d)
    rows = [("mean", v.crossJoin(F.broadcast(H.mean_vector(v, "e")))), ("group mean", _with_means(spark, d))]
    out = None
    for name, df in rows:
        one = df.agg(r(F.avg(A.squared_distance(F.col("e"), F.col("centre"))) / 64).alias("mse")).select(F.lit(name).alias("predictor"), "mse")
        out = one if out is None else out.unionByName(one)
    return out


@QUERIES.add(_V + " SELECT id, round(CASE WHEN id % 2 = 0 THEN e[1] ELSE list_sum(e[1:6]) / 6 END, 6) + 0.0 AS metric FROM v")
def run_metrics(spark, d):
    best = F.when(F.col("id") % 2 == 0, F.col("e")[0])
    return _v(spark, d).select("id", r(H.run_metric(best, F.slice("e", 1, 6))).alias("metric"))


_DIMS = 64


@QUERIES.add(_V + f""", x AS (SELECT i - 1 AS dim, e[i] AS x FROM v, range(1, {_DIMS + 1}) t(i)), g AS (SELECT min(x) AS lo, max(x) AS hi FROM x), c AS (SELECT least(floor((x - lo) / ((hi - lo) / 40)), 39) AS bin, dim, count(*) AS n FROM x, g GROUP BY 1, 2)
SELECT CAST(b.bin AS BIGINT) AS bin, CAST(k.dim AS INT) AS dim, coalesce(n, 0) AS n FROM range(40) b(bin) CROSS JOIN range({_DIMS}) k(dim) LEFT JOIN c ON c.bin = b.bin AND c.dim = k.dim""")
def latent_histograms(spark, d):
    flat = _v(spark, d).select(F.posexplode(F.slice("e", 1, _DIMS)).alias("dim", "x"))
    return Q.equal_width_histogram(flat, "x", 40, ["dim"])


@QUERIES.add("SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS matched, count(*) FILTER (WHERE l.doc_id IS NULL) AS only_left, count(*) FILTER (WHERE d.doc_id IS NULL) AS only_right, count(*) FILTER (WHERE l.doc_id IS NULL OR d.doc_id IS NULL) = 0 AS aligned FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id")
def row_alignment(spark, d):
    return H.same_rows(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@QUERIES.add("SELECT beat, min(side) AS sides FROM (SELECT user_id || ':' || event_type AS beat, CAST(event_id % 2 AS INT) AS side FROM events) GROUP BY 1 HAVING count(DISTINCT side) < 2")
def unpaired_beats(spark, d):
    rows = table(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("beat"), (F.col("event_id") % 2).cast("int").alias("side"))
    return H.lacking_sides(rows, "beat").select("beat", F.col("sides")[0].alias("sides"))


@QUERIES.add(_V + ", g AS (SELECT label, list(s ORDER BY i) AS s FROM (SELECT v.label, i, sqrt(avg(pow(c[i] - e[i], 2))) AS s FROM v JOIN lm ON lm.label = v.label, range(1, 4) t(i) GROUP BY 1, 2) GROUP BY label) SELECT label, printf('phi=%.2f | theta=%.2f | psi=%.2f', s[1], s[2], s[3]) AS text FROM g")
def rmse_texts(spark, d):
    flat = H.point_cloud(_with_means(spark, d).withColumn("z", F.slice(F.zip_with("centre", "e", lambda a, b: (a - b) * (a - b)), 1, 3)), ["label"], "z")
    each = flat.groupBy("label", "sample").agg(F.sqrt(F.avg("x")).alias("s")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample", "s"))), lambda t: t["s"]).alias("s"))
    return each.select("label", H.rmse_text(F.col("s"), ["phi", "theta", "psi"]).alias("text"))


@QUERIES.add()
def projections(spark, d):
    v = _v(spark, d)
    found = V.principal_components(v, "e")
    centre = H.mean_vector(v, "e").first()["centre"]
    out = v
    for k in range(3):
        out = V.projected(out, "e", centre, found["components"][k].tolist(), f"pc{k}")
    return out.select("id", *[r(f"pc{k}").alias(f"pc{k}") for k in range(3)])
