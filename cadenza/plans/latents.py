"""Vector queries on `embeddings`. A prediction is the mean of a vector's nearest others."""

from __future__ import annotations

from cadenza.functions import arrays as A
from cadenza.operators import graph as G
from cadenza.operators import ranks as R
from cadenza.operators import vectors as V
from cadenza.plans.common import Book, r
from cadenza.sources.tables import kept, table
from pyspark.sql import functions as F

QUERIES = Book()
K = 8

_V = "WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_KNN = _V + f""", q AS (SELECT * FROM v WHERE id % 4 = 0), d AS (SELECT q.id AS query, v.id AS neighbour, {_D2.format(a="q.e", b="v.e")} AS d2 FROM q, v),
k AS (SELECT query, neighbour, d2, row_number() OVER (PARTITION BY query ORDER BY d2, neighbour) AS rank FROM d QUALIFY rank <= {K})"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def _floats(spark, d):
    """As they are stored: searches move half the bytes."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))


def _near(spark, d):
    v = _floats(spark, d)
    return V.exact_neighbours(v.where("id % 4 = 0"), v, K)


@QUERIES.add(_KNN + " SELECT query, CAST(rank AS INT) AS rank, neighbour, round(d2, 6) AS d2 FROM k")
def nearest_neighbours(spark, d):
    return _near(spark, d).select("query", "rank", "neighbour", r("d2").alias("d2"))


@QUERIES.add(_KNN + ", y AS (SELECT query, avg(v.e[1]) AS pred FROM k JOIN v ON v.id = neighbour GROUP BY query) SELECT query, round(pred, 6) + 0.0 AS pred FROM y")
def neighbour_regression(spark, d):
    y = _vectors(spark, d).select("id", F.col("v")[0].alias("y"))
    return V.neighbour_means(_near(spark, d), y).select("query", r("pred").alias("pred"))


@QUERIES.add(_KNN + """, n AS (SELECT query, neighbour FROM d JOIN v a ON a.id = query JOIN v b ON b.id = neighbour WHERE a.label <> b.label QUALIFY row_number() OVER (PARTITION BY query ORDER BY d2, neighbour) = 1)
SELECT query, neighbour FROM n""")
def nearest_of_other_group(spark, d):
    v = _floats(spark, d)
    return V.exact_neighbours(v.where("id % 4 = 0"), v, 1, apart="label").select("query", "neighbour")


@QUERIES.add(_KNN + """, y AS (SELECT a.e[2] AS own, b.e[2] AS other FROM k JOIN v a ON a.id = query JOIN v b ON b.id = neighbour WHERE rank = 2), z AS (SELECT var_pop(e[2]) AS va FROM v)
SELECT count(*) AS n, round(avg(pow(own - other, 2)), 6) AS noise, round(any_value(va), 6) AS variance, round(1 - 0.5 * avg(pow(own - other, 2)) / any_value(va), 6) AS ceiling FROM y, z""")
def information_ceiling(spark, d):
    y = _vectors(spark, d).select("id", F.col("v")[1].alias("y"))
    return V.ceiling(_near(spark, d).where("rank = 2"), y).select("n", *[r(c).alias(c) for c in ("noise", "variance", "ceiling")])


def _predictions(spark, d):
    """(id, p, t), written once: neighbours' vectors go to their query whole, not a row for each dimension."""
    v = _floats(spark, d)
    near = _near(spark, d).where("rank > 1").join(v.select(F.col("id").alias("neighbour"), F.col("v").alias("x")), "neighbour")
    found = near.groupBy(F.col("query").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "x"))).alias("s"))
    total = F.aggregate("s", F.transform(F.col("s")[0]["x"], lambda x: F.lit(0.0)), lambda t, e: F.zip_with(t, e["x"], lambda x, y: x + y.cast("double")))
    means = found.select("id", F.transform(total, lambda x: x / F.size("s")).alias("p"))
    return kept(means.join(v.select("id", F.col("v").cast("array<double>").alias("t")), "id"))


_PRED = _KNN + f""", u AS (SELECT query, i AS dim, avg(v.e[i]) AS m FROM k JOIN v ON v.id = neighbour, range(1, 65) t(i) WHERE rank > 1 GROUP BY 1, 2),
p AS (SELECT query AS id, list(m ORDER BY dim) AS p FROM u GROUP BY 1), pt AS (SELECT p.id, p, e AS t FROM p JOIN v USING (id))"""


@QUERIES.add(_PRED + f""", w AS (SELECT a.id, count(*) FILTER (WHERE {_D2.format(a="a.p", b="b.t")} < {_D2.format(a="a.p", b="a.t")}) AS rank FROM pt a, pt b GROUP BY a.id) SELECT id, rank FROM w""")
def retrieval_ranks(spark, d):
    return V.retrieval_ranks(_predictions(spark, d)).select("id", "rank")


@QUERIES.add(_PRED + f""", w AS (SELECT a.id, count(*) FILTER (WHERE {_D2.format(a="a.p", b="b.t")} < {_D2.format(a="a.p", b="a.t")}) AS rank, count(*) AS n FROM pt a, pt b GROUP BY a.id)
SELECT CAST(trunc(median(rank)) AS BIGINT) AS median_rank, round(avg(rank), 6) AS mean_rank, round(median(rank * 1.0 / greatest(n - 1, 1)), 6) AS median_percentile, round(avg(CASE WHEN rank < 1 THEN 1.0 ELSE 0 END), 6) AS top_1, round(avg(CASE WHEN rank < 10 THEN 1.0 ELSE 0 END), 6) AS top_10 FROM w""")
def retrieval_summary(spark, d):
    out = V.retrieval_summary(V.retrieval_ranks(_predictions(spark, d)), (1, 10))
    return out.select("median_rank", *[r(c).alias(c) for c in ("mean_rank", "median_percentile", "top_1", "top_10")])


@QUERIES.add(_PRED + """, f AS (SELECT i - 1 AS dim, p[i] AS p, t[i] AS t FROM pt, range(1, 65) r(i))
SELECT CAST(dim AS INT) AS dim, round(CASE WHEN var_pop(t) * count(*) <= 1e-12 THEN 1 ELSE 1 - sum((p - t) * (p - t)) / (var_pop(t) * count(*)) END, 6) AS r2 FROM f GROUP BY dim""")
def r2_by_dimension(spark, d):
    return V.r2_by_dimension(_predictions(spark, d), "p", "t").select("dim", r("r2").alias("r2"))


@QUERIES.add(_V + " SELECT CAST(i - 1 AS INT) AS dim, count(*) AS n, round(avg(e[i]), 6) + 0.0 AS mean, round(stddev_samp(e[i]), 6) AS sd FROM v, range(1, 65) t(i) GROUP BY i")
def dimension_stats(spark, d):
    return V.dimension_stats(_vectors(spark, d), "v").select("dim", "n", r("mean").alias("mean"), r("sd").alias("sd"))


@QUERIES.add(_V + " SELECT CAST(i - 1 AS INT) AS i, CAST(j - 1 AS INT) AS j, round(covar_samp(e[i], e[j]), 6) + 0.0 AS cov FROM v, range(1, 65) a(i), range(1, 65) b(j) GROUP BY 1, 2")
def covariance(spark, d):
    return V.covariance(_vectors(spark, d), "v").select("i", "j", r("cov").alias("cov"))


@QUERIES.add(_V + """, s AS (SELECT i, avg(e[i]) AS m, stddev_samp(e[i]) AS sd FROM v, range(1, 65) t(i) GROUP BY i)
SELECT id, round(sqrt(sum(pow((e[i] - m) / greatest(sd, 1e-12), 2))), 6) AS distance FROM v JOIN s ON true GROUP BY id""")
def diagonal_mahalanobis(spark, d):
    v = _vectors(spark, d)
    stats = V.dimension_stats(v, "v").agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "sd"))).alias("s"))
    joined = v.crossJoin(F.broadcast(stats))
    return joined.select("id", r(V.mahalanobis_diagonal(F.col("v"), F.col("s.mean"), F.col("s.sd"))).alias("distance"))


@QUERIES.add(_V + f""", c AS (SELECT i, avg(e[i]) AS m FROM v, range(1, 65) t(i) GROUP BY i), cl AS (SELECT list(m ORDER BY i) AS m FROM c), dd AS (SELECT id, {_D2.format(a="e", b="m")} AS d2 FROM v, cl),
o AS (SELECT id, d2, row_number() OVER (ORDER BY d2, id) - 1 AS pos, count(*) OVER () AS n FROM dd), q AS (SELECT DISTINCT CAST(floor(k * 0.99 / 5 * (n - 1)) AS BIGINT) AS pos FROM (SELECT any_value(n) AS n FROM o), range(6) t(k))
SELECT id, CAST(o.pos AS BIGINT) AS pos, round(d2, 6) AS d2 FROM o JOIN q ON o.pos = q.pos""")
def spread_examples(spark, d):
    v = _vectors(spark, d)
    centre = V.dimension_stats(v, "v").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("m"))
    far = v.crossJoin(F.broadcast(centre)).select("id", A.squared_distance(F.col("v"), F.col("m")).alias("d2"))
    n = far.count()
    picks = sorted({int(k * 0.99 / 5 * (n - 1)) for k in range(6)}) if n else []
    return R.ranked(far, "d2", "id").where(F.col("pos").isin(picks)).select("id", "pos", r("d2").alias("d2"))


@QUERIES.add(_V + """, m AS (SELECT label, i, avg(e[i]) AS mean, stddev_pop(e[i]) AS sd FROM v, range(1, 65) t(i) GROUP BY 1, 2) SELECT label, CAST(i - 1 AS INT) AS phase, round(mean, 6) + 0.0 AS mean, round(sd, 6) AS sd FROM m""")
def templates(spark, d):
    flat = _vectors(spark, d).select("label", F.posexplode("v").alias("phase", "x"))
    return flat.groupBy("label", "phase").agg(r(F.avg("x")).alias("mean"), r(F.stddev_pop("x")).alias("sd"))


@QUERIES.add(_V + """, m AS (SELECT i, avg(e[i]) FILTER (WHERE label < 5) AS a, avg(e[i]) FILTER (WHERE label >= 5) AS b FROM v, range(1, 65) t(i) GROUP BY i) SELECT round(sqrt(sum((a - b) * (a - b))), 6) AS distance FROM m""")
def template_distance(spark, d):
    flat = _vectors(spark, d).select("label", F.posexplode("v").alias("phase", "x"))
    means = flat.groupBy("phase").agg(F.avg(F.when(F.col("label") < 5, F.col("x"))).alias("a"), F.avg(F.when(F.col("label") >= 5, F.col("x"))).alias("b"))
    return means.agg(r(F.sqrt(F.sum(F.pow(F.col("a") - F.col("b"), 2)))).alias("distance"))


_AFF = _KNN.replace(" WHERE id % 4 = 0", "") + """, ep AS (SELECT greatest(quantile_disc(d2, 0.5), 1e-12) AS epsilon FROM k WHERE query <> neighbour),
h AS (SELECT query AS i, neighbour AS j, exp(-d2 / epsilon) / 2 AS w FROM k, ep), ed AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, w FROM h UNION ALL SELECT j, i, w FROM h) GROUP BY i, j), dg AS (SELECT i, greatest(sum(w), 1e-12) AS degree FROM ed GROUP BY i)"""


def _edges(spark, d):
    v = _floats(spark, d)
    near = kept(V.exact_neighbours(v, v, K))  # read for the bandwidth and for the edges
    return G.affinity(near, G.bandwidth(near))


@QUERIES.add(_AFF + " SELECT i, j, round(w, 6) AS w FROM ed")
def affinity(spark, d):
    return _edges(spark, d).select("i", "j", r("w").alias("w"))


@QUERIES.add(_AFF + " SELECT i, round(degree, 6) AS degree FROM dg")
def degrees(spark, d):
    return G.degrees(_edges(spark, d)).select("i", r("degree").alias("degree"))


@QUERIES.add(_AFF + " SELECT ed.i, ed.j, round(w / sqrt(a.degree * b.degree), 6) AS p FROM ed JOIN dg a ON a.i = ed.i JOIN dg b ON b.i = ed.j")
def normalized_operator(spark, d):
    return G.normalized(kept(_edges(spark, d))).select("i", "j", r("p").alias("p"))


@QUERIES.add()
def diffusion_coordinates(spark, d):
    v = _floats(spark, d)
    found, _ = G.diffusion_map(V.exact_neighbours(v, v, 20), 4, strict=False)
    return found.select("i", F.transform("coordinates", lambda x: F.round(x, 6)).alias("coordinates"))


@QUERIES.add()
def principal_components(spark, d):
    found = V.principal_components(_vectors(spark, d), "v")
    rows = [(k, float(s), float(q), float(c)) for k, (s, q, c) in enumerate(zip(found["sd"], found["ratio"], found["cumulative"], strict=True))]
    return spark.createDataFrame(rows, "component int, sd double, ratio double, cumulative double").select("component", *[r(c).alias(c) for c in ("sd", "ratio", "cumulative")])


@QUERIES.add()
def ridge_predictions(spark, d):
    v = _vectors(spark, d).select("id", F.slice("v", 1, 60).alias("x"), F.slice("v", 61, 4).alias("y"))
    return V.ridge_predict(v, "x", V.ridge(v.where("id % 5 > 0"), "x", "y", 10.0)).where("id % 5 = 0").select("id", F.transform("pred", lambda x: F.round(x, 6)).alias("pred"))
