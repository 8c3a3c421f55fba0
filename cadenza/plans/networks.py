"""Queries of networks, their training and their storage, with weights that SQL can state: an embedding is a sequence of 64 samples, or the
body channels that a beat is predicted from."""

from __future__ import annotations

import uuid

import numpy as np
from cadenza.functions.layers import Convolution, Resize
from cadenza.functions.layers import Chain as Layers
from cadenza.functions.models import LinearEncoder, Regressor
from cadenza.operators import models as M
from cadenza.operators import training
from cadenza.plans.common import EV, Book, beats, r
from cadenza.sources import arrays, models
from cadenza.sources.tables import table
from pyspark.sql import functions as F

QUERIES = Book()

_V = "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _signals(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(F.col("embedding").cast("array<double>")).alias("x"))


def _fixed(kernel, dilation, bias):
    """A one-channel convolution of weights 1, 2, ... over 10."""
    layer = Convolution(1, 1, kernel, dilation)
    layer.parameters = {"weight": np.arange(1.0, kernel + 1).reshape(1, 1, -1) / 10, "bias": np.array([bias])}
    return layer


def _samples(df):
    return df.select("id", F.posexplode(F.col("y")[0]).alias("place", "y")).select("id", "place", r("y").alias("y"))


@QUERIES.add(_V + """, c AS (SELECT id, t, 0.25 + list_sum([(k / 10.0) * e[1 + greatest(0, least(63, t + 2 * (k - 3)))] for k in [1, 2, 3, 4, 5]]) AS y FROM v, range(64) s(t)),
p AS (SELECT j, t FROM range(12) a(j), range(64) s(t) WHERE t >= j * 64 // 12 AND t < ((j + 1) * 64 + 11) // 12)
SELECT id, CAST(j AS INT) AS place, round(avg(y), 6) + 0.0 AS y FROM c JOIN p USING (t) GROUP BY id, j""")
def encoder_front(spark, d):
    """What an encoder begins with: a dilated convolution whose ends repeat, and averages over twelve spans."""
    chain = Layers([_fixed(5, 2, 0.25), Resize("average", 12)])
    return _samples(M.passed_through(_signals(spark, d), chain, "x", "y"))


@QUERIES.add(_V + """, c AS (SELECT id, t, -0.5 + list_sum([(k / 10.0) * e[1 + greatest(0, least(127, t + k - 2)) // 2] for k in [1, 2, 3]]) AS y FROM v, range(128) s(t)),
w AS (SELECT j, greatest((j + 0.5) * 128 / 69 - 0.5, 0) AS u FROM range(69) s(j)),
b AS (SELECT j, CAST(floor(u) AS BIGINT) AS low, least(CAST(floor(u) AS BIGINT) + 1, 127) AS high, u - floor(u) AS f FROM w)
SELECT l.id, CAST(j AS INT) AS place, round(l.y * (1 - f) + h.y * f, 6) + 0.0 AS y FROM b JOIN c l ON l.t = b.low JOIN c h ON h.t = b.high AND h.id = l.id""")
def decoder_front(spark, d):
    """What a decoder begins with: samples doubled, a convolution, and linear interpolation to another length."""
    chain = Layers([Resize("nearest", 128), _fixed(3, 1, -0.5), Resize("linear", 69)])
    return _samples(M.passed_through(_signals(spark, d), chain, "x", "y"))


def _grid(rows, columns, base, scale):
    """Weights that SQL states too: ((3 i + 5 j + base) mod 11 - 5) / scale."""
    i, j = np.arange(rows)[:, None], np.arange(columns)
    return ((3 * i + 5 * j + base) % 11 - 5) / scale


_WEIGHT = "((3 * {i} + 5 * {j} + {base}) % 11 - 5) / {scale}"
_SCALED = "list_transform(list_concat(e, list_reverse(e)), lambda x: (x - 0.125) / 0.5)"


@QUERIES.add(_V + f""", x AS (SELECT id, {_SCALED} AS x FROM v),
o AS (SELECT id, j, list_sum([x[i + 1] * {_WEIGHT.format(i='i', j='j', base=1, scale='200.0')} for i in range(128)]) AS z FROM x, range(3) t(j)),
l AS (SELECT id, list(z ORDER BY j) FILTER (WHERE j < 2) AS l, max(z) FILTER (WHERE j = 2) AS d FROM o GROUP BY id),
y AS (SELECT id, k, list_sum([l[c + 1] * {_WEIGHT.format(i='c', j='k', base=2, scale='20.0')} for c in range(2)]) + k / 100.0 AS y FROM l, range(24) t(k))
SELECT l.id, round(l.l[1], 6) + 0.0 AS latent_0, round(l.l[2], 6) + 0.0 AS latent_1, CAST(greatest(round_even(exp(l.d * 0.1 + 4.2), 0), 2) AS BIGINT) AS duration,
  round((SELECT sum(y.y) FROM y WHERE y.id = l.id AND k < 4) + (SELECT sum(y.y) FROM y WHERE y.id = l.id AND k >= 12 AND k < 16), 6) + 0.0 AS left_phi
FROM l""")
def stored_composite(spark, d):
    """Latents, durations and the left wing's first channel of a chain that was stored part by part and loaded again."""
    at = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{uuid.uuid4().hex}"
    regressor = Regressor(hidden=(), weights=[_grid(128, 3, 1, 200)], biases=[np.zeros(3)], duration_mean=4.2, duration_sd=0.1)
    models.save_regressor(spark, regressor, f"{at}/regressor", {"type": "standardize", "indices": list(range(64)), "mean": [0.125] * 64, "std": [0.5] * 64})
    models.save_linear_encoder(spark, LinearEncoder(_grid(2, 24, 2, 20), np.arange(24) / 100, (6, 4)), f"{at}/decoder")
    chain = models.load_composite(spark, f"{at}/regressor", f"{at}/decoder")
    body = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("body")).withColumn("next_body", F.reverse("body"))
    made = M.composed(body, chain)
    left = F.aggregate(F.col("wings")[0], F.lit(0.0), lambda a, x: a + x)
    return made.select("id", *[r(F.col("pred_latent")[k]).alias(f"latent_{k}") for k in range(2)], F.col("pred_duration").alias("duration"), r(left).alias("left_phi"))


@QUERIES.add(EV + """, l AS (SELECT traj AS run, beat // 5 AS attempt, beat % 5 + 1 AS epoch, value AS val_loss FROM ev WHERE beat < 20),
a AS (SELECT run, attempt, min(val_loss) FILTER (WHERE epoch <= 3) AS early, min(val_loss) AS whole, max(epoch) >= 3 AND min(val_loss) FILTER (WHERE epoch <= 3) > 30 AS stuck FROM l GROUP BY run, attempt),
z AS (SELECT run, coalesce(min(attempt) FILTER (WHERE NOT stuck), max(attempt)) AS attempt FROM a GROUP BY run)
SELECT run, attempt + 1 AS attempts, stuck AS final_was_stuck, CASE WHEN stuck THEN early ELSE whole END AS best_val_loss FROM a JOIN z USING (run, attempt)""")
def restarted_runs(spark, d):
    """How many attempts each run takes if those stuck over a loss at the third pass start anew, three times at most: five events in order are
    an attempt's losses."""
    losses = beats(spark, d).where("beat < 20").select(F.col("traj").alias("run"), F.expr("beat div 5").alias("attempt"), (F.col("beat") % 5 + 1).alias("epoch"), F.col("value").alias("val_loss"))
    return training.attempts(losses, check=3, threshold=30.0, most=3)


@QUERIES.add("""SELECT o_orderpriority AS fixed_len, o_orderstatus AS latent_dim, run, best_val_loss, 'fixed_len_' || o_orderpriority || '/latent_dim_' || o_orderstatus AS folder FROM (
SELECT *, o_orderkey AS run, o_totalprice AS best_val_loss, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice, o_orderkey) AS k FROM orders) WHERE k = 1""")
def stored_winners(spark, d):
    """The run whose model is stored for each pair of swept values, and where."""
    runs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("fixed_len"), F.col("o_orderstatus").alias("latent_dim"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("best_val_loss"))
    keys = ["fixed_len", "latent_dim"]
    folder = F.concat_ws("/", *[F.concat_ws("_", F.lit(k), F.col(k)) for k in keys])
    return models.winners(runs, keys).withColumn("folder", folder)


@QUERIES.add(_V + " SELECT id, round(list_sum(e), 4) + 0.0 AS total, round(e[64], 6) + 0.0 AS last FROM v")
def array_files(spark, d):
    """Embeddings written as array files and read again, ids and vectors, without the labels that lie in the same files."""
    at = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{uuid.uuid4().hex}"
    arrays.write(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label"), at)
    back = arrays.read(spark, at, ["id", "v"])
    return back.select("id", r(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), r(F.col("v")[63]).alias("last"))


_MD5 = "md5(CAST(id AS VARCHAR))"


@QUERIES.add(_V + f""", p AS (SELECT * FROM v ORDER BY {_MD5}, id LIMIT 4000), s AS (SELECT id, CAST(t AS INT) AS sample, e[1 + t] AS sp, e[11 + t] AS st, e[21 + t] AS sy, e[31 + t] AS ap, e[41 + t] AS az, e[51 + t] AS ay FROM p, range(10) x(t))
SELECT id, CAST(w AS INT) AS wing, sample, round((sp + (1 - 2 * w) * ap) * pi() + sample / 10.0, 6) + 0.0 AS phi, round((st + (1 - 2 * w) * az) * 0.5 + sample / 10.0 + 1, 6) + 0.0 AS theta,
  round((sy + (1 - 2 * w) * ay) * pi() + sample / 10.0 + 2, 6) + 0.0 AS psi FROM s, range(2) y(w)""")
def background_cloud(spark, d):
    """Angles of both wings of 4,000 sampled beats: an embedding's first 60 numbers are six channels of ten samples."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(*[F.slice(F.col("embedding").cast("array<double>"), 1 + 10 * c, 10) for c in range(6)]).alias("beat"))
    mean = np.tile(np.arange(3)[:, None] + np.arange(10) / 10, (2, 1))
    found = M.background_cloud(v, "id", mean)
    return found.select("id", "wing", "sample", *[r(c).alias(c) for c in ("phi", "theta", "psi")])
