"""Operators on vector columns: neighbours, retrieval, projections, linear models."""

from __future__ import annotations

import numpy as np
from cadenza.functions import arrays as A
from cadenza.operators import blocks as B
from cadenza.operators import ranks as R
from cadenza.sources.tables import kept
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block of searches; a task holds two blocks.
BLOCK = 4096


def exact_neighbours(queries: DataFrame, rows: DataFrame, k: int, ident: str = "id", vector: str = "v", apart: str | None = None) -> DataFrame:
    """(query, rank, neighbour, d2) of the k nearest rows, the query itself included if it is one, ties to the smaller id.

    apart: a column; only rows with another value of it than the query's count, so `ident` leaves out the query itself and a
    group's column its whole group. As with <>, a null has no others and is no other.

    A stated query set is held against all rows in blocks (operators/blocks.py): each pair of a query block and a row block is a few matrix
    products in one task, so neither side is collected, no pair becomes a row and no vector is written for each block that it meets.
    """
    own, other = ([], []) if apart is None else ([F.col(apart).alias("qa")], [F.col(apart).alias("ra")])
    queries = queries.select(F.col(ident).cast("long").alias("query"), B.as_vector(queries, vector).alias("q"), *own)
    rows = rows.select(F.col(ident).cast("long").alias("neighbour"), B.as_vector(rows, vector).alias("r"), *other)
    if apart is not None:
        queries, rows = queries.where("qa is not null"), rows.where("ra is not null")
    kinds = B.kind_of(queries, "q"), B.kind_of(rows, "r")

    def search(batches):
        held, block, no = {}, None, None
        for b in batches:
            for at in range(b.num_rows):
                if (mine := b.column("q_no")[at].as_py()) not in held:
                    asked = B.ids(b, "q_ids", at)
                    held[mine] = B.Nearest(asked, B.vector(b, "q_q", at, len(asked), kinds[0]), B.listed(b, "q_also", at), k)
                if (this := b.column("r_no")[at].as_py()) != no:
                    found = B.ids(b, "r_ids", at)
                    block, no = B.Rows(found, B.vector(b, "r_r", at, len(found), kinds[1]), B.listed(b, "r_also", at), k), this
                held[mine].meet(block)
        for state in held.values():
            yield from state.found()

    packed = B.queries_packed(queries, "query", ["q"], "qa" if own else None, most=BLOCK), B.rows_packed(rows, "neighbour", ["r"], "ra" if own else None, most=BLOCK)
    return B.crossed(*packed, search, "query long, rank int, neighbour long, d2 double")


def neighbour_means(neighbours: DataFrame, values: DataFrame, ident: str = "id", value: str = "y") -> DataFrame:
    """(query, pred): mean of the neighbours' values."""
    return neighbours.join(values.select(F.col(ident).alias("neighbour"), F.col(value).alias("_y")), "neighbour").groupBy("query").agg(F.avg("_y").alias("pred"))


def retrieval_ranks(pairs: DataFrame, ident: str = "id", predicted: str = "p", true: str = "t") -> DataFrame:
    """(id, rank, n): how many true vectors lie strictly nearer to a prediction than its own, counted block against block."""
    rows = pairs.select(F.col(ident).cast("long").alias("id"), F.col(predicted).cast("array<double>").alias("p"), F.col(true).cast("array<double>").alias("t"))
    n = rows.count()

    def count(batches):
        import pyarrow as pa

        held, t, tt, no = {}, None, None, None
        for b in batches:
            for at in range(b.num_rows):
                if (mine := b.column("q_no")[at].as_py()) not in held:
                    asked = B.ids(b, "q_ids", at)
                    p, own = (B.vector(b, f"q_{c}", at, len(asked), "f8") for c in "pt")
                    held[mine] = asked, p, (p * p).sum(axis=1), ((p - own) ** 2).sum(axis=1), np.zeros(len(asked), np.int64)
                if (this := b.column("r_no")[at].as_py()) != no:
                    t, no = B.vector(b, "r_t", at, len(B.ids(b, "r_ids", at)), "f8"), this
                    tt = (t * t).sum(axis=1)
                _, p, pp, own, nearer = held[mine]
                for c in range(0, len(p), B.TILE):
                    q = slice(c, c + B.TILE)
                    g = p[q] @ t.T
                    g *= -2
                    g += pp[q][:, None]
                    g += tt
                    # those that rounding of the product form leaves open are settled by the differences
                    room = 1e-9 * (1 + pp[q] + tt.max())
                    nearer[q] += (g < (own[q] - room)[:, None]).sum(axis=1)
                    i, j = np.nonzero(np.abs(g - own[q][:, None]) <= room[:, None])
                    for e in range(0, len(i), B.EXACT):
                        x, y = i[e : e + B.EXACT], j[e : e + B.EXACT]
                        nearer[q] += np.bincount(x[((p[q][x] - t[y]) ** 2).sum(axis=1) < own[q][x]], minlength=len(p[q]))
        for asked, _, _, _, nearer in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(nearer)], names=["id", "rank"])

    found = B.crossed(B.queries_packed(rows, "id", ["p", "t"], most=BLOCK), B.rows_packed(rows.select("id", "t"), "id", ["t"], most=BLOCK), count, "id long, rank long")
    return found.withColumn("n", F.lit(n).cast("long"))


def retrieval_summary(ranks: DataFrame, tops: tuple[int, ...] = (1, 5, 10, 50, 100)) -> DataFrame:
    """Median (truncated) and mean rank, median percentile and the share among the first k, for every k up to the row count."""
    ranks = kept(ranks)  # what follows reads them several times
    percentile = F.col("rank") / F.greatest(F.col("n") - 1, F.lit(1))
    n = ranks.select("n").limit(1).collect()
    fits = [k for k in tops if n and k <= n[0]["n"]]
    middle = R.quantile_row(ranks, "rank", {"_m": 0.5}).select(F.col("_m").cast("long").alias("median_rank")).crossJoin(R.quantile_row(ranks, percentile, {"median_percentile": 0.5}))
    rest = ranks.agg(F.avg("rank").alias("mean_rank"), *[F.avg((F.col("rank") < k).cast("double")).alias(f"top_{k}") for k in fits])
    return middle.crossJoin(rest).select("median_rank", "mean_rank", "median_percentile", *[f"top_{k}" for k in fits])


def r2_by_dimension(df: DataFrame, predicted: str, true: str) -> DataFrame:
    """(dim, r2): 1 where the truth doesn't vary."""
    flat = df.select(F.posexplode(F.arrays_zip(F.col(predicted).alias("p"), F.col(true).alias("t"))).alias("dim", "z"))
    p, t = F.col("z.p").cast("double"), F.col("z.t").cast("double")
    sums = flat.groupBy("dim").agg(F.sum((p - t) * (p - t)).alias("res"), (F.var_pop(t) * F.count(F.lit(1))).alias("tot"))
    return sums.select("dim", F.when(F.col("tot") <= 1e-12, 1.0).otherwise(1 - F.col("res") / F.col("tot")).alias("r2"))


def channel_rmse_degrees(df: DataFrame, predicted: str, true: str, scale: list[float]) -> DataFrame:
    """(channel, rmse_deg): channels are the outer array; the scale is undone before degrees are taken."""
    flat = df.select(F.posexplode(F.arrays_zip(F.col(predicted).alias("p"), F.col(true).alias("t"))).alias("channel", "z"))
    each = flat.select("channel", F.explode(F.arrays_zip(F.col("z.p").alias("p"), F.col("z.t").alias("t"))).alias("z"))
    d = F.col("z.p").cast("double") - F.col("z.t").cast("double")
    by = F.element_at(F.array(*[F.lit(s) for s in scale]), F.col("channel") + 1)
    return each.groupBy("channel").agg(F.avg(d * d).alias("mse")).select("channel", F.degrees(F.sqrt("mse") * by).alias("rmse_deg"))


def dimension_stats(df: DataFrame, vector: str) -> DataFrame:
    """(dim, n, mean, sd): sample deviation of every dimension."""
    flat = df.select(F.posexplode(vector).alias("dim", "x"))
    x = F.col("x").cast("double")
    return flat.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, cov) with n - 1. Each task sums the products of its centred rows as one matrix, and the matrices are added up, so what is
    shuffled is a row for each entry and task. The vector's length bounds the result; fewer than two rows give none."""
    centre = [r["mean"] for r in dimension_stats(df, vector).orderBy("dim").collect()]
    size = len(centre)
    fields = "i int, j int, s double, n long"
    if not size:
        return df.sparkSession.createDataFrame([], "i int, j int, cov double")

    def moments(batches):
        import pandas as pd

        total, n = np.zeros((size, size)), 0
        for b in batches:
            if len(b):
                c = np.stack(b["v"].to_numpy()).astype(float) - centre
                total += c.T @ c
                n += len(c)
        if n:
            i, j = np.indices((size, size))
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel(), "n": n})

    rows = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    return rows.mapInPandas(moments, fields).groupBy("i", "j").agg((F.sum("s") / (F.sum("n") - 1)).alias("cov"))


def mean_and_covariance(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Both on the driver; the vector's length bounds their size."""
    mean = np.array([r["mean"] for r in dimension_stats(df, vector).orderBy("dim").collect()])
    c = np.zeros((len(mean), len(mean)))
    for r in covariance(df, vector).collect():
        c[r["i"], r["j"]] = r["cov"]
    return mean, c


def mahalanobis(df: DataFrame, vector: str, centre: np.ndarray, inverse: np.ndarray, name: str = "distance") -> DataFrame:
    """Adds the distance from `centre` under a full inverse covariance (a pseudo-inverse, where dimensions depend on each other)."""

    def run(batches):
        for b in batches:
            x = np.stack(b[vector].to_numpy()).astype(float) - centre if len(b) else np.zeros((0, len(centre)))
            yield b.assign(**{name: np.sqrt(np.maximum(np.einsum("ni,ij,nj->n", x, inverse, x), 0))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, {name} double")


def principal_components(df: DataFrame, vector: str) -> dict[str, np.ndarray]:
    """components (rows), sd, ratio, cumulative. The covariance, whose size the vector's length bounds, is solved on the driver.

    Each component's largest entry is made positive.
    """
    _, c = mean_and_covariance(df, vector)
    n = len(c)
    values, vectors = np.linalg.eigh(c)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    vectors = vectors * np.sign(vectors[np.arange(n), np.abs(vectors).argmax(axis=1)])[:, None]
    ratio = values / values.sum() if values.sum() else values
    return {"components": vectors, "sd": np.sqrt(values), "ratio": ratio, "cumulative": np.cumsum(ratio), "covariance": c}


def projected(df: DataFrame, vector: str, centre: list[float], component: list[float], name: str) -> DataFrame:
    c, m = F.array(*[F.lit(float(x)) for x in component]), F.array(*[F.lit(float(x)) for x in centre])
    return df.withColumn(name, A.dot(F.zip_with(F.col(vector).cast("array<double>"), m, lambda x, y: x - y), c))


def mahalanobis_diagonal(vector: Column, centre: Column, sd: Column) -> Column:
    return F.sqrt(A.total(F.zip_with(F.zip_with(vector, centre, lambda x, m: x - m), sd, lambda d, s: F.pow(d / F.greatest(s, F.lit(1e-12)), 2))))


def ridge(df: DataFrame, x: str, y: str, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, mean of x, mean of y): the intercept isn't penalised. Moments are summed on the executors; the system, whose size the
    vectors' lengths bound, is solved on the driver."""
    joint = df.select(F.concat(F.col(x).cast("array<double>"), F.col(y).cast("array<double>")).alias("v"), F.size(x).alias("_n"))
    size = joint.select("_n").first()["_n"]
    n = joint.count()
    mean, c = mean_and_covariance(joint, "v")
    c *= n - 1
    weights = np.linalg.solve(c[:size, :size] + alpha * np.eye(size), c[:size, size:]) if alpha > 0 else np.linalg.pinv(c[:size, :size]) @ c[:size, size:]
    return weights, mean[:size], mean[size:]


def ridge_predict(df: DataFrame, x: str, fitted: tuple[np.ndarray, np.ndarray, np.ndarray], name: str = "pred") -> DataFrame:
    weights, mx, my = fitted
    centre = F.array(*[F.lit(float(v)) for v in mx])
    d = F.zip_with(F.col(x).cast("array<double>"), centre, lambda a, b: a - b)
    return df.withColumn("_d", d).withColumn(name, F.array(*[A.dot(F.col("_d"), F.array(*[F.lit(float(w)) for w in weights[:, k]])) + F.lit(float(my[k])) for k in range(weights.shape[1])])).drop("_d")


def ceiling(neighbours: DataFrame, targets: DataFrame, ident: str = "id", value: str = "y") -> DataFrame:
    """Highest R2 that any function of the inputs may reach: 1 - mean |y - y of the nearest input|^2 / 2 over the variance."""
    t = targets.select(F.col(ident).alias("_i"), F.col(value).alias("_y"))
    near = neighbours.join(t.select(F.col("_i").alias("query"), F.col("_y").alias("own")), "query").join(t.select(F.col("_i").alias("neighbour"), F.col("_y").alias("other")), "neighbour")
    noise = near.agg(F.avg(F.pow(F.col("own") - F.col("other"), 2)).alias("noise"), F.count(F.lit(1)).alias("n"))
    return noise.crossJoin(t.agg(F.var_pop("_y").alias("variance"))).select("n", "noise", "variance", (1 - 0.5 * F.col("noise") / F.col("variance")).alias("ceiling"))


# scalers


def fit_scaler(df: DataFrame, values: list[str], kind: str) -> dict[str, tuple[float, float]]:
    """{column: (offset, scale)}: zscore (population deviation, 1 where it vanishes), sample_zscore, minmax, identity."""
    if kind in (None, "identity"):
        return {v: (0.0, 1.0) for v in values}
    if kind == "vector_norm":
        if len(values) % 3:
            raise ValueError("vector_norm takes columns in threes")
        norms = [A.vector_norm3(*[F.col(c) for c in values[i : i + 3]]) for i in range(0, len(values), 3)]
        row = df.agg(*[F.avg(n).alias(f"n{i}") for i, n in enumerate(norms)]).first()
        return {v: (0.0, row[f"n{i // 3}"] or 1e-8) for i, v in enumerate(values)}
    pair = {
        "zscore": lambda c: (F.avg(c), F.when(F.stddev_pop(c) > 1e-8, F.stddev_pop(c)).otherwise(1.0)),
        "sample_zscore": lambda c: (F.avg(c), F.stddev_samp(c)),
        "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)),
    }.get(kind)
    if pair is None:
        raise ValueError(f"no scaler {kind}")
    row = df.agg(*[x.cast("double").alias(f"{p}{i}") for i, v in enumerate(values) for p, x in zip("os", pair(F.col(v)), strict=True)]).first()
    return {v: (row[f"o{i}"], row[f"s{i}"]) for i, v in enumerate(values)}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]], inverse: bool = False) -> DataFrame:
    return df.withColumns({v: F.col(v) * s + o if inverse else (F.col(v) - o) / s for v, (o, s) in fitted.items()})


# features of beats, scaled inputs


def channel_features(df: DataFrame, beat: str, weights: list[float], equalize: bool = False, name: str = "features") -> DataFrame:
    """Adds the flattened beat (channels x samples) with each channel times the root of its weight, so that squared distances carry the
    weights. equalize: channels are first divided by their deviation over all rows and samples (at least 1e-8)."""
    scales = [w**0.5 for w in weights]
    if equalize:
        flat = df.select(F.posexplode(beat).alias("c", "_s")).select("c", F.explode("_s").alias("x"))
        sd = {r["c"]: r["sd"] for r in flat.groupBy("c").agg(F.stddev_samp(F.col("x").cast("double")).alias("sd")).collect()}  # a row a channel
        scales = [w / max(sd.get(c) or 0.0, 1e-8) for c, w in enumerate(scales)]
    factor = F.array(*[F.lit(float(x)) for x in scales])
    size = F.when(F.size(beat) == len(weights), F.col(beat)).otherwise(F.raise_error(F.lit(f"a beat hasn't {len(weights)} channels")))
    return df.withColumn(name, F.flatten(F.transform(size, lambda channel, c: F.transform(channel, lambda x: x.cast("double") * F.element_at(factor, c + 1)))))


def default_scaler(indices: list[int], core: int = 12) -> str:
    """vector_norm for exactly the core channels in order, else standardize."""
    return "vector_norm" if list(indices) == list(range(core)) else "standardize"


def fit_body_scaler(df: DataFrame, body: str, indices: list[int], kind: str | None = None) -> dict:
    """A scaler as a plain dict, from an array column: vector_norm divides threes of channels by their mean norm, standardize is a z-score."""
    kind = kind or default_scaler(indices)
    if kind == "vector_norm":
        if len(indices) % 3:
            raise ValueError("vector_norm takes channels in threes")
        threes = [indices[i : i + 3] for i in range(0, len(indices), 3)]
        row = df.agg(*[F.avg(A.vector_norm3(*[F.col(body)[c] for c in t])).alias(f"n{k}") for k, t in enumerate(threes)]).first()
        factors = [1.0] * (max(indices) + 1)
        for k, t in enumerate(threes):
            for c in t:
                factors[c] = row[f"n{k}"] or 1e-8
        return {"type": kind, "indices": list(indices), "scale_factors": factors}
    if kind != "standardize":
        raise ValueError(f"no scaler {kind}")
    row = df.agg(*[F.avg(F.col(body)[c]).alias(f"m{c}") for c in indices], *[F.stddev_pop(F.col(body)[c]).alias(f"s{c}") for c in indices]).first()
    return {"type": kind, "indices": list(indices), "mean": [row[f"m{c}"] for c in indices], "std": [s if (s := row[f"s{c}"]) > 1e-8 else 1.0 for c in indices]}


def offset_and_scale(scaler: dict) -> tuple[list[int], list[float], list[float]]:
    """(channels, offset, scale) of a stored scaler; vector_norm has no offset and, where it names no channels, takes all."""
    if scaler.get("type") == "vector_norm":
        factors = list(scaler["scale_factors"])
        indices = [int(i) for i in scaler.get("indices", range(len(factors)))]
        return indices, [0.0] * len(indices), [float(factors[i]) for i in indices]
    if scaler.get("type") == "standardize":
        return [int(i) for i in scaler["indices"]], [float(x) for x in scaler["mean"]], [float(x) for x in scaler["std"]]
    raise ValueError(f"no scaler {scaler.get('type')}")


def scaled_input(df: DataFrame, body: str, following: str, scaler: dict, with_next: bool = True, name: str = "x") -> DataFrame:
    """Adds the chosen channels, scaled, of this beat and, if asked, behind them those of the next one."""
    indices, offset, width = offset_and_scale(scaler)
    halves = [F.array(*[(F.col(c)[i] - o) / w for i, o, w in zip(indices, offset, width, strict=True)]) for c in [body, following][: 1 + with_next]]
    return df.withColumn(name, F.concat(*halves))


# predictors


def report_predictor(pairs: DataFrame, name: str, predicted: str = "p", true: str = "t") -> DataFrame:
    """(predictor, mse, mean_r2, median_percentile, top_10): errors of a prediction and how well it finds its own row."""
    pairs = kept(pairs)
    errors = F.zip_with(F.col(predicted).cast("array<double>"), F.col(true).cast("array<double>"), lambda a, b: (a - b) * (a - b))
    mse = pairs.agg(F.avg(A.total(errors) / F.size(true)).alias("mse"))
    r2 = r2_by_dimension(pairs, predicted, true).agg(F.avg("r2").alias("mean_r2"))
    found = kept(retrieval_ranks(pairs, "id", predicted, true))
    percentile = F.col("rank") / F.greatest(F.col("n") - 1, F.lit(1))
    ranks = found.agg(F.avg((F.col("rank") < 10).cast("double")).alias("top_10")).crossJoin(R.quantile_row(found, percentile, {"median_percentile": 0.5}))
    return mse.crossJoin(r2).crossJoin(ranks).select(F.lit(name).alias("predictor"), "mse", "mean_r2", "median_percentile", "top_10")


def predictor_ladder(train: DataFrame, val: DataFrame, alphas: tuple[float, ...] = (0.0, 1.0, 10.0, 100.0), ks: tuple[int, ...] = (1, 5, 10, 25, 50)) -> DataFrame:
    """What simple predictors reach on `val`: the train mean, ridge by alpha, and the mean of the k nearest train rows. Rows: id, x, y."""
    centre = [r["mean"] for r in dimension_stats(train, "y").orderBy("dim").collect()]
    out = report_predictor(val.select("id", F.array(*[F.lit(float(c)) for c in centre]).alias("p"), F.col("y").alias("t")), "mean")
    for a in alphas:
        fitted = ridge(train, "x", "y", a)
        out = out.unionByName(report_predictor(ridge_predict(val, "x", fitted, "p").select("id", "p", F.col("y").alias("t")), f"ridge {a:g}"))
    if ks:
        near = kept(exact_neighbours(val, train, max(ks), vector="x"))
        flat = near.join(train.select(F.col("id").alias("neighbour"), F.posexplode("y").alias("dim", "u")), "neighbour")
        for k in ks:
            means = flat.where(F.col("rank") <= k).groupBy("query", "dim").agg(F.avg("u").alias("m"))
            p = means.groupBy(F.col("query").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("p"))
            out = out.unionByName(report_predictor(p.join(val.select("id", F.col("y").alias("t")), "id"), f"nearest {k}"))
    return out


def achievable(rows: DataFrame, group: str = "label") -> DataFrame:
    """One row: the highest mean R2 that any function of x may reach for the vector y, from each row's nearest x of another group.

    Rows with near inputs share their conditional mean, so half their mean squared difference is noise. Rows: id, x, y and the group.
    """
    near = exact_neighbours(rows, rows, 1, vector="x", apart=group)
    y = rows.select("id", F.col("y").cast("array<double>").alias("y"))
    pairs = near.join(y.select(F.col("id").alias("query"), F.col("y").alias("_a")), "query").join(y.select(F.col("id").alias("neighbour"), F.col("y").alias("_b")), "neighbour")
    pairs = kept(pairs.select("d2", A.squared_distance(F.col("_a"), F.col("_b")).alias("_off")))
    noise = pairs.agg(F.count(F.lit(1)).alias("n"), (F.avg("_off") / 2).alias("noise")).crossJoin(R.quantile_row(pairs, F.sqrt("d2"), {"median_distance": 0.5}))
    variance = rows.select(F.posexplode("y").alias("dim", "u")).groupBy("dim").agg(F.var_pop(F.col("u").cast("double")).alias("v")).agg(F.sum("v").alias("variance"))
    size = R.quantile_row(rows, A.norm(F.col("x").cast("array<double>")), {"median_norm": 0.5})
    return noise.crossJoin(variance).crossJoin(size).withColumn("ceiling", 1 - F.col("noise") / F.greatest("variance", F.lit(1e-12)))


def compare_with_centre(rows: DataFrame, vector: str, queries: dict[str, list[float]]) -> DataFrame:
    """(name, l2, diagonal, full, percentile) of vectors against the mean of all rows: distance, Mahalanobis distances under deviations
    and under the whole covariance, and the percent of rows that lie nearer to the mean."""
    mean, c = mean_and_covariance(rows, vector)
    sd, inverse = np.maximum(np.sqrt(np.diag(c)), 1e-12), np.linalg.pinv(c)
    off = {name: np.asarray(q, float) - mean for name, q in queries.items()}
    l2 = {name: float(np.sqrt((d * d).sum())) for name, d in off.items()}
    centre = F.array(*[F.lit(float(x)) for x in mean])
    distance = F.sqrt(A.squared_distance(F.col(vector).cast("array<double>"), centre))
    nearer = rows.select(distance.alias("_d")).agg(*[(F.avg((F.col("_d") < v).cast("double")) * 100).alias(f"p{k}") for k, v in enumerate(l2.values())]).first()
    out = [(name, l2[name], float(np.sqrt(((d / sd) ** 2).sum())), float(np.sqrt(max(d @ inverse @ d, 0))), nearer[f"p{k}"]) for k, (name, d) in enumerate(off.items())]
    return rows.sparkSession.createDataFrame(out, "name string, l2 double, diagonal double, full double, percentile double")
