"""Approximate nearest neighbours: lists of rotated vectors, whose dimensions are read only as far as a test asks for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm._io import table, written

K = 5
EVERY = 50
#: Rows that centroids are fitted on, at most about; every row is put into a list.
SAMPLE = 20_000
#: Share of the true neighbours whose lists a query probes. How many lists that takes is learned from the sample: vectors in clusters need
#: few, vectors without clusters most of them.
REACH = 0.97
#: Rows of the sample that this is learned from.
TRIALS = 512
#: Dimensions of a column block, and how far from its expectation a partial distance must be to give a candidate up.
COLUMNS, EPSILON = 16, 2.1
#: Candidates, and queries, that one group of the search holds at most.
BLOCK = 4096


def usable(vectors: DataFrame, ident: str, column: str) -> DataFrame:
    """(vec_id long, vector array<double>) of the rows that take part.

    Null ids and null, empty or zero vectors are out, and those with null or non-finite parts. If lengths differ, the most
    frequent one stays (of equally frequent ones the smallest). Rows of one id are one vector's: the query's own is told by its id.
    """
    v = F.col("vector")
    rows = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size(v) == (sizes["size"] if sizes else 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(rows: DataFrame, n: int, k: int = K, reach: float = REACH, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """(rotation, centroids in rotated space, lists to probe) from a sample bounded by SAMPLE; about sqrt(n)/2 lists, 1024 at most.

    For some rows of the sample their k nearest others in it are found by brute force; the probed lists are as many of the nearest ones as
    hold the share `reach` of these. True neighbours are nearer still, so they lie in no more lists.
    """
    share = min(1.0, SAMPLE / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 20)) < share * (1 << 20)) if share < 1 else rows
    column = picked.orderBy("vec_id").select("vector").toArrow()["vector"].combine_chunks()
    sample = column.flatten().to_numpy().reshape(len(column), -1)
    random = np.random.default_rng(seed)
    size = sample.shape[1]
    rotation = np.linalg.qr(random.normal(size=(size, size)))[0]
    x = _unit(sample) @ rotation
    lists = int(min(1024, len(x), max(1, round(n**0.5 / 2))))
    centroids = x[random.choice(len(x), lists, replace=False)]
    for _ in range(8):
        near = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    kinds = np.unique(x.round(12), axis=0)  # copies would make the search look easier than it is
    return rotation, centroids, _probes(kinds, centroids, random.permutation(len(kinds))[:TRIALS], k, reach)


def _probes(x: np.ndarray, centroids: np.ndarray, trials: np.ndarray, k: int, reach: float) -> int:
    """Lists that hold the share `reach` of the k nearest others of the rows `trials`."""
    own = np.argmax(x @ centroids.T, axis=1)
    places = []
    for i in trials:
        near = x @ x[i]
        near[i] = -np.inf
        best = np.argsort(-near, kind="stable")[: min(k, len(x) - 1)]
        order = np.empty(len(centroids), np.int64)
        order[np.argsort(-(centroids @ x[i]), kind="stable")] = np.arange(len(centroids))
        places += order[own[best]].tolist()
    return int(np.quantile(places, reach, method="higher")) + 1 if places else 1


def scan(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rotation: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k nearest of a list's vectors for each query: (query numbers, ids, cosines).

    Distances of unit vectors grow block by block of rotated dimensions. After d of D, the squared part times D/d
    estimates the whole; a candidate goes when that exceeds the k-th best distance so far by more than chance would allow,
    (1 + EPSILON / sqrt(d))**2. What is left after all blocks is measured on the original vectors.
    """
    vectors, queries = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (vectors, queries))  # cosines stay as they are
    order = np.argsort(ids, kind="stable") if len(np.unique(ids)) == len(ids) else np.lexsort((*vectors.T, ids))
    vectors, ids = vectors[order], ids[order]
    fresh = np.append(True, (ids[1:] != ids[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1))  # equal rows count once
    vectors, ids = vectors[fresh], ids[fresh]
    turned, asked = _unit(vectors) @ rotation, _unit(queries) @ rotation
    size = turned.shape[1]
    edges = [*range(0, size, COLUMNS), size]
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    numbers, found, scores = [], [], []
    for i, q in enumerate(asked):
        part = np.zeros(len(ids))
        alive = np.flatnonzero(ids != own[i])
        seeds = alive[: 8 * k]
        first = ((turned[seeds] - q) ** 2).sum(axis=1)
        safe = np.argpartition(first, k - 1)[:k] if len(seeds) > k else np.arange(len(seeds))
        best = first[safe].max() if len(seeds) >= k else np.inf
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part[alive] += ((turned[alive, a:b] - q[a:b]) ** 2).sum(axis=1)
            slack = (1 + EPSILON / b**0.5) ** 2 if b < size else 1 + 1e-9
            alive = alive[part[alive] * (size / b) <= best * slack + 1e-12]
        part[seeds[safe]] = first[safe]  # those that the bound comes from are known in full and stay
        alive = np.union1d(alive, seeds[safe])
        if len(alive) > 4 * k:
            alive = alive[part[alive] <= np.partition(part[alive], k - 1)[k - 1] * (1 + 1e-9) + 1e-12]
        exact = (vectors[alive] * queries[i]).sum(axis=1) / (lengths[alive] * np.sqrt((queries[i] * queries[i]).sum()))
        top = np.lexsort((ids[alive], -exact))[:k]
        numbers += [i] * len(top)
        found += ids[alive[top]].tolist()
        scores += exact[top].tolist()
    return numbers, found, scores


def nearest(vectors: DataFrame, ident: str = "vec_id", column: str = "embedding", every: int = EVERY, k: int = K, reach: float = REACH) -> DataFrame:
    """Each query's k nearest: query_id, rank (from 1), vec_id, score (cosine in double precision), ties to the smaller vec_id.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but the query's own. Lists are cut
    into blocks of candidates and of queries, so neither a list of most vectors nor a growing query set overloads a task.
    Null, zero and non-finite vectors take no part; of vectors of several lengths those of the most frequent one do. Equal rows of one
    id count once; other columns don't matter; an empty table gives no row. A query whose lists hold fewer than k others probes more of them.
    """
    spark = vectors.sparkSession
    result = "query_id long, vec_id long, score double"
    rows = written(usable(vectors, ident, column))
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rotation, centroids, probes = fit(rows, n, k, reach)
    shared = spark.sparkContext.broadcast((rotation, centroids))
    lists = len(centroids)

    def put(batches):
        rotation, centroids = shared.value
        for frame in batches:
            x = _unit(np.stack(frame["vector"].to_numpy()).astype(float)) @ rotation if len(frame) else np.zeros((0, len(rotation)))
            yield frame.assign(list=np.argmax(x @ centroids.T, axis=1).astype(np.int32))

    def ask(batches):
        rotation, centroids = shared.value
        for frame in batches:
            x = _unit(np.stack(frame["vector"].to_numpy()).astype(float)) @ rotation if len(frame) else np.zeros((0, len(rotation)))
            order = np.argsort(-(x @ centroids.T), axis=1, kind="stable").astype(np.int32)
            enough = (np.cumsum(held[order], axis=1) <= k).sum(axis=1) + 1  # lists until there are k others for sure
            yield frame.assign(lists=[o[: max(probes, n)].tolist() for o, n in zip(order, enough.tolist(), strict=True)])

    placed = written(rows.mapInPandas(put, "vec_id long, vector array<double>, list int"))
    counted = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids")).collect()  # a row a list
    sizes, held = {r["list"]: r["n"] for r in counted}, np.zeros(lists, np.int64)
    held[[r["list"] for r in counted]] = [r["ids"] for r in counted]
    blocks = F.create_map(*[F.lit(x) for c, size in sizes.items() for x in (c, -(-size // BLOCK))])
    queries = rows.where(F.col("vec_id") % every == 0)
    rounds = max(1, -(-(queries.count() * probes // lists) // BLOCK))
    asked = queries.mapInPandas(ask, "vec_id long, vector array<double>, lists array<int>").select(F.col("vec_id").alias("query_id"), "vector", F.explode("lists").alias("list"), F.pmod(F.xxhash64("vec_id"), F.lit(rounds)).cast("int").alias("part"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce(F.element_at(blocks, F.col("list")), F.lit(1)) - 1)))
    offered = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(blocks, F.col("list"))).cast("int")).withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(rounds)])))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, v = (np.stack(x["vector"].to_numpy()).astype(float) for x in (left, right))
        own = left["query_id"].to_numpy()
        numbers, found, scores = scan(q, own, v, right["vec_id"].to_numpy(), shared.value[0], k)
        return pd.DataFrame({"query_id": own[np.array(numbers, int)], "vec_id": found, "score": scores})

    keys = ["list", "block", "part"]
    near = asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInPandas(search, result).distinct()
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest by cosine of every vector whose vec_id is divisible by 50.

    Null, zero and non-finite vectors take no part; equal rows count once; ties go to the smaller vec_id; an empty table gives no row.
    """
    return nearest(table(spark, sf_dir, "embeddings"))
