"""Ranks, quantiles of groups and pruned neighbours against plain versions, on lopsided rows and with cells forced."""

import numpy as np
import pytest
from cadenza.operators import pruned, ranks
from cadenza.operators import statistics as Q
from cadenza.operators import vectors as V
from pyspark.sql import functions as F

RANDOM = np.random.default_rng(2)


def lopsided(n=6000):
    """Groups of every size, one with two thirds of all rows of which half share a value; nulls, a null group, ties."""
    out = []
    for i in range(n):
        g = "hot" if i % 3 else ["a", "b", None, f"g{i % 7}"][i % 4]
        x = 5.0 if g == "hot" and i % 2 else round(float(RANDOM.normal() * (1 if g == "hot" else 100)), 2)
        out.append((i, g, None if i % 41 == 0 else x))
    return [*out, (n, "alone", 3.0), (n + 1, "empty", None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(lopsided(), "id long, g string, x double").repartition(5).cache()


AT = {"p0": 0.0, "p10": 0.1, "half": 0.5, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("most", [10**6, 400, 20])
def test_group_quantiles(spark, rows, most):
    groups = {}
    for _, g, x in map(tuple, rows.collect()):
        if x is not None:
            groups.setdefault(g, []).append(x)
    got = {r.g: r for r in ranks.group_quantiles(rows, "x", ["g"], AT, most).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert np.allclose([got[g][k] for k in AT], np.quantile(xs, list(AT.values())), atol=1e-12), g
    assert ranks.group_quantiles(rows.where("false"), "x", ["g"], AT).collect() == []


def test_ranks_in_cells(spark, rows):
    want = {i: k for k, (i, _, _) in enumerate(sorted(map(tuple, rows.collect()), key=lambda r: (r[2] is not None, r[2] or 0, r[0])))}
    for cells in (None, 3, 200):
        assert {r.id: r.pos for r in ranks.ranked(rows, "x", "id", cells=cells).collect()} == want
    values = sorted(r.x for r in rows.collect() if r.x is not None)
    for cells in (None, 5, 300):
        assert all(r.below == int(np.searchsorted(values, r.x)) for r in ranks.counted_below(rows, "x", cells=cells).collect())
    texts = rows.select(F.concat(F.lit("k"), F.col("id") % 100).alias("t"), "id")
    want = {i: k for k, (t, i) in enumerate(sorted((r.t, r.id) for r in texts.collect()))}
    assert {r.id: r.pos for r in ranks.ranked(texts, "t", "id", cells=7).collect()} == want


def test_whole_quantiles_and_ranks(rows):
    values = sorted(r.x for r in rows.collect() if r.x is not None)
    assert np.allclose(ranks.quantiles(rows, "x", [0.0, 0.3, 0.5, 1.0]), np.quantile(values, [0, 0.3, 0.5, 1]))
    assert ranks.at_rank(rows, "x", 0.5) == values[(len(values) - 1) // 2] and ranks.at_rank(rows.where("false"), "x", 0.5) is None


def test_robust_band_by_group(rows):
    got = {r.g: r for r in Q.robust_band(rows.where("x is not null"), "x", 5.0, ["g"]).collect()}
    groups = {}
    for _, g, x in map(tuple, rows.collect()):
        if x is not None:
            groups.setdefault(g, []).append(x)
    for g, xs in groups.items():
        middle = np.median(xs)
        mad = np.median(np.abs(np.array(xs) - middle))
        width = 5 * (1.4826 * mad if mad > 0 else np.std(xs))
        assert np.allclose([got[g].centre, got[g].low, got[g].high], [middle, middle - width, middle + width])
    assert set(got) == set(groups)


def test_split_takes_whole_keys(spark):
    keys = spark.range(500).select((F.col("id") % 40).alias("k"))
    got = {r.k: r.role for r in Q.split_by_key(keys, "k", 0.15, 3).collect()}
    order = [r.k for r in keys.distinct().orderBy(F.xxhash64(F.lit(3), "k"), "k").collect()]
    assert {k for k, role in got.items() if role == "val"} == set(order[:6]) and len(got) == 40


# neighbours


def clustered(n=900, clusters=30):
    centres = RANDOM.normal(size=(clusters, 6)) * 20
    v = centres[np.arange(n) % clusters] + RANDOM.normal(size=(n, 6)) * 0.3
    v[::3] = v[0]  # a third of all rows are the same
    return v


@pytest.mark.parametrize(("k", "apart"), [(4, None), (1, "id"), (5, "g"), (700, None)])
def test_pruned_neighbours_are_exact(spark, monkeypatch, k, apart):
    monkeypatch.setattr(pruned, "BLOCK", 64)
    v = clustered()
    rows = spark.createDataFrame([(i, (i * 7) % 11 if i % 50 else None, x.tolist()) for i, x in enumerate(v)], "id long, g long, v array<double>").cache()
    queries = rows.where("id % 4 = 1")
    found = pruned.nearest(queries, rows, k, apart=apart)
    got = sorted(map(tuple, found.neighbours.collect()))
    want = sorted(map(tuple, V.exact_neighbours(queries, rows, k, apart=apart).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    if k < 10:
        row = found.compared.first()
        assert 0 < row.pairs < 0.55 * row.every  # the repeated third is compared with what lies in its list


def test_few_pairs_on_clusters(spark):
    centres = RANDOM.normal(size=(40, 8)) * 50
    rows = spark.createDataFrame([(i, (centres[i % 40] + RANDOM.normal(size=8)).tolist()) for i in range(2000)], "id long, v array<double>").cache()
    found = pruned.nearest(rows, rows, 5)
    row = found.compared.first()
    assert row.pairs < 0.15 * row.every == 0.15 * 4_000_000
    assert sorted(map(tuple, found.neighbours.select("query", "rank", "neighbour").collect())) == sorted(map(tuple, V.exact_neighbours(rows, rows, 5).select("query", "rank", "neighbour").collect()))
    empty = pruned.nearest(rows, rows.where("false"), 5)
    assert empty.neighbours.count() == 0 and tuple(empty.compared.first()) == (0, 0)
    assert pruned.nearest(rows.where("false"), rows, 5).neighbours.count() == 0
