import math

import numpy as np
from cadenza.llm import neighbours as N


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            found = sorted((-(q * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum())), j) for j, v in good if j != i)
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


def got(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(found, want):
    assert found.keys() == want.keys()
    for i, rows in found.items():
        exact = dict(want[i])
        assert all(abs(exact[j] - s) < 1e-12 for j, s in rows if j in exact)
        assert rows == sorted(rows, key=lambda x: (-x[1], x[0]))
    return np.mean([len({j for j, _ in found[i]} & {j for j, _ in want[i]}) / len(want[i]) for i in want if want[i]])


def test_recall_on_table(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in e.collect()], 50, 5)
    assert recall(got(N.op3_nearest_neighbours(spark, small)), want) >= 0.9


def test_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=40) * 10.0 ** int(r.integers(-3, 3))).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[10][1]) for i in range(400)]
    e = spark.createDataFrame([(*x, "q") for x in rows], "vec_id long, embedding array<double>, list string").repartition(5)
    want = brute(rows, 10, 5)
    found = got(N.nearest(e, every=10))
    assert recall(found, want) >= 0.9
    assert [j for j, _ in found[10]] == [5000 + i for i in range(5)]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (50, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [2.0, 2.0]), (None, [1.0, 0.0]), (8, [1.0]), (9, []), (100, [1e-300, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = got(N.nearest(e))
    assert [j for j, _ in found[0]] == [100, 1, 7] and set(found) == {0, 100}
    assert N.nearest(e.where("false")).count() == 0
    assert got(N.nearest(e.where("vec_id = 0"))) == {}


def test_clusters_need_few_lists(spark):
    """Recall holds with and without clusters; the lists that are probed are learned, copies and all."""
    r = np.random.default_rng(6)
    plain = r.normal(size=(2500, 24))
    centres = r.normal(size=(40, 24)) * 6
    grouped = centres[r.integers(0, 40, 2500)] + r.normal(size=(2500, 24))
    grouped[:900] = grouped[0]
    shares = []
    for x in (plain, grouped):
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        _, centroids, probes = N.fit(N.usable(e, "vec_id", "embedding"), len(rows))
        shares.append(probes / len(centroids))
        assert recall(got(N.nearest(e)), brute(rows, 50, 5)) >= 0.9
    assert shares[1] < 0.4 < shares[0]


def test_repeated_rows(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5])], "vec_id long, embedding array<double>")
    assert [(i, j) for i, rows in got(N.nearest(e)).items() for j, _ in rows] == [(0, 1)]


def test_lists_with_few_rows_are_not_enough(spark, monkeypatch):
    """Where the nearest list holds fewer than k others, more lists are probed until there are as many."""
    fitted = N.fit
    monkeypatch.setattr(N, "fit", lambda *a, **b: (*fitted(*a, **b)[:2], 1))
    centres = np.random.default_rng(3).normal(size=(150, 24))
    rows = [(i, (centres[i // 2] + 0.01 * (i % 2)).tolist()) for i in range(300)]
    found = N.nearest(spark.createDataFrame([*rows, *rows[:20]], "vec_id long, embedding array<double>"), every=10)
    ranks = {}
    for r in found.collect():
        ranks.setdefault(r.query_id, []).append(r.rank)
    assert set(ranks) == set(range(0, 300, 10)) and all(sorted(x) == [1, 2, 3, 4, 5] for x in ranks.values())
    few = N.nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>"), every=1)
    assert few.count() == 12
