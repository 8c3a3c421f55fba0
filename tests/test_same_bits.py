"""What is computed twice has the same bits both times, however rows come in."""

import numpy as np
import pandas as pd
import pytest
from cadenza.plans.common import beats


@pytest.fixture(scope="module")
def ways(spark, tmp_path_factory):
    """The same events, in the order of their time and the other way round: sums over a user in the order of arrival would differ."""
    r = np.random.default_rng(3)
    n = 6000
    rows = pd.DataFrame({"event_id": np.arange(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="s"), "user_id": r.integers(0, 60, n), "event_type": r.choice(["a", "b"], n), "value": np.round(r.exponential(50, n), 2)})
    out = []
    for name, part in (("there", rows), ("back", rows.iloc[::-1])):
        at = tmp_path_factory.mktemp(name)
        part.to_parquet(at / "events.parquet", coerce_timestamps="us", index=False)
        out.append(str(at))
    return rows, out


def test_centred_values_have_the_same_bits(spark, ways):
    rows, (there, back) = ways
    a, b = ({q.event_id: q.x for q in beats(spark, d).select("event_id", "x").collect()} for d in (there, back))
    assert a == b
    for _, of in rows.groupby("user_id"):
        total = 0.0
        for v in of["value"]:
            total += v
        assert [a[i] for i in of["event_id"]] == [v - total / len(of) for v in of["value"]]


def test_relations_keep_all_rows(spark, ways):
    """ranks are joined to rows by x, from another computation of it."""
    import duckdb
    from cadenza.plans import catalog

    for d in ways[1]:
        con = duckdb.connect()
        con.execute(f"create view events as select * from '{d}/events.parquet'")
        want = con.execute(catalog.ORACLE_SQL["relations"])
        columns = [c[0] for c in want.description]
        got = catalog.QUERIES["relations"](spark, d).select(columns).collect()
        assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_rows_on_a_bands_edge(spark, ways):
    """bands and the rows held against them come from several computations of x, without the beats' numbers."""
    a, b = (sorted(map(tuple, beats(spark, d).select("event_type", "x").collect())) for d in ways[1])
    assert a == b


def test_half_way_durations(spark, tmp_path):
    """roots half way between whole numbers are rounded by their last bit, which Java's and the C library's functions don't share."""
    import duckdb
    from cadenza.plans import catalog

    prices = [(n + 0.5) ** 2 for n in range(1, 3000)] + [None, 2.0, 1e15]
    pd.DataFrame({"o_orderkey": range(len(prices)), "o_totalprice": prices}).to_parquet(tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    want = con.execute(catalog.ORACLE_SQL["duration_decode"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["duration_decode"](spark, str(tmp_path)).select("o_orderkey", "duration").collect())) == sorted(want)
