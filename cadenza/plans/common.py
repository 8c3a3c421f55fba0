from __future__ import annotations

from collections.abc import Callable

from cadenza.sources.tables import table
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Book(dict):
    """Queries by name: (callable, SQL or None)."""

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            self[query.__name__] = (query, sql)
            return query

        return put


def r(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def beats(spark: SparkSession, d: str) -> DataFrame:
    """(traj, beat, event_id, event_type, value, x).

    A mean adds up its values in the beats' order, as DuckDB does, so that x has the same last bits each time it is computed: joins on x
    and rows that lie on an edge depend on them. By the order in which a shuffle's blocks come in, they would differ.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id", "value")
    mean = F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return table(spark, d, "events").select(F.col("user_id").alias("traj"), (F.row_number().over(w) - 1).cast("long").alias("beat"), "event_id", "event_type", "value", (F.col("value") - mean).alias("x"))


EV = """WITH ev AS (SELECT user_id AS traj, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS beat,
  event_id, event_type, value, value - avg(value) OVER (PARTITION BY user_id) AS x FROM events)"""
