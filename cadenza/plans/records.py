"""Configuration, file and run records, on the relational tables."""

from __future__ import annotations

from cadenza.operators import statistics as Q
from cadenza.operators.ranks import ranked
from cadenza.plans.common import Book, r
from cadenza.sources.tables import latest, table
from pyspark.sql import functions as F

QUERIES = Book()


@QUERIES.add("SELECT doc_id, md5(text) AS fingerprint FROM documents")
def fingerprints(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("fingerprint"))


@QUERIES.add("SELECT url AS path, CAST(row_number() OVER (ORDER BY url, page_id) - 1 AS BIGINT) AS trajectory_id FROM pages")
def path_ordinals(spark, d):
    files = table(spark, d, "pages").select("url", "page_id")
    return ranked(files, "url", "page_id", "trajectory_id").select(F.col("url").alias("path"), "trajectory_id")


@QUERIES.add("SELECT max(url) AS url FROM pages")
def latest_path(spark, d):
    return latest(table(spark, d, "pages"), "url")


@QUERIES.add("SELECT o_orderpriority AS length, o_custkey AS latent, o_orderkey AS run, round(o_totalprice, 6) AS loss FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_totalprice, o_orderkey) = 1")
def best_runs(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("length"), F.col("o_custkey").alias("latent"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("loss"))
    return Q.winners(runs, ["length", "latent"], "loss", "run").select("length", "latent", "run", r("loss").alias("loss"))


@QUERIES.add("SELECT o_orderpriority AS length, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd, round(min(o_totalprice), 4) AS least, round(max(o_totalprice), 4) AS most FROM orders GROUP BY 1")
def sweep_summary(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("length")).agg(F.count(F.lit(1)).alias("n"), r(F.avg(p), 4).alias("mean"), r(F.stddev_pop(p), 4).alias("sd"), r(F.min(p), 4).alias("least"), r(F.max(p), 4).alias("most"))


@QUERIES.add("""SELECT 69 AS length, latent, seed, CAST(row_number() OVER (ORDER BY latent, seed) - 1 AS BIGINT) AS run FROM (SELECT unnest([4, 8]) AS latent), (SELECT unnest([0, 1, 2, 3, 4]) AS seed)""")
def config_grid(spark, d):
    from cadenza.plans.grid import expand

    return expand(spark, {"length": 69, "latent": [4, 8], "seed": [0, 1, 2, 3, 4]}).select("length", "latent", "seed", "run")


@QUERIES.add("SELECT round(avg(abs(o_totalprice - m)), 4) AS mae, round(avg(abs(o_totalprice - m) / greatest(o_totalprice, 1)) * 100, 4) AS mape FROM (SELECT o_totalprice, avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS m FROM orders)")
def duration_errors(spark, d):
    from pyspark.sql import Window

    p = F.col("o_totalprice")
    rows = table(spark, d, "orders").withColumn("m", F.avg(p).over(Window.partitionBy("o_orderstatus")))
    return rows.agg(r(F.avg(F.abs(p - F.col("m"))), 4).alias("mae"), r(F.avg(F.abs(p - F.col("m")) / F.greatest(p, F.lit(1.0))) * 100, 4).alias("mape"))


@QUERIES.add("""WITH g AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), h AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k FROM orders)
SELECT g.o_custkey AS trajectory_id, CAST(g.k - 1 AS BIGINT) AS position, g.o_orderkey AS a, h.o_orderkey AS b FROM g JOIN h ON g.o_custkey = h.o_custkey AND g.k = h.k""")
def aligned_rows(spark, d):
    from cadenza.operators.sequence import numbered

    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "trajectory_id")
    a = numbered(orders, "trajectory_id", ["o_orderkey"], "position").select("trajectory_id", "position", F.col("o_orderkey").alias("a"))
    b = numbered(orders, "trajectory_id", ["o_totalprice", "o_orderkey"], "position").select("trajectory_id", "position", F.col("o_orderkey").alias("b"))
    return a.join(b, ["trajectory_id", "position"])


@QUERIES.add("SELECT c_nationkey AS experiment, count(*) AS files, round(sum(c_acctbal), 4) AS total FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey + 1000, count(*), round(sum(s_acctbal), 4) FROM supplier GROUP BY 1")
def old_and_new(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("experiment"), F.col("c_acctbal").alias("x"))
    s = table(spark, d, "supplier").select((F.col("s_nationkey") + 1000).alias("experiment"), F.col("s_acctbal").alias("x"))
    return c.unionByName(s).groupBy("experiment").agg(F.count(F.lit(1)).alias("files"), r(F.sum("x"), 4).alias("total"))


def _root(values):
    """exp(ln(x) / 2) of a series by the C library, whose last bits DuckDB has and Java's functions haven't; nulls stay."""
    import math

    import pandas as pd

    return pd.Series([None if v is None or v != v else math.exp(math.log(v) / 2) for v in values], dtype="float64")


@QUERIES.add("""SELECT o_orderkey, CAST(greatest(round_even(exp(ln(o_totalprice) / 2), 0), 2) AS BIGINT) AS duration FROM orders""")
def duration_decode(spark, d):
    """Roots that lie half way between whole numbers, as far as Java's functions can tell, are looked at again: their last bit decides."""
    price = F.col("o_totalprice")
    root = F.exp(F.ln(price) / 2)
    half = F.abs(root - F.floor(root) - 0.5) < 1e-12 * (1 + root)
    again = F.pandas_udf(_root, "double")(F.when(half, price))
    return table(spark, d, "orders").select("o_orderkey", F.greatest(F.rint(F.coalesce(again, root)), F.lit(2.0)).cast("long").alias("duration"))
