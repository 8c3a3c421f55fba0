"""How far the sources of a language differ in the terms they use, in exact whole numbers.

A group is a (lang, source). Each group gives each of the language's V kept terms a share p in parts of SCALE, smoothed by one occurrence;
the distance of p from another share q is f = floor((p - q)^2 / q), and that of two groups the sum of f over all kept terms.

Most counts are zero, and a zero count has one share in all of a group. So a pair (g, h) begins at V * f(p0, q0), as if both had no term at
all, and an inverted index corrects it:

* each term that g has adds f(p, q0) - f(p0, q0), and each that h has f(p0, q) - f(p0, q0). These depend on the term's share alone, so terms
  of one share are one row of a histogram;
* each term that both have adds f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0). Postings of a term meet in blocks of BLOCK groups, and a task
  returns sums of pairs, not terms.

Terms that a group uses more than its language are ranked by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm import _text as T
from cadenza.llm._io import drop, table, written

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
TERMS = 200
BLOCK = 256  # groups of one posting list
SALTS = 16
SLICE = 4 << 20

#: Bytes of terms: ASCII letters, and all bytes of other characters.
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

_G = ["lang", "source"]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (lang, source, text) to (lang, source, term, n, docs) of each slice: occurrences, and rows that hold the term."""
    for whole in batches:
        for batch in T.slices(whole, "text", SLICE):
            data, offsets = T.buffers(batch.column(2))
            data = T.LOWER_AZ[data]
            starts, ends, first = T.words(data, offsets, LETTERS)
            if not len(starts):
                continue
            lengths = ends - starts
            at = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(lengths, out=at[1:])
            joined = np.ascontiguousarray(data[T.ranges(starts, lengths)])
            terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(joined)).dictionary_encode()
            code, v = terms.indices.to_numpy().astype(np.int64), len(terms.dictionary)
            keys = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], names=_G)
            group, which = np.unique(np.array([f"{len(k['lang'])}:{k['lang']}{k['source']}" for k in keys.to_pylist()]), return_index=True, return_inverse=True)[1:]
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            uses, n = np.unique(which[row] * v + code, return_counts=True)
            held = np.unique(row * v + code)
            found, docs = np.unique(which[held // v] * v + held % v, return_counts=True)
            assert len(found) == len(uses)  # both list the (group, term) pairs in order
            take = pa.array(group[uses // v])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), terms.dictionary.take(pa.array(uses % v)).cast(pa.string()), pa.array(n), pa.array(docs)], names=[*_G, "term", "n", "docs"])


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact for any counts; 1 where there are no terms."""
    whole = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(total + terms > 0, F.call_function("div", whole, (total + terms).cast("decimal(20,0)")) + 1).otherwise(F.lit(1)).cast("long")


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so squares fit a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with their group's columns; a group with a third of all rows is met in SALTS parts."""
    salted = groups.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, [*_G, "salt"]).drop("salt")


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (lang, one, two), posting lists of the same term: (lang, g, h, s), sums over the batch's terms of what both groups
    having the term adds. A list's entries are (i, p, p0)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = [batch.column(k) for k in (1, 2)]
        at = [c.offsets.to_numpy().astype(np.int64) for c in lists]
        at = [a - a[0] for a in at]
        values = [{x: c.flatten().field(x).to_numpy() for x in ("i", "p", "p0")} for c in lists]
        sizes = [np.diff(a) for a in at]
        lang = batch.column(0).dictionary_encode()
        code = lang.indices.to_numpy()
        low = 0
        ends = np.cumsum(sizes[0] * sizes[1])
        sums: dict[tuple[int, int, int], int] = {}
        while low < batch.num_rows:  # runs of rows of about a million pairs
            to = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (1 << 20), side="right")))
            m, k = sizes[0][low:to], sizes[1][low:to]
            left = np.repeat(T.ranges(at[0][low:to], m), np.repeat(k, m))
            right = T.ranges(np.repeat(at[1][low:to], m), np.repeat(k, m))
            row = np.repeat(np.arange(low, to), m * k)
            p, p0, q, q0 = values[0]["p"][left], values[0]["p0"][left], values[1]["p"][right], values[1]["p0"][right]
            add = (p - q) ** 2 // q - (p - q0) ** 2 // q0 - (p0 - q) ** 2 // q + (p0 - q0) ** 2 // q0
            key = np.stack([code[row], values[0]["i"][left], values[1]["i"][right]])
            keep = key[1] != key[2]
            key, add = key[:, keep], add[keep]
            by = np.lexsort(key[::-1])
            key, add = key[:, by], add[by]
            edge = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))) if len(add) else np.zeros(0, np.int64)
            for (c, g, h), s in zip(key[:, edge].T.tolist(), np.add.reduceat(add, edge).tolist() if len(edge) else [], strict=True):
                sums[c, g, h] = sums.get((c, g, h), 0) + s
            low = to
        rows = [(*k, s) for k, s in sums.items() if s]
        if rows:
            c, g, h, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(c)), pa.array(g, pa.int64()), pa.array(h, pa.int64()), pa.array(s, pa.int64())], names=["lang", "g", "h", "s"])


class Counted:
    """The written tables that both parts are made of."""

    def __init__(self, docs: DataFrame, least: int):
        plain = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in (*_G, "text")])
        counts = written(plain.mapInArrow(_counts, "lang string, source string, term string, n long, docs long").groupBy(*_G, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        term = Window.partitionBy("lang", "term")  # a row for each source at most
        kept = written(counts.withColumns({"held": F.sum("docs").over(term), "lang_n": F.sum("n").over(term)}).where(F.col("held") >= least).drop("docs", "held"))
        drop(counts)
        langs = kept.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("lang_total"))
        totals = kept.groupBy(*_G).agg(F.sum("n").alias("total"))
        every = plain.select(*_G).distinct().join(totals, _G, "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1  # a row a source
        self.groups = written(every.select(*_G, "total", "v", "lang_total", _share(F.lit(0), F.col("total"), F.col("v")).alias("p0"), place.alias("i")))
        shares = _with_groups(kept, self.groups)
        p, q = _share(F.col("n"), F.col("total"), F.col("v")), _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
        self.postings = written(shares.select(*_G, "term", "i", "p0", p.alias("p"), q.alias("q")))
        drop(kept)


def term_part(counted: Counted, most: int = TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group uses more than its language, farthest first, to rank `most`."""
    w = Window.partitionBy(*_G).orderBy(F.col("value").desc(), "item")
    over = counted.postings.where("p > q").select(*_G, F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    return over.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)  # Spark cuts to `most` before it shuffles


def pair_part(counted: Counted) -> DataFrame:
    """(lang, source, item, value, rank): every other source of a group's language, farthest first."""
    groups, postings = counted.groups, counted.postings
    side = lambda name: groups.select("lang", F.col("source").alias(f"{name}_source"), F.col("i").alias(name), F.col("p0").alias(f"{name}_p0"), "v")
    pairs = side("g").join(side("h").drop("v"), "lang").where("g != h")
    base = pairs.select("lang", "g", "h", _exact(F.col("v").cast("decimal(18,0)") * _f(F.col("g_p0"), F.col("h_p0")).cast("decimal(19,0)")).alias("s"))
    shares = written(postings.groupBy("lang", "i", "p0", "p").agg(F.count(F.lit(1)).alias("k")))
    salts = F.array(*[F.lit(k) for k in range(SALTS)])
    zero = groups.select("lang", F.col("i").alias("j"), F.col("p0").alias("q0"), F.explode(salts).alias("salt"))
    one = shares.withColumn("salt", F.pmod(F.xxhash64("p"), F.lit(SALTS)).cast("int")).join(zero, ["lang", "salt"]).where("i != j")
    times = lambda c: _exact(F.sum(F.col("k").cast("decimal(19,0)") * c.cast("decimal(19,0)")))
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    first = one.groupBy("lang", F.col("i").alias("g"), F.col("j").alias("h")).agg(times(_f(p, q0) - _f(p0, q0)).alias("s"))
    second = one.groupBy("lang", F.col("j").alias("g"), F.col("i").alias("h")).agg(times(_f(q0, p) - _f(q0, p0)).alias("s"))
    lists = written(postings.groupBy("lang", "term", F.floor(F.col("i") / BLOCK).alias("block")).agg(F.collect_list(F.struct("i", "p", "p0")).alias("list")))
    left, right = lists.select("lang", "term", F.col("list").alias("one")), lists.select("lang", "term", F.col("list").alias("two"))
    both = left.join(right, ["lang", "term"]).select("lang", "one", "two").mapInArrow(_pair_rows, "lang string, g long, h long, s long").select("lang", "g", "h", _exact(F.col("s")).alias("s"))
    sums = base.unionByName(first).unionByName(second).unionByName(both).groupBy("lang", "g", "h").agg(F.sum("s").cast("long").alias("value"))
    named = sums.join(pairs.select("lang", "g", "h", F.col("g_source").alias("source"), F.col("h_source").alias("item")), ["lang", "g", "h"])
    w = Window.partitionBy(*_G).orderBy(F.col("value").desc(), "item")
    return named.select(*_G, "item", "value", F.row_number().over(w).alias("rank"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, most: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): both parts for every (lang, source) of docs.

    Null text, lang and source count as ''. A term is a run of ASCII letters and other characters outside ASCII, A-Z lower-cased; a language
    keeps those in at least `least` of its rows, where repeated rows count each. A language without kept terms has pairs of value 0; a source
    alone in its language has none. Texts of any length are read whole; an empty table gives no rows. Other columns don't matter. Values fit
    a long while a language keeps under 10^9 terms.
    """
    counted = Counted(docs, least)
    parts = [rows.select(*_G, F.lit(name).alias("part"), "item", "value", "rank") for name, rows in (("pair", pair_part(counted)), ("term", term_part(counted, most)))]
    return parts[0].unionByName(parts[1])


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all sources of a language, and each source's 200 most particular terms: lang, source, part, item, value, rank.

    Null text, lang and source count as ''; repeated rows count each; an empty table gives no rows.
    """
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + v.v) AS HUGEINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS HUGEINT) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER w AS INTEGER) AS rank FROM every
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 200"""
