"""Ranks and exact quantiles of a whole table without one task that holds it.

Rows are dealt into cells by bounds that a bounded sketch gives. Cells are counted first, and a row's rank is its cell's offset plus its
place in the cell. A value that is so frequent that it makes up bounds of its own gets cells of its own, cut by the tie column.
"""

from __future__ import annotations

from bisect import bisect_left
from math import isqrt

from cadenza.sources.tables import kept
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a cell that a task may sort, about, and how few and how many cells there are.
CELL_ROWS = 250_000
FEWEST, MOST = 64, 1024
#: Rows that bounds of texts are taken from, about, and rows that a quantile's last step may sort on the driver.
SAMPLE = 4096

_SKETCHED = ("byte", "short", "int", "bigint", "long", "float", "double", "tinyint", "smallint", "date", "timestamp", "timestamp_ntz")


def _cells(n: int, cells: int | None) -> int:
    return cells or min(MOST, max(FEWEST, -(-n // CELL_ROWS)))


def _thinned(values: list, cells: int) -> list:
    return sorted({values[len(values) * k // cells] for k in range(1, cells)}, key=lambda x: (x != x, x)) if values else []


def _count_and_bounds(df: DataFrame, columns: list[str], cells: int | None = None) -> tuple[int, list[list]]:
    """The number of rows and, for each column, up to `cells` values that cut it into about even parts. Any bounds give right ranks.

    Numbers and times are counted and sketched in one pass; texts are sampled.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    sketched = [c for c in dict.fromkeys(columns) if kinds[c] in _SKETCHED]
    shares = [k / MOST for k in range(1, MOST)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, shares, 4 * MOST).alias(f"b{k}") for k, c in enumerate(sketched)]).first()
    n, known = row["n"], {c: list(row[f"b{k}"] or []) for k, c in enumerate(sketched)}
    if cells is None and n <= CELL_ROWS:  # one cell is small enough
        return n, [[] for _ in columns]
    for c in columns:
        if c not in known:
            picked = df.where(F.col(c).isNotNull()).select(c)
            picked = picked if n <= SAMPLE else picked.where(F.rand(7) < SAMPLE / n)
            known[c] = sorted(r[0] for r in picked.collect())
    return n, [_thinned(known[c], _cells(n, cells)) for c in columns]


def _cell(column: str, bounds: list) -> Column:
    """Twice the number of bounds below the value, and one more if it is a bound itself; nulls come first."""
    if not bounds:
        return F.lit(0)
    step = max(1, isqrt(len(bounds)))
    known, ends = F.array(*[F.lit(b) for b in bounds]), F.array(*[F.lit(b) for b in bounds[step - 1 :: step]])
    block = F.size(F.filter(ends, lambda b: b < F.col(column))) * step  # whole blocks of bounds first, then inside one
    below = block + F.size(F.filter(F.slice(known, block + 1, F.lit(step)), lambda b: b < F.col(column)))
    return F.when(F.col(column).isNull(), F.lit(-1)).otherwise(2 * below + F.coalesce((F.get(known, below) == F.col(column)).cast("int"), F.lit(0)))


def ranked(df: DataFrame, value: str, tie: str, name: str = "pos", cells: int | None = None) -> DataFrame:
    """Adds the 0-based place of each row in the order (value, tie), nulls first."""
    _, (bounds, ties) = _count_and_bounds(df.select(value, tie) if value != tie else df.select(value), [value, tie], cells)
    inner = F.when((F.col("_cell") % 2 == 1) | (F.col("_cell") < 0), _cell(tie, ties)).otherwise(0)
    dealt = df.withColumn("_cell", _cell(value, bounds)).withColumn("_part", inner)
    counts = dealt.groupBy("_cell", "_part").agg(F.count(F.lit(1)).alias("_n"))  # at most (2 * cells) ** 2 rows
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_cell", "_part")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("_cell", "_part").orderBy(value, tie)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(before), ["_cell", "_part"]).withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_cell", "_part", "_place", "_before")


def counted_below(df: DataFrame, value: str, name: str = "below", by: list[str] | None = None, same: str | None = None, cells: int | None = None) -> DataFrame:
    """Adds how many rows (of the row's group) have a smaller value, and as `same` how many have this one. Equal values are counted first, so
    a frequent one is one row. Rows without a value go."""
    by = by or []
    kinds = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_same"))
    found = running(kinds, value, {name: "_same"}, by, cells).select(*by, value, name, *([F.col("_same").alias(same)] if same else []))
    return df.join(found, [*by, value])


def mean_rank(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Adds the 1-based rank (in the row's group), ties at their mean."""
    return counted_below(df, value, "_below", by, "_ties").withColumn(name, F.col("_below") + (F.col("_ties") + 1) / 2).drop("_below", "_ties")


def running(df: DataFrame, value: str, sums: dict[str, str], by: list[str] | None = None, cells: int | None = None) -> DataFrame:
    """Adds, for each name, the sum of its column over all rows (of the row's group) of smaller value; a group's values must be distinct."""
    by = by or []
    _, (bounds,) = _count_and_bounds(df.select(value), [value], cells)
    dealt = df.withColumn("_cell", _cell(value, bounds))
    order = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*by, "_cell").agg(*[F.sum(c).alias(f"_o{i}") for i, c in enumerate(sums.values())])  # at most 2 * cells rows a group
    offsets = offsets.select(*by, "_cell", *[F.coalesce(F.sum(f"_o{i}").over(order), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    inside = Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumns({f"_s{i}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for i, c in enumerate(sums.values())}).join(offsets, [*by, "_cell"])
    return summed.withColumns({name: F.col(f"_b{i}") + F.col(f"_s{i}") for i, name in enumerate(sums)}).drop("_cell", *[f"_{x}{i}" for x in "bs" for i in range(len(sums))])


def quantiles(df: DataFrame, value: str | Column, at: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation (null without rows); nulls don't count.

    Counts by cell tell where a rank lies; only rows of that cell are looked at again, until few enough are left to sort.
    """
    rows = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).where("v is not null")
    n = rows.count()
    if n == 0:
        return [None] * len(at)
    places = sorted({i for q in at for i in (int((n - 1) * q), min(n - 1, int((n - 1) * q) + 1))})
    found = dict(zip(places, _at_ranks(rows, n, places), strict=True))

    def mixed(q: float) -> float:
        low = int((n - 1) * q)
        a, b = found[low], found[min(n - 1, low + 1)]
        return a + (b - a) * ((n - 1) * q - low)

    return [mixed(q) for q in at]


def _at_ranks(rows: DataFrame, n: int, places: list[int]) -> list[float]:
    if n <= SAMPLE:
        values = sorted((r["v"] for r in rows.collect()), key=lambda x: (x != x, x))
        return [values[p] for p in places]
    bounds = _count_and_bounds(rows, ["v"], MOST)[1][0]
    counts = sorted((r["c"], r["n"]) for r in rows.groupBy(_cell("v", bounds).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect())
    ends, total = [], 0
    for _, c in counts:
        total += c
        ends.append(total)
    out = []
    for cell in sorted({bisect_left(ends, p + 1) for p in places}):
        number, size = counts[cell]
        wanted = [p - (ends[cell] - size) for p in places if bisect_left(ends, p + 1) == cell]
        if number % 2:
            out += [float(bounds[number // 2])] * len(wanted)
            continue
        inside = rows
        if number // 2 > 0:
            inside = inside.where(F.col("v") > bounds[number // 2 - 1])
        if number // 2 < len(bounds):
            inside = inside.where(F.col("v") < bounds[number // 2])
        out += _at_ranks(inside, size, wanted)
    return out


def quantile_row(df: DataFrame, value: str | Column, at: dict[str, float]) -> DataFrame:
    """One row with a column for each named quantile."""
    found = quantiles(df, value, list(at.values()))
    return df.sparkSession.createDataFrame([tuple(found)], ", ".join(f"{k} double" for k in at))


def at_rank(df: DataFrame, value: str | Column, share: float) -> float | None:
    """The value of rank floor((n - 1) * share), 0-based: a quantile that is one of the values (0.5: the lower median)."""
    rows = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).where("v is not null")
    n = rows.count()
    return _at_ranks(rows, n, [int((n - 1) * share)])[0] if n else None


def group_quantiles(df: DataFrame, value: str | Column, by: list[str], at: dict[str, float], most: int = CELL_ROWS) -> DataFrame:
    """(by.., a column for each named share): exact quantiles of each group, with linear interpolation; nulls don't count, and a group without
    values isn't there.

    A quantile lies between two ranks. Counts by group and cell tell the cells that hold them; only rows of those are looked at again, in
    finer cells, until none holds more than `most` rows, which are then sorted cell by cell. So no buffer and no task holds a group, nor a
    value that a third of all rows share: such a value is a cell of its own, which is counted and never sorted.
    """
    keys = [f"_g{k}" for k in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")).where("_v is not null").withColumn("_path", F.lit(""))
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    low = {name: F.floor((F.col("_n") - 1) * F.lit(q)).cast("long") for name, q in at.items()}
    ranks = F.array_distinct(F.array(*[x for r in low.values() for x in (r, F.least(r + 1, F.col("_n") - 1))]))
    open_ranks = totals.select(*keys, F.lit("").alias("_path"), F.explode(ranks).alias("_rank")).withColumn("_in", F.col("_rank"))
    found = None

    def alike(a: list[str]) -> list[str]:
        return [*keys, *a]

    # null groups are groups as well, so joins go by one text that spells the group
    spelled = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows, open_ranks = rows.withColumn("_k", spelled), open_ranks.withColumn("_k", spelled)
    while True:
        n = rows.count()
        bounds = [] if n <= most else _count_and_bounds(rows.select("_v"), ["_v"], MOST)[1][0]
        dealt = rows.withColumn("_cell", _cell("_v", bounds))
        counts = dealt.groupBy("_k", "_path", "_cell").agg(F.count(F.lit(1)).alias("_c"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy("_k", "_path").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = open_ranks.join(counts.withColumn("_b", before), ["_k", "_path"]).where((F.col("_in") >= F.col("_b")) & (F.col("_in") < F.col("_b") + F.col("_c")))
        placed = placed.select(*alike(["_k", "_path", "_rank", "_cell", "_c"]), (F.col("_in") - F.col("_b")).alias("_in"))
        if bounds:
            placed = kept(placed)
            known = F.element_at(F.array(*[F.lit(float(b)) for b in bounds]), (F.floor(F.col("_cell") / 2) + 1).cast("int"))
            single = placed.where("_cell % 2 = 1").select("_k", "_rank", known.alias("_v"))
            found = single if found is None else found.unionByName(single)
            placed = placed.where("_cell % 2 = 0")
        asked = placed.select("_k", "_path", "_cell").distinct()
        inside = dealt.join(asked, ["_k", "_path", "_cell"])
        if not bounds or (placed.agg(F.max("_c").alias("m")).first()["m"] or 0) <= most:
            place = (F.row_number().over(Window.partitionBy("_k", "_path", "_cell").orderBy("_v")) - 1).cast("long")
            last = inside.withColumn("_in", place).join(placed, ["_k", "_path", "_cell", "_in"]).select("_k", "_rank", "_v")
            found = last if found is None else found.unionByName(last)
            break
        path = F.concat("_path", F.lit("/"), F.col("_cell").cast("string"))
        rows = kept(inside.select(*alike(["_k", "_v"]), path.alias("_path")))
        open_ranks = placed.select(*alike(["_k", "_rank", "_in"]), path.alias("_path"))
    values = found.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"))  # two ranks a share
    both = totals.withColumn("_k", spelled).join(values, "_k")

    def mixed(name: str) -> Column:
        a, b = F.col("_m")[low[name]], F.col("_m")[F.least(low[name] + 1, F.col("_n") - 1)]
        return (a + (b - a) * ((F.col("_n") - 1) * F.lit(at[name]) - low[name])).alias(name)

    return both.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *[mixed(name) for name in at])
