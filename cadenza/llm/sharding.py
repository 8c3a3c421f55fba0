"""Sharding by balanced label propagation: linked documents gather in shards, and every shard gets as many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm._io import table, text_key, written

SHARDS = 24
ROUNDS = 6
#: Cells that a running sum is dealt over, for each shard.
CELLS = 64


def _running(df: DataFrame, within: list[str], cell: list[str], amount: Column, order: list[str], name: str) -> DataFrame:
    """Adds the sum of `amount` over all rows before, in the order (cell, order) within each key of `within`.

    Cells are summed first, so a key with most of the rows is no single task's work: only its cells' sums are put in a row.
    """
    cells = df.groupBy(*within, *cell).agg(F.sum(amount).alias("_cell"))
    earlier = Window.partitionBy(*within).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("_before", F.coalesce(F.sum("_cell").over(earlier), F.lit(0))).drop("_cell")
    inside = Window.partitionBy(*within, *cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return summed.join(offsets, [*within, *cell]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def _lookup(values: list[int], key: Column) -> Column:
    """values[key]; there are as many values as shards."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (key + 1).cast("int"))


def propagate(members: DataFrame, shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """(key_a, key_b, shard, n): how many of each group's members each shard holds, after label propagation.

    members: the same before. Members of a group are linked with one another, so a member's neighbours vote for a shard with the
    number of members that it holds, and all members of a group there have the same votes; the state is kept by group
    and shard instead of by document. In each round every group names the shard with most of its members among those with room,
    and members elsewhere ask to move there. A shard admits as many as fit, members with most neighbours there first.
    """
    state = written(members)
    for _ in range(rounds):
        loads = dict(state.groupBy("shard").agg(F.sum("n")).collect())  # a row a shard
        free = [max(0, capacity - loads.get(s, 0)) for s in range(shards)]
        room = _lookup(free, F.col("shard"))
        group = Window.partitionBy("key_a", "key_b")
        # a group's shards are at most `shards` rows; a full shard keeps its members but is no target
        best = F.max(F.when(room > 0, F.struct("n", F.xxhash64("key_a", "shard").alias("tie"), F.col("shard")))).over(group)
        own = F.max(F.struct("n", F.xxhash64("key_a", "shard").alias("tie"), F.col("shard"))).over(group)
        votes = state.withColumns({"best": best, "own": own})
        ask = votes.where((F.col("best.shard") != F.col("shard")) & ((F.col("own.shard") != F.col("shard")) | (room > 0))).select(
            "key_a", "key_b", "shard", "n", F.col("best.shard").alias("to"), (-F.floor(F.log2(F.col("best.n")))).cast("int").alias("gain"), F.pmod("key_b", F.lit(CELLS)).cast("int").alias("cell")
        )
        asked = _running(ask, ["to"], ["gain", "cell"], F.col("n"), ["key_a", "key_b", "shard"], "before")
        admitted = F.greatest(F.lit(0), F.least(F.col("n"), _lookup(free, F.col("to")) - F.col("before")))
        moves = written(asked.withColumn("moved", admitted.cast("long")).where("moved > 0").select("key_a", "key_b", "shard", "to", "moved"))
        if moves.isEmpty():
            break
        change = moves.select("key_a", "key_b", "shard", (-F.col("moved")).alias("n")).unionByName(moves.select("key_a", "key_b", F.col("to").alias("shard"), F.col("moved").alias("n")))
        state = written(state.unionByName(change).groupBy("key_a", "key_b", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    return state


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Equal texts are linked; a null text counts as empty. Shards' numbers of rows differ by one at most. Slots run from 0
    without a gap in each shard. Groups larger than a shard spread over as few as can hold them. Repeated rows are members like others;
    only hashes and sizes of texts move, so their length doesn't matter; other columns neither; an empty table gives no row.
    """
    if not docs.columns:
        raise ValueError("no columns")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *text_key()).withColumn("shard", F.pmod(F.xxhash64("doc_id", "key_a"), F.lit(shards)).cast("int"))
    )
    spread = rows.groupBy("key_a", "key_b", "shard").agg(F.count(F.lit(1)).alias("n"))
    sizes = spread.groupBy("key_a", "key_b").agg(F.sum("n").alias("members")).where("members > 1").drop("members")
    total = rows.count()
    kept = propagate(spread.join(written(sizes), ["key_a", "key_b"]), shards, max(1, total // shards), rounds)
    # members take their group's places in the order of a rank; a group's places are at most `shards` entries
    places = kept.groupBy("key_a", "key_b").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("places"))
    salted = rows.drop("shard").withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int"))
    linked = written(salted.join(written(places), ["key_a", "key_b"], "left").withColumn("shard", F.pmod(F.xxhash64("doc_id", "key_a"), F.lit(shards)).cast("int")))
    ranked = _running(linked.where("places is not null"), ["key_a", "key_b"], ["cell"], F.lit(1), ["doc_id"], "rank")
    upto = F.aggregate("places", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("shard")), lambda a, p: F.when((a["shard"] < 0) & (F.col("rank") < a["seen"] + p["n"]), F.struct(a["seen"].alias("seen"), p["shard"].alias("shard"))).otherwise(F.struct((a["seen"] + p["n"]).alias("seen"), a["shard"].alias("shard"))))
    columns = ["doc_id", "size", "text_crc32", "key_a", "key_b", "shard", "first"]
    moved = ranked.withColumn("shard", upto["shard"]).withColumn("first", F.lit(0)).select(columns)
    single = linked.where("places is null").withColumn("first", F.lit(1)).select(columns)
    return _level(written(moved.unionByName(single)), shards, total).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _level(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """Moves what a shard has over its share of the rows to shards with room, unlinked documents first, and numbers slots."""
    loads = dict(rows.groupBy("shard").agg(F.count(F.lit(1))).collect())  # a row a shard
    load = [loads.get(s, 0) for s in range(shards)]
    quota = [total // shards] * shards
    for s in sorted(range(shards), key=lambda s: -load[s])[: total % shards]:
        quota[s] += 1
    over, under = [max(0, n - q) for n, q in zip(load, quota, strict=True)], [max(0, q - n) for n, q in zip(load, quota, strict=True)]
    begin = [sum(over[:s]) for s in range(shards)]
    room = [sum(under[:s]) for s in range(shards)]
    cells = rows.withColumns({"cell": F.pmod("key_b", F.lit(CELLS)).cast("int"), "part": F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int")})
    ranked = _running(cells, ["shard"], ["first", "cell", "part"], F.lit(1), ["key_a", "key_b", "doc_id"], "rank")
    ranked = ranked.withColumn("extra", F.when(F.col("rank") >= _lookup(quota, F.col("shard")), _lookup(begin, F.col("shard")) + F.col("rank") - _lookup(quota, F.col("shard"))))
    to = F.lit(None).cast("int")
    for s in range(shards):
        to = F.when((F.col("extra") >= room[s]) & (F.col("extra") < room[s] + under[s]), F.lit(s)).otherwise(to)
    ranked = ranked.withColumn("to", to)
    slot = F.when(F.col("to").isNull(), F.col("rank")).otherwise(_lookup(load, F.col("to")) + F.col("extra") - _lookup(room, F.col("to")))
    return ranked.withColumn("slot", slot.cast("long")).withColumn("shard", F.coalesce("to", "shard"))


def op4_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 and its place there; equal texts are linked.

    Null texts have eight bytes and the checksum of nothing; repeated rows each get a slot; an empty table gives none.
    """
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
