"""Sorted runs: ingest, ranks, block packing and the checks on them.

A run is a table of (key, value) without repeated keys.  Its order is a rank
column, never the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


TREE = 256  # so many cuts make one tree
RANGE = 65536  # so many dense ranks make one range


class DuplicateKey(ValueError):
    pass


def duplicate_keys(df: DataFrame, *by: str) -> DataFrame:
    """The keys that occur more than once, with their counts."""
    return df.groupBy(*by).agg(F.count("*").alias("copies")).where("copies > 1")


def ingest(df: DataFrame, key: str = "key") -> DataFrame:
    """A run of the rows; raises on a repeated key, nothing is overwritten."""
    again = duplicate_keys(df, key).limit(1).collect()
    if again:
        raise DuplicateKey(f"key {again[0][key]} occurs {again[0]['copies']} times")
    return ranked(df, key)


class UnsortedRun(ValueError):
    pass


def strict(df: DataFrame, position: str) -> DataFrame:
    """A run whose order is given: raises where a key is not above the one before it, sorts nothing.

    position: whole numbers from 0 without gaps.
    """
    rows = df.withColumn("__range", F.expr(f"{position} div {RANGE}"))
    wrong = not_increasing(rows, position, ("__range",)).select(position)
    ends = rows.groupBy("__range").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.min(position).alias(position))
    seams = ends.withColumn("before", F.lag("hi").over(Window.partitionBy(F.lit(0)).orderBy("__range"))).where("before >= lo").select(position)  # a row for each range
    found = wrong.unionByName(seams).orderBy(position).head()
    if found is not None:
        raise UnsortedRun(f"the key at {found[0]} is not above the one before it")
    return df.withColumn("rank", F.col(position).cast("long"))


def range_of(df: DataFrame, key: str, buckets: int | None = None) -> tuple[Column, list[float]]:
    """A column that numbers ranges of the key in order, of about equal sizes, and the cuts between them."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(key, [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    return cut_column(F.col(key), cuts), cuts


def cut_column(key: Column, cuts: list[float]) -> Column:
    """How many cuts are no greater than the key: a balanced tree of comparisons, whose leaves are
    counted in a short part of the cuts where there are many, so that the code stays small."""

    def tree(of: list[float], a: int, z: int) -> Column:
        if a == z:
            return F.lit(a)
        m = (a + z) // 2
        return F.when(key < F.lit(of[m]), tree(of, a, m)).otherwise(tree(of, m + 1, z))

    if len(cuts) <= TREE:
        return tree(cuts, 0, len(cuts))
    width = math.ceil(math.sqrt(len(cuts)))
    parts = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    part = tree([x[0] for x in parts[1:]], 0, len(parts) - 1)
    inside = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in parts]), part + 1)
    return part * width + F.size(F.filter(inside, lambda c: c <= key))


def ranked(df: DataFrame, key: str = "key", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``rank``, the place of the key (from 0), within each group of ``by``.

    Ranks are counted inside ranges of the key, which are sorted in parallel,
    and the sizes of the ranges before are added, so no run meets in one task.
    """
    bucket, _ = range_of(df, key)
    rows = df.withColumn("__range", bucket)
    sizes = rows.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each range, not for each key
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*by, "__range", before.alias("__start"))
    local = Window.partitionBy(*by, "__range").orderBy(key)
    rows = rows.withColumn("__local", F.row_number().over(local) - 1)
    joined = rows.join(starts, [*by, "__range"])
    return joined.withColumn("rank", (F.col("__start") + F.col("__local")).cast("long")).drop("__range", "__start", "__local", "__n")


def running_total(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before, in the order of ``order``, whole numbers from 0 without gaps."""
    rows = rows.withColumn("__range", F.expr(f"{order} div {RANGE}"))
    sums = rows.groupBy("__range").agg(F.sum(value).alias("__sum"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sums.select("__range", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__start"))
    local = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("__local", F.coalesce(F.sum(value).over(local), F.lit(0))).join(starts, "__range")
    return found.withColumn(name, (F.col("__start") + F.col("__local")).cast("long")).drop("__range", "__local", "__start")


def packed(run: DataFrame, capacity: int) -> DataFrame:
    """Adds block_rank and block_offset: full blocks and one last partial one."""
    return run.withColumn("block_rank", F.expr(f"rank div {capacity}")).withColumn("block_offset", F.expr(f"rank % {capacity}"))


def blocks(run: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each block with its records in order."""
    items = F.sort_array(F.collect_list(F.struct("key", "value")))  # a block holds at most its capacity
    return run.groupBy(*by, "block_rank").agg(items.alias("items"))


def flattened(packed_blocks: DataFrame) -> DataFrame:
    return packed_blocks.select("*", F.posexplode("items").alias("block_offset", "__item")).select(
        *[c for c in packed_blocks.columns if c != "items"], "block_offset", F.col("__item.key").alias("key"), F.col("__item.value").alias("value")
    )


def block_intervals(run: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Least and greatest key, ranks and size of each block."""
    return run.groupBy(*by, "block_rank").agg(
        F.min("key").alias("key_lo"), F.max("key").alias("key_hi"), F.min("rank").alias("item_start"), (F.max("rank") + 1).alias("item_end"), F.count("*").alias("size")
    )


def placed(intervals: DataFrame, base: int = 0) -> DataFrame:
    """Gives each block the next free slot, in block order."""
    return intervals.withColumn("slot_id", (F.lit(base) + F.col("block_rank")).cast("long"))


def not_increasing(run: DataFrame, position: str = "rank", by: tuple[str, ...] = ("block_rank",)) -> DataFrame:
    """Records whose key is not above the one before them in their block."""
    last = F.lag("key").over(Window.partitionBy(*by).orderBy(position))
    return run.withColumn("previous_key", last).where("previous_key >= key")


def overlapping(intervals: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Blocks whose greatest key is not below the least key of the next block."""
    after = F.lead("key_lo").over(Window.partitionBy(*by).orderBy("block_rank"))
    return intervals.withColumn("next_lo", after).where("next_lo <= key_hi")


def misfilled(intervals: DataFrame, capacity: int, by: tuple[str, ...]) -> DataFrame:
    """Blocks before the last that are not full, and last blocks of no or too many records."""
    last = intervals.groupBy(*by).agg(F.max("block_rank").alias("last_rank"))
    joined = intervals.join(last, list(by)) if by else intervals.join(F.broadcast(last))  # one row where there are no groups
    return joined.where(f"(block_rank < last_rank AND size <> {capacity}) OR size NOT BETWEEN 1 AND {capacity}")


def mapping_violations(mapping: DataFrame) -> DataFrame:
    """Blocks and slots that stand in the mapping more than once."""
    one = mapping.groupBy(F.col("block_id").alias("id")).count().where("count > 1").select(F.lit("block").alias("kind"), "id", "count")
    two = mapping.groupBy(F.col("slot_id").alias("id")).count().where("count > 1").select(F.lit("slot").alias("kind"), "id", "count")
    return one.unionByName(two)


def repeated_blocks(blocks: DataFrame, by: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """Block ids that stand in levels more than once."""
    return blocks.groupBy(*by).agg(F.count("*").alias("count")).where("count > 1")


def unstored_blocks(blocks: DataFrame, mapping: DataFrame, stored: DataFrame) -> DataFrame:
    """block_id, slot_id, fault of blocks without a slot, with an empty slot, or whose slot holds another block.

    blocks: block_id.  mapping: block_id, slot_id.  stored: slot_id, stored_id, a row for each slot in use.
    """
    found = blocks.select("block_id").join(mapping, "block_id", "left").join(stored, "slot_id", "left")
    fault = F.when(F.col("slot_id").isNull(), "unmapped").when(F.col("stored_id").isNull(), "empty").when(F.col("stored_id") != F.col("block_id"), "other block")
    return found.select("block_id", "slot_id", fault.alias("fault")).where("fault IS NOT NULL")


def canonical_violations(run: DataFrame, capacity: int) -> DataFrame:
    """check, count of what makes a packed run no input of a merge: order inside and across blocks, gaps, fullness, blocks of another capacity.

    Every check is of the records at hand: none reads a slot.
    """
    last = F.lag("key").over(Window.partitionBy("__range").orderBy("rank"))
    rows = run.withColumn("__range", F.expr(f"rank div {RANGE}"))
    inside = rows.withColumn("__last", last).where("__last >= key").agg(F.count("*").alias("n"))
    ends = rows.groupBy("__range").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("rank").alias("first"), F.max("rank").alias("end"), F.count("*").alias("n"), F.count_distinct("rank").alias("d"))
    across = ends.withColumn("before", F.lag("hi").over(Window.partitionBy(F.lit(0)).orderBy("__range"))).where("before >= lo").agg(F.count("*").alias("n"))  # a row for each range
    gaps = ends.where(f"first <> __range * {RANGE} OR end - first + 1 <> n OR d <> n").agg(F.count("*").alias("n"))
    placed_wrong = rows.where(f"block_rank <> rank div {capacity} OR block_offset <> rank % {capacity}").agg(F.count("*").alias("n"))
    wrong = misfilled(block_intervals(run), capacity, ()).agg(F.count("*").alias("n"))
    parts = [("order", inside), ("order across ranges", across), ("ranks", gaps), ("capacity", placed_wrong), ("fullness", wrong)]
    found = None
    for name, part in parts:
        one = part.select(F.lit(name).alias("check"), F.col("n").alias("count"))
        found = one if found is None else found.unionByName(one)
    return found


def insert(packed_blocks: DataFrame, records: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Records put into the blocks that they name, without moving any between blocks: (blocks, refused).

    packed_blocks: block_rank, items.  records: block_rank, key, value.  A block that would be
    over its capacity or have a key twice is left as it is, and all its new records are refused.
    """
    new = records.groupBy("block_rank").agg(F.collect_list(F.struct("key", "value")).alias("__new"))  # what a block may take is bounded by its capacity
    joined = packed_blocks.join(new, "block_rank", "full_outer")
    both = F.sort_array(F.concat(F.coalesce("items", F.expr("CAST(array() AS array<struct<key:bigint,value:string>>)")), F.coalesce("__new", F.expr("CAST(array() AS array<struct<key:bigint,value:string>>)"))))
    joined = joined.withColumn("__both", both).withColumn("__keys", F.transform("__both", lambda x: x["key"]))
    fault = F.when(F.col("items").isNull(), "no block").when(F.size("__both") > capacity, "full").when(F.size(F.array_distinct("__keys")) < F.size("__keys"), "key again")
    joined = joined.withColumn("__fault", F.when(F.col("__new").isNotNull(), fault))
    kept = joined.where("items IS NOT NULL").select("block_rank", F.when(F.col("__new").isNotNull() & F.col("__fault").isNull(), F.col("__both")).otherwise(F.col("items")).alias("items"))
    refused = joined.where("__fault IS NOT NULL").select("block_rank", F.col("__fault").alias("fault"), F.explode("__new").alias("__r")).select("block_rank", "__r.key", "__r.value", "fault")
    return kept, refused


def multiset_difference(one: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of either table that the other has fewer of, and how many fewer; empty where both are equal."""
    cols = one.columns
    both = one.select("*", F.lit(1).alias("__n")).unionByName(other.select("*", F.lit(-1).alias("__n")))
    found = both.groupBy(*cols).agg(F.sum("__n").alias("surplus"))
    return found.where("surplus <> 0")


def missing_and_unexpected(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, side ('missing' or 'unexpected'): what one of two sets lacks."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("missing").alias("side")).unionByName(b.join(a, key, "left_anti").select(key, F.lit("unexpected").alias("side")))


def rank_slice(run: DataFrame, start: int, stop: int) -> DataFrame:
    """The records of the ranks [start, stop)."""
    return run.where((F.col("rank") >= start) & (F.col("rank") < stop))


def block_records(run: DataFrame, block_rank: int) -> DataFrame:
    return run.where(F.col("block_rank") == block_rank)


def slot_owners(slots: DataFrame, mapping: DataFrame) -> DataFrame:
    """slot_id, block_id, in_use."""
    found = slots.select("slot_id").distinct().join(mapping, "slot_id", "left")
    return found.select("slot_id", "block_id", F.col("block_id").isNotNull().alias("in_use"))


def assign(mapping: DataFrame, pairs: DataFrame) -> DataFrame:
    """The mapping with more pairs (block_id, slot_id); a pair that it has already changes nothing, a conflict raises."""
    out = mapping.select("block_id", "slot_id").unionByName(pairs.select("block_id", "slot_id")).distinct()
    wrong = mapping_violations(out).head()
    if wrong is not None:
        raise ValueError(f"{wrong['kind']} {wrong['id']} would be in {wrong['count']} pairs")
    return out


def unassign(mapping: DataFrame, blocks: DataFrame) -> DataFrame:
    return mapping.join(blocks.select("block_id").distinct(), "block_id", "left_anti")


def relocate(mapping: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mapping after the moves (block_id, new_slot), and their events: read old, write new, write old."""
    moved = mapping.join(moves, "block_id", "left").select("block_id", F.coalesce("new_slot", "slot_id").alias("slot_id"))
    found = moves.join(mapping, "block_id").where("new_slot != slot_id")
    steps = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("READ").alias("operation"), F.col("slot_id").alias("slot_id")),
        F.struct(F.lit(1).alias("seq"), F.lit("WRITE").alias("operation"), F.col("new_slot").alias("slot_id")),
        F.struct(F.lit(2).alias("seq"), F.lit("WRITE").alias("operation"), F.col("slot_id").alias("slot_id")),
    )
    return moved, found.select("block_id", F.explode(steps).alias("e")).select("block_id", "e.*")
