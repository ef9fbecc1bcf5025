"""Point lookups in one run or in several, and the block reads they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.runs import range_of


def single(queries: DataFrame, run: DataFrame) -> DataFrame:
    """key, found, value.  A null value is found: presence has its own flag."""
    hits = run.select("key", "value", F.lit(True).alias("hit"))
    return queries.join(hits, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("found"), "value")


def lower_bounds(queries: DataFrame, run: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """key, lower_bound: how many keys of the run are below it (in its group of ``by``).

    A key that is not between the least and the greatest key of the run needs no
    comparison.  The others and the keys of the run are dealt to the same ranges, cut
    by both; counts run inside a range and the sizes of the ranges before are added.
    A null key has no bound.
    """
    groups = list(by)
    ends = run.groupBy(*by).agg(F.min("key").alias("__lo"), F.max("key").alias("__hi"), F.count("*").alias("__n"))
    asked = queries.select(*by, "key")
    if by:
        asked = asked.join(F.broadcast(ends), groups, "left")  # a row for each group, such as a level
    else:
        lo, hi, n = ends.first()
        asked = asked.withColumns({"__lo": F.lit(lo), "__hi": F.lit(hi), "__n": F.lit(n)})
    empty, inside = F.coalesce("__n", F.lit(0)) == 0, (F.col("key") > F.col("__lo")) & (F.col("key") <= F.col("__hi"))
    beyond = F.when(F.col("key").isNull(), None).when(empty | (F.col("key") <= F.col("__lo")), 0).otherwise(F.col("__n"))
    outer = asked.where(~F.coalesce(inside, F.lit(False))).select(*by, "key", beyond.cast("long").alias("lower_bound"))
    rows = run.select(*by, "key", F.lit(1).alias("own")).unionByName(asked.where(inside).select(*by, "key", F.lit(0).alias("own")))
    bucket, _ = range_of(rows, "key")
    rows = rows.withColumn("range", bucket)
    sizes = rows.groupBy(*by, "range").agg(F.sum("own").alias("n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each range
    ahead = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    below = F.sum("own").over(Window.partitionBy(*by, "range").orderBy("key", "own").rowsBetween(Window.unboundedPreceding, 0))
    counted = rows.withColumn("below", below).where("own = 0").join(starts, [*by, "range"])
    return counted.select(*by, "key", (F.col("start") + F.col("below")).cast("long").alias("lower_bound")).unionByName(outer)


def rightmost(keys: DataFrame, starts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """key, at: which of the starts (from 0, in order) is the last one at or before the key; -1 where none is.

    starts: key.  Keys of both are whole numbers.
    """
    found = lower_bounds(keys.select(*by, (F.col("key") + 1).alias("key")), starts, by)
    return found.select(*by, (F.col("key") - 1).alias("key"), (F.col("lower_bound") - 1).alias("at"))


def newest_first(queries: DataFrame, levels: DataFrame, active: list[int]) -> DataFrame:
    """key, found, value, hit_level, searched: the first level of the caller's order that has the key.

    levels: priority, key, value.  active: the priorities of the non-empty
    levels in order.  All levels are joined at once and the least priority
    wins; a level after the hit counts as not searched.
    """
    best = levels.groupBy("key").agg(F.min(F.struct("priority", "value")).alias("best"))
    joined = queries.join(best, "key", "left")
    tried = F.when(F.col("best").isNull(), len(active)).otherwise(F.size(F.filter(F.array(*map(F.lit, active)), lambda p: p <= F.col("best.priority"))))
    return joined.select("key", F.col("best").isNotNull().alias("found"), F.col("best.value").alias("value"), F.col("best.priority").alias("hit_level"), tried.cast("long").alias("searched"))


def cover(windows: DataFrame, capacity: int) -> DataFrame:
    """Block ranks first_block..last_block of the rank window [lo, hi); nulls for an empty one."""
    some = F.col("lo") < F.col("hi")
    return windows.withColumn("first_block", F.when(some, F.expr(f"lo div {capacity}"))).withColumn("last_block", F.when(some, F.expr(f"(hi - 1) div {capacity}")))


def trace(covered: DataFrame, mapping: DataFrame) -> DataFrame:
    """key, seq, operation, slot_id: every block of the cover once, by ascending slot.

    mapping: block_rank, slot_id.  Covers are unrolled, so the join is on equal
    ranks and not on ranges.
    """
    wanted = covered.where("first_block IS NOT NULL").select("key", F.explode(F.sequence("first_block", "last_block")).alias("block_rank"))
    read = wanted.join(mapping, "block_rank")
    seq = F.row_number().over(Window.partitionBy("key").orderBy("slot_id")) - 1
    return read.select("key", seq.cast("long").alias("seq"), F.lit("READ").alias("operation"), "slot_id")


def locate(slots: DataFrame, regions: DataFrame) -> DataFrame:
    """slot_id, level, offset: the region that holds each slot.  regions: level, start, size, a row for each level, and
    levels are a logarithm of the records: that bounds the broadcast."""
    joined = slots.join(F.broadcast(regions), (F.col("slot_id") >= F.col("start")) & (F.col("slot_id") < F.col("start") + F.col("size")))
    return joined.select("slot_id", "level", (F.col("slot_id") - F.col("start")).alias("offset"))


def region_starts(levels: DataFrame) -> DataFrame:
    """level, start, size: consecutive regions in ascending level."""
    ahead = Window.partitionBy(F.lit(0)).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    return levels.select("level", F.coalesce(F.sum("size").over(ahead), F.lit(0)).cast("long").alias("start"), "size")
