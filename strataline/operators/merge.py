"""Newer-wins merging of two runs, and the steps a resumable merge takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.runs import ranked


class MergeIdentity(ValueError):
    pass


def check_levels(source: int, target: int) -> None:
    """A resumable merge goes from a level to the next one and nowhere else."""
    if target != source + 1:
        raise MergeIdentity(f"no merge from level {source} to level {target}")


def newer_wins(newer: DataFrame, older: DataFrame) -> DataFrame:
    """key, value, in_newer, in_older.  Presence decides, so a newer null wins too."""
    a = newer.select("key", F.col("value").alias("newer_value"), F.lit(True).alias("n"))
    b = older.select("key", F.col("value").alias("older_value"), F.lit(True).alias("o"))
    joined = a.join(b, "key", "full_outer")
    return joined.select(
        "key", F.when(F.col("n"), F.col("newer_value")).otherwise(F.col("older_value")).alias("value"),
        F.coalesce("n", F.lit(False)).alias("in_newer"), F.coalesce("o", F.lit(False)).alias("in_older"),
    )


def counts(merged: DataFrame) -> DataFrame:
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    n, o = F.col("in_newer"), F.col("in_older")
    return merged.agg(one(n).alias("newer"), one(o).alias("older"), F.count("*").alias("output"), one(n & o).alias("discarded"))


def cursors(merged: DataFrame, capacity: int, step: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """The state after each decision: records, source and target cursors, blocks out, records pending, step; and the columns ``carry``."""
    rows = ranked(merged, "key")
    cuts = rows.withColumn("range", F.expr("rank div 65536"))  # ranks are dense, so these ranges are of one size
    sums = cuts.groupBy("range").agg(F.sum(F.col("in_newer").cast("long")).alias("a"), F.sum(F.col("in_older").cast("long")).alias("b"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("a").over(ahead), F.lit(0)).alias("a0"), F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("b0"))
    run = Window.partitionBy("range").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = cuts.withColumn("i", F.sum(F.col("in_newer").cast("long")).over(run)).withColumn("j", F.sum(F.col("in_older").cast("long")).over(run)).join(starts, "range")
    return out.select(
        "key", (F.col("rank") + 1).alias("r"), (F.col("i") + F.col("a0")).alias("i"), (F.col("j") + F.col("b0")).alias("j"),
        F.expr(f"(rank + 1) div {capacity}").alias("blocks"), F.expr(f"(rank + 1) % {capacity}").alias("pending"), F.expr(f"rank div {step}").alias("step"), *carry,
    )


def trace(newer_slots: DataFrame, older_slots: DataFrame, output_slots: DataFrame) -> DataFrame:
    """seq, phase, operation, slot_id of a blocking merge: reads of newer, older and output, then writes of output, newer and older, as they happen."""
    phases = [(0, "READ", newer_slots), (1, "READ", older_slots), (2, "WRITE", output_slots), (3, "READ", output_slots), (4, "WRITE", newer_slots), (5, "WRITE", older_slots)]
    rows = None
    for phase, operation, slots in phases:
        part = slots.select(F.lit(phase).alias("phase"), F.lit(operation).alias("operation"), "block_rank", "slot_id")
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("place", F.col("phase").cast("long") * (1 << 40) + F.col("block_rank"))
    return ranked(rows, "place").select(F.col("rank").alias("seq"), "phase", "operation", "slot_id")
