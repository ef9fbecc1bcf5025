"""What an observer of slot accesses sees: descriptive metrics of a transcript.

events: op_index, class, seq, operation, slot_id.  operations: op_index, class
(operations without events have no event rows).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.exact import ratio
from strataline.operators.runs import ranked
from strataline.session import settled

CLASSES = ("BUILD_INITIAL", "QUERY", "UPSERT", "BUILD_PGM", "MERGE")
ALLOWED_EVENT = ("seq", "operation", "slot_id")
BLOCK, BLOCK_SLOTS = 2048, 1 << 20  # so many sets, and so many slots of all of them, make a block
WIDE, DENSE = 512, 64  # slots multiplied at once; a slot of more than one in DENSE of a block pair's pairs is multiplied, others are unrolled
JOINED = 64  # a row of a join on slots costs about as much as so many pairs in blocks


class ScriptMismatch(ValueError):
    pass


def summary(operations: DataFrame, events: DataFrame) -> DataFrame:
    """One row of totals."""
    ops = operations.agg(F.count("*").alias("operation_count"), F.count_if(F.col("class") == "QUERY").alias("query_count"), F.count_if(F.col("class") == "MERGE").alias("merge_count"))
    ev = events.agg(F.count_if(F.col("operation") == "READ").alias("read_count"), F.count_if(F.col("operation") == "WRITE").alias("write_count"), F.count_distinct("slot_id").alias("distinct_slots"))
    return ops.join(ev)  # one row each


def operation_metrics(operations: DataFrame, events: DataFrame) -> DataFrame:
    """Volumes, distinct and repeated slots and span of each operation."""
    per_slot = events.groupBy("op_index", "slot_id").agg(F.count("*").alias("n"), F.count_if(F.col("operation") == "READ").alias("r"))
    per = per_slot.groupBy("op_index").agg(
        F.sum("n").alias("event_count"), F.sum("r").alias("read_volume"), F.count("*").alias("distinct_slots"), F.count_if(F.col("n") > 1).alias("repeated_slots"),
        F.sum(F.col("n") - 1).alias("repeat_accesses"), F.min("slot_id").alias("slot_min"), F.max("slot_id").alias("slot_max"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    joined = operations.join(per, "op_index", "left")
    return joined.select(
        "op_index", "class", zero("event_count"), zero("read_volume"), (F.coalesce("event_count", F.lit(0)) - F.coalesce("read_volume", F.lit(0))).cast("long").alias("write_volume"),
        zero("distinct_slots"), zero("repeated_slots"), zero("repeat_accesses"), "slot_min", "slot_max", (F.col("slot_max") - F.col("slot_min") + 1).alias("span"),
    )


def slot_lists(operations: DataFrame, events: DataFrame) -> DataFrame:
    """op_index, sequence (slots in order), repeated_slot_ids (ascending) of each operation, by its own events."""
    e = events.groupBy("op_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "slot_id"))), lambda x: x["slot_id"]).alias("sequence"))
    again = events.groupBy("op_index", "slot_id").count().where("count > 1").groupBy("op_index").agg(F.sort_array(F.collect_list("slot_id")).alias("repeated_slot_ids"))
    none = F.expr("CAST(array() AS array<bigint>)")
    joined = operations.select("op_index").join(e, "op_index", "left").join(again, "op_index", "left")
    return joined.select("op_index", F.coalesce("sequence", none).alias("sequence"), F.coalesce("repeated_slot_ids", none).alias("repeated_slot_ids"))


def histogram(metrics: DataFrame, column: str) -> DataFrame:
    return metrics.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("count"))


def pairs(queries: DataFrame, events: DataFrame) -> DataFrame:
    """a, b, intersection, union_size, jaccard, set_equal, sequence_equal for all a < b of the queries.

    All pairs are what the metric is about, so its result, and only that, is as large as
    the pairs: they leave the tasks that make them, and what is shuffled is the sets.
    """
    info = settled(shapes(queries, events).where("op_index IS NOT NULL").select("op_index", "size", "slots", F.unhex("sequence").alias("sequence")))

    def work(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        both = intersections(a, b)
        (op_a, size_a), (op_b, size_b) = ((_numbers(t, "op_index"), _numbers(t, "size")) for t in (a, b))
        ids: dict[bytes, int] = {}
        seq_a, seq_b = (np.array([ids.setdefault(x, len(ids)) for x in t["sequence"].to_pylist()], "int64") for t in (a, b))
        step = max(1, 65536 // max(1, len(op_b)))
        for i in range(0, len(op_a), step):
            cut = slice(i, i + step)
            one, n = op_a[cut, None], both[cut].astype("int64")
            union = size_a[cut, None] + size_b - n
            wanted = one < op_b if same else one != op_b
            columns = (np.minimum(one, op_b), np.maximum(one, op_b), n, union, _ratios(n, union), (n == size_a[cut, None]) & (n == size_b), seq_a[cut, None] == seq_b)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(c, wanted.shape)[wanted]) for c in columns], ["a", "b", "intersection", "union_size", "jaccard", "set_equal", "sequence_equal"])

    found = of_blocks(info, work, "a long, b long, intersection long, union_size long, jaccard double, set_equal boolean, sequence_equal boolean")
    kind = info.schema["op_index"].dataType
    return found.withColumns({c: F.col(c).cast(kind) for c in ("a", "b")})


def of_blocks(sets: DataFrame, work: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work`` makes of every two blocks of the sets (op_index, slots and more columns), and of each block with itself (same).

    Blocks have about BLOCK sets or BLOCK_SLOTS slots; a set is sent once for each block, and no pair is shuffled.
    """
    count, slots = sets.agg(F.count("*"), F.coalesce(F.sum(F.size("slots")), F.lit(0))).first()
    n = max(1, math.ceil(count / BLOCK), math.ceil(slots / BLOCK_SLOTS))
    dealt = sets.withColumns({"op_index": F.col("op_index").cast("long"), "size": F.col("size").cast("long"), "__block": F.pmod(F.xxhash64(F.col("op_index").cast("long")), F.lit(n))})
    sent = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    sent = sent.withColumns({"__i": F.least("__block", "__other"), "__j": F.greatest("__block", "__other")}).drop("__other")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            keys = batch["__i"].to_numpy() * n + batch["__j"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, z in zip(cuts, cuts[1:]):
                if a < z and keys[a] != at:
                    yield from meet(at, held)
                    at, held = keys[a], []
                held.append(batch.slice(a, z - a))
        yield from meet(at, held)

    def meet(at: int | None, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if at is None:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        i, j = divmod(int(at), n)
        first = len(rows) if i == j else int(np.searchsorted(_numbers(rows, "__block"), j))
        if first and (i == j or first < len(rows)):
            yield from work(rows.slice(0, first), rows if i == j else rows.slice(first), i == j)

    return sent.repartition(min(n * (n + 1) // 2, 4096), "__i", "__j").sortWithinPartitions("__i", "__j", "__block", "op_index").mapInArrow(each, schema)


def _numbers(rows: pa.Table, column: str) -> np.ndarray:
    return rows[column].combine_chunks().to_numpy(zero_copy_only=False).astype("int64")


def intersections(a: pa.Table, b: pa.Table) -> np.ndarray:
    """How many slots each set of one table shares with each of the other.

    Slots of many pairs are multiplied as matrices, the others are unrolled pair by pair.
    """
    (row_a, slot_a), (row_b, slot_b) = (_members(t) for t in (a, b))
    both, shared = np.zeros((len(a), len(b)), "int32"), np.intersect1d(slot_a, slot_b)
    (row_a, at_a), (row_b, at_b) = ((r[m], np.searchsorted(shared, x[m])) for r, x in ((row_a, slot_a), (row_b, slot_b)) for m in (np.isin(x, shared),))
    in_a, in_b = np.bincount(at_a, minlength=len(shared)), np.bincount(at_b, minlength=len(shared))
    dense = in_a * in_b * DENSE > both.size
    number = np.where(dense, np.cumsum(dense) - 1, -1)
    for low in range(0, int(dense.sum()), WIDE):
        sides = []
        for row, at, rows in ((row_a, at_a, len(a)), (row_b, at_b, len(b))):
            own = (number[at] >= low) & (number[at] < low + WIDE)
            side = np.zeros((rows, min(WIDE, int(dense.sum()) - low)), "float32")
            side[row[own], number[at[own]] - low] = 1
            sides.append(side)
        both += (sides[0] @ sides[1].T).astype("int32")
    row_a, at_a = row_a[~dense[at_a]], at_a[~dense[at_a]]
    order = np.argsort(at_b, kind="stable")
    starts, row_b, flat = np.cumsum(in_b) - in_b, row_b[order], both.reshape(-1)
    for low in range(0, len(row_a), BLOCK):
        row, at = row_a[low : low + BLOCK], at_a[low : low + BLOCK]
        n = in_b[at]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[at], n)
        np.add.at(flat, np.repeat(row, n) * len(b) + row_b[place], 1)
    return both


def _members(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row number and slot, for every slot of every set."""
    slots = rows["slots"].combine_chunks()
    n = slots.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(rows)), n), slots.flatten().to_numpy(zero_copy_only=False).astype("int64")


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, and where each code is among them."""
    top = int(codes.max(initial=0)) + 1
    if top > 1 << 20:
        found, where = np.unique(codes, return_inverse=True)
        return found, where.reshape(codes.shape)
    found = np.flatnonzero(np.bincount(codes.reshape(-1), minlength=top))
    where = np.zeros(top, "int64")
    where[found] = np.arange(len(found))
    return found, where[codes]


def _ratios(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """``ratio`` of whole numbers: each different pair of them is divided and rounded once."""
    base = int(d.max(initial=0)) + 1
    found, where = _counted(n * base + d)
    return np.array([float(Decimal(repr(x // base / (x % base))).quantize(Decimal("1e-6"), ROUND_HALF_EVEN)) if x % base else 0.0 for x in found.tolist()], "float64")[where]


def shapes(queries: DataFrame, events: DataFrame) -> DataFrame:
    """op_index, size, slots, set, sequence: the slots that a query touches, how many they are, and digests of them as a set and in order."""
    digest = lambda c: F.sha2(F.array_join(c.cast("array<string>"), ","), 256)
    order = F.transform(F.sort_array(F.collect_list(F.struct("seq", "slot_id"))), lambda x: x["slot_id"])  # a query's own events
    per = events.groupBy("op_index").agg(order.alias("o")).select("op_index", F.size(F.array_distinct("o")).alias("size"), F.array_compact(F.array_distinct("o")).alias("slots"), digest(F.array_sort(F.array_distinct("o"))).alias("set"), digest(F.col("o")).alias("sequence"))
    none, no_slots = F.sha2(F.lit(""), 256), F.expr("CAST(array() AS array<bigint>)")
    return queries.select("op_index").join(per, "op_index", "left").select("op_index", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce(F.col("slots").cast("array<bigint>"), no_slots).alias("slots"), F.coalesce("set", none).alias("set"), F.coalesce("sequence", none).alias("sequence"))


def pair_summary(queries: DataFrame, events: DataFrame) -> DataFrame:
    """One row about all pairs of queries; the mean is of the rounded values, and is rounded again.

    Queries with equal sets are one row with their number.  Different sets meet by their
    slots where few share one, so pairs without a common slot are counted, not made; else
    they meet in blocks, and pairs leave a task as counts of their sizes.
    """
    info = settled(shapes(queries, events))
    sets = settled(info.groupBy("set", "size").agg(F.count("*").alias("n"), F.min("op_index").alias("op_index"), F.first("slots").alias("slots")))
    twin = lambda n: F.col(n) * (F.col(n) - 1) / 2
    met = _met_by_slots(sets) if _few_share(sets) else of_blocks(sets.select("op_index", "size", "n", "slots"), _sizes, "both long, sizes long, times long")
    met = met.groupBy("both", "sizes").agg(F.sum("times").alias("times")).withColumn("jaccard", ratio(F.col("both"), F.col("sizes") - F.col("both")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    total = info.agg(F.count("*").alias("q")).select((F.col("q") * (F.col("q") - 1) / 2).cast("long").alias("pairs"))
    different = met.agg(zero(F.sum("times")).alias("met"), F.coalesce(F.sum(F.col("jaccard") * F.col("times")), F.lit(0.0)).alias("sum"), F.max("jaccard").alias("max"), F.min("jaccard").alias("min"))
    same = sets.agg(zero(F.sum(twin("n"))).alias("set_equal"), zero(F.sum(F.when(F.col("size") > 0, twin("n")))).alias("full"))
    ordered = info.groupBy("sequence").agg(F.count("*").alias("n")).agg(zero(F.sum(twin("n"))).alias("sequence_equal"))
    one = total.join(different).join(same).join(ordered)  # one row each
    pairs, full, apart = F.col("pairs"), F.col("full"), F.col("pairs") - F.col("met") - F.col("full")
    mean = (F.col("sum") + full) / F.nullif(pairs, F.lit(0))
    least = F.when((pairs == 0) | (apart > 0), 0.0).otherwise(F.least(F.col("min"), F.when(full > 0, 1.0)))
    most = F.when(full > 0, 1.0).otherwise(F.coalesce("max", F.lit(0.0)))
    return one.select(
        pairs.alias("pair_count"), F.coalesce(F.bround(mean, 6), F.lit(0.0)).alias("mean_jaccard"), most.alias("max_jaccard"), F.coalesce(least, F.lit(0.0)).alias("min_jaccard"),
        (F.col("met") + full).alias("intersecting"), "set_equal", "sequence_equal", ratio(F.col("sequence_equal"), pairs).alias("sequence_equal_rate"),
    )


def _few_share(sets: DataFrame) -> bool:
    """Whether a join of the sets on their slots has so few rows that it costs less than all pairs in blocks."""
    per = sets.select(F.explode("slots").alias("slot_id")).groupBy("slot_id").agg(F.count("*").cast("double").alias("n"))
    rows = per.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
    count = sets.count()
    return rows * JOINED < count * (count - 1) / 2


def _met_by_slots(sets: DataFrame) -> DataFrame:
    """both, sizes, times of every two sets that share a slot, by a join on slots."""
    slots = sets.select("op_index", F.explode("slots").alias("slot_id"))
    common = slots.select(F.col("op_index").alias("a"), "slot_id").join(slots.select(F.col("op_index").alias("b"), "slot_id"), "slot_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    side = lambda x: sets.select(F.col("op_index").alias(x), F.col("n").alias(f"n_{x}"), F.col("size").alias(f"size_{x}"))
    met = common.join(side("a"), "a").join(side("b"), "b")
    return met.select("both", (F.col("size_a").cast("long") + F.col("size_b")).alias("sizes"), (F.col("n_a") * F.col("n_b")).alias("times"))


def _sizes(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
    """both, sizes, times: how many pairs of queries share so many slots and have so many in all, of those that share one."""
    both = intersections(a, b).astype("int64")
    sizes = _numbers(a, "size")[:, None] + _numbers(b, "size")
    wanted = (both > 0) & (np.triu(np.ones(both.shape, bool), 1) if same else True)
    base = int(sizes.max(initial=0)) + 1
    found, where = _counted((both * base + sizes)[wanted])
    n_a, n_b = _numbers(a, "n"), _numbers(b, "n")
    if n_a.max(initial=1) == n_b.max(initial=1) == 1:
        times = np.bincount(where, minlength=len(found))
    else:
        times = np.zeros(len(found), "int64")
        np.add.at(times, where, (n_a[:, None] * n_b)[wanted])
    yield pa.RecordBatch.from_arrays([pa.array(c.astype("int64")) for c in (found // base, found % base, times)], ["both", "sizes", "times"])


def hotness(events: DataFrame) -> DataFrame:
    """slot_id, query_count (distinct operations), access_count."""
    per = events.groupBy("slot_id", "op_index").agg(F.count("*").alias("n"))
    return per.groupBy("slot_id").agg(F.count("*").alias("query_count"), F.sum("n").alias("access_count"))


def steps(events: DataFrame) -> DataFrame:
    """op_index, diff: from each access of an operation to its next."""
    after = F.lead("slot_id").over(Window.partitionBy("op_index").orderBy("seq"))
    return events.withColumn("diff", after - F.col("slot_id")).where("diff IS NOT NULL").select("op_index", "diff")


def adjacency(events: DataFrame) -> DataFrame:
    found = steps(events).groupBy("op_index").agg(F.count("*").alias("steps"), F.count_if(F.abs("diff") == 1).alias("adjacent"))
    return found.select("op_index", "steps", "adjacent", ratio(F.col("adjacent"), F.col("steps")).alias("adjacent_rate"))


def runs(events: DataFrame) -> DataFrame:
    """op_index, run, operation, length: the run-length encoding of reads and writes."""
    each = Window.partitionBy("op_index").orderBy("seq")
    new = (F.col("operation") != F.lag("operation").over(each)).cast("long")
    marked = events.withColumn("run", F.sum(F.coalesce(new, F.lit(0))).over(each))
    return marked.groupBy("op_index", "run", "operation").agg(F.count("*").alias("length"))


def longest_runs(found: DataFrame) -> DataFrame:
    pick = lambda k: F.coalesce(F.max(F.when(F.col("operation") == k, F.col("length"))), F.lit(0))
    return found.groupBy("op_index").agg(pick("READ").alias("longest_read_run"), pick("WRITE").alias("longest_write_run"), F.count("*").alias("run_count"))


def prior_overlap(events: DataFrame) -> DataFrame:
    """op_index, slots, prior: the slots of each merge, and those that a query before it has touched."""
    first = events.where("class = 'QUERY'").groupBy("slot_id").agg(F.min("op_index").alias("first_query"))
    touched = events.where("class = 'MERGE'").select("op_index", "slot_id").distinct().join(first, "slot_id", "left")
    return touched.groupBy("op_index").agg(F.count("*").alias("slots"), F.count_if(F.col("first_query") < F.col("op_index")).alias("prior")).select("op_index", "slots", "prior", ratio(F.col("prior"), F.col("slots")).alias("prior_rate"))


def merge_metrics(operations: DataFrame, events: DataFrame) -> DataFrame:
    merges = events.where("class = 'MERGE'")
    volumes = operation_metrics(operations.where("class = 'MERGE'"), merges)
    sides = merges.groupBy("op_index").agg(F.count_distinct(F.when(F.col("operation") == "READ", F.col("slot_id"))).alias("read_slots"), F.count_distinct(F.when(F.col("operation") == "WRITE", F.col("slot_id"))).alias("write_slots"))
    return volumes.join(sides, "op_index", "left").join(longest_runs(runs(merges)), "op_index", "left").join(prior_overlap(events), "op_index", "left").na.fill(0, ["read_slots", "write_slots", "run_count", "slots", "prior", "longest_read_run", "longest_write_run"])


def equality_classes(labelled: DataFrame) -> DataFrame:
    """op_index, label: QClassN, numbered by where each key first occurs.  labelled: op_index, key."""
    first = labelled.groupBy("key").agg(F.min("op_index").alias("first"))
    number = ranked(first.select("first").distinct(), "first")
    named = first.join(number, "first").select("key", F.concat(F.lit("QClass"), F.col("rank").cast("string")).alias("label"))
    return labelled.join(named, "key").select("op_index", "label")


def labels_of_script(script: DataFrame, operations: DataFrame) -> DataFrame:
    """op_index, label of the queries of a run, from the script it came from: operation by operation, of the same kind.

    script: op_index, kind, key.  operations: op_index, class.  Raises where an operation of either has no equal in the other.
    """
    both = script.join(operations, "op_index", "full_outer")
    odd = both.where("kind IS NULL OR class IS NULL OR kind <> class").select("op_index").orderBy("op_index").head()
    if odd is not None:
        raise ScriptMismatch(f"operation {odd['op_index']} of script and run differ")
    return equality_classes(script.where("kind = 'QUERY'").select("op_index", "key"))


def class_counts(operations: DataFrame) -> DataFrame:
    """Operations of every class, zeros included."""
    kinds = operations.sparkSession.createDataFrame([(k,) for k in CLASSES], "class string")
    return kinds.join(operations.groupBy("class").agg(F.count("*").alias("n")), "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("operation_count"))


def sequence_violations(operations: DataFrame, events: DataFrame) -> DataFrame:
    """Operations whose events are not numbered 0..n-1 or whose read and write counts differ from their events."""
    per = events.groupBy("op_index").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count_distinct("seq").alias("d"), F.count_if(F.col("operation") == "READ").alias("r"))
    joined = operations.join(per, "op_index", "left")
    wrong = "n IS NOT NULL AND (lo <> 0 OR hi <> n - 1 OR d <> n)"
    if {"read_count", "write_count"} <= set(operations.columns):
        wrong = f"({wrong}) OR read_count <> coalesce(r, 0) OR write_count <> coalesce(n - r, 0)"
    return joined.where(wrong).select("op_index")
