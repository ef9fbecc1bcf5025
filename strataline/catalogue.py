"""Every registered query of the library with its SQL oracle.

The driver's tables play the parts of runs and transcripts:

* newer run: even order keys, older run: those divisible by three;
* levels, newest first: keys divisible by 7, 5, 3, 2; lookups: the order keys of
  line items, and the same far above all keys, which miss;
* transcript: an operation for each user, its class by the user's number, its
  events in order of time, slots from the event's properties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.operators import lookup, merge, observe, runs
from strataline.plans import pgm, planner, profile, store
from strataline.session import settled

Query = Callable[[SparkSession, str], DataFrame]
CAPACITY, STEP, EPSILON, FAR = 256, 1000, 64, 10_000_000
MODULI = (7, 5, 3, 2)
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def run_of(spark: SparkSession, d: str, modulus: int, tag: str) -> DataFrame:
    orders = table(spark, d, "orders").where(F.col("o_orderkey") % modulus == 0)
    return orders.select(F.col("o_orderkey").alias("key"), F.concat_ws(":", F.lit(tag), "o_orderstatus").alias("value"))


def newer(spark: SparkSession, d: str) -> DataFrame:
    return run_of(spark, d, 2, "s")


def older(spark: SparkSession, d: str) -> DataFrame:
    return run_of(spark, d, 3, "t")


def levels(spark: SparkSession, d: str) -> DataFrame:
    """priority, key, value: one scan, a row for each level that has the key."""
    orders = table(spark, d, "orders")
    found = F.array(*[F.when(F.col("o_orderkey") % m == 0, F.lit(p)) for p, m in enumerate(MODULI)])
    rows = orders.select(F.col("o_orderkey").alias("key"), "o_orderstatus", F.explode(F.array_compact(found)).alias("priority"))
    return rows.select("priority", "key", F.concat_ws(":", F.concat(F.lit("L"), F.col("priority").cast("string")), "o_orderstatus").alias("value"))


def keys_asked(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    return keys.select(F.explode(F.array("key", F.col("key") + FAR)).alias("key"))


def block_run(spark: SparkSession, d: str) -> DataFrame:
    return runs.packed(runs.ranked(newer(spark, d)), CAPACITY)


def level_blocks(spark: SparkSession, d: str) -> DataFrame:
    return runs.packed(runs.ranked(levels(spark, d), "key", ("priority",)), CAPACITY)


def operations(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("user_id") % 5 == 0, "MERGE").when(F.col("user_id") % 5 == 1, "UPSERT").otherwise("QUERY")
    return table(spark, d, "events").select(F.col("user_id").alias("op_index"), kind.alias("class")).distinct()


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("user_id") % 5 == 0, "MERGE").when(F.col("user_id") % 5 == 1, "UPSERT").otherwise("QUERY")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(
        F.col("user_id").alias("op_index"), kind.alias("class"), seq.cast("long").alias("seq"),
        F.when(F.col("event_type").isin("purchase", "error"), "WRITE").otherwise("READ").alias("operation"),
        F.get_json_object("props", "$.k").cast("long").alias("slot_id"),
    )


def asked(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("class = 'QUERY'")


# --- the same tables for the oracle ---------------------------------------------------------

NEWER = "newer AS (SELECT o_orderkey AS key, 's:' || o_orderstatus AS value FROM orders WHERE o_orderkey % 2 = 0)"
OLDER = "older AS (SELECT o_orderkey AS key, 't:' || o_orderstatus AS value FROM orders WHERE o_orderkey % 3 = 0)"
RANKED = f"{NEWER}, run AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS rank FROM newer)"
PACKED = f"{RANKED}, packed AS (SELECT *, rank // {CAPACITY} AS block_rank, rank % {CAPACITY} AS block_offset FROM run)"
LEVELS = "levels AS (" + " UNION ALL ".join(f"SELECT {p} AS priority, o_orderkey AS key, 'L{p}:' || o_orderstatus AS value FROM orders WHERE o_orderkey % {m} = 0" for p, m in enumerate(MODULI)) + ")"
LEVEL_BLOCKS = f"""{LEVELS}, lr AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY key) - 1 AS rank FROM levels),
  lb AS (SELECT priority, rank // {CAPACITY} AS block_rank, min(key) AS key_lo, max(key) AS key_hi, count(*) AS size FROM lr GROUP BY ALL)"""
ASKED_KEYS = f"asked AS (SELECT DISTINCT l_orderkey AS key FROM lineitem UNION ALL SELECT DISTINCT l_orderkey + {FAR} FROM lineitem)"
MERGED = f"""{NEWER}, {OLDER}, merged AS (SELECT coalesce(n.key, o.key) AS key, CASE WHEN n.key IS NOT NULL THEN n.value ELSE o.value END AS value,
  n.key IS NOT NULL AS in_newer, o.key IS NOT NULL AS in_older FROM newer n FULL OUTER JOIN older o ON n.key = o.key)"""
EVENTS = """ev AS (SELECT user_id AS op_index, CASE user_id % 5 WHEN 0 THEN 'MERGE' WHEN 1 THEN 'UPSERT' ELSE 'QUERY' END AS class,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  CASE WHEN event_type IN ('purchase', 'error') THEN 'WRITE' ELSE 'READ' END AS operation, CAST(json_extract_string(props, '$.k') AS BIGINT) AS slot_id FROM events),
  ops AS (SELECT DISTINCT op_index, class FROM ev), q AS (SELECT * FROM ev WHERE class = 'QUERY')"""
OP_METRICS = f"""{EVENTS}, per_slot AS (SELECT op_index, class, slot_id, count(*) AS n, count(*) FILTER (operation = 'READ') AS r FROM ev GROUP BY ALL),
  metrics AS (SELECT op_index, class, sum(n)::BIGINT AS event_count, sum(r)::BIGINT AS read_volume, (sum(n) - sum(r))::BIGINT AS write_volume, count(*) AS distinct_slots,
  count(*) FILTER (n > 1) AS repeated_slots, sum(n - 1)::BIGINT AS repeat_accesses, min(slot_id) AS slot_min, max(slot_id) AS slot_max, max(slot_id) - min(slot_id) + 1 AS span FROM per_slot GROUP BY ALL)"""
PAIRS = f"""{EVENTS}, sets AS (SELECT op_index, list_sort(list(DISTINCT slot_id)) AS s, list(slot_id ORDER BY seq) AS o FROM q GROUP BY op_index),
  inter AS (SELECT a.op_index AS a, b.op_index AS b, len(list_intersect(a.s, b.s)) AS intersection, len(a.s) AS na, len(b.s) AS nb, a.o = b.o AS sequence_equal FROM sets a JOIN sets b ON a.op_index < b.op_index),
  pairs AS (SELECT a, b, intersection::BIGINT AS intersection, (na + nb - intersection)::BIGINT AS union_size,
  CASE WHEN na + nb - intersection = 0 THEN 0.0::DOUBLE ELSE round_even(intersection::DOUBLE / (na + nb - intersection)::DOUBLE, 6) END AS jaccard, intersection = na AND intersection = nb AS set_equal, sequence_equal FROM inter)"""
RATE = "CASE WHEN {d} = 0 THEN 0.0::DOUBLE ELSE round_even({n}::DOUBLE / {d}::DOUBLE, 6) END"


# --- runs and packing -----------------------------------------------------------------------


@query(f"WITH {RANKED} SELECT key, value, rank FROM run")
def ingest_rank(spark: SparkSession, d: str) -> DataFrame:
    return runs.ingest(newer(spark, d)).select("key", "value", "rank")


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return runs.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query(f"WITH {PACKED} SELECT key, value, rank, block_rank, block_offset FROM packed")
def pack_blocks(spark: SparkSession, d: str) -> DataFrame:
    return block_run(spark, d).select("key", "value", "rank", "block_rank", "block_offset")


@query(f"WITH {PACKED} SELECT block_rank, min(key) AS key_lo, max(key) AS key_hi, min(rank) AS item_start, max(rank) + 1 AS item_end, count(*) AS size, block_rank + 100 AS slot_id FROM packed GROUP BY block_rank")
def block_intervals(spark: SparkSession, d: str) -> DataFrame:
    return runs.placed(runs.block_intervals(block_run(spark, d)), 100)


@query(f"WITH {PACKED} SELECT block_rank, string_agg(key || '=' || value, ',' ORDER BY key) AS records FROM packed GROUP BY block_rank")
def sorted_blocks(spark: SparkSession, d: str) -> DataFrame:
    items = F.transform("items", lambda x: F.concat_ws("=", x["key"].cast("string"), x["value"]))
    return runs.blocks(block_run(spark, d)).select("block_rank", F.array_join(items, ",").alias("records"))


@query(f"WITH {PACKED} SELECT block_rank, block_offset, key, value FROM packed")
def flatten_blocks(spark: SparkSession, d: str) -> DataFrame:
    found = runs.flattened(runs.blocks(block_run(spark, d)))
    return found.select("block_rank", F.col("block_offset").cast("long").alias("block_offset"), "key", "value")


FAULTY = f"{PACKED}, faulty AS (SELECT block_rank, rank, CASE WHEN rank % 97 = 5 THEN key - 4 ELSE key END AS key FROM packed)"


@query(f"WITH {FAULTY}, l AS (SELECT *, lag(key) OVER (PARTITION BY block_rank ORDER BY rank) AS previous_key FROM faulty) SELECT block_rank, rank, key, previous_key FROM l WHERE previous_key >= key")
def validate_strict(spark: SparkSession, d: str) -> DataFrame:
    """Faults are put in, as an empty result would prove nothing."""
    rows = block_run(spark, d).withColumn("key", F.when(F.col("rank") % 97 == 5, F.col("key") - 4).otherwise(F.col("key")))
    return runs.not_increasing(rows).select("block_rank", "rank", "key", "previous_key")


@query(f"WITH {LEVEL_BLOCKS}, w AS (SELECT priority, block_rank, key_lo, key_hi + CASE WHEN block_rank % 3 = 1 THEN 40 ELSE 0 END AS key_hi FROM lb), n AS (SELECT *, lead(key_lo) OVER (PARTITION BY priority ORDER BY block_rank) AS next_lo FROM w) SELECT priority, block_rank, key_hi, next_lo FROM n WHERE next_lo <= key_hi")
def validate_ranges(spark: SparkSession, d: str) -> DataFrame:
    found = runs.block_intervals(level_blocks(spark, d), ("priority",))
    wide = found.withColumn("key_hi", F.col("key_hi") + F.when(F.col("block_rank") % 3 == 1, 40).otherwise(0))
    return runs.overlapping(wide, ("priority",)).select("priority", "block_rank", "key_hi", "next_lo")


@query(f"WITH {LEVEL_BLOCKS}, f AS (SELECT priority, block_rank, CASE WHEN block_rank % 4 = 2 THEN size - 1 ELSE size END AS size FROM lb), l AS (SELECT *, max(block_rank) OVER (PARTITION BY priority) AS last_rank FROM f) SELECT priority, block_rank, size FROM l WHERE (block_rank < last_rank AND size <> {CAPACITY}) OR size NOT BETWEEN 1 AND {CAPACITY}")
def validate_fullness(spark: SparkSession, d: str) -> DataFrame:
    found = runs.block_intervals(level_blocks(spark, d), ("priority",))
    wrong = found.withColumn("size", F.when(F.col("block_rank") % 4 == 2, F.col("size") - 1).otherwise(F.col("size")))
    return runs.misfilled(wrong, CAPACITY, ("priority",)).select("priority", "block_rank", "size")


@query("""WITH m AS (SELECT p_partkey AS block_id, p_partkey // 2 * (p_partkey % 5) AS slot_id FROM part)
SELECT 'block' AS kind, block_id AS id, count(*) AS count FROM m GROUP BY block_id HAVING count(*) > 1 UNION ALL SELECT 'slot', slot_id, count(*) FROM m GROUP BY slot_id HAVING count(*) > 1""")
def mapping_bijection(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    mapping = table(spark, d, "part").select(key.alias("block_id"), F.expr("p_partkey div 2 * (p_partkey % 5)").alias("slot_id"))
    return runs.mapping_violations(mapping)


MOVES = "m AS (SELECT p_partkey AS block_id, p_partkey * 2 AS slot_id FROM part), mv AS (SELECT p_partkey AS block_id, 1000000 + p_partkey AS new_slot FROM part WHERE p_partkey % 7 = 0)"


def _moves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part")
    mapping = part.select(F.col("p_partkey").alias("block_id"), (F.col("p_partkey") * 2).alias("slot_id"))
    return mapping, part.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("block_id"), (F.col("p_partkey") + 1_000_000).alias("new_slot"))


@query(f"WITH {MOVES} SELECT m.block_id, coalesce(new_slot, slot_id) AS slot_id FROM m LEFT JOIN mv USING (block_id)")
def relocated_mapping(spark: SparkSession, d: str) -> DataFrame:
    return runs.relocate(*_moves(spark, d))[0]


@query(f"""WITH {MOVES}, j AS (SELECT * FROM m JOIN mv USING (block_id) WHERE new_slot <> slot_id)
SELECT block_id, 0::BIGINT AS seq, 'READ' AS operation, slot_id FROM j UNION ALL SELECT block_id, 1, 'WRITE', new_slot FROM j UNION ALL SELECT block_id, 2, 'WRITE', slot_id FROM j""")
def relocation_events(spark: SparkSession, d: str) -> DataFrame:
    return runs.relocate(*_moves(spark, d))[1].withColumn("seq", F.col("seq").cast("long"))


@query(f"WITH {PACKED} SELECT key, rank FROM packed WHERE rank >= 300 AND rank < 1100")
def rank_slice(spark: SparkSession, d: str) -> DataFrame:
    """The records of a range of ranks, which crosses blocks."""
    return runs.rank_slice(block_run(spark, d), 300, 1100).select("key", "rank")


@query("WITH b AS (SELECT p_partkey // 3 AS block_id FROM part WHERE p_partkey % 5 < 2) SELECT block_id, count(*) AS count FROM b GROUP BY 1 HAVING count(*) > 1")
def repeated_blocks(spark: SparkSession, d: str) -> DataFrame:
    return runs.repeated_blocks(table(spark, d, "part").where("p_partkey % 5 < 2").select(F.expr("p_partkey div 3").alias("block_id")))


STORED = "b AS (SELECT p_partkey AS block_id FROM part), m AS (SELECT p_partkey AS block_id, p_partkey * 2 AS slot_id FROM part WHERE p_partkey % 7 <> 0), st AS (SELECT p_partkey * 2 AS slot_id, p_partkey + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS stored_id FROM part WHERE p_partkey % 13 <> 0)"


@query(f"WITH {STORED} SELECT block_id, slot_id, fault FROM (SELECT b.block_id, m.slot_id, CASE WHEN m.slot_id IS NULL THEN 'unmapped' WHEN stored_id IS NULL THEN 'empty' WHEN stored_id <> b.block_id THEN 'other block' END AS fault FROM b LEFT JOIN m USING (block_id) LEFT JOIN st ON st.slot_id = m.slot_id) WHERE fault IS NOT NULL")
def unstored_blocks(spark: SparkSession, d: str) -> DataFrame:
    part, key = table(spark, d, "part"), F.col("p_partkey")
    mapping = part.where(key % 7 != 0).select(key.alias("block_id"), (key * 2).alias("slot_id"))
    stored = part.where(key % 13 != 0).select((key * 2).alias("slot_id"), (key + F.when(key % 11 == 0, 1).otherwise(0)).alias("stored_id"))
    return runs.unstored_blocks(part.select(key.alias("block_id")), mapping, stored)


@query(f"""WITH {FAULTY}, l AS (SELECT rank, key, lag(key) OVER (ORDER BY rank) AS before FROM faulty), g AS (SELECT rank // 65536 AS r, key, rank, lag(key) OVER (PARTITION BY rank // 65536 ORDER BY rank) AS inside FROM faulty),
e AS (SELECT r, min(key) AS lo, max(key) AS hi FROM g GROUP BY r), s AS (SELECT lag(hi) OVER (ORDER BY r) AS before, lo FROM e)
SELECT 'order' AS "check", (SELECT count(*) FROM g WHERE inside >= key) AS count UNION ALL SELECT 'order across ranges', (SELECT count(*) FROM s WHERE before >= lo) UNION ALL SELECT 'ranks', 0 UNION ALL SELECT 'capacity', 0 UNION ALL SELECT 'fullness', 0""")
def canonical_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = block_run(spark, d).withColumn("key", F.when(F.col("rank") % 97 == 5, F.col("key") - 4).otherwise(F.col("key")))
    return runs.canonical_violations(rows, CAPACITY)


@query("""WITH a AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey % 3 = 0), u AS (SELECT *, 1 AS n FROM a UNION ALL SELECT *, -1 FROM b)
SELECT l_suppkey, l_linenumber, sum(n)::BIGINT AS surplus FROM u GROUP BY ALL HAVING sum(n) <> 0""")
def multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    part = lambda m: table(spark, d, "lineitem").where(f"l_orderkey % {m} = 0").select("l_suppkey", "l_linenumber")
    return runs.multiset_difference(part(2), part(3))


@query("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_custkey, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT o_custkey, 'unexpected' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    part = lambda m: table(spark, d, "orders").where(f"o_orderkey % {m} = 0")
    return runs.missing_and_unexpected(part(2), part(3), "o_custkey")


@query(f"""WITH {PACKED}, more AS (SELECT b.block_rank, n.k AS key FROM (SELECT DISTINCT block_rank FROM packed) b, (SELECT unnest([-1, -2]) AS k) n WHERE b.block_rank % 2 = 0), sz AS (SELECT block_rank, count(*) AS n FROM packed GROUP BY 1)
SELECT m.block_rank, m.key, 'full' AS fault FROM more m JOIN sz USING (block_rank) WHERE n + 2 > {CAPACITY}""")
def block_insert_refused(spark: SparkSession, d: str) -> DataFrame:
    """Two records for every other block: full blocks refuse them."""
    packed_blocks = runs.blocks(block_run(spark, d))
    more = packed_blocks.where("block_rank % 2 = 0").select("block_rank", F.explode(F.array(F.lit(-1), F.lit(-2)).cast("array<bigint>")).alias("key"), F.lit("new").alias("value"))
    return runs.insert(packed_blocks, more, CAPACITY)[1].select("block_rank", "key", "fault")


# --- lookups --------------------------------------------------------------------------------


@query(f"WITH {NEWER}, {ASKED_KEYS} SELECT a.key, n.key IS NOT NULL AS found, n.value FROM asked a LEFT JOIN newer n ON a.key = n.key")
def lookup_single(spark: SparkSession, d: str) -> DataFrame:
    return lookup.single(keys_asked(spark, d), newer(spark, d))


@query(f"""WITH {NEWER}, {ASKED_KEYS}, u AS (SELECT key, 1 AS own FROM newer UNION ALL SELECT key, 0 FROM asked),
s AS (SELECT key, own, sum(own) OVER (ORDER BY key, own ROWS UNBOUNDED PRECEDING) AS below FROM u) SELECT key, below::BIGINT AS lower_bound FROM s WHERE own = 0""")
def lookup_lower_bound(spark: SparkSession, d: str) -> DataFrame:
    return lookup.lower_bounds(keys_asked(spark, d), newer(spark, d))


@query(f"""WITH {LEVELS}, {ASKED_KEYS}, best AS (SELECT key, min(priority) AS priority, arg_min(value, priority) AS value FROM levels GROUP BY key)
SELECT a.key, b.key IS NOT NULL AS found, b.value, b.priority AS hit_level FROM asked a LEFT JOIN best b ON a.key = b.key""")
def lookup_multi_newest_first(spark: SparkSession, d: str) -> DataFrame:
    return lookup.newest_first(keys_asked(spark, d), levels(spark, d), [0, 1, 2, 3]).drop("searched")


@query(f"""WITH {LEVELS}, {ASKED_KEYS}, best AS (SELECT key, min(priority) AS priority FROM levels GROUP BY key)
SELECT a.key, CASE WHEN b.key IS NULL THEN 4 ELSE b.priority + 1 END::BIGINT AS searched FROM asked a LEFT JOIN best b ON a.key = b.key""")
def lookup_searched_levels(spark: SparkSession, d: str) -> DataFrame:
    return lookup.newest_first(keys_asked(spark, d), levels(spark, d), [0, 1, 2, 3]).select("key", "searched")


WINDOWS = f"""{NEWER}, n AS (SELECT count(*) AS n FROM newer), ask AS (SELECT DISTINCT l_orderkey AS key FROM lineitem),
  win AS (SELECT key, greatest(0, (key + 1) // 2 - {EPSILON}) AS lo, least(n.n, (key + 1) // 2 + {EPSILON} + 2) AS hi FROM ask, n),
  cov AS (SELECT key, lo, hi, CASE WHEN lo < hi THEN lo // {CAPACITY} END AS first_block, CASE WHEN lo < hi THEN (hi - 1) // {CAPACITY} END AS last_block FROM win)"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """The even keys are dense, so the lower bound of a key is its half, rounded up."""
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    n = newer(spark, d).count()
    at = F.expr("(key + 1) div 2")
    return keys.select("key", F.greatest(F.lit(0), at - EPSILON).cast("long").alias("lo"), F.least(F.lit(n), at + EPSILON + 2).cast("long").alias("hi"))


@query(f"WITH {WINDOWS} SELECT key, lo, hi, first_block, last_block FROM cov")
def lookup_block_cover(spark: SparkSession, d: str) -> DataFrame:
    return lookup.cover(_windows(spark, d), CAPACITY)


@query(f"""WITH {WINDOWS}, u AS (SELECT key, unnest(range(first_block, last_block + 1)) AS block_rank FROM cov WHERE first_block IS NOT NULL),
m AS (SELECT DISTINCT (row_number() OVER (ORDER BY key) - 1) // {CAPACITY} AS block_rank FROM newer), s AS (SELECT key, block_rank * 7 % 1009 AS slot_id FROM u JOIN m USING (block_rank))
SELECT key, row_number() OVER (PARTITION BY key ORDER BY slot_id) - 1 AS seq, 'READ' AS operation, slot_id FROM s""")
def lookup_trace(spark: SparkSession, d: str) -> DataFrame:
    mapping = block_run(spark, d).select("block_rank").distinct().select("block_rank", (F.col("block_rank") * 7 % 1009).alias("slot_id"))
    return lookup.trace(lookup.cover(_windows(spark, d), CAPACITY), mapping)


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    run = settled(block_run(spark, d))
    mapping = run.select("block_rank").distinct().select("block_rank", (F.col("block_rank") * 7 % 1009).alias("slot_id"))
    segments = settled(pgm.build_levels(run.select(F.lit(0).alias("level"), "key"), EPSILON))
    return store.indexed_lookup(keys_asked(spark, d), run, segments, mapping, CAPACITY)


@query(f"""WITH {NEWER}, {ASKED_KEYS}, u AS (SELECT key, 1 AS own FROM newer UNION ALL SELECT key, 0 FROM asked), s AS (SELECT key, own, sum(own) OVER (ORDER BY key, own ROWS UNBOUNDED PRECEDING) AS below FROM u),
n AS (SELECT count(*) AS n FROM newer) SELECT s.key, newer.key IS NOT NULL AS found, newer.value, below::BIGINT AS lower_bound, true AS in_window FROM n, s LEFT JOIN newer ON s.key = newer.key WHERE own = 0""")
def indexed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every key by way of the learned index: its window, the blocks of the window, the hit in them."""
    return _indexed(spark, d)[0].select("key", "found", "value", "lower_bound", F.expr(f"lower_bound BETWEEN lo AND hi AND hi - lo <= 2 * {EPSILON} + 2").alias("in_window"))


@query(f"""WITH {NEWER}, {ASKED_KEYS}, u AS (SELECT key, 1 AS own FROM newer UNION ALL SELECT key, 0 FROM asked), s AS (SELECT key, own, sum(own) OVER (ORDER BY key, own ROWS UNBOUNDED PRECEDING) AS below FROM u)
SELECT s.key, newer.key IS NOT NULL AS found, CASE WHEN newer.key IS NOT NULL THEN (below // {CAPACITY} * 7 % 1009)::BIGINT END AS hit_slot, newer.key IS NOT NULL AS hit_was_read, true AS once_in_order FROM s LEFT JOIN newer ON s.key = newer.key WHERE own = 0 AND (newer.key IS NOT NULL OR s.key < (SELECT max(key) FROM newer))""")
def indexed_trace(spark: SparkSession, d: str) -> DataFrame:
    """The reads of those lookups: the hit's slot is among them, each slot once and in order; keys far above all are left out."""
    answers, reads = _indexed(spark, d)
    per = reads.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "slot_id"))), lambda x: x["slot_id"]).alias("slots"))
    slot = F.when(F.col("found"), F.expr(f"lower_bound div {CAPACITY} * 7 % 1009"))
    rows = answers.where(f"key < {FAR}").join(per, "key", "left").withColumn("hit_slot", slot)
    most = newer(spark, d).agg(F.max("key").alias("most"))
    rows = rows.join(F.broadcast(most)).where("found OR key < most")  # one row
    return rows.select("key", "found", "hit_slot", F.coalesce(F.array_contains("slots", F.col("hit_slot")), F.lit(False)).alias("hit_was_read"), (F.col("slots") == F.array_sort(F.array_distinct("slots"))).alias("once_in_order"))


# --- merging --------------------------------------------------------------------------------


def merged(spark: SparkSession, d: str) -> DataFrame:
    return merge.newer_wins(newer(spark, d), older(spark, d))


@query(f"WITH {MERGED} SELECT key, value, in_newer, in_older FROM merged")
def merge_newer_wins(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d)


@query(f"WITH {MERGED} SELECT count(*) FILTER (in_newer) AS newer, count(*) FILTER (in_older) AS older, count(*) AS output, count(*) FILTER (in_newer AND in_older) AS discarded FROM merged")
def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    return merge.counts(merged(spark, d))


MERGE_RANKED = f"{MERGED}, mr AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS rank FROM merged)"


@query(f"WITH {MERGE_RANKED} SELECT rank // {CAPACITY} AS block_rank, min(key) AS key_lo, max(key) AS key_hi, min(rank) AS item_start, max(rank) + 1 AS item_end, count(*) AS size FROM mr GROUP BY 1")
def merge_blocks(spark: SparkSession, d: str) -> DataFrame:
    return runs.block_intervals(runs.packed(runs.ranked(merged(spark, d)), CAPACITY))


@query(f"WITH {MERGE_RANKED} SELECT rank // {STEP} AS step, count(*) AS decisions, min(key) AS key_lo, max(key) AS key_hi, count(*) FILTER (in_newer AND in_older) AS duplicates FROM mr GROUP BY 1")
def merge_step_q(spark: SparkSession, d: str) -> DataFrame:
    both = F.count_if(F.col("in_newer") & F.col("in_older"))
    rows = runs.ranked(merged(spark, d)).withColumn("step", F.expr(f"rank div {STEP}"))
    return rows.groupBy("step").agg(F.count("*").alias("decisions"), F.min("key").alias("key_lo"), F.max("key").alias("key_hi"), both.alias("duplicates"))


@query(f"""WITH {MERGE_RANKED} SELECT key, rank + 1 AS r, (sum(in_newer::INT) OVER w)::BIGINT AS i, (sum(in_older::INT) OVER w)::BIGINT AS j, (rank + 1) // {CAPACITY} AS blocks, (rank + 1) % {CAPACITY} AS pending, rank // {STEP} AS step
FROM mr WINDOW w AS (ORDER BY key ROWS UNBOUNDED PRECEDING)""")
def merge_cursors(spark: SparkSession, d: str) -> DataFrame:
    return merge.cursors(merged(spark, d), CAPACITY, STEP)


@query(f"""WITH {MERGE_RANKED}, c AS (SELECT key, rank + 1 AS rank_c, sum(in_newer::INT) OVER w AS a, sum(in_older::INT) OVER w AS b, sum((in_newer AND in_older)::INT) OVER w AS dab FROM mr WINDOW w AS (ORDER BY key ROWS UNBOUNDED PRECEDING))
SELECT count(*) AS keys, count(*) FILTER (rank_c <> a + b - dab) AS violations, max(rank_c) AS output_rank, max(a + b)::BIGINT AS input_ranks FROM c""")
def merge_rank_identity(spark: SparkSession, d: str) -> DataFrame:
    """Output ranks are the input ranks' sum less the keys that both have."""
    rows = merge.cursors(merged(spark, d), CAPACITY, STEP)
    both = newer(spark, d).join(older(spark, d).select("key"), "key", "left_semi")
    shared = lookup.lower_bounds(rows.select((F.col("key") + 1).alias("key")), both).select((F.col("key") - 1).alias("key"), F.col("lower_bound").alias("dab"))
    joined = rows.join(shared, "key")
    return joined.agg(F.count("*").alias("keys"), F.count_if(F.col("r") != F.col("i") + F.col("j") - F.col("dab")).alias("violations"), F.max("r").alias("output_rank"), F.max(F.col("i") + F.col("j")).alias("input_ranks"))


def _slots(df: DataFrame, base: int) -> DataFrame:
    return runs.placed(runs.packed(runs.ranked(df), CAPACITY).select("block_rank").distinct(), base)


TRACE = f"""{MERGE_RANKED}, nb AS (SELECT DISTINCT (row_number() OVER (ORDER BY key) - 1) // {CAPACITY} AS b FROM newer), ob AS (SELECT DISTINCT (row_number() OVER (ORDER BY key) - 1) // {CAPACITY} AS b FROM older),
  xb AS (SELECT DISTINCT rank // {CAPACITY} AS b FROM mr),
  t AS (SELECT 0 AS phase, 'READ' AS operation, b, b + 1000 AS slot_id FROM nb UNION ALL SELECT 1, 'READ', b, b + 100000 FROM ob UNION ALL SELECT 2, 'WRITE', b, b + 200000 FROM xb
  UNION ALL SELECT 3, 'READ', b, b + 200000 FROM xb UNION ALL SELECT 4, 'WRITE', b, b + 1000 FROM nb UNION ALL SELECT 5, 'WRITE', b, b + 100000 FROM ob)"""


@query(f"WITH {TRACE} SELECT row_number() OVER (ORDER BY phase, b) - 1 AS seq, phase, operation, slot_id FROM t")
def merge_trace(spark: SparkSession, d: str) -> DataFrame:
    return merge.trace(_slots(newer(spark, d), 1000), _slots(older(spark, d), 100_000), _slots(merged(spark, d), 200_000))


# --- the index ------------------------------------------------------------------------------

NATION = "k AS (SELECT DISTINCT n_nationkey * n_nationkey * n_nationkey % 101 AS key FROM nation), r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS rank FROM k)"


@query(f"""WITH RECURSIVE {NATION}, p AS (SELECT a.rank AS i, b.rank AS j, (greatest(0, b.rank - 1) - (a.rank + 1))::DOUBLE / (b.key - a.key) AS least, (b.rank + 1 - greatest(0, a.rank - 1))::DOUBLE / (b.key - a.key) AS most FROM r a JOIN r b ON a.rank < b.rank),
w AS (SELECT s.rank AS a, e.rank AS b, coalesce(max(p.least), 0) <= coalesce(min(p.most), 0) + 1e-12 AS ok FROM r s JOIN r e ON s.rank <= e.rank LEFT JOIN p ON p.i >= s.rank AND p.j <= e.rank GROUP BY ALL),
reach AS (SELECT a, max(b) AS b FROM w WHERE ok GROUP BY a), seg AS (SELECT a, b, 0 AS n FROM reach WHERE a = 0 UNION ALL SELECT reach.a, reach.b, n + 1 FROM seg JOIN reach ON reach.a = seg.b + 1)
SELECT n AS segment, a AS start_rank, b AS end_rank FROM seg""")
def pgm_segments_small(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "nation").select(F.lit(0).alias("level"), F.expr("n_nationkey * n_nationkey * n_nationkey % 101").alias("key")).distinct()
    return pgm.build_levels(keys, 1).select("segment", "start_rank", "end_rank")


def _event_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.lit(0).alias("level"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("key"))


TIMES = "k AS (SELECT epoch_us(ts) AS key FROM events), r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS rank FROM k)"


@query(f"WITH {TIMES}, u AS (SELECT key, 1 AS own FROM k UNION ALL SELECT key, 0 FROM k UNION ALL SELECT key + 1, 0 FROM k), s AS (SELECT key, own, sum(own) OVER (ORDER BY key, own ROWS UNBOUNDED PRECEDING) AS below FROM u) SELECT DISTINCT key, below::BIGINT AS lower_bound, true AS in_window FROM s WHERE own = 0")
def pgm_search_contract(spark: SparkSession, d: str) -> DataFrame:
    """Every time and the microsecond after it, with its true lower bound, which lies in the index's window."""
    keys = _event_keys(spark, d)
    wanted = settled(keys.select("level", F.explode(F.array("key", F.col("key") + 1)).alias("key")).distinct())
    found = pgm.search_rows(wanted, settled(pgm.build_levels(keys, EPSILON)))
    true = lookup.lower_bounds(wanted.select("key"), keys.select("key"))
    return found.join(true, "key").select("key", "lower_bound", F.expr(f"lower_bound BETWEEN lo AND hi AND hi - lo <= 2 * {EPSILON} + 2").alias("in_window"))


@query(f"WITH {TIMES} SELECT key, rank, true AS certified FROM r")
def pgm_certificate_band(spark: SparkSession, d: str) -> DataFrame:
    """Every time with its rank, and whether its segment's certificate holds for it (for a repeated time: for its first rank, which the others follow)."""
    keys = _event_keys(spark, d)
    rows = runs.ranked(keys)
    wrong = pgm.band_violations(rows, settled(pgm.build_levels(keys, 8)), 8)
    return rows.select("key", "rank").join(wrong.select("key", F.lit(True).alias("wrong")), "key", "left").select("key", "rank", F.col("wrong").isNull().alias("certified"))


@query()
def pgm_segments_events(spark: SparkSession, d: str) -> DataFrame:
    """The segments of all event times (no SQL, which would be quadratic; tested by brute force)."""
    return pgm.build_levels(_event_keys(spark, d), EPSILON).select("segment", "start_rank", "end_rank")


@query("SELECT e.key, s.segment, s.start_key FROM (SELECT event_id AS key FROM events) e ASOF JOIN (SELECT c_custkey AS segment, c_custkey * c_custkey AS start_key FROM customer) s ON e.key >= s.start_key")
def segment_asof(spark: SparkSession, d: str) -> DataFrame:
    """The rightmost segment that starts at or before the key: segments and keys meet in ranges of the key."""
    starts = table(spark, d, "customer").select((F.col("c_custkey") * F.col("c_custkey")).alias("start_key"), F.col("c_custkey").alias("segment"))
    keys = table(spark, d, "events").select(F.col("event_id").alias("key"))
    at = lookup.rightmost(keys, starts.select(F.col("start_key").alias("key")))
    order = runs.ranked(starts, "start_key").select("segment", "start_key", F.col("rank").alias("at"))
    return at.join(order, "at").select("key", "segment", "start_key")


# --- observation ----------------------------------------------------------------------------


@query(f"WITH {EVENTS} SELECT (SELECT count(*) FROM ops) AS operation_count, (SELECT count(*) FROM ops WHERE class = 'QUERY') AS query_count, (SELECT count(*) FROM ops WHERE class = 'MERGE') AS merge_count, count(*) FILTER (operation = 'READ') AS read_count, count(*) FILTER (operation = 'WRITE') AS write_count, count(DISTINCT slot_id) AS distinct_slots FROM ev")
def transcript_summary(spark: SparkSession, d: str) -> DataFrame:
    return observe.summary(operations(spark, d), events(spark, d))


@query(f"WITH {EVENTS} SELECT op_index, class, seq, operation, slot_id FROM ev")
def transcript_extract(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("op_index", "class", *observe.ALLOWED_EVENT)


@query(f"WITH {OP_METRICS} SELECT * FROM metrics")
def op_metrics(spark: SparkSession, d: str) -> DataFrame:
    return observe.operation_metrics(operations(spark, d), events(spark, d))


@query(f"""WITH {EVENTS}, again AS (SELECT op_index, slot_id FROM ev GROUP BY ALL HAVING count(*) > 1), r AS (SELECT op_index, string_agg(slot_id, ',' ORDER BY slot_id) AS repeated FROM again GROUP BY 1)
SELECT op_index, string_agg(slot_id, ',' ORDER BY seq) AS sequence, coalesce(any_value(repeated), '') AS repeated FROM ev LEFT JOIN r USING (op_index) GROUP BY 1""")
def slot_lists(spark: SparkSession, d: str) -> DataFrame:
    found = observe.slot_lists(operations(spark, d), events(spark, d))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return found.select("op_index", text("sequence").alias("sequence"), text("repeated_slot_ids").alias("repeated"))


@query(f"WITH {OP_METRICS} SELECT event_count AS key, count(*) AS count FROM metrics WHERE class = 'QUERY' GROUP BY 1")
def trace_length_hist(spark: SparkSession, d: str) -> DataFrame:
    return observe.histogram(op_metrics(spark, d).where("class = 'QUERY'"), "event_count")


@query(f"WITH {OP_METRICS} SELECT distinct_slots AS key, count(*) AS count FROM metrics WHERE class = 'QUERY' GROUP BY 1")
def distinct_slot_hist(spark: SparkSession, d: str) -> DataFrame:
    return observe.histogram(op_metrics(spark, d).where("class = 'QUERY'"), "distinct_slots")


@query(f"WITH {OP_METRICS} SELECT min(event_count) AS min_length, max(event_count) AS max_length, round_even(avg(event_count), 6) AS mean_length, sum(event_count)::BIGINT AS total_length FROM metrics WHERE class = 'QUERY'")
def trace_length_summary(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_count")
    return op_metrics(spark, d).where("class = 'QUERY'").agg(F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.bround(F.avg(n), 6).alias("mean_length"), F.sum(n).alias("total_length"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return observe.pairs(operations(spark, d).where("class = 'QUERY'"), asked(spark, d))


@query(f"WITH {PAIRS} SELECT a, b, intersection, union_size, jaccard, set_equal, sequence_equal FROM pairs")
def pairwise_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


@query(f"""WITH {PAIRS} SELECT count(*) AS pair_count, coalesce(round_even(avg(jaccard), 6), 0.0::DOUBLE) AS mean_jaccard, coalesce(max(jaccard), 0.0::DOUBLE) AS max_jaccard, coalesce(min(jaccard), 0.0::DOUBLE) AS min_jaccard, count(*) FILTER (intersection > 0) AS intersecting,
count(*) FILTER (set_equal) AS set_equal, count(*) FILTER (sequence_equal) AS sequence_equal, {RATE.format(n="count(*) FILTER (sequence_equal)", d="count(*)")} AS sequence_equal_rate FROM pairs""")
def pairwise_summary(spark: SparkSession, d: str) -> DataFrame:
    return observe.pair_summary(operations(spark, d).where("class = 'QUERY'"), asked(spark, d))


HOT = f"{EVENTS}, hot AS (SELECT slot_id, count(DISTINCT op_index) AS query_count, count(*) AS access_count FROM q GROUP BY slot_id)"


@query(f"WITH {HOT} SELECT slot_id, query_count, access_count FROM hot")
def slot_hotness(spark: SparkSession, d: str) -> DataFrame:
    return observe.hotness(asked(spark, d))


@query(f"WITH {HOT} SELECT query_count AS key, count(*) AS count FROM hot GROUP BY 1")
def hotness_hist(spark: SparkSession, d: str) -> DataFrame:
    return observe.histogram(slot_hotness(spark, d), "query_count")


DIFF = f"{EVENTS}, df AS (SELECT op_index, lead(slot_id) OVER (PARTITION BY op_index ORDER BY seq) - slot_id AS diff FROM q)"


@query(f"WITH {DIFF} SELECT diff AS key, count(*) AS count FROM df WHERE diff IS NOT NULL GROUP BY 1")
def adjacency_hist(spark: SparkSession, d: str) -> DataFrame:
    return observe.histogram(observe.steps(asked(spark, d)), "diff")


@query(f"WITH {DIFF} SELECT op_index, count(*) AS steps, count(*) FILTER (abs(diff) = 1) AS adjacent, {RATE.format(n='count(*) FILTER (abs(diff) = 1)', d='count(*)')} AS adjacent_rate FROM df WHERE diff IS NOT NULL GROUP BY 1")
def adjacency_per_query(spark: SparkSession, d: str) -> DataFrame:
    return observe.adjacency(asked(spark, d))


RUNS = f"""{EVENTS}, mg AS (SELECT *, CASE WHEN operation <> lag(operation) OVER (PARTITION BY op_index ORDER BY seq) THEN 1 ELSE 0 END AS new FROM ev WHERE class = 'MERGE'),
  marked AS (SELECT *, (sum(new) OVER (PARTITION BY op_index ORDER BY seq))::BIGINT AS run FROM mg), rl AS (SELECT op_index, run, operation, count(*) AS length FROM marked GROUP BY ALL)"""


@query(f"WITH {RUNS} SELECT op_index, run, operation, length FROM rl")
def merge_runs(spark: SparkSession, d: str) -> DataFrame:
    return observe.runs(events(spark, d).where("class = 'MERGE'"))


@query(f"WITH {RUNS} SELECT op_index, coalesce(max(length) FILTER (operation = 'READ'), 0) AS longest_read_run, coalesce(max(length) FILTER (operation = 'WRITE'), 0) AS longest_write_run, count(*) AS run_count FROM rl GROUP BY 1")
def merge_max_run(spark: SparkSession, d: str) -> DataFrame:
    return observe.longest_runs(merge_runs(spark, d))


@query(f"""WITH {EVENTS}, first AS (SELECT slot_id, min(op_index) AS f FROM q GROUP BY 1), t AS (SELECT DISTINCT op_index, slot_id FROM ev WHERE class = 'MERGE')
SELECT op_index, count(*) AS slots, count(*) FILTER (f < op_index) AS prior, {RATE.format(n="count(*) FILTER (f < op_index)", d="count(*)")} AS prior_rate FROM t LEFT JOIN first USING (slot_id) GROUP BY 1""")
def merge_prior_overlap(spark: SparkSession, d: str) -> DataFrame:
    return observe.prior_overlap(events(spark, d))


@query(f"""WITH {RUNS}, lr AS (SELECT op_index, coalesce(max(length) FILTER (operation = 'READ'), 0) AS longest_read_run, coalesce(max(length) FILTER (operation = 'WRITE'), 0) AS longest_write_run, count(*) AS run_count FROM rl GROUP BY 1),
vol AS (SELECT op_index, count(*) AS event_count, count(DISTINCT slot_id) FILTER (operation = 'READ') AS read_slots, count(DISTINCT slot_id) FILTER (operation = 'WRITE') AS write_slots FROM ev WHERE class = 'MERGE' GROUP BY 1),
first AS (SELECT slot_id, min(op_index) AS f FROM q GROUP BY 1), t AS (SELECT DISTINCT op_index, slot_id FROM ev WHERE class = 'MERGE'), pr AS (SELECT op_index, count(*) FILTER (f < op_index) AS prior FROM t LEFT JOIN first USING (slot_id) GROUP BY 1)
SELECT op_index, event_count, read_slots, write_slots, longest_read_run, longest_write_run, run_count, prior FROM vol JOIN lr USING (op_index) JOIN pr USING (op_index)""")
def merge_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = observe.merge_metrics(operations(spark, d), events(spark, d))
    return found.select("op_index", "event_count", "read_slots", "write_slots", "longest_read_run", "longest_write_run", "run_count", "prior")


@query("""WITH l AS (SELECT o_orderkey AS op_index, o_custkey AS key FROM orders), f AS (SELECT key, min(op_index) AS first FROM l GROUP BY 1), n AS (SELECT key, 'QClass' || (dense_rank() OVER (ORDER BY first) - 1) AS label FROM f)
SELECT op_index, label FROM l JOIN n USING (key)""")
def equality_classes(spark: SparkSession, d: str) -> DataFrame:
    return observe.equality_classes(table(spark, d, "orders").select(F.col("o_orderkey").alias("op_index"), F.col("o_custkey").alias("key")))


@query("""WITH l AS (SELECT o_orderkey AS op_index, o_custkey AS key FROM orders WHERE o_orderkey % 3 <> 0), f AS (SELECT key, min(op_index) AS first FROM l GROUP BY 1), n AS (SELECT key, 'QClass' || (dense_rank() OVER (ORDER BY first) - 1) AS label FROM f)
SELECT op_index, label FROM l JOIN n USING (key)""")
def labels_of_script(spark: SparkSession, d: str) -> DataFrame:
    """Script and run are zipped by operation; queries alone get labels."""
    kind = F.when(F.col("o_orderkey") % 3 == 0, "MERGE").otherwise("QUERY")
    script = table(spark, d, "orders").select(F.col("o_orderkey").alias("op_index"), kind.alias("kind"), F.col("o_custkey").alias("key"))
    return observe.labels_of_script(script, script.select("op_index", F.col("kind").alias("class")))


@query(f"WITH {EVENTS} SELECT k.class, count(ops.op_index) AS operation_count FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in observe.CLASSES)}) k(class) LEFT JOIN ops ON ops.class = k.class GROUP BY 1")
def op_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return observe.class_counts(operations(spark, d))


@query(f"WITH {EVENTS}, f AS (SELECT op_index, CASE WHEN op_index % 9 = 4 THEN seq + 1 ELSE seq END AS seq FROM ev) SELECT op_index FROM f GROUP BY 1 HAVING min(seq) <> 0 OR max(seq) <> count(*) - 1 OR count(DISTINCT seq) <> count(*)")
def event_integrity(spark: SparkSession, d: str) -> DataFrame:
    faulty = events(spark, d).withColumn("seq", F.when(F.col("op_index") % 9 == 4, F.col("seq") + 1).otherwise(F.col("seq")))
    return observe.sequence_violations(operations(spark, d), faulty)


# --- planning -------------------------------------------------------------------------------

BIN_CAPACITY, BIN_BLOCK = 16, 4
LOAD = "(i * 5 + 3) % 12 + 1"
# bins of six and a half blocks on average, for all blocks of each run
PLANNED = f"""{NEWER}, {OLDER}, rs AS (SELECT 'source' AS side, key, (row_number() OVER (ORDER BY key) - 1) // {BIN_BLOCK} AS b FROM newer UNION ALL SELECT 'target', key, (row_number() OVER (ORDER BY key) - 1) // {BIN_BLOCK} FROM older),
  nb AS (SELECT side, max(b) + 1 AS blocks FROM rs GROUP BY side), loads AS (SELECT side, blocks, i AS bin_index, {LOAD} AS sampled_load FROM (SELECT side, blocks, unnest(range(blocks // 6 + 2)) AS i FROM nb)),
  st AS (SELECT *, least(coalesce(sum(sampled_load) OVER (PARTITION BY side ORDER BY bin_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), blocks)::BIGINT AS rank_start FROM loads),
  planned AS (SELECT side, bin_index, sampled_load, rank_start, rank_start + least(sampled_load, blocks - rank_start) AS rank_stop, least(sampled_load, blocks - rank_start) AS real_count, {BIN_CAPACITY} - least(sampled_load, blocks - rank_start) AS dummy_count FROM st)"""


def _binned(run: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The run in small blocks, and bins for all of them, with loads that SQL can make too."""
    packed = settled(runs.packed(runs.ranked(run), BIN_BLOCK))
    blocks = -(-packed.count() // BIN_BLOCK)
    loads = run.sparkSession.range(blocks // 6 + 2).select(F.col("id").alias("bin_index"), F.expr("(id * 5 + 3) % 12 + 1").alias("sampled_load"))
    return packed, planner.bin_intervals(loads, blocks, BIN_CAPACITY)


@query(f"WITH {PLANNED} SELECT bin_index, sampled_load, rank_start, rank_stop, real_count, dummy_count FROM planned WHERE side = 'source'")
def bin_rank_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _binned(newer(spark, d))[1]


@query(f"WITH {PLANNED} SELECT count(*) AS bins, sum(sampled_load)::BIGINT AS sampled_capacity, count(*) * {BIN_CAPACITY} AS planned_slots, sum(dummy_count)::BIGINT AS dummy_count, sum(real_count)::BIGINT AS covered_ranks FROM planned WHERE side = 'source'")
def plan_totals(spark: SparkSession, d: str) -> DataFrame:
    return planner.totals(_binned(newer(spark, d))[1], BIN_CAPACITY)


BOUND = f"""{PLANNED}, blocks_of AS (SELECT side, bin_index, unnest(range(rank_start, rank_stop)) AS b FROM planned),
  bound AS (SELECT rs.side, key, rs.b AS block_rank, bin_index FROM rs JOIN blocks_of ON rs.side = blocks_of.side AND rs.b = blocks_of.b),
  pts AS (SELECT p.side, p.bin_index, min(key) AS key FROM planned p LEFT JOIN bound ON bound.side = p.side AND bound.bin_index = p.bin_index GROUP BY ALL),
  tagged AS (SELECT side, bin_index, key IS NULL AS is_dummy, key, CASE WHEN key IS NULL THEN NULL ELSE 0 END::BIGINT AS record_index, CASE side WHEN 'source' THEN bin_index + 1 ELSE -bin_index - 1 END AS signed_tag FROM pts),
  ordered AS (SELECT *, row_number() OVER (ORDER BY is_dummy, key, signed_tag) - 1 AS position FROM tagged)"""


@query(f"WITH {BOUND} SELECT key, block_rank, bin_index FROM bound WHERE side = 'source'")
def bin_bind(spark: SparkSession, d: str) -> DataFrame:
    return planner.bind(*_binned(newer(spark, d))).select("key", "block_rank", "bin_index")


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """Both sides with the first record of each bin as its point: a choice that SQL can make too."""
    rows = None
    for side, run in (("source", newer(spark, d)), ("target", older(spark, d))):
        packed, plan = _binned(run)
        part = planner.interior_points(planner.bind(packed, plan), plan, side, planner.PlanConfig(seed=3), lambda n, u: F.lit(0))
        rows = part if rows is None else rows.unionByName(part)
    return planner.tag_order(rows)


@query(f"WITH {BOUND} SELECT side, bin_index, is_dummy, key, record_index, signed_tag, position FROM ordered")
def tag_order(spark: SparkSession, d: str) -> DataFrame:
    return _ordered(spark, d)


@query(f"""WITH {BOUND}, nth AS (SELECT side, row_number() OVER (PARTITION BY side ORDER BY position) AS bin_index, position AS spot, count(*) OVER (PARTITION BY side) AS n FROM ordered),
f AS (SELECT DISTINCT side, 0::BIGINT AS bin_index, CASE side WHEN 'source' THEN -2 ELSE -1 END AS spot FROM ordered UNION ALL SELECT side, bin_index, spot FROM nth WHERE bin_index < n) SELECT row_number() OVER (ORDER BY spot) - 1 AS fetch_no, side, bin_index FROM f""")
def fetch_order(spark: SparkSession, d: str) -> DataFrame:
    return planner.fetch_order(_ordered(spark, d))


@query(f"WITH {BOUND}, held AS (SELECT bin_index, count(*) AS records, min(key) AS key_lo, max(key) AS key_hi FROM bound WHERE side = 'source' GROUP BY 1) SELECT bin_index, records, key_lo, key_hi, true AS inside, true AS at_index FROM held")
def interior_membership(spark: SparkSession, d: str) -> DataFrame:
    """Seeded points are records of their bins, at the place that was drawn."""
    packed, plan = _binned(newer(spark, d))
    bound = planner.bind(packed, plan)
    points = planner.interior_points(bound, plan, "source", planner.PlanConfig(seed=3)).where("NOT is_dummy").select("bin_index", F.col("key").alias("point"), "record_index")
    joined = bound.join(points, "bin_index")
    held = joined.groupBy("bin_index").agg(
        F.count("*").alias("records"), F.min("key").alias("key_lo"), F.max("key").alias("key_hi"), F.bool_or(F.col("key") == F.col("point")).alias("inside"),
        (F.count_if(F.col("key") < F.col("point")) == F.max("record_index")).alias("at_index"),
    )
    return held


@query()
def merge_plan(spark: SparkSession, d: str) -> DataFrame:
    """The composed plan of two whole runs with drawn loads and points: its fetches (no SQL; tested by its own rules)."""
    packed = [runs.packed(runs.ranked(run), BIN_BLOCK) for run in (newer(spark, d), older(spark, d))]
    return planner.merge_plan(3, packed[0], 4, packed[1], BIN_BLOCK, planner.PlanConfig(seed=3)).fetches


@query("SELECT unnest([1, 8, 21, 64, 100, 200])::BIGINT AS blocks, 0::BIGINT AS violations")
def noisy_prefix_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Noisy sums start at 0, never fall, and stay within the capacity of the true sums."""
    cfg = planner.PlanConfig()
    z = planner.bin_capacity(cfg)
    rows = []
    for n in (1, 8, 21, 64, 100, 200):
        rng = planner.stream(n, planner.LOADS)
        ws = planner.weights(z, cfg.privacy_epsilon)
        loads = [planner.draw(rng, ws) for _ in range(planner.bin_count(planner.factor(z, cfg), n))]
        prefix, _ = planner.noisy_prefix_sums(loads, cfg.privacy_epsilon, z, planner.stream(n, planner.LAPLACE))
        rows += [(n, t, v, sum(loads[:t]), prefix[t - 1] if t else 0) for t, v in enumerate(prefix)]
    df = spark.createDataFrame(rows, "blocks long, t long, noisy long, true_sum long, previous long")
    wrong = (F.col("noisy") < F.col("previous")) | (F.abs(F.col("noisy") - F.col("true_sum")) > z) | ((F.col("t") == 0) & (F.col("noisy") != 0))
    return df.groupBy("blocks").agg(F.count_if(wrong).alias("violations"))


# --- the lookup profile ---------------------------------------------------------------------

SIZES = {3: 120, 4: 600, 5: 700, 6: 900}
PROFILE = profile.Profile()
REGIONS = f"rg(level, size) AS (VALUES {', '.join(f'({lv}::BIGINT, {-(-n // 256)}::BIGINT)' for lv, n in SIZES.items())}), st AS (SELECT level, coalesce(sum(size) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, size FROM rg)"


def _regions(spark: SparkSession) -> DataFrame:
    return lookup.region_starts(spark.createDataFrame([(lv, -(-n // PROFILE.per_block)) for lv, n in SIZES.items()], "level long, size long"))


@query(f"WITH {REGIONS} SELECT level, start, size FROM st")
def region_starts(spark: SparkSession, d: str) -> DataFrame:
    return _regions(spark)


@query(f'WITH {REGIONS} SELECT e.event_id AS event_id, s.level AS level, e.slot_id - s.start AS "offset" FROM (SELECT event_id, event_id % 11 AS slot_id FROM events) e JOIN st s ON e.slot_id >= s.start AND e.slot_id < s.start + s.size')
def slot_locate(spark: SparkSession, d: str) -> DataFrame:
    """A table of as many rows as levels is all that is sent to the slots."""
    slots = table(spark, d, "events").select("event_id", (F.col("event_id") % 11).alias("slot_id"))
    found = lookup.locate(slots.select("slot_id").distinct(), _regions(spark))
    return slots.join(F.broadcast(found), "slot_id").select("event_id", "level", "offset")  # eleven slots


@query(f"""WITH lv(level, n) AS (VALUES {", ".join(f"({lv}::BIGINT, {n}::BIGINT)" for lv, n in SIZES.items())}), data AS (SELECT level, level * 1000000 + 3 * i AS key, 'v' || level || '_' || i AS value FROM (SELECT level, unnest(range(n)) AS i FROM lv)),
ask AS (SELECT DISTINCT (3 + o_custkey % 5) * 1000000 + o_custkey % 2000 AS key FROM orders), best AS (SELECT key, min(level) AS hit_level, arg_min(value, level) AS value FROM data GROUP BY key)
SELECT ask.key, best.key IS NOT NULL AS found, best.value, hit_level, CASE WHEN best.key IS NULL THEN 4 ELSE hit_level - 2 END::BIGINT AS searched_levels FROM ask LEFT JOIN best ON ask.key = best.key""")
def profile_lookup_result(spark: SparkSession, d: str) -> DataFrame:
    asked_keys = table(spark, d, "orders").select(F.expr("(3 + o_custkey % 5) * 1000000 + o_custkey % 2000").alias("key")).distinct()
    found = profile.query_rows(profile.Levels(PROFILE, profile.default_scenario()), asked_keys)
    return found.select("key", "found", "value", "hit_level", F.size("searched").cast("long").alias("searched_levels"))


@query(f"""WITH {REGIONS}, o AS (SELECT *, row_number() OVER (ORDER BY level) - 1 AS op_index FROM st), u AS (SELECT op_index, start, unnest(range(size)) AS seq FROM o)
SELECT op_index, 'BUILD_INITIAL' AS class, seq, start + seq AS slot_id FROM u""")
def load_trace(spark: SparkSession, d: str) -> DataFrame:
    return profile.load_trace(spark, SIZES, PROFILE)


# Windows, keys and the probes, reads and places that the profile's search must come to
GOLDEN = (
    (0, 10, 1025, (5, 7, 8, 9, 9), (0,), 10, False), (14, 30, 1025, (22, 26, 24, 25, 24), (0, 1), 25, True), (2, 20, 1025, (11, 15, 17, 18, 19, 19), (0, 1), 20, False),
    (5, 40, 1025, (22, 31, 26, 24, 25, 25, 24), (0, 1, 2), 25, True), (0, 64, 1005, (32, 16, 8, 4, 6, 5, 4), (1, 2, 3, 0), 5, True), (25, 26, 1026, (25,), (1,), 26, True),
)


def _listed(x: Iterable[int]) -> str:
    return ",".join(map(str, x))


@query("SELECT * FROM (VALUES " + ", ".join(f"({lo}::BIGINT, {hi}::BIGINT, {key}::BIGINT, '{_listed(p)}', '{_listed(r)}', {pos}::BIGINT, {found})" for lo, hi, key, p, r, pos, found in GOLDEN) + ") t(lo, hi, key, probes, reads, pos, found)")
def profile_trace_golden(spark: SparkSession, d: str) -> DataFrame:
    """Probe-exact reads of a few lookups against the fixed traces."""
    keys = [1000 + r for r in range(64)]
    data = profile.LevelData(4, keys, [f"v{r}" for r in range(64)], 16, [0, 1, 2, 3], 0, None)
    rows = []
    for lo, hi, key, *_ in GOLDEN:
        got = profile.search(data, key, lo, hi, True)
        rows.append((lo, hi, key, _listed(got.probes), _listed(got.reads), got.pos, got.found))
    return spark.createDataFrame(rows, "lo long, hi long, key long, probes string, reads string, pos long, found boolean")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
