"""Mixing sources to target weights, by hash-threshold histograms.

Every source has a word budget.  Documents have a fixed place in [0, 2^60) by
a hash of their id; a document is taken when its place lies below the threshold
of its source.  The threshold comes from nested histograms: words are summed by
source and the top 12 bits of the place, the bucket in which the budget runs
out is summed again by the next 12 bits, and within that bucket alone by the
whole place.  Nothing is sorted but sums, and no source is gathered in a task.
A source whose target is above its size is taken whole once or more, and the
threshold decides about the rest.

Where a long document stands at the threshold, the budget is left short of the
target by up to its length.  If that is more than ``tolerance`` of the target,
a further threshold is found in the same way for the documents not yet taken
that are no longer than what is left.  This goes on until no source is short or
nothing that is left fits; each time takes one document at least.

Everything runs as DataFrame functions.  Defined cases: a null text has size 0;
a null source is a source, the last one; rows that repeat an id are taken or
left together; a table without words takes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.common import discard, durable

BLANKS = "\t\n\x0b\x0c\r "


@dataclass(frozen=True)
class MixConfig:
    """Weights go to the sources in code-point order, over and over; at most ``repeats`` copies."""

    weights: tuple[int, ...] = (1, 2, 3)
    repeats: int = 3
    tolerance: float = 0.001
    seed: str = "mix"
    broadcast_bytes: int = 8 << 20
    #: a table of sources too large to broadcast is joined in so many copies, so that no source is one task's work
    salts: int = 64
    #: where so few rows are open, they are gone through at once
    few_rows: int = 100_000


def count_words(text: Column) -> Column:
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, BLANKS, "")), F.lit(0)).cast("long")


def place(doc_id: Column, seed: str) -> Column:
    """The first 60 bits of an md5 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, cfg: MixConfig) -> DataFrame:
    """Adds target to one row per source (source, source_size).

    Targets are min(repeats * size, level * weight).  With the sources in the
    order of their caps per weight, the level that gives all sizes away is the
    largest of (what is left when the first j are capped) / (the weights left).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, cfg.weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(cfg.weights))).cast("int") + 1)
    s = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * cfg.repeats)
    ahead = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(ahead), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ahead), F.lit(0))
    s = s.withColumn("level", left / weights)
    level = F.max("level").over(every)
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def _boundary(sums: DataFrame, key: str) -> DataFrame:
    """Per source the first ``key`` after which the words exceed what is left, and what is left before it."""
    up = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    after = sums.withColumn("after", F.sum("words").over(up))
    over = after.where(F.col("after") > F.col("budget"))
    return over.groupBy("source").agg(F.min(F.struct(key, "after", "words", "budget")).alias("b")).select(
        "source", F.col(f"b.{key}").alias(key), (F.col("b.budget") - (F.col("b.after") - F.col("b.words"))).alias("budget"), F.col("b.words").alias("words")
    )


def thresholds(places: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold, rest: the most places from the start whose words stay within the budget.

    places: source, size, place.  budgets: source, budget.
    """
    rows = places.select("source", F.col("size").alias("words"), "place", F.shiftright("place", 48).alias("high"), F.shiftright("place", 36).alias("mid"))

    def level(within: DataFrame, key: str, b: DataFrame) -> DataFrame:
        sums = within.groupBy("source", key).agg(F.sum("words").alias("words")).alias("s")
        return _boundary(sums.join(b.alias("b"), F.expr("s.source <=> b.source")).select("s.source", key, "words", "b.budget"), key)

    def inside(within: DataFrame, key: str, edge: DataFrame) -> DataFrame:
        on = F.expr(f"r.source <=> e.source AND r.{key} = e.{key}")
        return within.alias("r").join(edge.select("source", key).alias("e"), on, "left_semi")

    high = durable(level(rows, "high", budgets), "mix-high")
    part = inside(rows, "high", high)
    mid = durable(level(part, "mid", high.select("source", "budget")), "mix-mid")
    last = level(inside(part, "mid", mid), "place", mid.select("source", "budget"))
    last = durable(last.select("source", F.col("place").alias("threshold"), F.col("budget").alias("rest")), "mix-edge")
    discard(high, mid)
    return last


def _taken(cuts: Column, size: Column, place: Column) -> Column:
    return F.exists(cuts, lambda c: (place < c["threshold"]) & (size <= c["longest"]))


def _with_source(rows: DataFrame, plan: DataFrame, cfg: MixConfig) -> DataFrame:
    """The rows (source, place, ..) with the plan of their source, as a struct ``s``.

    The plan is broadcast if its measured size is within the bound; else both sides are salted.
    """
    plan = plan.select(F.struct("source").alias("of"), F.struct("*").alias("s"))
    n, longest, cuts = plan.agg(F.count("*"), F.coalesce(F.max(F.octet_length("s.source")), F.lit(0)), F.coalesce(F.max(F.size("s.cuts")), F.lit(0))).first()
    on = F.struct(F.col("source").alias("source")) == F.col("of")
    if n * (longest + 64 + 16 * cuts) <= cfg.broadcast_bytes:
        return rows.join(F.broadcast(plan), on).drop("of")
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(cfg.salts - 1))))
    return rows.join(plan, on & (F.pmod(F.col("place"), F.lit(cfg.salts)) == F.col("salt"))).drop("of", "salt")


def _filled(open_rows: DataFrame, due: DataFrame, cfg: MixConfig) -> DataFrame:
    """source, places: what the further thresholds would take of few open rows, found in one pass over each source.

    In the order of places, a document is taken if it fits into what is left; where one doesn't
    while it fitted at the last stop, the next threshold begins there, unless little enough is left.
    """
    items = open_rows.groupBy("source", "place").agg(F.sum("size").alias("size")).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("place", "size"))).alias("items"))
    rows = items.alias("i").join(due.alias("d"), F.expr("i.source <=> d.source")).select("i.source", "items", "rest", "target")
    start = F.struct(F.col("rest").alias("rest"), F.col("rest").alias("longest"), F.lit(False).alias("done"), F.expr("CAST(array() AS array<bigint>)").alias("places"))

    def step(s: Column, x: Column) -> Column:
        candidate = ~s["done"] & (x["size"] <= s["longest"])
        fits = candidate & (x["size"] <= s["rest"])
        stop = candidate & ~fits
        return F.struct(
            F.when(fits, s["rest"] - x["size"]).otherwise(s["rest"]).alias("rest"), F.when(stop, s["rest"]).otherwise(s["longest"]).alias("longest"),
            (s["done"] | (stop & (s["rest"] <= cfg.tolerance * F.col("target")))).alias("done"), F.when(fits, F.concat(s["places"], F.array(x["place"]))).otherwise(s["places"]).alias("places"),
        )

    return rows.select("source", F.aggregate("items", start, step, lambda s: s["places"]).alias("places"))


def mix(docs: DataFrame, cfg: MixConfig | None = None, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies; with ``carry`` also the input row as a struct, ``row``."""
    cfg = cfg or MixConfig()
    own = [docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), count_words(docs["text"]).alias("size"), place(docs["doc_id"], cfg.seed).alias("place")]
    places = durable(docs.select(*own), "mix-places")
    sources = targets(places.groupBy("source").agg(F.sum("size").alias("source_size")), cfg)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = sources.withColumn("whole", F.least(whole, F.lit(cfg.repeats))).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = durable(sources.select("source", "source_size", "target", "whole", F.expr("CAST(array() AS array<struct<threshold:bigint,longest:double>>)").alias("cuts"), F.col("budget").alias("rest")), "mix-plan")
    short, open_rows, last = F.col("rest") > cfg.tolerance * F.col("target"), places, None
    while not plan.where(short).isEmpty():
        due = plan.where(short)
        if open_rows is not places or last is not None:  # what is not yet taken and fits into what is left
            part = _with_source(open_rows, due, cfg).where(~_taken(F.col("s.cuts"), F.col("size"), F.col("place")) & (F.col("size") <= F.col("s.rest")) & (F.col("size") > 0))
            before, open_rows = open_rows, durable(part.select("source", "size", "place"), "mix-open")
            if before is not places:
                discard(before)
            n = open_rows.count()
            if n <= cfg.few_rows:
                last = durable(_filled(open_rows, due, cfg), "mix-filled") if n else None
                break
        first = open_rows is places
        found = thresholds(open_rows, due.select("source", F.col("rest").alias("budget")))
        fits = F.lit(float(1 << 62)) if first else F.col("p.rest")
        cut = F.struct(F.coalesce("f.threshold", F.lit(1 << 60)).alias("threshold"), fits.alias("longest"))
        all_of = open_rows.groupBy("source").agg(F.sum("size").alias("words"))  # where everything fits, there is no threshold
        joined = plan.alias("p").join(found.alias("f"), F.expr("p.source <=> f.source"), "left").join(all_of.alias("a"), F.expr("p.source <=> a.source"), "left")
        is_due = F.expr(f"p.rest > {cfg.tolerance!r}D * p.target")
        rest = F.coalesce("f.rest", F.greatest(F.col("p.rest") - F.coalesce("a.words", F.lit(0)), F.lit(0.0)))
        before, plan = plan, durable(joined.select("p.source", "source_size", "target", "whole", F.when(is_due, F.concat("p.cuts", F.array(cut))).otherwise(F.col("p.cuts")).alias("cuts"), F.when(is_due, rest).otherwise(F.col("p.rest")).alias("rest")), "mix-plan")
        discard(before)
        last = plan
    rows = _with_source(docs.select(*own, F.struct("*").alias("row")) if carry else places, plan, cfg)
    more = _taken(F.col("s.cuts"), F.col("size"), F.col("place"))
    if last is not None and last is not plan:  # at most few_rows places in all
        extra = last.select(F.struct("source").alias("of"), F.explode("places").alias("at"))
        rows = rows.join(F.broadcast(extra), (F.struct(F.col("source").alias("source")) == F.col("of")) & (F.col("place") == F.col("at")) & (F.col("size") <= F.col("s.rest")), "left")
        more = more | F.col("at").isNotNull()
    copies = F.col("s.whole") + more.cast("int")
    return rows.select("doc_id", "size", F.col("s.source_size").alias("source_size"), F.col("s.target").alias("target"), (F.col("size") * copies).alias("taken"), copies.alias("copies"), *(["row"] if carry else []))


def oracle(cfg: MixConfig | None = None, rounds: int = 8) -> str:
    """The same mix as DuckDB SQL, for at most ``rounds`` thresholds: one ordered running sum instead of nested histograms."""
    cfg = cfg or MixConfig()
    picks = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(cfg.weights))
    n, due, hit, steps = rounds, f"rest > {cfg.tolerance!r}::DOUBLE * target", "FALSE", ""
    for i in range(1, n + 1):
        longest = f"{float(1 << 62)!r}::DOUBLE" if i == 1 else "rest"
        steps += f"""
open{i} AS MATERIALIZED (
  SELECT d.source, place, sum(size)::BIGINT AS words FROM sized d JOIN plan{i - 1} b ON d.source IS NOT DISTINCT FROM b.source
  WHERE {due} AND NOT ({hit}) AND size <= {longest} GROUP BY ALL),
run{i} AS (
  SELECT o.source, place, words, rest, sum(words) OVER (PARTITION BY o.source ORDER BY place)::BIGINT AS after
  FROM open{i} o JOIN plan{i - 1} b ON o.source IS NOT DISTINCT FROM b.source),
edge{i} AS MATERIALIZED (
  SELECT source, min(place) FILTER (after > rest) AS threshold,  arg_min(rest - (after - words), place) FILTER (after > rest) AS left_over, max(after) AS everything FROM run{i} GROUP BY source),
plan{i} AS MATERIALIZED (
  SELECT p.* EXCLUDE (rest), CASE WHEN {due} THEN coalesce(threshold, {1 << 60}) ELSE 0 END AS cut{i}, CASE WHEN {due} THEN {longest} ELSE 0 END AS longest{i},
         CASE WHEN {due} THEN coalesce(left_over, greatest(rest - coalesce(everything, 0), 0)) ELSE rest END AS rest
  FROM plan{i - 1} p LEFT JOIN edge{i} e ON p.source IS NOT DISTINCT FROM e.source),"""
        hit += f" OR (place < cut{i} AND size <= longest{i})"
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{cfg.seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS place
  FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(cfg.weights)} {picks} END)::BIGINT AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * {cfg.repeats}) OVER ahead, 0))::BIGINT::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0))::BIGINT::DOUBLE AS level
  FROM weighed
  WINDOW ahead AS (ORDER BY (source_size * {cfg.repeats})::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least((source_size * {cfg.repeats})::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
budgets AS (
  SELECT *, (CASE WHEN source_size > 0 THEN least(floor(target / source_size), {cfg.repeats}) ELSE 0 END)::INTEGER AS whole FROM targets),
plan0 AS (SELECT *, target - whole * source_size AS rest FROM budgets),
{steps}
taken AS (
  SELECT doc_id, size, source_size, target, whole + CASE WHEN {hit} THEN 1 ELSE 0 END AS copies
  FROM sized d JOIN plan{n} b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM taken
"""
