"""Bin planning: capacity, sampled loads, noisy prefix sums, and the fetch order of a merge.

Capacities and the noise on prefix sums are sequential mathematics on the driver,
with seeded generators, one stream for each purpose; everything that has a row for
each bin, block or record is a DataFrame plan, whose draws are hashes of the seed,
the purpose and the bin.  No privacy guarantee is claimed for any of it.
"""

from __future__ import annotations

import hashlib
import math
import random
from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.operators.merge import check_levels
from strataline.operators.runs import ranked, running_total
from strataline.session import settled

# the names that separate the random streams of one seed
LOADS, LAPLACE = "bin loads", "prefix noise"
INTERIOR = {"source": "interior of the source", "target": "interior of the target"}
UINT32 = 2**32 - 1


class PlanError(ValueError):
    pass


class ShortCapacity(PlanError):
    """The sampled loads hold fewer blocks than the run has; never repaired by drawing again."""

    def __init__(self, needed: int, sampled: int):
        super().__init__(f"{needed} blocks, but the sampled loads hold {sampled}")
        self.shortfall = needed - sampled


def _whole(x: object, name: str, least: int) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x < least:
        raise PlanError(f"{name} must be a whole number from {least}, not {x!r}")
    return x


def _positive(x: object, name: str) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x <= 0:
        raise PlanError(f"{name} must be a positive number, not {x!r}")
    return float(x)


@dataclass(frozen=True)
class PlanConfig:
    security_lambda: int = 512
    privacy_epsilon: float = 1.0
    privacy_delta: float = 1e-12
    seed: int = 0

    def __post_init__(self) -> None:
        _whole(self.security_lambda, "security_lambda", 2)
        _positive(self.privacy_epsilon, "privacy_epsilon")
        if _positive(self.privacy_delta, "privacy_delta") >= 1:
            raise PlanError("privacy_delta must be below 1")
        _whole(self.seed, "seed", 0)


def even_up(n: int) -> int:
    return n + n % 2


def power(base: float, exponent: int) -> float:
    """By squaring: the last bits depend on the order of the products."""
    out = 1.0
    while exponent:
        out = out * base if exponent % 2 else out
        base, exponent = base * base, exponent // 2
    return out


def decay(security_lambda: int) -> float:
    found = 1.0 - math.log(security_lambda) ** -2
    if found <= 0:
        raise PlanError("the decay 1 - ln(lambda)^-2 must be positive")
    return found


def weights(capacity: int, epsilon: float) -> list[float]:
    """Loads 0..capacity weigh alpha^(d(d+1)/2) at distance d from the middle."""
    alpha, half = math.exp(-epsilon), capacity // 2
    top = (1.0 - alpha) / (1.0 + alpha - 2.0 * power(alpha, half + 1))
    ratios = accumulate([alpha] * half, lambda a, _: a * alpha)
    arm = list(accumulate(ratios, lambda w, r: w * r, initial=top))
    return [*reversed(arm), *arm[1:]]


def convolved(base: Sequence[float], n: int) -> list[float]:
    """Weights of the sum of n loads."""
    out = list(base)
    for _ in range(n - 1):
        new = [0.0] * (len(out) + len(base) - 1)
        for i, a in enumerate(out):
            if a:
                for j, b in enumerate(base):
                    new[i + j] += a * b
        out = new
    return out


def bin_capacity(cfg: PlanConfig) -> int:
    """Even capacity found by bisection on the weight that all loads together are 0.

    The last probe is returned, whether it passed or not: see ``tail_ok``.
    """
    rate = decay(cfg.security_lambda)
    upper = even_up(math.floor(power(math.log(cfg.security_lambda), 5) / cfg.privacy_epsilon))
    lower = 2
    found = max(lower, upper)
    while lower + 2 < upper:
        found = even_up((lower + upper) // 2)
        if empty_weight(found, cfg, rate) > cfg.privacy_delta:
            lower = found + 2
        else:
            upper = found
    return found


def empty_weight(capacity: int, cfg: PlanConfig, rate: float | None = None) -> float:
    """The first term of the convolution, which is a plain product."""
    n = math.ceil(2.0 / (capacity * (rate or decay(cfg.security_lambda))))
    first = weights(capacity, cfg.privacy_epsilon)[0]
    out = first
    for _ in range(n - 1):
        out *= first
    return out


def tail_ok(capacity: int, cfg: PlanConfig) -> bool:
    return empty_weight(capacity, cfg) <= cfg.privacy_delta


def factor(capacity: int, cfg: PlanConfig) -> float:
    return 2.0 / (capacity * decay(cfg.security_lambda))


def bin_count(rate: float, blocks: int) -> int:
    return math.ceil(rate * _whole(blocks, "blocks", 0)) if blocks else 0


def stream(seed: int, domain: str) -> random.Random:
    return random.Random(int.from_bytes(hashlib.sha256(f"{seed}|{domain}".encode()).digest()[:8], "big"))


def draw(rng: random.Random, ws: Sequence[float], total: float | None = None) -> int:
    sums = list(accumulate(ws))
    return min(bisect_right(sums, rng.random() * (sums[-1] if total is None else total)), len(ws) - 1)


def laplace(rng: random.Random, scale: float) -> float:
    u = rng.random() or 2.0**-53
    return -scale * (1.0 if u > 0.5 else -1.0) * math.log(1.0 - 2.0 * abs(u - 0.5))


def to_uint32(x: float) -> int:
    if not math.isfinite(x):
        raise PlanError("a noisy sum is not finite")
    return int(min(max(x, 0.0), float(UINT32)))


def noisy_prefix_sums(loads: Sequence[int], epsilon: float, capacity: int, rng: random.Random) -> tuple[list[int], int]:
    """Prefix sums with noise on dyadic blocks, made monotone and kept within the capacity of the truth."""
    out, true, error = [0], 0, 0
    open_sums: dict[int, tuple[int, float]] = {}  # exponent of a dyadic block -> its sum, without and with noise
    for t, load in enumerate(loads, 1):
        true += load
        level = (t & -t).bit_length() - 1
        total = load + sum(open_sums.pop(i)[0] for i in range(level))
        open_sums[level] = (total, total + laplace(rng, 1.0 / epsilon))
        noisy = 0.0
        for i in range(t.bit_length()):
            if t >> i & 1:
                noisy += open_sums[i][1]
        value = max(out[-1], to_uint32(noisy))
        value = max(min(value, true + capacity), true - capacity)
        out.append(value)
        error = max(error, abs(true - value))
    return out, error


@dataclass(frozen=True)
class Allocation:
    blocks: int
    capacity: int
    factor: float
    loads: tuple[int, ...]
    prefix: tuple[int, ...]
    error: int
    config: PlanConfig


def allocate(blocks: int, cfg: PlanConfig, sampler: Callable[[], int] | None = None) -> Allocation:
    """Loads for the bins of a run; ``sampler`` stands in for the seeded draws."""
    _whole(blocks, "blocks", 0)
    z = bin_capacity(cfg)
    rate = factor(z, cfg)
    n = bin_count(rate, blocks)
    ws, rng = weights(z, cfg.privacy_epsilon), stream(cfg.seed, LOADS)
    loads = [_whole(sampler(), "a load", 0) if sampler else draw(rng, ws) for _ in range(n)]
    if any(x > z for x in loads):
        raise PlanError("a load exceeds the capacity")
    if sum(loads) < blocks:
        raise ShortCapacity(blocks, sum(loads))
    prefix, error = noisy_prefix_sums(loads, cfg.privacy_epsilon, z, stream(cfg.seed, LAPLACE))
    return Allocation(blocks, z, rate, tuple(loads), tuple(prefix), error, cfg)


def bins(spark: SparkSession, plan: Allocation) -> DataFrame:
    return bin_intervals(spark.createDataFrame([(i, x) for i, x in enumerate(plan.loads)], "bin_index long, sampled_load long"), plan.blocks, plan.capacity)


def uniform(seed: int, domain: str, of: Column) -> Column:
    """A number in [0, 1) for each value, always the same for a seed and a purpose."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}|{domain}"), of), 11) / F.lit(float(1 << 53))


def drawn_loads(spark: SparkSession, blocks: int, cfg: PlanConfig) -> DataFrame:
    """bin_index, sampled_load of a run of any length; raises where the loads hold fewer blocks than it has."""
    z = bin_capacity(cfg)
    sums = list(accumulate(weights(z, cfg.privacy_epsilon)))
    u = uniform(cfg.seed, LOADS, F.col("id")) * sums[-1]
    load = F.least(F.size(F.filter(F.array(*map(F.lit, sums)), lambda w: w <= u)), F.lit(z))
    found = spark.range(bin_count(factor(z, cfg), blocks)).select(F.col("id").alias("bin_index"), load.cast("long").alias("sampled_load"))
    held = found.agg(F.coalesce(F.sum("sampled_load"), F.lit(0))).first()[0]
    if held < blocks:
        raise ShortCapacity(blocks, held)
    return found


def bin_intervals(loads: DataFrame, blocks: int | Column, capacity: int) -> DataFrame:
    """Rank interval, real and padding count of each bin: loads are filled in order until the run ends."""
    blocks = F.lit(blocks) if isinstance(blocks, int) else blocks
    rows = running_total(loads, "bin_index", "sampled_load", "__before")
    rows = rows.withColumn("rank_start", F.least(F.col("__before"), blocks).cast("long"))
    rows = rows.withColumn("real_count", F.least(F.col("sampled_load"), blocks - F.col("rank_start")).cast("long"))
    return rows.select("bin_index", "sampled_load", "rank_start", (F.col("rank_start") + F.col("real_count")).alias("rank_stop"), "real_count", (F.lit(capacity) - F.col("real_count")).cast("long").alias("dummy_count"))


def bind(run: DataFrame, planned: DataFrame) -> DataFrame:
    """The records of the run with their bin: intervals are unrolled to block ranks, and joined on them."""
    of = planned.where("real_count > 0").select("bin_index", F.explode(F.sequence("rank_start", F.col("rank_stop") - 1)).alias("block_rank"))
    return run.join(of, "block_rank")


def interior_index(load: int, epsilon: float, u: float) -> int:
    """The record that a uniform draw picks; record i weighs exp(epsilon)^(min(i, load - i) + 1).

    Weights are taken relative to the greatest, so they never overflow.
    """
    top = load // 2
    ws = [math.exp(epsilon * (min(i, load - i) - top)) for i in range(load)]
    return min(bisect_right(list(accumulate(ws)), u * math.fsum(ws)), load - 1)


def picked_index(load: Column, epsilon: float, u: Column) -> Column:
    """``interior_index`` as a column; a bin holds at most its capacity, which bounds the weights of a row."""
    top = F.floor(load / 2)
    ws = F.transform(F.sequence(F.lit(0).cast("long"), load - 1), lambda i: F.exp(F.lit(epsilon) * (F.least(i, load - i) - top)))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"))
    whole = F.aggregate(ws, F.lit(0.0), lambda a, w: a + w)
    step = lambda a, w: F.struct((a["sum"] + w).alias("sum"), (a["below"] + F.when(a["sum"] + w <= u * whole, 1).otherwise(0)).cast("long").alias("below"))
    return F.least(F.aggregate(ws, start, step, lambda a: a["below"]), load - 1)


def interior_points(bound: DataFrame, planned: DataFrame, side: str, cfg: PlanConfig, pick: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """side, bin_index, is_dummy, key, record_index, signed_tag: one point for each bin.

    Each bin has a draw of its own; ``pick`` (columns of the records of a bin and of the
    uniform draw) replaces the choice.  Bins without records get the dummy.
    """
    place = Window.partitionBy("bin_index").orderBy("key")
    records = bound.select("bin_index", "key", (F.row_number().over(place) - 1).cast("long").alias("record_index"))
    u = uniform(cfg.seed, INTERIOR[side], F.col("bin_index"))
    choose = pick or (lambda n, x: picked_index(n, cfg.privacy_epsilon, x))
    wanted = bound.groupBy("bin_index").agg(F.count("*").alias("n")).select("bin_index", choose(F.col("n"), u).cast("long").alias("record_index"))
    found = planned.select("bin_index").join(records.join(wanted, ["bin_index", "record_index"]), "bin_index", "left")
    tag = (F.col("bin_index") + 1) * (1 if side == "source" else -1)
    return found.select(F.lit(side).alias("side"), "bin_index", F.col("key").isNull().alias("is_dummy"), "key", "record_index", tag.cast("long").alias("signed_tag"))


def tag_order(points: DataFrame) -> DataFrame:
    """Adds position: by key, dummies last, and by signed tag within equals (so targets lead).

    A side has a key once at most, so key and side give one place; no window holds all bins.
    """
    points = settled(points)  # a row for each bin, read several times below
    at = F.when(F.col("is_dummy"), F.col("signed_tag").cast("decimal(38,0)")).otherwise(F.col("key").cast("decimal(20,0)") * 2 + (F.col("signed_tag") > 0).cast("int"))
    rows = ranked(points.withColumn("__at", at), "__at", ("is_dummy",))
    real = points.where("NOT is_dummy").count()
    return rows.withColumn("position", (F.col("rank") + F.when(F.col("is_dummy"), real).otherwise(0)).cast("long")).drop("rank", "__at")


def fetch_order(ordered: DataFrame) -> DataFrame:
    """fetch_no, side, bin_index: first bin 0 of each side, then at the k-th tag of a side its bin k, if there is one."""
    ordered = settled(ordered)
    bins_of = ordered.groupBy("side").agg(F.count("*").alias("n"))  # two rows
    first = bins_of.select("side", F.lit(0).cast("long").alias("bin_index"), F.when(F.col("side") == "source", -2).otherwise(-1).cast("long").alias("at"))
    rest = ranked(ordered, "position", ("side",)).join(F.broadcast(bins_of), "side")
    rest = rest.select("side", (F.col("rank") + 1).alias("bin_index"), F.col("position").alias("at"), "n").where("bin_index < n").drop("n")
    return ranked(first.unionByName(rest), "at").select(F.col("rank").alias("fetch_no"), "side", "bin_index")


@dataclass(frozen=True)
class MergePlan:
    """How a level is merged into the next one: both sides' bins, points and the order in which bins are fetched."""

    source_level: int
    target_level: int
    source_bins: DataFrame
    target_bins: DataFrame
    points: DataFrame
    fetches: DataFrame


def merge_plan(source_level: int, source: DataFrame, target_level: int, target: DataFrame, per_block: int, cfg: PlanConfig) -> MergePlan:
    """The whole plan of two packed runs (key, block_rank) of one block size; only level L and L + 1 merge."""
    check_levels(source_level, target_level)
    planned, parts = {}, []
    for side, run in (("source", settled(source)), ("target", settled(target))):
        blocks, fullest = run.groupBy("block_rank").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("block_rank") + 1, F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if fullest > per_block:
            raise PlanError(f"a block of the {side} holds {fullest} records, not {per_block} at most")
        planned[side] = bin_intervals(drawn_loads(run.sparkSession, blocks, cfg), blocks, bin_capacity(cfg))
        parts.append(interior_points(bind(run, planned[side]), planned[side], side, cfg))
    points = settled(tag_order(parts[0].unionByName(parts[1])))
    return MergePlan(source_level, target_level, planned["source"], planned["target"], points, fetch_order(points))


def plan_violations(planned: DataFrame, blocks: int, capacity: int) -> DataFrame:
    """bin_index, fault: bins that overlap, leave a gap or exceed the capacity; bin_index -1 where blocks are left over."""
    rows = planned.select("bin_index", "rank_start", "rank_stop", "real_count", "dummy_count")
    after = rows.select((F.col("bin_index") - 1).alias("bin_index"), F.col("rank_start").alias("next_start"))
    joined = rows.join(after, "bin_index", "left")
    fault = F.when(F.expr("real_count < 0 OR dummy_count < 0 OR rank_stop - rank_start <> real_count"), "count").when(F.expr(f"real_count + dummy_count <> {capacity}"), "capacity")
    fault = fault.when(F.expr(f"coalesce(next_start, {blocks}) <> rank_stop"), "gap or overlap")
    return joined.select("bin_index", fault.alias("fault")).where("fault IS NOT NULL")


def fetch_violations(fetches: DataFrame, points: DataFrame) -> DataFrame:
    """side, bin_index, times of bins that are not fetched exactly once."""
    wanted = points.select("side", "bin_index").distinct()
    seen = fetches.groupBy("side", "bin_index").agg(F.count("*").alias("times"))
    return wanted.join(seen, ["side", "bin_index"], "full_outer").select("side", "bin_index", F.coalesce("times", F.lit(0)).alias("times")).where("times <> 1")


def totals(planned: DataFrame, capacity: int) -> DataFrame:
    return planned.agg(
        F.count("*").alias("bins"), F.sum("sampled_load").alias("sampled_capacity"), (F.count("*") * capacity).alias("planned_slots"),
        F.sum("dummy_count").alias("dummy_count"), F.sum("real_count").alias("covered_ranks"),
    )
