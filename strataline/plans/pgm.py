"""An exact piecewise-linear index of keys to ranks, with error at most epsilon.

A segment is the longest run of keys through whose bands
[max(0, rank - epsilon), rank + epsilon] one line passes.  A line through bands
exists when the least slope that any pair of keys asks for is no greater than
the greatest slope that any pair allows; both bounds are kept as the keys
arrive, with the convex hulls of the lower and of the upper band ends, so a key
costs the logarithm of the hull.  The line of the greatest slope is the model.
The rank of a key that several rows have is that of the first of them, its lower bound;
the key after it, where no row has it, is a point too, with the rank behind the last:
all keys in the gap have that lower bound, which a line over one large step would miss.
All arithmetic is on Python's integers, which do not overflow.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions.exact import round_div, trunc_div
from strataline.operators.lookup import rightmost

Point = tuple[int, int]


class KeyOrder(ValueError):
    pass


def _steeper(a: Point, b: Point) -> bool:
    """Whether slope a is above slope b; slopes are (rise, run) with run > 0."""
    return a[0] * b[1] > b[0] * a[1]


def _slope(p: Point, q: Point) -> Point:
    return q[1] - p[1], q[0] - p[0]


@dataclass(frozen=True)
class Segment:
    """start_key, start_rank and the rounded line; the certificate is the unrounded line.

    start_key may be the key after a repeated one.  end_key is a row's, end_rank that of its last row.
    """

    start_key: int
    start_rank: int
    slope_num: int
    slope_den: int
    intercept: int
    end_key: int
    end_rank: int
    origin_num: int
    denominator: int

    def predict(self, key: int) -> int:
        return max(0, trunc_div(self.slope_num * (key - self.start_key), self.slope_den) + self.intercept)

    def certifies(self, key: int, rank: int, epsilon: int) -> bool:
        line = self.slope_num * (key - self.start_key) + self.origin_num
        return max(0, rank - epsilon) * self.denominator <= line <= (rank + epsilon) * self.denominator


@dataclass
class BandFitter:
    """The open segment: hulls of the band ends, and the tightest slopes with the pairs that give them."""

    epsilon: int
    low: list[Point] = field(default_factory=list)  # concave hull of the lower ends
    high: list[Point] = field(default_factory=list)  # convex hull of the upper ends
    least: tuple[Point, Point] | None = None
    most: tuple[Point, Point] | None = None
    first: Point | None = None
    last: Point | None = None

    def add(self, key: int, rank: int) -> bool:
        """Takes the key in, or leaves all as it is and says no."""
        lo, hi = (key, max(0, rank - self.epsilon)), (key, rank + self.epsilon)
        least, most = self.least, self.most
        if self.first is not None:
            up = self._touch(self.low, hi, below=True)
            down = self._touch(self.high, lo, below=False)
            if most is None or _steeper(_slope(*most), _slope(up, hi)):
                most = (up, hi)
            if least is None or _steeper(_slope(down, lo), _slope(*least)):
                least = (down, lo)
            if _steeper(_slope(*least), _slope(*most)):
                return False
        self.least, self.most = least, most
        self.first = self.first or (key, rank)
        self.last = (key, rank)
        self._push(self.low, lo, -1)
        self._push(self.high, hi, 1)
        return True

    @staticmethod
    def _touch(hull: list[Point], p: Point, below: bool) -> Point:
        """The hull point from which the slope to p is least (to upper ends) or greatest (to lower ends)."""
        a, z = 0, len(hull) - 1
        while a < z:
            m = (a + z) // 2
            here, there = _slope(hull[m], p), _slope(hull[m + 1], p)
            if _steeper(here, there) if below else _steeper(there, here):
                a = m + 1
            else:
                z = m
        return hull[a]

    @staticmethod
    def _push(hull: list[Point], p: Point, turn: int) -> None:
        while len(hull) > 1:
            (x0, y0), (x1, y1) = hull[-2:]
            if turn * ((x1 - x0) * (p[1] - y0) - (y1 - y0) * (p[0] - x0)) > 0:
                break
            hull.pop()
        hull.append(p)

    def close(self) -> Segment:
        (k0, r0), (k1, r1) = self.first, self.last
        if self.most is None:
            lo, hi = self.low[0][1], self.high[0][1]
            return Segment(k0, r0, 0, 1, (lo + hi) // 2, k1, r1, lo + hi, 2)
        (x, y), _ = self.most
        num, den = _slope(*self.most)
        return Segment(k0, r0, num, den, round_div(num * (k0 - x), den) + y, k1, r1, num * (k0 - x) + y * den, den)

    @property
    def state_points(self) -> int:
        return len(self.low) + len(self.high)


class IndexBuilder:
    """Takes keys in any number of steps; the segments do not depend on the steps."""

    def __init__(self, epsilon: int):
        if isinstance(epsilon, bool) or not isinstance(epsilon, int) or epsilon < 0:
            raise ValueError(f"epsilon must be a whole number from 0, not {epsilon!r}")
        self.epsilon, self.done, self.n, self.last, self.copies = epsilon, [], 0, None, 0
        self.open = BandFitter(epsilon)

    def add(self, key: int, copies: int = 1) -> None:
        """Takes the key in, with the number of rows that have it."""
        if self.last is not None and key <= self.last:
            raise KeyOrder(f"key {key} after {self.last}")
        if self.copies > 1 and key > self.last + 1:
            end = self.open.last
            if self._joins(self.last + 1, self.n):
                self.open.last = end
        self._joins(key, self.n)
        self.open.last = (key, self.n + copies - 1)
        self.last, self.copies, self.n = key, copies, self.n + copies

    def _joins(self, key: int, rank: int) -> bool:
        """Whether the open segment takes the point; else the point opens the next one."""
        if self.open.add(key, rank):
            return True
        self.done.append(self.open.close())
        self.open = BandFitter(self.epsilon)
        self.open.add(key, rank)
        return False

    def drain(self) -> list[Segment]:
        """The segments closed since the last call; the builder keeps the open one alone."""
        out, self.done = self.done, []
        return out

    def extend(self, keys: Iterable[int]) -> IndexBuilder:
        for k in keys:
            self.add(k)
        return self

    def diagnostics(self) -> dict:
        """The open segment: its first rank, the keys it spans, and the hull points that it holds."""
        first = self.open.first
        return {"start_rank": first[1] if first else None, "active_span": self.n - first[1] if first else 0, "hull_points": self.open.state_points}

    def index(self) -> Index:
        return Index(self.epsilon, self.n, [*self.done, self.open.close()] if self.n else [], self.last)


@dataclass
class Index:
    epsilon: int
    n: int
    segments: list[Segment]
    last_key: int | None = None

    def search(self, key: int) -> tuple[int, int, int]:
        """(position, lo, hi): the lower bound of the key is within [lo, hi]."""
        if not self.n or key < self.segments[0].start_key:
            pos = 0
        elif key > self.last_key:
            pos = self.n
        else:
            i = bisect_right(self.segments, key, key=lambda s: s.start_key) - 1
            cap = self.segments[i + 1].intercept if i + 1 < len(self.segments) else self.n
            pos = min(max(0, min(self.segments[i].predict(key), cap)), self.n)
        return pos, max(0, pos - self.epsilon), min(self.n, pos + self.epsilon + 2)


def build(keys: Iterable[int], epsilon: int) -> Index:
    return IndexBuilder(epsilon).extend(keys).index()


SEGMENT_SCHEMA = "level int, epsilon int, segment int, start_key decimal(38,0), start_rank long, slope_num decimal(38,0), slope_den decimal(38,0), intercept decimal(38,0), end_key decimal(38,0), end_rank long, origin_num decimal(38,0), denominator decimal(38,0)"


def build_levels(runs: DataFrame, epsilon: int) -> DataFrame:
    """Segments of every level of (level, key); ``n`` counts its rows, and keys may be repeated.

    Where a segment begins depends on all keys before it, so a level is one task's
    work; levels run in parallel.  The keys of a level stream through in order, in
    batches, and segments leave with the batch that closes them: the open hull is all
    that is held, never the run or its segments.
    """
    rows = runs.select(F.col("level").cast("int").alias("level"), F.col("key").cast("long").alias("key"))
    sizes = rows.groupBy("level").agg(F.count("*").alias("n"))
    counted = rows.groupBy("level", "key").agg(F.count("*").alias("copies"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, builder, number = None, None, 0
        for pdf in batches:
            out = []
            for lv, key, copies in zip(pdf["level"].tolist(), pdf["key"].tolist(), pdf["copies"].tolist(), strict=True):
                if lv != level:
                    out += of(level, number, builder.index().segments if builder else [])
                    level, builder, number = lv, IndexBuilder(epsilon), 0
                builder.add(key, copies)
            if builder is not None:
                closed = builder.drain()
                out += of(level, number, closed)
                number += len(closed)
            if out:
                yield table(out)
        if builder is not None:
            yield table(of(level, number, builder.index().segments))

    def of(level: int | None, first: int, segments: list[Segment]) -> list[tuple]:
        return [(level, epsilon, first + i, s.start_key, s.start_rank, s.slope_num, s.slope_den, s.intercept, s.end_key, s.end_rank, s.origin_num, s.denominator) for i, s in enumerate(segments)]

    names = [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")]
    wide = {"start_key", "slope_num", "slope_den", "intercept", "end_key", "origin_num", "denominator"}

    def table(out: list[tuple]) -> pd.DataFrame:
        from decimal import Decimal

        return pd.DataFrame([[Decimal(v) if c in wide else v for c, v in zip(names, r, strict=True)] for r in out], columns=names)

    found = counted.repartition("level").sortWithinPartitions("level", "key").mapInPandas(work, SEGMENT_SCHEMA)
    return found.join(F.broadcast(sizes), "level").select(*names, "n")  # a row for each level


def index_of(segments: DataFrame, epsilon: int) -> Index:
    """The segments of one level as an index on the driver, for lookups key by key."""
    rows = segments.orderBy("segment").collect()
    found = [Segment(*(int(r[c]) for c in ("start_key", "start_rank", "slope_num", "slope_den", "intercept", "end_key", "end_rank", "origin_num", "denominator"))) for r in rows]
    return Index(epsilon, rows[0]["n"] if rows else 0, found, found[-1].end_key if found else None)


def search_rows(queries: DataFrame, segments: DataFrame) -> DataFrame:
    """level, key, pos, lo, hi for queries (level, key).

    Keys meet the segments in ranges of the key; segments are no larger a table than the
    run, and none of them passes through the driver.  Lines are followed in decimals of
    38 digits: ranks of up to 18 digits times keys of up to 20.
    """
    asked = queries.select(F.col("level").cast("int").alias("level"), F.col("key").cast("long").alias("key"))
    starts = segments.select("level", F.col("start_key").cast("long").alias("key"))
    at = rightmost(asked.distinct(), starts, ("level",)).select("level", "key", F.col("at").alias("segment"))
    follows = segments.select("level", (F.col("segment") - 1).alias("segment"), F.col("intercept").alias("next_intercept"))
    found = at.join(segments.drop("n", "epsilon"), ["level", "segment"], "left").join(follows, ["level", "segment"], "left")
    sizes = segments.groupBy("level").agg(F.max("n").alias("n"), F.max("epsilon").alias("epsilon"), F.max(F.col("end_key")).alias("last_key"))
    found = found.join(F.broadcast(sizes), "level", "left")  # a row for each level
    key = F.col("key").cast("decimal(20,0)")
    cap = F.coalesce("next_intercept", F.col("n").cast("decimal(38,0)"))
    line = F.expr("slope_num * CAST(CAST(key AS decimal(20,0)) - CAST(start_key AS decimal(20,0)) AS decimal(20,0))")
    beyond = line >= F.expr("slope_den * CAST(coalesce(next_intercept, CAST(n AS decimal(38,0))) - intercept + 1 AS decimal(19,0))")
    followed = F.when(beyond, cap).otherwise(F.least(F.greatest(F.lit(0), F.when(~beyond, F.expr(LINE)) + F.col("intercept")), cap))
    pos = F.when(F.col("n").isNull() | F.col("start_key").isNull(), 0).when(key > F.col("last_key"), F.col("n")).otherwise(F.least(F.greatest(followed, F.lit(0)), F.col("n")))
    found = found.select("level", "key", pos.cast("long").alias("pos"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("epsilon", F.lit(0)).alias("epsilon"))
    found = found.select("level", "key", "pos", F.greatest(F.lit(0), F.col("pos") - F.col("epsilon")).cast("long").alias("lo"), F.least("n", F.col("pos") + F.col("epsilon") + 2).cast("long").alias("hi"))
    return asked.join(found, ["level", "key"])


# the whole quotient of a line that ends below its cap
LINE = "CAST((slope_num * CAST(CAST(key AS decimal(20,0)) - CAST(start_key AS decimal(20,0)) AS decimal(20,0))) div slope_den AS decimal(20,0))"


def band_violations(ranked_runs: DataFrame, segments: DataFrame, epsilon: int) -> DataFrame:
    """Keys whose rank is off the certified line of their segment by more than epsilon, by exact decimals.

    The rank of a repeated key is its first row's, and those of its other rows must follow.  Keys meet the segments in ranges of the key.
    """
    rows = ranked_runs.groupBy(F.col("level").cast("int").alias("level"), "key").agg(F.min("rank").alias("rank"), (F.max("rank") - F.min("rank") + 1 != F.count("*")).alias("apart"))
    at = rightmost(rows.select("level", "key"), segments.select("level", F.col("start_key").cast("long").alias("key")), ("level",))
    at = at.select("level", "key", F.col("at").alias("segment"))
    s = segments.select("level", "segment", "start_key", "slope_num", "origin_num", "denominator")
    joined = rows.join(at, ["level", "key"]).join(s, ["level", "segment"])
    line = F.expr("slope_num * CAST(CAST(key AS decimal(20,0)) - CAST(start_key AS decimal(20,0)) AS decimal(20,0)) + origin_num")
    return joined.where(F.col("apart") | (F.expr(f"CAST(greatest(0, rank - {epsilon}) AS decimal(19,0)) * denominator") > line) | (line > F.expr(f"CAST(rank + {epsilon} AS decimal(19,0)) * denominator"))).select("level", "key", "rank")
