"""Resumable merges and online indexes.

``ResumableMerge`` advances a newer-wins merge by a budget of output records.
``stream_index`` runs the index builder as a stateful streaming query: each
micro-batch of keys extends the open hull of its level, which is the state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataline.operators import merge, runs
from strataline.plans.pgm import IndexBuilder
from strataline.session import settled


class NotDone(RuntimeError):
    pass


class ResumableMerge:
    """begin, advance(q) until done, finalize.

    Decision r is the record of rank r of the merge, so a step is a range of
    ranks; nothing but the number of decisions is carried from step to step.
    """

    def __init__(self, source_level: int, source: DataFrame, target_level: int, target: DataFrame, capacity: int, sink: Callable[[DataFrame], None] | None = None):
        merge.check_levels(source_level, target_level)
        self.capacity, self.sink = capacity, sink
        # merged once: every step reads the same table
        self.states = settled(merge.cursors(merge.newer_wins(source, target), capacity, 1, ("value", "rank")))
        self.records = runs.packed(self.states.select("key", "value", "rank"), capacity)
        self.total = self.states.count()
        self.decided = self.emitted = 0

    @property
    def done(self) -> bool:
        return self.decided == self.total

    def advance(self, budget: int) -> dict:
        """At most ``budget`` more decisions; after the last one, nothing happens any more."""
        if isinstance(budget, bool) or not isinstance(budget, int) or budget < 1:
            raise ValueError("a step decides one record at least")
        was = self.decided
        self.decided = min(self.total, was + budget)
        ready = self.total if self.done else self.decided - self.decided % self.capacity
        if self.sink and ready > self.emitted:
            self.sink(self.records.where((F.col("rank") >= self.emitted) & (F.col("rank") < ready)))
        self.emitted = max(self.emitted, ready)
        return self.progress()

    def progress(self) -> dict:
        """Cursors, records and blocks out, and records pending: fewer than a block, whatever the runs' size."""
        at = self.states.where(F.col("r") == self.decided).head() if self.decided else None
        return {"i": at["i"] if at else 0, "j": at["j"] if at else 0, "r": self.decided, "blocks": -(-self.emitted // self.capacity), "pending": self.decided - self.emitted, "done": self.done}

    def state_report(self) -> dict:
        """What is carried from step to step, and what bounds it."""
        at = self.progress()
        return {"pending": at["pending"], "pending_bound": self.capacity - 1, "cursors": 3, "bounded": at["pending"] < self.capacity}

    def finalize(self) -> DataFrame:
        if not self.done:
            raise NotDone(f"{self.total - self.decided} records are undecided")
        return self.records


OUT = "level int, n long, segments long, hull_points long"


def stream_index(keys: DataFrame, epsilon: int) -> DataFrame:
    """level, n, segments, hull_points after each micro-batch of a stream of (level, key).

    Keys of a level must rise from batch to batch; within one they are sorted, in the
    memory of a task: ``maxFilesPerTrigger`` and its like bound a batch.  The state is
    the open hull and a count of closed segments, whatever has streamed through.
    """

    def step(level: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        builder, closed = pickle.loads(state.get[0]) if state.exists else (IndexBuilder(epsilon), 0)
        for k in sorted(k for pdf in batches for k in pdf["key"].tolist()):
            builder.add(k)
        closed += len(builder.drain())
        state.update((pickle.dumps((builder, closed)),))
        yield pd.DataFrame({"level": [level[0]], "n": [builder.n], "segments": [closed + (builder.n > 0)], "hull_points": [builder.open.state_points]})

    rows = keys.select(F.col("level").cast("int").alias("level"), F.col("key").cast("long").alias("key"))
    return rows.groupBy("level").applyInPandasWithState(step, OUT, "builder binary", "update", GroupStateTimeout.NoTimeout)
