"""Document quality: a factorisation machine over words, structure and metadata.

Features of a text are its hashed words (relative frequencies), a dozen
structure statistics (case, symbols, repetition, line shape), its length, and
what the table says about it (``n_chars``: its size, whether it is given, whether
it is true).  The score is the logistic of

    w0 + sum_j w_j x_j + 1/2 sum_f [ (sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2 ]

so all pairwise interactions cost time linear in the features of a text.  The
machine is trained by AdaGrad in numpy on a bounded sample of labelled rows.

Defined cases: a null text scores as an empty one; an empty text has a zero
feature vector but for its metadata; a table without ``n_chars`` has none given.
Labels outside 0 and 1 or null are not
learned from.  With no labelled row every score is 0.5; with one class only,
scores follow that class.  Repeated rows get equal scores.  Texts are read whole,
in training too: executors send features, not texts, to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import fields, fold, held_out, in_batches, schema_of, text_at, text_of, unit_hash, with_row


@dataclass(frozen=True)
class QualityConfig:
    """The labelled sample fitted on the driver has at most 1.25 * ``train_rows`` rows of at most ``buckets`` words."""

    buckets: int = 1 << 14
    rank: int = 6
    train_rows: int = 4000
    epochs: int = 12
    rate: float = 0.15
    decay: float = 1e-5
    folds: int = 3
    seed: int = 11


STATS = ("upper", "digit", "symbol", "bar", "spaces", "high", "word_length", "short_words", "distinct", "repeats", "lines", "line_repeats", "ends", "caps_words", "log_chars", "log_words", "said_chars", "said_none", "said_wrong")

# byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 bar, 7 other symbol, 8 beyond ASCII
_CLASS = np.zeros(256, np.uint8)
_CLASS[[c for c in range(33, 127)]] = 7
_CLASS[[c for c in range(97, 123)]] = 1
_CLASS[[c for c in range(65, 91)]] = 2
_CLASS[[c for c in range(48, 58)]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
_CLASS[ord("|")] = 6
_CLASS[128:] = 8


class Buckets(dict):
    """word -> hashed bucket, emptied when it grows."""

    LIMIT = 300_000

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        found = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.n
        if len(word) <= 64:
            self[word] = found
        return found


def features(text: str | None, said: int | None, seen: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Ids and values of the features of a text, whose table says that it has ``said`` characters.

    Structure statistics and metadata follow the word buckets.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    stats = np.zeros(len(STATS))
    by = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) if raw else np.zeros(9)
    n, words = max(1, len(raw)), text.split()
    letters = max(1, by[1] + by[2] + by[8])
    stats[:6] = by[2] / letters, by[3] / n, by[7] / n, by[6] / n, by[4] / n, by[8] / n
    ids, counts = np.zeros(0, np.int64), np.zeros(0)
    if words:
        hashed = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        ids, counts = np.unique(hashed, return_counts=True)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        lines = text.split("\n")
        stats[6] = min(lengths.mean(), 40) / 10
        stats[7] = (lengths <= 3).mean()
        stats[8] = len(ids) / min(len(words), seen.n)
        stats[9] = (hashed[1:] == hashed[:-1]).mean() if len(words) > 1 else 0
        stats[10] = min(1, 10 * len(lines) / len(words))
        stats[11] = 1 - len(set(lines)) / len(lines)
        stats[12] = min(1.0, 10 * by[5] / len(words))
        stats[13] = sum(map(str.isupper, words)) / len(words)
    stats[14], stats[15] = np.log1p(len(text)) / 12, np.log1p(len(words)) / 10
    stats[16:] = np.log1p(max(0, said or 0)) / 12, said is None, said is not None and said != len(text)
    values = counts / np.sqrt((counts**2).sum()) if len(counts) else counts
    return np.concatenate([ids, seen.n + np.arange(len(STATS))]), np.concatenate([values, stats])


@dataclass(frozen=True)
class FactorisationMachine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, ids: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[ids] * x[:, None]
        s = vx.sum(0)
        return float(self.w0 + self.w[ids] @ x + 0.5 * ((s * s).sum() - (vx * vx).sum()))

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(ids, x), -30, 30))))


def train(data: list[tuple[np.ndarray, np.ndarray, int]], cfg: QualityConfig) -> FactorisationMachine:
    """Fit on (ids, values, label) rows."""
    rng = np.random.default_rng(cfg.seed)
    size = cfg.buckets + len(STATS)
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, cfg.rank))
    if not data:
        return FactorisationMachine(0.0, w, np.zeros_like(v))
    ones = sum(y for *_, y in data)
    w0 = float(np.log((ones + 0.5) / (len(data) - ones + 0.5)))
    g0, gw, gv = 1e-6, np.full(size, 1e-6), np.full((size, cfg.rank), 1e-6)
    for _ in range(cfg.epochs):
        for i in rng.permutation(len(data)):
            ids, x, y = data[i]
            vi = v[ids]
            vx = vi * x[:, None]
            s = vx.sum(0)
            z = w0 + w[ids] @ x + 0.5 * ((s * s).sum() - (vx * vx).sum())
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            dw = d * x + cfg.decay * w[ids]
            dv = d * (x[:, None] * s - vx * x[:, None]) + cfg.decay * vi
            g0 += d * d
            gw[ids] += dw * dw
            gv[ids] += dv * dv
            w0 -= cfg.rate * d / np.sqrt(g0)
            w[ids] -= cfg.rate * dw / np.sqrt(gw[ids])
            v[ids] -= 0.3 * cfg.rate * dv / np.sqrt(gv[ids])
    return FactorisationMachine(float(w0), w, v)


def _said(docs: DataFrame) -> Column:
    return (docs["n_chars"] if "n_chars" in docs.columns else F.lit(None)).cast("long")


def sample_labelled(docs: DataFrame, labels: DataFrame, cfg: QualityConfig) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and labels of a bounded sample of labelled texts outside the held-out fold, spread over both classes."""
    marks = fields(labels, "doc_id", "quality").where("quality IN (0, 1)")
    marks = marks.where(fold(marks.doc_id, cfg.folds) != 1)
    counts = {r["quality"]: r["count"] for r in marks.groupBy("quality").count().collect()}
    total = sum(counts.values())
    if not total:
        return []
    chance = unit_hash(F.col("doc_id"), f"quality{cfg.seed}")
    limit = cfg.train_rows + cfg.train_rows // 4
    picked = marks.withColumn("chance", chance).where(F.col("chance") < cfg.train_rows / total)
    picked = picked.orderBy("chance", "doc_id", "quality").limit(limit)
    # the sample has at most 1.25 train_rows rows of three numbers: that bounds the broadcast
    texts = docs.select(docs["doc_id"], docs["text"], _said(docs).alias("said")).join(F.broadcast(picked), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Buckets(cfg.buckets)
        for batch in batches:
            found = [features(t.as_py(), n.as_py(), seen) for t, n in zip(batch.column("text"), batch.column("said"), strict=True)]
            ids = [i.astype(np.uint32).tobytes() for i, _ in found]
            values = [x.astype(np.float32).tobytes() for _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column("chance"), batch.column("quality").cast(pa.int32()), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], ["chance", "quality", "ids", "values"])

    found = in_batches(texts.select("chance", "quality", "text", "said"), work, "chance double, quality int, ids binary, values binary")
    rows = found.orderBy("chance", "quality", "ids", "values").limit(limit).collect()
    return [(np.frombuffer(r["ids"], np.uint32), np.frombuffer(r["values"], np.float32), r["quality"]) for r in rows]


def assess(docs: DataFrame, labels: DataFrame, cfg: QualityConfig | None = None, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted; with ``carry`` also the input row as a struct, ``row``."""
    cfg = cfg or QualityConfig()
    model = train(sample_labelled(docs, labels, cfg), cfg)
    rows = with_row(docs, carry, doc_id=docs["doc_id"], held_out=held_out(docs["doc_id"], cfg.folds), said=_said(docs))
    names, at = ["doc_id", "held_out", *(["row"] if carry else [])], text_at(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Buckets(cfg.buckets)
        for batch in batches:
            score = [model.score(*features(t.as_py(), n.as_py(), seen)) for t, n in zip(text_of(batch, at), batch.column("said"), strict=True)]
            cols = [batch.column(n) for n in names]
            cols += [pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "score", "predicted"])

    out = in_batches(rows, work, schema_of(rows, names, "score double, predicted int"))
    return out.select("doc_id", "held_out", "score", "predicted", *names[2:])
