"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is the mean of the embeddings of its character n-grams, and a linear
softmax on that mean gives a probability per language.  Both are trained by
stochastic gradient descent in numpy on a bounded sample.  Because the model is
linear in the embeddings, the trained tables fold into one (bucket x language)
table of logits, and that small table is all the executors need.  With many
languages the two tables stay apart: there is no bound on their number.

A temperature fitted on a part of the sample that training has not seen
calibrates the probabilities; on the same part a rejection threshold is set so
that at most ``reject_rate`` of the rightly labelled texts fall below it.

Defined cases: null text, empty text or a text without letters gives ``und``,
score 0 and ``rejected``.  A null id is never held out and never trained on.
Repeated rows get equal predictions.  With no labelled row every text is ``und``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import fields, fold, held_out, in_batches, schema_of, text_at, text_of, unit_hash, with_row

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageConfig:
    """The model is fitted on the driver, on at most 1.25 * max(``train_rows``, ``least_rows`` for each language)
    texts, of each of which at most ``train_grams`` n-grams, drawn from the whole text, are used."""

    buckets: int = 1 << 15
    dim: int = 16
    min_n: int = 1
    max_n: int = 4
    train_rows: int = 2000
    least_rows: int = 4
    train_grams: int = 8000
    #: up to so many languages, embeddings and softmax are folded into one table of logits
    folded: int = 64
    epochs: int = 4
    least_steps: int = 2000  # a small sample is gone through more often
    step_grams: int = 1500
    rate: float = 8.0
    reject_rate: float = 0.001
    reject_ceiling: float = 0.5
    folds: int = 3
    seed: int = 7

    @property
    def gram_type(self) -> np.dtype:
        """The smallest integers that number the buckets: grams of the whole sample are held at once."""
        return np.min_scalar_type(self.buckets - 1)


_ALPHA: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point, whether it is a letter (surrogates are not)."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def grams(text: str, cfg: LanguageConfig) -> Iterator[np.ndarray]:
    """Buckets of the character n-grams of the words of a text, in blocks.

    Only letters count; a space stands for either end of a word, and a gram may
    have one at its ends only.  Nothing comes of a text without letters.
    """
    codes = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = codes[letter | (codes == 32)]
    if not letter.any():
        return
    space = np.concatenate([[0], np.cumsum(codes == 32)])
    codes = codes.astype(np.uint64)
    for a in range(0, len(codes), 1 << 18):
        block = codes[a : a + (1 << 18) + cfg.max_n - 1]
        h = np.zeros(len(block), np.uint64)
        for n in range(1, cfg.max_n + 1):
            last = min(1 << 18, len(block) - n + 1)
            if last <= 0:
                break
            h = h[:last] * np.uint64(0x9E3779B97F4A7C15) + block[n - 1 : n - 1 + last]
            i = a + np.arange(last)
            inner = space[i + n - 1] - space[i + 1] if n > 1 else 0
            good = (space[i + n] - space[i] < min(n, 3)) & (inner == 0)
            if n >= cfg.min_n:
                mixed = h[good] * np.uint64(0xD6E8FEB86659FD93)
                yield ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(cfg.buckets)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # bucket x language logits, or bucket x dimension embeddings where ``out`` is set
    out: np.ndarray | None
    bias: np.ndarray
    temperature: float
    threshold: float
    cfg: LanguageConfig

    def probabilities(self, total: np.ndarray, n: float) -> np.ndarray:
        mean = total / n
        z = ((mean if self.out is None else mean @ self.out) + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def drawn_grams(text: str, doc_id: str, cfg: LanguageConfig) -> np.ndarray:
    """The n-grams of a whole text, or ``train_grams`` of them drawn by a seed of the id."""
    found = list(grams(text, cfg))
    ids = np.concatenate(found) if found else np.zeros(0, np.int64)
    if len(ids) > cfg.train_grams:
        ids = ids[np.random.default_rng([cfg.seed, zlib.crc32(doc_id.encode("utf-8", "surrogatepass"))]).integers(0, len(ids), cfg.train_grams)]
    return ids.astype(cfg.gram_type)


def train(rows: list[tuple[np.ndarray, str]], cfg: LanguageConfig) -> LanguageModel | None:
    """Fit on (n-gram buckets, label) rows; None if there is nothing to fit."""
    rng = np.random.default_rng(cfg.seed)
    labels = sorted({y for _, y in rows})
    number = {y: i for i, y in enumerate(labels)}
    data = [(ids, number[y]) for ids, y in rows if len(ids)]
    if not data:
        return None
    order = rng.permutation(len(data))
    cut = max(1, len(data) // 5) if len(data) >= 10 else 0
    calibration, training = [data[i] for i in order[:cut]], [data[i] for i in order[cut:]]
    emb = rng.normal(0, 1 / cfg.dim, (cfg.buckets, cfg.dim))
    out, bias = np.zeros((cfg.dim, len(labels))), np.zeros(len(labels))
    epochs = max(cfg.epochs, -(-cfg.least_steps // len(training)))
    steps, done = epochs * len(training), 0
    for _ in range(epochs):
        for i in rng.permutation(len(training)):
            ids, y = training[i]
            if len(ids) > cfg.step_grams:
                ids = ids[rng.integers(0, len(ids), cfg.step_grams)]
            mean = emb[ids].mean(0)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            rate = cfg.rate * (1 - done / steps)
            back = out @ p
            out -= 0.1 * rate * np.outer(mean, p)
            bias -= 0.01 * rate * p
            np.subtract.at(emb, ids, (rate / len(ids)) * back)
            done += 1
    zs = np.array([emb[ids].mean(0) @ out + bias for ids, _ in calibration or training])
    ys = np.array([y for _, y in calibration or training])

    def log_p(t: float) -> np.ndarray:
        s = zs / t
        s = s - s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))

    each = np.arange(len(ys))
    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -log_p(t)[each, ys].mean())
    best = np.exp(log_p(temperature))
    right = np.sort(best.max(1)[best.argmax(1) == ys])
    threshold = min(cfg.reject_ceiling, float(np.quantile(right, cfg.reject_rate))) if len(right) else 0.0
    if len(labels) <= cfg.folded:
        return LanguageModel(labels, (emb @ out).astype(np.float32), None, bias, float(temperature), threshold, cfg)
    return LanguageModel(labels, emb.astype(np.float32), out, bias, float(temperature), threshold, cfg)


def predict_text(text: str | None, model: LanguageModel) -> tuple[str, float, bool]:
    total, n = np.zeros(model.table.shape[1]), 0
    for ids in grams(text or "", model.cfg):
        total += model.table[ids].sum(0, dtype=np.float64)
        n += len(ids)
    if not n:
        return UNDETERMINED, 0.0, True
    p = model.probabilities(total, n)
    k = int(p.argmax())
    return model.labels[k], float(p[k]), bool(p[k] < model.threshold)


def sample_labelled(docs: DataFrame, cfg: LanguageConfig) -> list[tuple[np.ndarray, str]]:
    """n-grams and labels of a bounded sample of labelled texts, as evenly from the languages as they allow.

    The driver holds one count for each language, and the sample.
    """
    rows = fields(docs, "doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.where(fold(rows.doc_id, cfg.folds) != 1)
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return []
    share = max(cfg.train_rows / len(counts), cfg.least_rows)
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, share / r["count"])) for r in counts], "lang string, rate double")
    chance = unit_hash(F.col("doc_id"), f"language{cfg.seed}")
    picked = rows.join(F.broadcast(rates), "lang").withColumn("chance", chance).where("chance < rate")  # one row for each language
    picked = picked.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "chance")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [drawn_grams(t.as_py(), str(i.as_py()), cfg).tobytes() for t, i in zip(batch.column("text"), batch.column("doc_id"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("chance"), batch.column("doc_id"), batch.column("lang"), pa.array(ids, pa.binary())], ["chance", "doc_id", "lang", "grams"])

    found = in_batches(picked, work, "chance double, doc_id string, lang string, grams binary")
    found = found.orderBy("chance", "doc_id", "lang", "grams").limit(math.ceil(1.25 * share * len(counts))).collect()
    return [(np.frombuffer(r["grams"], cfg.gram_type), r["lang"]) for r in found]


def identify(docs: DataFrame, cfg: LanguageConfig | None = None, carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; with ``carry`` also the input row as a struct, ``row``."""
    cfg = cfg or LanguageConfig()
    model = train(sample_labelled(docs, cfg), cfg)
    rows = with_row(docs, carry, doc_id=docs["doc_id"], held_out=held_out(docs["doc_id"], cfg.folds))
    names, at = ["doc_id", "held_out", *(["row"] if carry else [])], text_at(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [predict_text(t.as_py(), model) if model else (UNDETERMINED, 0.0, True) for t in text_of(batch, at)]
            cols = [batch.column(n) for n in names]
            cols += [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "lang_pred", "score", "rejected"])

    out = in_batches(rows, work, schema_of(rows, names, "lang_pred string, score double, rejected boolean"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected", *names[2:])
