"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases level by level.  On each level, runs of one
symbol are joined; deterministic coin tossing (the place and value of the
lowest bit in which a name differs from its left neighbour's, four times over)
shrinks the names to labels below six, neighbours staying different; a phrase
begins at each local maximum of the labels.  The name of a phrase is a 64-bit
hash of its symbols, and the phrase names are the symbols of the next level.
Where a phrase begins depends on a few neighbours only, so equal substrings get
equal phrases, away from their ends, wherever they stand.

The fingerprint keeps, for each of several levels, a hash of the least hash of the
names in every of a few classes; the share of agreeing registers estimates how much
of two texts' phrases agree.

Defined cases: a null text is an empty one; an empty text has the empty
fingerprint, like 1 to itself and 0 to others.  Equal texts have equal
fingerprints.  Documents that repeat an id are ordered by text.  With one
document alone, its next document is itself.  A null id counts as the least.  Ids
are whole numbers; a column of another type is refused.  Rows that share an id are
one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import fields, in_batches

LEAST = -(1 << 63)
EMPTY = 0xFFFF
U = np.uint64
NONE = U(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class FingerprintConfig:
    first_level: int = 2
    last_level: int = 5
    registers: int = 24
    block_chars: int = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS = np.multiply.accumulate(np.full(64, 0x9E3779B97F4A7C15, U))
# label of a name in [0, 128) beside a left neighbour in [0, 128)
_LOW = np.arange(128)[:, None] ^ np.arange(128)[None, :]
_BIT = np.bitwise_count((_LOW & -_LOW) - 1) * (_LOW > 0)
_TOSS = (2 * _BIT + (np.arange(128)[None, :] >> _BIT & 1)).astype(np.uint8)  # [left, own]


def _toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six; ``first`` marks the first name of each document."""
    x = names ^ np.concatenate([names[:1], names[:-1]])
    x[first] = U(1)  # a first name is told by its lowest bit
    k = np.bitwise_count((x & (~x + U(1))) - U(1))
    label = ((k << 1) | ((names >> k.astype(U)) & U(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(3):
        left = np.concatenate([label[:1], label[:-1]])
        new = _TOSS[left, label]
        new[first] = label[first] & 1
        label = new
    return label


def parse_level(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and documents of the phrases of one level; documents stand in order."""
    edge = np.empty(len(names), bool)
    edge[0] = True
    edge[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(edge)
    runs = np.diff(at, append=len(names)).astype(U)
    names, doc = names[at], doc[at]
    if (runs > 1).any():
        names = np.where(runs > 1, _mix(names + runs * U(0xD1B54A32D192ED03)), names)
        # two joined runs can't have one name but by a collision of 64-bit hashes, which the toss survives
    first = np.empty(len(names), bool)
    first[0] = True
    first[1:] = doc[1:] != doc[:-1]
    label = _toss(names, first)
    start = first.copy()
    if len(label) > 2:
        inner = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[1:-1] & ~first[2:]
        start[1:-1] |= inner
    at = np.flatnonzero(start)
    place = np.arange(len(names)) - np.repeat(at, np.diff(at, append=len(names)))
    mixed = _mix(names) * _POWERS[place % 64] + place.astype(U) // U(64)
    return _mix(np.add.reduceat(mixed, at)), doc[at]


def sketches(texts: list[str], cfg: FingerprintConfig) -> np.ndarray:
    """Registers (text x level x class) of 16 bits; EMPTY where a class has no phrase.

    A register is a hash of the least 64-bit hash of its class, so that chance agreement
    stays at 2^-16 however many phrases there are.
    """
    levels = cfg.last_level - cfg.first_level + 1
    least = np.full((len(texts), levels * cfg.registers), NONE, U)
    lengths = np.array([len(t) for t in texts], np.int64)
    if lengths.sum():
        names = _mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U))
        doc = np.repeat(np.arange(len(texts)), lengths)
        flat = least.reshape(-1)
        for level in range(1, cfg.last_level + 1):
            names, doc = parse_level(names, doc)
            if level >= cfg.first_level:
                h = _mix(names + U(level))
                slot = (doc * levels + level - cfg.first_level) * cfg.registers + (h % U(cfg.registers)).astype(np.int64)
                np.minimum.at(flat, slot, h)
    return np.where(least == NONE, U(EMPTY), np.minimum(_mix(least) >> U(48), U(EMPTY - 1))).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Agreeing registers among those that either has."""
    either = ((a != EMPTY) | (b != EMPTY)).sum(-1)
    same = ((a == b) & (a != EMPTY)).sum(-1)
    return np.where(either > 0, same / np.maximum(either, 1), 1.0)


def encode(row: np.ndarray) -> str:
    return "" if (row == EMPTY).all() else row.astype(">u2").tobytes().hex()


def _blocks(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    a = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > limit:
            yield a, i
            a, n = i, 0
        n += len(t)
    if len(texts) > a:
        yield a, len(texts)


def _sketch_all(texts: list[str], cfg: FingerprintConfig) -> np.ndarray:
    parts = [sketches(texts[a:b], cfg) for a, b in _blocks(texts, cfg.block_chars)]
    return np.concatenate(parts) if parts else sketches([], cfg)


def fingerprints(docs: DataFrame, cfg: FingerprintConfig | None = None) -> DataFrame:
    """doc_id, n_chars, fingerprint of every text."""
    cfg = cfg or FingerprintConfig()
    rows = fields(docs, "doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            found = [encode(r) for r in _sketch_all(texts, cfg)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(found, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return in_batches(rows, work, f"doc_id {id_type}, n_chars long, fingerprint string")


def in_order(docs: DataFrame, per_partition: int = 4) -> tuple[DataFrame, int]:
    """Rows (own, key, doc_id, text) dealt to ranges of ids and sorted, each range led by the rows before it.

    ``own`` is false for the leading rows, which repeat the greatest id of the
    range before (of the last range, for the first).  Texts are shuffled once;
    range bounds and greatest ids come from the id column alone.
    """
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("doc_id must be a whole number")
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(LEAST))
    ids = docs.select(key.alias("key"))
    n = max(1, docs.rdd.getNumPartitions())
    cuts = ids.approxQuantile("key", [i / (n * per_partition) for i in range(1, n * per_partition)], 0.2 / (n * per_partition)) if n > 1 else []
    cuts = np.unique(np.array(cuts, np.float64))
    bucket = F.lit(0)
    if len(cuts):

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k = batch.column("key").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, k.astype(np.float64), "right").astype(np.int32)), batch.column("key")], ["bucket", "key"])

        ends = in_batches(ids, place, "bucket int, key long").groupBy("bucket").agg(F.max("key").alias("key"))
    else:
        ends = ids.select(bucket.alias("bucket"), "key").groupBy("bucket").agg(F.max("key").alias("key"))
    ends = sorted((r["bucket"], r["key"]) for r in ends.collect())  # one row for each range
    follow = {k: ends[(i + 1) % len(ends)][0] for i, (_, k) in enumerate(ends)}
    rows = docs.select(key.alias("key"), docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            own = np.searchsorted(cuts, keys.astype(np.float64), "right").astype(np.int32)
            lead = np.array([i for i, k in enumerate(keys.tolist()) if k in follow], np.int64)
            pick = pa.array(np.concatenate([np.arange(len(keys)), lead]))
            to = np.concatenate([own, np.array([follow[int(keys[i])] for i in lead], np.int32)])
            flags = pa.array([True] * len(keys) + [False] * len(lead))
            yield pa.RecordBatch.from_arrays([pa.array(to), flags, *(batch.column(c).take(pick) for c in ("key", "doc_id", "text"))], ["bucket", "own", "key", "doc_id", "text"])

    dealt = in_batches(rows, deal, f"bucket int, own boolean, key long, doc_id {id_type}, text string")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "own", "key", "text"), n


def compare_with_next(docs: DataFrame, cfg: FingerprintConfig | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last floor(n/2) characters replaced by the first as
    many of the next document, in descending order of ids (after the last: the first).
    """
    cfg = cfg or FingerprintConfig()
    rows, _ = in_order(docs)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_bucket, last_text, last_sketch = None, "", np.zeros(0, np.uint16)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                buckets, own = batch.column("bucket").to_pylist(), batch.column("own").to_pylist()
                texts = batch.column("text").to_pylist()
                sketch = _sketch_all(texts, cfg)
                before_text, before = [], np.empty_like(sketch)
                for i, t in enumerate(texts):
                    if buckets[i] != last_bucket:
                        last_bucket, last_text, last_sketch = buckets[i], t, sketch[i]  # a range begins with its leading rows
                    before_text.append(last_text)
                    before[i] = last_sketch
                    last_text, last_sketch = t, sketch[i]
                mine = [i for i, o in enumerate(own) if o]
                edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + before_text[i][: len(texts[i]) // 2] for i in mine]
                changed = _sketch_all(edited, cfg)
                a, b = sketch[mine], before[mine]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(mine, pa.int64())),
                        pa.array([len(texts[i]) for i in mine], pa.int64()),
                        pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                        pa.array([encode(r) for r in a], pa.string()),
                        pa.array([encode(r) for r in changed], pa.string()),
                        pa.array(likeness(a, changed), pa.float64()),
                        pa.array(likeness(a, b), pa.float64()),
                    ],
                    names,
                )

    return in_batches(rows, work, f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
