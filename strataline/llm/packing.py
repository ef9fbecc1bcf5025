"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Only the number of pieces of each length decides which bins exist, so the
driver packs a histogram of at most ``capacity`` counts: lengths go in
decreasing order, and a segment tree over the remaining capacities gives the
tightest open bin in logarithmic time.  Pieces of one length and bins of one
capacity are handled as ranges, which yields exactly the bins that best-fit
decreasing builds document by document, however many documents there are.  The
resulting plan (ranges of ranks to ranges of bins) is bounded by the lengths
too.  Executors then rank the pieces of each length, in salted buckets so that
a common length is no hot key, and look their place up in the plan.

Defined cases: a null or empty text is the single token id 1.  Repeated rows
are packed once each.  An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.common import durable, fields, in_batches


@dataclass(frozen=True)
class PackConfig:
    tokenizer: str
    capacity: int = 4096
    end_id: int = 1
    rows_per_bucket: int = 2000
    max_buckets: int = 4096


class TokenBytes:
    """Ids of texts as little-endian 32-bit numbers, by a table of white-space-free chunks.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its chunks in a row.  It puts text into composed form and
    lower case first; chunks of ``PLAIN`` characters are put into lower case
    here, text by text, so that all forms of a word are one entry.
    """

    LIMIT = 600_000
    LONGEST = 64  # longer chunks aren't kept
    # in composed form in any order, and lower case is one character by character; no part of a special token
    PLAIN = "\x00-\x1b\x20-{\x7d-\u012f\u0131-\u02ff\u0400-\u0482\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
    OTHER = re.compile(f"[^{PLAIN}]")
    # str.split() also splits here, where the tokenizer sees no white space
    ODD = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        self.known: dict[str, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for words that the normalizer would leave as they are: the same model, split at white space only
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.plain.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def encode(self, text: str) -> bytes:
        return self.bytes_of(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def learn(self, plain: set[str], others: set[str]) -> None:
        """Encodes chunks that are new, in two calls: those in lower case and of plain characters, and others.

        Letters and the marks after them are pieces of their own.
        """
        words = {c for c in plain if c.isalpha()}
        parts, whole = [], set(others)
        for c in plain:
            if c not in words:
                body = c.rstrip(punctuation) if len(c) <= self.LONGEST else ""
                if body.isalpha():
                    parts.append((c, body, c[len(body) :]))
                    words.add(body)
                    whole.add(c[len(body) :])
                else:
                    whole.add(c)
        self.spell(list(words.difference(self.known)))
        fresh = list(whole.difference(self.known))
        for chunk, found in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            self.known[chunk] = self.bytes_of(found.ids)
        self.known.update([(c, self.known[body] + self.known[marks]) for c, body, marks in parts])

    def spell(self, words: list[str]) -> None:
        """Ids of words of lower-case letters, many in one text; the last token of each is marked as one."""
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            found = self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
            raw, ends = self.bytes_of(found), (4 * (1 + np.flatnonzero(self.last[found]))).tolist()
            if len(ends) != len(part):
                raise ValueError("a word is not one piece")
            self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))

    @staticmethod
    def bytes_of(ids: list[int]) -> bytes:
        found = array("I", ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def chunks(self, text: str, plain: set[str], others: set[str]) -> list[str] | None:
        """The chunks of a text, also put into the two sets; None for a text that has to stay whole."""
        if not self.OTHER.search(text):
            found = text.lower().split()
            plain.update(found)
            return found
        if self.ODD.search(text):
            return None
        found = []
        for c in text.split():
            if self.OTHER.search(c):
                others.add(c)
            else:
                c = c.lower()
                plain.add(c)
            found.append(c)
        return found

    def of(self, texts: list[str]) -> list[bytes]:
        plain: set[str] = set()
        others: set[str] = set()
        split = [self.chunks(t, plain, others) for t in texts]
        if len(self.known) + len(plain) + len(others) > self.LIMIT:  # what is at hand stays, the rest goes
            self.known = {c: self.known[c] for s in (plain, others) for c in s if c in self.known}
        fresh = [s.difference(self.known) for s in (plain, others)]
        self.learn(*fresh)
        out = [self.encode(t) if chunks is None else b"".join(map(self.known.__getitem__, chunks)) for t, chunks in zip(texts, split, strict=True)]
        for c in [c for s in fresh for c in s if len(c) > self.LONGEST]:
            del self.known[c]
        return out


@lru_cache(maxsize=2)
def token_bytes(path: str) -> TokenBytes:
    """One for each Python worker, kept from task to task."""
    return TokenBytes(path)


class CapacityTree:
    """Which remaining capacities have an open bin; finds the least one >= x in O(log n)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def mark(self, at: int, present: bool) -> None:
        i = at + self.leaves
        self.any[i] = present
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.leaves
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, pieces per bin, first bin, offset in the bin) and the number of bins."""
    tree, open_bins, rows, bins = CapacityTree(capacity), {}, [], 0

    def put(at: int, first: int, n: int) -> None:
        if at > 0 and n > 0:
            open_bins.setdefault(at, deque()).append((first, n))
            tree.mark(at, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = tree.tightest(length)
            if at is None:
                at, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[at].popleft()
                if not open_bins[at]:
                    tree.mark(at, False)
            per = min(at // length, left)
            used = min(n, left // per)
            rows.append((length, rank, per, first, capacity - at))
            put(at - per * length, first, used)
            rank, left = rank + used * per, left - used * per
            if n > used:
                if at == capacity:  # the last new bin gets what is left
                    if left:
                        rows.append((length, rank, left, first + used, 0))
                        put(capacity - left * length, first + used, 1)
                        left = 0
                else:
                    open_bins[at].appendleft((first + used, n - used))
                    tree.mark(at, True)
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5), bins


RANK_BITS = 46


def pieces(docs: DataFrame, cfg: PackConfig) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    rows = fields(docs, "doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([cfg.end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_bytes(cfg.tokenizer)
        for batch in (b.slice(i, 2048) for b in batches for i in range(0, max(1, b.num_rows), 2048)):
            at, out = [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for k, found in enumerate(encoder.of(texts)):
                ids = found + end
                for i, a in enumerate(range(0, len(ids), 4 * cfg.capacity)):
                    part = ids[a : a + 4 * cfg.capacity]
                    at.append(k)
                    out.append((i, a // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return in_batches(rows, work, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, cfg: PackConfig) -> DataFrame:
    """pieces() with the sequence and the offset that each piece gets."""
    cut = durable(pieces(docs, cfg), "pieces")
    lengths = cut.groupBy("length").count()
    total = lengths.agg(F.sum("count")).first()[0] or 0
    buckets = min(cfg.max_buckets, max(1, total // cfg.rows_per_bucket))
    salted = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = durable(salted.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    full = histogram.pop(cfg.capacity, 0)
    plan, _ = plan_bins(histogram, cfg.capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    place = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = salted.withColumn("place", F.row_number().over(place) - 1).join(first, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place")).alias("rank"))
    keys = (plan[:, 0] << RANK_BITS) + plan[:, 1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = rank.copy(), np.zeros(len(rank), np.int64)
            rest = length < cfg.capacity
            if rest.any():
                row = plan[np.searchsorted(keys, (length[rest] << RANK_BITS) + rank[rest], "right") - 1]
                i = rank[rest] - row[:, 1]
                sequence[rest] = full + row[:, 3] + i // row[:, 2]
                offset[rest] = row[:, 4] + i % row[:, 2] * length[rest]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    id_type = ranked.schema["doc_id"].dataType.simpleString()
    return in_batches(ranked, work, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
