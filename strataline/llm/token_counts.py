"""Exact token counts at every prefix of a text, by dynamic programming.

In a byte-pair encoding, a sequence of tokens is the encoding of its text just
when each token and the next are the encoding of their joint text.  So the
last token of the encoding of a prefix is the one vocabulary entry that ends
there and agrees with the last token of the shorter prefix before it, and

    count(prefix) = count(prefix without its last token) + 1

fills a table of the counts at all prefixes in one pass.  The table of a text
is kept as the running count at the ends of its chunks plus the tables of the
distinct chunks, which are made once and reused.  Truncation ("the longest
prefix of at most n tokens") and budget questions read the table; nothing is
encoded again.

Defined cases: a null text counts as an empty one (0 tokens).  Special strings
inside a text count as one token, the library's default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strataline.llm.common import fields, in_batches

# The published split pattern of the byte-level vocabulary, and Unicode's white space
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BLANK = re.compile(f"[{SPACE}]*")


@dataclass(frozen=True)
class CountConfig:
    tokenizer: str
    limit: int = 512


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix tables over one vocabulary file."""

    LIMIT = 700_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _byte_of_char()
        self.ids = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in back for c in t)}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.endings = dict.fromkeys((b[i:] for b in self.ids for i in range(len(b))), -1)  # -1: the end of a token, but none itself
        self.endings.update(self.ids)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {}
        for r, (a, b) in enumerate(pairs):
            left, right = bytes(back[c] for c in a), bytes(back[c] for c in b)
            self.rank[self.ids[left], self.ids[right]] = (r, self.ids[left + right])
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.agree: dict[int, dict[int, bool]] = {}
        self.agreed = 0
        self.pieces: dict[bytes, list[int]] = {}
        self.totals: dict[str, int] = {}
        self.tables: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """The encoding of a short byte string, by merging; for pairs of tokens only."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            r, out, i = best[0], [], 0
            while i < len(ids):
                hit = self.rank.get((ids[i], ids[i + 1])) if i + 1 < len(ids) else None
                if hit and hit[0] == r:
                    out.append(hit[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def after(self, a: int) -> dict[int, bool]:
        """What is known of the tokens that can stand right after token a (-1: at the start)."""
        return self.agree.setdefault(a, {})

    def follows(self, a: int, b: int) -> bool:
        """Whether token b can stand right after token a; remembered in after(a)."""
        joint = self.bytes_of.get(a, b"") + self.bytes_of[b]
        found = self.merge(joint) == ([b] if a < 0 else [a, b])
        self.after(a)[b] = found
        self.agreed += 1
        return found

    def fill(self, wanted: Iterable[bytes]) -> None:
        """Tables of pieces that the split pattern keeps whole.

        In sorted order, a piece starts with the table of the prefix that it
        shares with the one before.
        """
        if self.agreed > 3_000_000:
            self.agree.clear()
            self.agreed = 0
        endings, before = self.endings, b""
        count, last, known = [0], [-1], [self.after(-1)]
        for data in sorted(wanted):
            n = len(commonprefix((before, data)))
            del count[n + 1 :], last[n + 1 :], known[n + 1 :]
            for end in range(n + 1, len(data) + 1):
                start = end - 1
                while start >= 0 and (token := endings.get(data[start:end])) is not None:
                    if token >= 0:
                        fits = known[start].get(token)
                        if self.follows(last[start], token) if fits is None else fits:
                            break
                    start -= 1
                else:
                    raise ValueError("the vocabulary has no consistent last token")
                count.append(count[start] + 1)
                last.append(token)
                known.append(self.after(token))
            before = data
            self.pieces[data] = count[1:]

    def piece(self, data: bytes) -> list[int]:
        """Token counts at the prefixes 1..n of one piece."""
        if data not in self.pieces:
            self.fill([data])
        return self.pieces[data]

    def chunk(self, text: str) -> list[int]:
        """Token counts at the byte prefixes of one chunk."""
        out, base = [], 0
        for part in SPLIT.findall(text):
            if part in ("'re", "'ve", "'ll"):  # cut short, these split otherwise
                counts = [*(self.piece(b"'")), 1 + self.piece(part[1:2].encode())[-1], self.piece(part.encode())[-1]]
            else:
                counts = self.piece(part.encode())
            out += [base + c for c in counts]
            base += counts[-1]
        return out

    def total(self, chunk: str) -> int:
        found = self.totals.get(chunk)
        return self.learn(chunk) if found is None else found

    def learn(self, chunk: str) -> int:
        counts = self.chunk(chunk)
        if len(counts) <= 64:
            self.totals[chunk], self.tables[chunk] = counts[-1], bytes(counts)
        return counts[-1]

    def prepare(self, texts: list[str]) -> None:
        """Makes the tables of all new chunks of some texts together."""
        fresh: set[str] = set()
        for t in texts:
            fresh.update(CHUNK.findall(t))
        if len(self.totals) + len(fresh) > self.LIMIT:
            self.totals.clear()
            self.tables.clear()
        self.pieces.clear()
        fresh = {c for c in fresh if c not in self.totals and len(c) <= 64}
        self.fill({p.encode() for c in fresh for p in SPLIT.findall(c)})
        for c in fresh:
            self.learn(c)

    def table(self, text: str) -> PrefixTable:
        parts, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            parts += [(c, False) for c in CHUNK.findall(text[at : m.start()])] + [(m.group(), True)]
            at = m.end()
        if not parts:
            chunks = CHUNK.findall(text)
            return PrefixTable(self, chunks, np.fromiter(map(self.total, chunks), np.int64, len(chunks)), frozenset())
        parts += [(c, False) for c in CHUNK.findall(text[at:])]
        totals = np.array([1 if s else self.total(c) for c, s in parts], np.int64)
        return PrefixTable(self, [c for c, _ in parts], totals, frozenset(i for i, (_, s) in enumerate(parts) if s))


class PrefixTable:
    """Token counts at all prefixes of one text."""

    def __init__(self, counter: PrefixCounter, chunks: list[str], totals: np.ndarray, specials: frozenset[int]):
        self.counter, self.chunks, self.specials = counter, chunks, specials
        self.ends = np.cumsum(totals)

    @property
    def n_tokens(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def within(self, k: int) -> bytes | list[int]:
        found = self.counter.tables.get(self.chunks[k])
        return self.counter.chunk(self.chunks[k]) if found is None else found

    def count_at(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters (those of a cut special string are plain text)."""
        k, left = 0, chars
        while k < len(self.chunks) and left >= len(self.chunks[k]):
            left -= len(self.chunks[k])
            k += 1
        before = int(self.ends[k - 1]) if k else 0
        cut = self.chunks[k][:left] if left else ""
        # white space at the end of a prefix is one piece, also where it is several in the text
        odd = cut and k in self.specials
        if odd or ((tail := cut if cut else (self.chunks[k - 1] if k else "")) and BLANK.fullmatch(tail)):
            first = k if cut else k - 1
            while first and first - 1 not in self.specials and BLANK.fullmatch(self.chunks[first - 1]):
                first -= 1
            run = "".join(self.chunks[first:k]) + cut
            return (int(self.ends[first - 1]) if first else 0) + sum(self.counter.total(c) for c in CHUNK.findall(run))
        return before + (self.within(k)[len(cut.encode()) - 1] if cut else 0)

    def longest(self, budget: int) -> int:
        """UTF-8 bytes of the longest prefix, cut between characters, up to which no prefix has more tokens than the budget."""
        k = int(np.searchsorted(self.ends, budget, "right"))
        size = sum(len(c.encode()) for c in self.chunks[:k])
        if k == len(self.chunks) or k in self.specials:
            return size
        left, counts, raw = budget - (int(self.ends[k - 1]) if k else 0), self.within(k), self.chunks[k].encode()
        fit = next((i for i, c in enumerate(counts) if c > left), len(counts))
        while fit and fit < len(raw) and raw[fit] & 0xC0 == 0x80:
            fit -= 1
        return size + fit


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """One for each Python worker, kept from task to task."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, cfg: CountConfig) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_bytes (bytes that fit into the limit)."""
    rows = fields(docs, "doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(cfg.tokenizer)
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, max(1, b.num_rows), 1024)):
            out = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counter.prepare(texts)
            for text in texts:
                table, size = counter.table(text), len(text.encode())
                over = table.n_tokens > cfg.limit
                out.append((size, table.n_tokens, over, table.longest(cfg.limit) if over else size))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_bytes"])

    return in_batches(rows, work, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean, limit_bytes long")
