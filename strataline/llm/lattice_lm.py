"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary are the arcs of a lattice over a word, whose
nodes are the prefixes of the word.  A segmentation is a path; the probability of
the word is the sum over all its segmentations, by the forward recursion in log
space, and nothing else adds to it.  A path weighs the product of its arcs and of
its end,

    P_k(x | p) = (c_k(p, x) + M G(x | p)) / (c_k(p) + M)
    G(x | p)   = (c(p, x) + T(p) U_k(x)) / (c(p) + T(p))
    U_k(x)     = (e_k(x) + A S(x) + F) / (e_k + A + ..)

for the piece (or the end) x after the prefix p, in the language k.  S are the
vocabulary's own scores (ranks, read as a Zipf distribution): they weigh all
segmentations, at first alone.  The forward and backward recursion under them
gives how often each piece is expected in the training words, and once more,
under the scores so corrected, how often in each language each piece (e) and each
piece after each prefix (c) is.  T(p) is the number of different x after p, so a
prefix that was often followed by something new leaves more to the pieces; a
prefix that was never seen, or has more than ``context_chars`` characters, leaves
all to U.  Pieces at the start of a word and inside of one have an e of their own.

The most frequent languages k of the training documents have counts of their own,
up to ``components``; all further languages and documents without one share the
counts of one more component.  The probability of a text is the marginal
sum_k pi_k prod_w P_k(w), each word and the end at their share of k's tokens.

Words are dealt to blocks that are ranges of the alphabet.  A prefix has all its
words in one block, unless it is a prefix of a cut between blocks: only those
prefixes (and the sums by piece) are added up beforehand and sent to all.  The most
used words are scored where the text is read, found by a histogram of uses; the
others, each below that use, are joined by word.

Defined cases: a null or empty text is one end token.  Without training documents,
all counts are 0 and S carries all mass.  Repeated rows are counted and scored each.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import discard, durable, fold, held_out, in_batches

LN10 = math.log(10)
MARK = "\u2581"
U = np.uint64
END = U(0x9AE16A3B2F90404F)


@dataclass(frozen=True)
class LatticeConfig:
    """``head_words`` words, as many as ``head_bytes`` bytes or a digest each, and ``shared_rows`` transitions bound what is broadcast."""

    vocabulary: str
    head_words: int = 250_000
    head_bytes: int = 48
    components: int = 5
    prior: float = 20.0  # A: how many pieces the vocabulary's own scores count for
    floor: float = 1e-3  # F
    trust: float = 50.0  # M
    context_chars: int = 48
    #: an arc with less of a word's segmentations is not counted as a transition of its prefix
    least_share: float = 1e-3
    block_words: int = 24_000
    most_blocks: int = 4096
    shared_rows: int = 2_000_000
    folds: int = 5


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Pieces:
    """The pieces of a sentencepiece vocabulary, found by rolling hashes of code points."""

    BASE = 0x9E3779B97F4A7C15
    MASK = (1 << 64) - 1

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found, byte_ids = {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)) and model.get_score(i) > -1e8:
                found[piece] = i
        rank = {i: -model.get_score(i) for i in found.values()}
        self.size = model.get_piece_size()
        weight = np.zeros(self.size)
        for i, r in rank.items():
            weight[i] = 1 / (r + 3)
        least = min(1 / (r + 3) for r in rank.values()) if rank else 1.0
        for i in byte_ids.values():
            weight[i] = least
        self.initial = weight / weight.sum()
        self.longest = max(map(len, found), default=1)
        self.bytes = np.array([byte_ids.get(b, 0) for b in range(256)])
        hashes = sorted((self.hash(p), i) for p, i in found.items())
        self.keys = np.array([h for h, _ in hashes], U)
        self.ids = np.array([i for _, i in hashes])
        self.start = np.zeros(self.size, bool)  # pieces that begin a word; its mark can be spelt in bytes too
        self.start[[*(i for p, i in found.items() if p.startswith(MARK)), *byte_ids.values()]] = True
        self.maybe = np.zeros(1 << 20, bool)  # tells most code-point runs that are no piece
        self.maybe[_mix(self.keys) >> U(44)] = True

    def hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * self.BASE + ord(c) + 1) & self.MASK
        return h

    def spelt(self, char: int) -> np.ndarray:
        """Byte ids of a character that is no piece."""
        return self.bytes[list(chr(char).encode("utf-8", "surrogatepass"))]


class Lattice:
    """All segmentations of some words: arcs (source node, target node, id), in the order of their ends.

    A word of n characters has n + 1 nodes.  Ids from the number of pieces on are
    characters that are no piece, spelt in bytes.
    """

    def __init__(self, pieces: Pieces, words: list[str]):
        self.pieces = pieces
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        n = len(codes)
        word = np.repeat(np.arange(len(words)), lengths)
        first = np.cumsum(lengths) - lengths
        place = np.arange(n) - first[word]
        left = lengths[word] - place
        starts, sizes, ids = [], [], []
        alive, h, single = np.arange(n), np.zeros(n, U), np.zeros(n, bool)
        for size in range(1, pieces.longest + 1):
            on = left[alive] >= size
            alive, h = alive[on], h[on] * U(pieces.BASE)
            if not len(alive):
                break
            h += codes[alive + size - 1] + U(1)
            some = np.flatnonzero(pieces.maybe[_mix(h) >> U(44)])
            at = np.minimum(np.searchsorted(pieces.keys, h[some]), len(pieces.keys) - 1)
            hit = pieces.keys[at] == h[some]
            starts.append(alive[some[hit]])
            sizes.append(np.full(len(starts[-1]), size))
            ids.append(pieces.ids[at[hit]])
            if size == 1:
                single[starts[-1]] = True
        rest = np.flatnonzero(~single)
        chars, which = np.unique(codes[rest], return_inverse=True)
        self.spelt = [pieces.spelt(int(c)) for c in chars]
        start = np.concatenate([*starts, rest]).astype(np.int64)
        size = np.concatenate([*sizes, np.ones(len(rest), np.int64)]).astype(np.int64)
        found = np.concatenate([*ids, pieces.size + which]).astype(np.int64)
        order_key = (place[start] + size) * (pieces.longest + 1) + size
        if n and order_key.max(initial=0) < 1 << 16:
            order_key = order_key.astype(np.uint16)  # sorted by radix
        order = np.argsort(order_key, kind="stable")
        start, size, self.ids, order_key = start[order], size[order], found[order], order_key[order]
        cut = np.flatnonzero(order_key[1:] != order_key[:-1]) + 1
        self.groups = list(zip([0, *cut.tolist()], [*cut.tolist(), len(order)], strict=True)) if len(order) else []  # one arc of a word at most in each
        self.word, self.depth = word[start], place[start]
        self.source, self.target = start + self.word, start + size + self.word
        self.first, self.last, self.length = first + np.arange(len(words)), first + lengths + np.arange(len(words)), lengths
        self.nodes = n + len(words)
        # the key of a node is a hash of its prefix: a sum over characters and their places
        power = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, pieces.BASE, U))
        sums = np.cumsum(_mix(codes + U(1)) * power[place])
        before = np.concatenate([np.zeros(1, U), sums])[first]
        keys = np.zeros(self.nodes, U)
        keys[np.arange(n) + word + 1] = sums - before[word]
        self.keys = _mix(keys + U(1))
        self.arc_keys = _mix(self.keys[self.source] * U(0xD1B54A32D192ED03) + self.keys[self.target])
        self.end_keys = _mix(self.keys[self.last] * U(0xD1B54A32D192ED03) + END)

    def weights(self, table: np.ndarray) -> np.ndarray:
        """Rows of the table (piece x ..) and, for characters that are no piece, the product of their bytes."""
        extra = [table[b].prod(0) for b in self.spelt]
        return np.concatenate([table, np.array(extra).reshape(len(extra), *table.shape[1:])])

    def forward(self, log_weight: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all paths to each node, a column for each column of the arcs' weights."""
        alpha = np.full((self.nodes, log_weight.shape[1]), -np.inf)
        alpha[self.first] = 0
        for a, z in self.groups:
            to = self.target[a:z]
            alpha[to] = np.logaddexp(alpha[to], alpha[self.source[a:z]] + log_weight[a:z])
        return alpha

    def shares(self, weight: np.ndarray) -> np.ndarray:
        """How much of its word's segmentations goes through each arc, under one weight for each piece."""
        lw = np.log(np.maximum(self.weights(weight), 1e-300))[self.ids]
        alpha = self.forward(lw[:, None])[:, 0]
        beta = np.full(self.nodes, -np.inf)
        beta[self.last] = 0
        for a, z in reversed(self.groups):
            of = self.source[a:z]
            beta[of] = np.logaddexp(beta[of], lw[a:z] + beta[self.target[a:z]])
        return np.exp(alpha[self.source] + lw + beta[self.target] - alpha[self.last][self.word])

    def counted(self, rows: np.ndarray, uses: np.ndarray) -> np.ndarray:
        """Summed uses of the arcs ``rows`` by piece; characters count for their bytes."""
        found = np.bincount(self.ids[rows], uses, self.pieces.size + len(self.spelt))
        out = found[: self.pieces.size].copy()
        for i, b in enumerate(self.spelt):
            np.add.at(out, b, found[self.pieces.size + i])
        return out


def lattices(pieces: Pieces, words: list[bytes], chars: int = 1 << 17) -> Iterator[tuple[slice, Lattice]]:
    """Lattices of parts of the words, with their start marks, of about so many characters."""
    texts = [MARK + w.decode("utf-8", "replace") for w in words]
    a = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > chars:
            yield slice(a, i), Lattice(pieces, texts[a:i])
            a, n = i, 0
        n += len(t)
    if len(texts) > a:
        yield slice(a, len(texts)), Lattice(pieces, texts[a:])


def summed(keys: np.ndarray, nodes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal transitions added up, in the order of their keys."""
    order = np.argsort(keys, kind="stable")
    keys, nodes, counts = keys[order], nodes[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], nodes[at], np.add.reduceat(counts, at, axis=0) if len(at) else counts


def transitions(lat: Lattice, share: np.ndarray, uses: np.ndarray, cfg: LatticeConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, node, uses by language) of the arcs and ends of the words, which have ``uses`` (word x language)."""
    on = np.flatnonzero((share >= cfg.least_share) & (lat.depth <= cfg.context_chars))
    ends = np.flatnonzero(lat.length <= cfg.context_chars)
    keys = np.concatenate([lat.arc_keys[on], lat.end_keys[ends]])
    nodes = np.concatenate([lat.keys[lat.source[on]], lat.keys[lat.last[ends]]])
    return summed(keys, nodes, np.concatenate([share[on, None] * uses[lat.word[on]], uses[ends]]))


class Model:
    """P_k of arcs and ends, from transition counts and the weights of pieces."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], start: np.ndarray, inner: np.ndarray, end: np.ndarray, cfg: LatticeConfig):
        self.keys, of, counts = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        self.nodes, at = np.unique(of, return_inverse=True)
        k = counts.shape[1]
        totals = np.stack([np.bincount(at, counts[:, c], len(self.nodes)) for c in range(k)], 1)
        zero = np.zeros((1, k))  # the last row: what was never seen
        self.counts, self.totals = np.concatenate([counts, zero]), np.concatenate([totals, zero])
        self.types = np.concatenate([np.bincount(at, minlength=len(self.nodes)), [1]]).astype(float)
        self.start, self.inner, self.end, self.trust = start, inner, end, cfg.trust

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def log_p(self, keys: np.ndarray, nodes: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Log P_k of transitions; ``plain`` is their U."""
        node, seen = self._find(self.nodes, nodes), self._find(self.keys, keys)
        total, count, types = self.totals[node], self.counts[seen], self.types[node][:, None]
        all_languages = (count.sum(1, keepdims=True) + types * plain) / (total.sum(1, keepdims=True) + types)
        return np.log((count + self.trust * all_languages) / (total + self.trust))

    def score(self, lat: Lattice) -> np.ndarray:
        """Log probability of each word in each language."""
        plain = np.where((lat.depth == 0)[:, None], lat.weights(self.start)[lat.ids], lat.weights(self.inner)[lat.ids])
        alpha = lat.forward(self.log_p(lat.arc_keys, lat.keys[lat.source], plain))
        ends = np.broadcast_to(self.end, (len(lat.last), len(self.end)))
        return alpha[lat.last] + self.log_p(lat.end_keys, lat.keys[lat.last], ends)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[pa.Table]:
    """Batches put together, so that words of one length come in large groups."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case (as UTF-8)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame, languages: list[str], n: int, cfg: LatticeConfig) -> DataFrame:
    """word, component (of a training document; -1 for the others), n, in partial sums."""
    component = F.coalesce(F.array_position(F.array(*map(F.lit, languages)), docs["lang"]) - 1, F.lit(-1)) if languages else F.lit(-1)
    component = F.when(component >= 0, component).otherwise(n - 1)
    train = F.coalesce(fold(docs["doc_id"], cfg.folds) != 1, F.lit(False))
    rows = docs.select(docs["text"].alias("text"), F.when(train, component).otherwise(-1).cast("int").alias("component"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, Counter] = {k: Counter() for k in range(-1, n)}

        def flush() -> Iterator[pa.RecordBatch]:
            for k, found in by.items():
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(np.full(len(found), k, np.int32)), pa.array(found.values(), pa.int64())], ["word", "component", "n"])
                    found.clear()

        for batch in batches:
            for text, k in zip(batch.column("text"), batch.column("component").to_pylist(), strict=True):
                by[k].update(tokens(text.as_py()))
                if sum(map(len, by.values())) > 400_000:
                    yield from flush()
        yield from flush()

    return in_batches(rows, work, "word binary, component int, n long")


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """One for each Python worker, kept from task to task."""
    return Pieces(path)


def _columns(batch: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c), np.float64) for c in names], axis=1)


def _pooled(vocab: DataFrame, pieces: Pieces, cfg: LatticeConfig) -> np.ndarray:
    """The vocabulary's own weights, corrected by one step of expectation maximisation over all training words."""
    path = cfg.vocabulary

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(path)
        expected = np.zeros(own.size)
        weight = np.maximum(own.initial, 1e-300)
        for batch in gathered(batches):
            uses, words = _columns(batch, ["c"])[:, 0], batch.column("word").to_pylist()
            for part, lat in lattices(own, words):
                every = np.arange(len(lat.ids))
                expected += lat.counted(every, lat.shares(weight) * uses[part][lat.word])
        at = np.flatnonzero(expected)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(expected[at])], ["piece", "n"])

    seen = in_batches(vocab.where("c > 0").select("word", "c"), work, "piece int, n double")
    expected = cfg.prior * pieces.initial + cfg.floor * (pieces.initial > 0)
    for r in seen.groupBy("piece").agg(F.sum("n").alias("n")).collect():  # at most one row for each piece
        expected[r["piece"]] += r["n"]
    return np.maximum(expected / expected.sum(), 1e-300)


def _cuts(vocab: DataFrame, n: int, blocks: int, cfg: LatticeConfig) -> list[str]:
    """Words between which the blocks are cut, by a sample of about 16 words a block."""
    if blocks < 2:
        return []
    sample = vocab.where(F.pmod(F.xxhash64("word", F.lit("cut")), F.lit(max(1, n // (16 * blocks)))) == 0)
    found = sorted(r["w"].decode("utf-8", "replace") for r in sample.select(F.substring("word", 1, cfg.context_chars).alias("w")).collect())
    return sorted({found[len(found) * i // blocks] for i in range(1, blocks)}) if found else []


def _dealt(vocab: DataFrame, cuts: list[str], names: list[str]) -> DataFrame:
    """The vocabulary with the block of each word, each block in one partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = [bisect_right(cuts, w.decode("utf-8", "replace")) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *(batch.column(c) for c in ("word", "uses", *names))], ["block", "word", "uses", *names])

    kinds = ", ".join(f"{c} long" for c in ("uses", *names))
    return in_batches(vocab.select("word", "uses", *names), work, f"block int, word binary, {kinds}").repartition(len(cuts) + 1, "block")


def shared_nodes(pieces: Pieces, cuts: list[str], cfg: LatticeConfig) -> np.ndarray:
    """Keys of the prefixes whose words stand in several blocks."""
    return np.unique(Lattice(pieces, [MARK + c[: cfg.context_chars] for c in cuts]).keys) if cuts else np.zeros(0, U)


def _train(vocab: DataFrame, n: int, pieces: Pieces, cs: list[str], cfg: LatticeConfig) -> tuple[list[str], np.ndarray, tuple, tuple]:
    """(cuts, pooled weights, shared transitions, (U at the start, inside, of the end))."""
    pooled, path, k = _pooled(vocab, pieces, cfg), cfg.vocabulary, len(cs)
    es = [f"e{c}" for c in range(k)]
    blocks = min(cfg.most_blocks, max(1, -(-n // cfg.block_words)))
    while True:
        cuts = _cuts(vocab, n, blocks, cfg)
        shared = shared_nodes(pieces, cuts, cfg)

        def work(table: pa.Table) -> pa.Table:
            own, words, uses = pieces_of(path), table.column("word").to_pylist(), _columns(table, cs)
            sums, parts = np.zeros((2, own.size, k)), []
            for part, lat in lattices(own, words):
                share, of = lat.shares(pooled), uses[part]
                for inside in range(2):
                    rows = np.flatnonzero((lat.depth > 0) == inside)
                    for c in range(k):
                        sums[inside, :, c] += lat.counted(rows, share[rows] * of[lat.word[rows], c])
                if len(shared):
                    keys, nodes, counts = transitions(lat, share, of, cfg)
                    on = Model._find(shared, nodes) >= 0
                    parts.append((keys[on], nodes[on], counts[on]))
            rows = [(inside, piece, 0, *sums[inside, piece]) for inside in range(2) for piece in np.flatnonzero(sums[inside].any(1)).tolist()]
            rows.append((2, 0, 0, *uses.sum(0)))
            if parts:
                keys, nodes, counts = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                rows += zip(repeat(3), keys.view(np.int64).tolist(), nodes.view(np.int64).tolist(), *counts.T.tolist())
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * k]
            return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "key", "node", *es])

        schema = "kind int, key long, node long, " + ", ".join(f"{e} double" for e in es)
        seen = _dealt(vocab.where("c > 0"), cuts, cs).groupBy("block").applyInArrow(work, schema)
        seen = durable(seen.groupBy("kind", "key", "node").agg(*[F.sum(e).alias(e) for e in es]), "lattice-sums")
        if blocks == 1 or seen.count() <= cfg.shared_rows:
            break
        blocks = max(1, blocks // 4)
        discard(seen)
    got = seen.toArrow()  # two rows for each piece and ``shared_rows`` at most
    discard(seen)
    kind, key, counts = np.asarray(got.column("kind")), np.asarray(got.column("key")), _columns(got, es).reshape(-1, k)
    sums = np.zeros((2, pieces.size, k))
    for inside in range(2):
        sums[inside, key[kind == inside]] = counts[kind == inside]
    base = cfg.prior * pieces.initial[:, None] + cfg.floor * (pieces.initial[:, None] > 0)
    start = np.where(pieces.start[:, None], sums[0] + base, 0)
    inner, end = sums[1] + base, counts[kind == 2].sum(0) + 1
    on = kind == 3
    common = key[on].view(U), np.asarray(got.column("node"))[on].view(U), counts[on]
    return cuts, pooled, common, (start / np.maximum(start.sum(0), 1e-300), inner / (inner.sum(0) + end), end / (inner.sum(0) + end))


def _weighed(vocab: DataFrame, trained: tuple, cs: list[str], cfg: LatticeConfig) -> DataFrame:
    """word, uses, c and the log10 probability in each language (p0, ..)."""
    cuts, pooled, common, plain = trained
    path, ps = cfg.vocabulary, [f"p{c}" for c in range(len(cs))]
    sent = vocab.sparkSession.sparkContext.broadcast((common, pooled, plain))  # bounded by ``shared_rows`` and the pieces

    def work(table: pa.Table) -> pa.Table:
        own, words, uses = pieces_of(path), table.column("word").to_pylist(), _columns(table, cs)
        shared, pooled, plain = sent.value
        nodes_shared, parts = np.unique(shared[1]), [shared]
        held = list(lattices(own, words)) if sum(map(len, words)) <= 1 << 22 else None
        for part, lat in held or lattices(own, words):
            keys, nodes, counts = transitions(lat, lat.shares(pooled), uses[part], cfg)
            on = (Model._find(nodes_shared, nodes) < 0) & counts.any(1)
            parts.append((keys[on], nodes[on], counts[on]))
        model = Model(parts, *plain, cfg)
        found = np.concatenate([model.score(lat) for _, lat in held or lattices(own, words)]) / LN10
        return pa.table([*(table.column(c) for c in ("word", "uses", "c")), *(pa.array(np.ascontiguousarray(x)) for x in found.T)], names=["word", "uses", "c", *ps])

    schema = "word binary, uses long, c long, " + ", ".join(f"{p} double" for p in ps)
    return _dealt(vocab, cuts, ["c", *cs]).groupBy("block").applyInArrow(work, schema)


def _least_uses(model: DataFrame, cfg: LatticeConfig) -> int:
    """The least use of the head: as many words as ``head_words`` at most have it, by a histogram of eighths of octaves."""
    step = lambda x: F.floor(F.log2(x) * 8).cast("int")
    total, least = 0, None
    for r in model.groupBy(step(F.col("uses")).alias("step")).agg(F.count("*").alias("n"), F.min("uses").alias("least")).orderBy(F.desc("step")).collect():  # 8 * 63 rows at most
        total += r["n"]
        if total > cfg.head_words:
            break
        least = r["least"]
    return least if least is not None else 1 << 62


def name(word: bytes, longest: int) -> bytes:
    """A word, or a digest of a long one; no word has a space."""
    return word if len(word) <= longest else b" " + hashlib.md5(word, usedforsecurity=False).digest()


def score(docs: DataFrame, cfg: LatticeConfig) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    train = docs.where(F.coalesce(fold(docs["doc_id"], cfg.folds) != 1, F.lit(False)))
    per = train.groupBy(train["lang"].alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("lang").asc_nulls_last()).limit(cfg.components + 1).collect()
    languages = [r["lang"] for r in per if r["lang"] is not None][: cfg.components]
    d_all = train.agg(F.count("*")).first()[0]
    d = [next(r["n"] for r in per if r["lang"] == x) for x in languages]
    if d_all > sum(d) or not d:
        d.append(d_all - sum(d))
    n_comp = len(d)
    cs = [f"c{k}" for k in range(n_comp)]
    of = lambda k: F.sum(F.when(F.col("component") == k, F.col("n")).otherwise(0))
    counted = count_words(docs, languages, n_comp, cfg).groupBy("word").agg(F.sum("n").alias("uses"), *[of(k).alias(c) for k, c in enumerate(cs)])
    vocab = durable(counted.withColumn("c", sum((F.col(c) for c in cs[1:]), F.col(cs[0]))), "words")
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).alias(name)
    totals = vocab.agg(F.count("*").alias("rows"), *[total(c, c) for c in cs], total((F.col("c") > 0).cast("long"), "v")).first()
    words_of = [totals[c] for c in cs]
    n_all, v_all = sum(words_of) + sum(d), totals["v"] + (d_all > 0)
    trained = _train(vocab, totals["rows"], Pieces(cfg.vocabulary), cs, cfg)
    ps = [f"p{k}" for k in range(n_comp)]
    as_word = [math.log10((x + 0.5) / (x + y + 1)) for x, y in zip(words_of, d, strict=True)]
    base = F.log10((F.col("c") + 0.5) / (n_all + 0.5 * (v_all + 1)))
    weighed = _weighed(vocab, trained, cs, cfg)
    model = durable(weighed.select("word", "uses", (F.col("c") > 0).cast("int").alias("known"), base.alias("base"), *[(F.col(p) + x).alias(p) for p, x in zip(ps, as_word, strict=True)]), "model")
    discard(vocab)
    least = _least_uses(model, cfg)
    named = F.when(F.octet_length("word") <= cfg.head_bytes, F.col("word")).otherwise(F.concat(F.lit(b" "), F.unhex(F.md5("word"))))
    head = model.where(F.col("uses") >= least).select(named.alias("word"), "known", "base", *ps).toArrow()
    words = spark.sparkContext.broadcast(head.column("word").to_pylist())
    table = spark.sparkContext.broadcast(np.stack([head.column(c).to_numpy().astype(np.float64) for c in ("known", "base", *ps)], axis=1) if head.num_rows else np.zeros((0, 2 + n_comp)))
    end_p = [(y + 0.5) / (x + y + 1) for x, y in zip(words_of, d, strict=True)]
    end = [float(d_all > 0), math.log10((d_all + 0.5) / (n_all + 0.5 * (v_all + 1))), *map(math.log10, end_p)]
    rows = docs.select(docs["doc_id"], held_out(docs["doc_id"], cfg.folds).alias("held_out"), F.monotonically_increasing_id().alias("row"), docs["text"].alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    sums = ["known", "base", *ps]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, longest = {w: i for i, w in enumerate(words.value)}, cfg.head_bytes
        numbers = table.value
        for batch in batches:
            n, acc, rest_words, rest_counts = [], [], [], []
            for text in batch.column("text"):
                found = tokens(text.as_py())
                at = np.fromiter(map(index.get, found, repeat(-1)), np.int64, len(found))
                for i in np.flatnonzero(at < 0).tolist():
                    if len(found[i]) > longest:
                        at[i] = index.get(name(found[i], longest), -1)
                hit = at >= 0
                acc.append(numbers[at[hit]].sum(0) + end)
                rest = Counter(found[i] for i in np.flatnonzero(~hit))
                rest_words.append(list(rest.keys()))
                rest_counts.append(list(rest.values()))
                n.append(len(found) + 1)
            acc = np.array(acc).reshape(-1, 2 + n_comp)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "held_out", "row")),
                    pa.array(n, pa.int64()),
                    *(pa.array(np.ascontiguousarray(acc[:, k])) for k in range(2 + n_comp)),
                    pa.array(rest_words, pa.list_(pa.binary())),
                    pa.array(rest_counts, pa.list_(pa.int32())),
                ],
                ["doc_id", "held_out", "row", "n_tokens", *sums, "rest_words", "rest_counts"],
            )

    schema = f"doc_id {id_type}, held_out boolean, row long, n_tokens long, " + ", ".join(f"{c} double" for c in sums) + ", rest_words array<binary>, rest_counts array<int>"
    scored = durable(in_batches(rows, first_pass, schema), "scored")
    rest = scored.select("row", F.explode(F.arrays_zip("rest_words", "rest_counts")).alias("r")).select("row", F.col("r.rest_words").alias("word"), F.col("r.rest_counts").alias("tf"))
    tail = rest.join(model, "word").groupBy("row").agg(*[F.sum(F.col("tf") * F.col(c)).alias(f"t_{c}") for c in sums])
    joined = scored.select("doc_id", "held_out", "row", "n_tokens", *sums).join(tail, "row", "left")
    total = {c: F.col(c) + F.coalesce(F.col(f"t_{c}"), F.lit(0.0)) for c in sums}
    prior = [math.log10(x / d_all) if d_all and x else -300.0 for x in d]
    joined = joined.select("doc_id", "held_out", "n_tokens", total["known"].cast("long").alias("n_known"), total["base"].alias("base_score"), *[(total[p] + lp).alias(p) for p, lp in zip(ps, prior, strict=True)])
    top = F.greatest(*ps) if n_comp > 1 else F.col(ps[0])
    mixed = top + F.log10(sum((F.pow(F.lit(10.0), F.col(p) - top) for p in ps[1:]), F.pow(F.lit(10.0), F.col(ps[0]) - top)))
    return joined.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", mixed.alias("score"))
