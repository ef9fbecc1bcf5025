"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is the weighted set of its five-word shingles (lower case, split at
white space; weight: how often).  ProbMinHash lets the arrivals of a Poisson
process, whose rate is the weight of the shingle, fall on the registers; each
register keeps the shingle that came first, and a shingle is done when its next
arrival is later than every register's first.  Two texts agree in a register
with their probability Jaccard similarity

    J_P = sum_d 1 / sum_e max(a_e / a_d, b_e / b_d),

which is the Jaccard similarity where all weights are one.  A text has a second
signature with every weight one, whose registers agree with the Jaccard
similarity of the shingle sets; without repeats it is the first one.  Texts that
share a band of either signature are candidates, and two are linked if J_P or the
Jaccard similarity of their shingle sets, both computed exactly, is 0.8 or more.
Classes are the connected components of the links.

Nothing pairs all members of a bucket.  Equal texts are one node.  Each bucket
first tests its members against its most central one, the head (the node in the
fullest buckets).  Where the others of a bucket are then still in several
components, those outside the largest one are tested against the rest, in blocks
of bounded size inside tasks, with the registers as a filter; only links leave the
tasks.  A pair is tested in the first bucket that it shares and nowhere else, and
not at all once it is in one component: what is not tested can't change a class.

Defined cases: a null text counts as an empty one; texts without words are one
class if they are equal and never near others; texts of fewer than five words
are one shingle.  Rows that repeat an id are rows of their own: one stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import discard, discard_paths, durable, in_batches, stage_paths, stages_since

U = np.uint64


@dataclass(frozen=True)
class NearConfig:
    words: int = 5
    similarity: float = 0.8
    bands: int = 28
    rows: int = 5
    seed: int = 3
    #: registers may agree this much less than the similarity before a pair of a block is not verified (4.5 sigma)
    slack: float = 0.15
    #: a block of a bucket holds about so many rows and characters at most
    block_rows: int = 256
    block_chars: int = 1 << 20
    #: so many pairs share one copy of their head's text; heads with more are broadcast up to a number
    hub_pairs: int = 256
    broadcast_hubs: int = 200_000

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words(dict):
    LIMIT = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = found
        return found


def shingles(text: str | None, cfg: NearConfig, seen: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles, and how often each occurs."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.fromiter(map(seen.__getitem__, words), U, len(words))
    n = max(1, len(h) - cfg.words + 1)
    out = np.zeros(n, U)
    for j in range(min(cfg.words, len(h))):
        out = out * U(0x9E3779B97F4A7C15) + h[j : j + n]
    return np.unique(_mix(out), return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], cfg: NearConfig) -> np.ndarray:
    """The first shingle of each register of each set (0 for an empty set)."""
    m, sizes = cfg.registers, [len(h) for h, _ in sets]
    first = np.zeros(len(sets) * m, U)
    if not sum(sizes):
        return first.reshape(len(sets), m)
    time = np.full(len(sets) * m, np.inf)
    item = np.concatenate([h for h, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)
    of = np.repeat(np.arange(len(sets)), sizes)
    clock, i = np.zeros(len(item)), 0
    while len(item):
        i += 1
        draw = _mix(item + U((i * 2 + cfg.seed) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        clock = clock - np.log1p(-((draw >> U(11)).astype(np.float64) / (1 << 53))) / weight
        slot = of * m + (_mix(draw ^ U(0xA5A5A5A5A5A5A5A5)) % U(m)).astype(np.int64)
        better = clock < time[slot]
        s, c, x = slot[better], clock[better], item[better]
        np.minimum.at(time, s, c)
        won = time[s] == c
        first[s[won]] = x[won]
        last = time.reshape(len(sets), m).max(1)
        go = clock < last[of]
        item, weight, of, clock = item[go], weight[go], of[go], clock[go]
    return first.reshape(len(sets), m)


def both_signatures(sets: list[tuple[np.ndarray, np.ndarray]], cfg: NearConfig) -> np.ndarray:
    """The signature of the weighted set, then the one with every weight one."""
    weighted = signatures(sets, cfg)
    plain, often = weighted.copy(), [i for i, (_, w) in enumerate(sets) if len(w) and w.max() > 1]
    if often:
        plain[often] = signatures([(sets[i][0], np.ones_like(sets[i][1])) for i in often], cfg)
    return np.stack([weighted, plain], 1)


def band_keys(signature: np.ndarray, cfg: NearConfig) -> np.ndarray:
    out = np.tile(_mix(np.arange(1, cfg.bands + 1).astype(U)), (len(signature), 1))
    parts = signature.reshape(len(signature), cfg.bands, cfg.rows)
    for r in range(cfg.rows):
        out = _mix(out * U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out.view(np.int64)


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(Jaccard of the sets, J_P of the weighted sets), exactly."""
    if not len(a[0]) or not len(b[0]):
        return 0.0, 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    union = len(a[0]) + len(b[0]) - len(i)
    plain = len(i) / union
    if not len(i) or (a[1].max() == 1 and b[1].max() == 1):
        return plain, plain
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    above = np.cumsum(x[::-1])[::-1] + a[1].sum() - x.sum()  # a's weights where a_e/b_e is no less, with those b lacks
    below = np.concatenate([[0], np.cumsum(y)])[:-1] + b[1].sum() - y.sum()
    return plain, float((1 / (above / x + below / y)).sum())


def _node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def sign(docs: DataFrame, cfg: NearConfig) -> DataFrame:
    """id, node, row, bands, registers (their low bytes), of both signatures one after the other."""
    rows = docs.select(F.struct(docs["doc_id"]).alias("id"), _node(docs["text"]).alias("node"), F.monotonically_increasing_id().alias("row"), docs["text"].alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Words()
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                sets = [shingles(t.as_py(), cfg, seen) for t in batch.column("text")]
                found = both_signatures(sets, cfg)
                keys = np.concatenate([band_keys(found[:, s], cfg) for s in range(2)], 1)
                low = found.astype(np.uint8)
                some = [len(h) > 0 for h, _ in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("id", "node", "row")),
                        pa.array([keys[i] if s else [] for i, s in enumerate(some)], pa.list_(pa.int64())),
                        pa.array([low[i].tobytes() for i in range(len(low))], pa.binary()),
                    ],
                    ["id", "node", "row", "bands", "registers"],
                )

    return in_batches(rows, work, f"id {id_type}, node binary, row long, bands array<long>, registers binary")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): alternating large and small stars.

    Each half step is a minimum per node, aggregated before its shuffle, and a
    join whose heavy keys the engine can split.  Nothing is collected.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        old = e
        if large:
            e = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        else:
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = durable(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m")), "stars")
        joined = e.join(least, e.a == least.c)
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        out = durable(out.where("a != b").distinct(), "edges")
        discard(old, least)
        return out

    e, before = durable(edges.where("a != b").distinct(), "edges"), None
    while True:
        e = star(star(e, True), False)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    rooted = e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    rooted = durable(rooted, "roots")
    discard(e)
    return rooted


def verify(pairs: DataFrame, texts: DataFrame, cfg: NearConfig) -> DataFrame:
    """The pairs (a, b) that are linked.

    b repeats, so its shingles are kept from pair to pair; a b of many pairs is
    salted, with a copy of its text for every ``hub_pairs`` of them.
    """
    many = durable(pairs.groupBy("b").agg(F.ceil(F.count("*") / cfg.hub_pairs).cast("int").alias("salts")).where("salts > 1"), "hubs")
    spread = F.broadcast(many) if many.count() <= cfg.broadcast_hubs else many
    salts = F.coalesce("salts", F.lit(1))
    hubs = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).join(spread, "b", "left").select("b", "text_b", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    salted = pairs.join(spread, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), salts).cast("int").alias("salt"))
    left = salted.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(hubs, ["b", "salt"]).sortWithinPartitions("b").select("a", "b", "text_a", "text_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last, last_set = Words(), None, None
        for batch in batches:
            good = []
            for i, (b, ta, tb) in enumerate(zip(*(batch.column(c) for c in ("b", "text_a", "text_b")), strict=True)):
                if b.as_py() != last:
                    last, last_set = b.as_py(), shingles(tb.as_py(), cfg, seen)
                if max(similarities(shingles(ta.as_py(), cfg, seen), last_set)) >= cfg.similarity:
                    good.append(i)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return in_batches(both, work, "a binary, b binary")


def block_links(bucket: int, outer: pd.DataFrame, inner: pd.DataFrame, cfg: NearConfig) -> list[tuple[bytes, bytes]]:
    """Links between two blocks of a bucket, at most one for each outer node and inner component.

    ``bucket`` must be the first band that a pair shares, and either signature may agree.  An
    inner component that an outer node is linked to already needs no further test.
    """
    seen, sets = Words(), {}

    def of(node: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
        if node not in sets:
            sets[node] = shingles(text, cfg, seen)
        return sets[node]

    registers = np.frombuffer(b"".join(inner["registers"]), np.uint8).reshape(len(inner), 2, -1)
    bands = np.stack([np.asarray(b) for b in inner["bands"]])
    roots = inner["root"].map(bytes).to_numpy()
    codes, _ = pd.factorize(roots)
    nodes, texts = inner["node"].map(bytes).to_list(), inner["text"].to_list()
    main, names = inner["main"].to_numpy(bool), np.array(nodes, object)
    found = []
    for node, root, text, reg, band in zip(outer["node"], outer["root"], outer["text"], outer["registers"], outer["bands"], strict=True):
        node, done = bytes(node), set()
        agree = (registers == np.frombuffer(reg, np.uint8).reshape(2, -1)).mean(2).max(1)
        # two nodes outside the largest component meet twice: the lesser one tests
        near = np.flatnonzero((main | (names > node)) & (roots != bytes(root)) & (agree >= cfg.similarity - cfg.slack))
        shared = bands[near] == np.asarray(band)
        near = near[shared.any(1) & (np.asarray(band)[shared.argmax(1)] == bucket)]
        for k in near[np.argsort(-agree[near], kind="stable")]:
            if codes[k] not in done and max(similarities(of(node, text), of(nodes[k], texts[k]))) >= cfg.similarity:
                done.add(codes[k])
                found.append((node, nodes[k]))
    return found


def residual_links(members: DataFrame, heads: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, cfg: NearConfig) -> DataFrame:
    """Links between components inside buckets, but for those of the heads.

    The nodes of a bucket outside its largest component (outer) meet all others
    (inner) in a grid of blocks, each block one task's work.  Buckets whose nodes
    but the head are in one component need none.
    """
    rows = members.select("bucket", "node").join(heads, "bucket").where("node != b").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    parts = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    plan = parts.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1").select("bucket", F.col("largest.root").alias("largest"))
    due = rows.join(plan, "bucket").select("bucket", "node", "root", (F.col("root") == F.col("largest")).alias("main"))
    due = durable(due.join(texts.select("node", "text"), "node").join(nodes.select("node", "bands", "registers"), "node"), "contested")
    blocks = lambda which: F.ceil(F.greatest(F.count_if(which) / cfg.block_rows, F.sum(F.when(which, F.length("text")).otherwise(0)) / cfg.block_chars, F.lit(1))).cast("int")
    grid = durable(due.groupBy("bucket").agg(blocks(F.lit(True)).alias("inner_n"), blocks(~F.col("main")).alias("outer_n")), "grid")
    due = due.join(grid, "bucket")
    lot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["bucket", "i", "j", "node", "root", "main", "text", "bands", "registers"]
    outer = due.where("NOT main").withColumn("i", lot("outer_n")).withColumn("j", every("inner_n")).select(cols)
    inner = due.withColumn("j", lot("inner_n")).withColumn("i", every("outer_n")).select(*[F.col(c).alias(c) for c in cols])  # columns apart from outer's

    def work(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = block_links(int(key[0]), a, b, cfg) if len(a) and len(b) else []
        return pd.DataFrame(found, columns=["a", "b"])

    by = ["bucket", "i", "j"]
    return outer.groupBy(by).cogroup(inner.groupBy(by)).applyInPandas(work, "a binary, b binary")


def classes(docs: DataFrame, cfg: NearConfig | None = None) -> DataFrame:
    """id (a struct of doc_id), node, row, class_id, class_size, keep, for every row."""
    cfg, before = cfg or NearConfig(), stage_paths()
    signed = durable(sign(docs, cfg), "signed")
    one = signed.groupBy("node").agg(F.min("row").alias("row"))
    nodes = durable(signed.join(one.select("row"), "row").select("id", "node", "bands", "registers"), "nodes")
    banded = nodes.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = durable(banded.join(crowded, "bucket"), "members")
    central = durable(members.groupBy("node").agg(F.sum("n").alias("weight")), "central")
    heads = members.join(central, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("h")).select("bucket", F.col("h.node").alias("b"))
    heads = durable(heads, "heads")
    pairs = durable(members.select(F.col("node").alias("a"), "bucket").join(heads, "bucket").where("a != b").select("a", "b").distinct(), "pairs")
    wanted = nodes.select("id", "node").join(central.select("node"), "node", "left_semi")
    whole = docs.select(F.struct(docs["doc_id"]).alias("id"), _node(docs["text"]).alias("node"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    texts = durable(whole.join(wanted, ["id", "node"], "left_semi").dropDuplicates(["id", "node"]).select("node", "text"), "texts")
    roots = components(verify(pairs, texts, cfg))
    discard(pairs, central)
    more = durable(residual_links(members, heads, roots, nodes, texts, cfg), "more-links")
    discard(texts, members, heads, nodes)
    if not more.isEmpty():  # components of components: the stars so far and the new links
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    labelled = signed.select("id", "node", "row").join(roots, "node", "left")
    labelled = durable(labelled.select("id", "node", "row", F.coalesce("root", "node").alias("root")), "labelled")
    per = labelled.groupBy("root").agg(F.min(F.struct("id", "row")).alias("first"), F.min("id.doc_id").alias("class_id"), F.count("*").alias("class_size"))
    per = durable(per.select("root", "class_id", "class_size", F.col("first.row").alias("first")), "classes")
    discard_paths(stages_since(before, labelled, per))
    return labelled.join(per, "root").select("id", "node", "row", "class_id", "class_size", (F.col("row") == F.col("first")).alias("keep"))


def near_duplicates(docs: DataFrame, cfg: NearConfig | None = None) -> DataFrame:
    """doc_id, class_id (least id of the class), class_size, keep (true for one row of a class)."""
    return classes(docs, cfg).select("id.doc_id", "class_id", "class_size", "keep")


def drop_near_duplicates(docs: DataFrame, cfg: NearConfig | None = None) -> DataFrame:
    """One row of each class, with all its columns, whatever they are called."""
    kept = durable(classes(docs, cfg).where("keep").select("id", "node"), "kept")
    keyed = docs.select(F.struct(docs["doc_id"]).alias("id"), _node(docs["text"]).alias("node"), F.struct("*").alias("row"))
    return keyed.join(kept, ["id", "node"], "left_semi").dropDuplicates(["id", "node"]).select("row.*")
