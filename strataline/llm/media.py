"""Media columns: Matroska written to and parsed from binary columns.

``parse`` reads the EBML tree (variable-length ids and sizes, also unknown
sizes), tracks, clusters, simple blocks and block groups with no, Xiph, fixed
or EBML lacing, and cues, into a table of packets with track, timestamp and
byte range.  ``mux`` writes samples as one 8-bit PCM track with laced blocks,
clusters and cues.  Nothing in a file depends on time or chance, so equal
payloads give equal files.

Defined cases: a null text is stored as an empty one, which pads to one block
of 64 zero bytes.  Bytes that are no whole Matroska file raise ``MatroskaError``
in ``parse``; in a table they are no failure: ``read`` gives nulls and says what
is wrong in ``error``, and ``packets`` has no rows for them.  A null file is one
of these.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataline.llm.common import fields, in_batches

# Element ids of the Matroska specification (RFC 9559)
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, NUMBER, UID, KIND, LACING, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
FRAME_NS = 0x23E383
TIME, SIMPLE, GROUP, BLOCK, LENGTH = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
POINT, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}


class MatroskaError(ValueError):
    pass


@dataclass(frozen=True)
class MediaConfig:
    rate: int = 8000
    frame: int = 1024
    lace: int = 8
    cluster_blocks: int = 4
    align: int = 64


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    cluster: int
    block: int
    offset: int
    size: int
    key: bool
    lacing: int


@dataclass
class Media:
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, place of the cluster
    clusters: list[tuple[int, int]] = field(default_factory=list)  # place in the segment, time
    scale: int = 1_000_000
    duration: float = 0.0


# --- reading -----------------------------------------------------------------


def read_id(b: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end or not b[at]:
        raise MatroskaError(f"no element id at {at}")
    n = 9 - b[at].bit_length()
    if n > 4 or at + n > end:
        raise MatroskaError(f"no element id at {at}")
    return int.from_bytes(b[at : at + n], "big"), at + n


def read_size(b: bytes, at: int, end: int) -> tuple[int | None, int]:
    """A variable-length number; None where all its bits are ones, which says unknown."""
    if at >= end or not b[at]:
        raise MatroskaError(f"no size at {at}")
    n = 9 - b[at].bit_length()
    if at + n > end:
        raise MatroskaError(f"size cut off at {at}")
    value = int.from_bytes(b[at : at + n], "big") - (1 << 7 * n)
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def elements(b: bytes, at: int, end: int, stop: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, place of the element, start and end of its data); of unknown size, the data goes on to the next id in ``stop``."""
    while at < end:
        place = at
        kind, at = read_id(b, at, end)
        size, at = read_size(b, at, end)
        if size is None:
            last = end if kind not in stop else _until(b, at, end, stop)
        elif at + size > end:
            raise MatroskaError(f"element {kind:X} at {place} is cut off")
        else:
            last = at + size
        yield kind, place, at, last
        at = last


def _until(b: bytes, at: int, end: int, stop: frozenset[int] | set[int]) -> int:
    while at < end:
        kind, start = read_id(b, at, end)
        if kind in stop:
            return at
        size, start = read_size(b, start, end)
        if size is None:
            raise MatroskaError(f"element {kind:X} at {at} has no size")
        at = start + size
    return end


def _uint(b: bytes, a: int, z: int) -> int:
    return int.from_bytes(b[a:z], "big")


def _float(b: bytes, a: int, z: int) -> float:
    return struct.unpack({4: ">f", 8: ">d"}[z - a], b[a:z])[0] if z > a else 0.0


def lace_sizes(b: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block, and where the first one starts."""
    if not lacing:
        return [end - at], at
    n, at = b[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:  # Xiph
        for _ in range(n - 1):
            size = 0
            while b[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + b[at])
            at += 1
    elif lacing == 3:  # EBML: the first size, then signed differences
        for i in range(n - 1):
            width = 9 - b[at].bit_length()
            value, at = read_size(b, at, end)
            if value is None:
                raise MatroskaError("a lace size is unknown")
            sizes.append(sizes[-1] + value - ((1 << (7 * width - 1)) - 1) if i else value)
    else:
        if (end - at) % n:
            raise MatroskaError("fixed lacing with unequal frames")
        return [(end - at) // n] * n, at
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise MatroskaError("lace sizes exceed the block")
    return [*sizes, last], at


def parse(b: bytes) -> Media:
    try:
        return _parse(b)
    except (IndexError, KeyError, OverflowError, UnicodeDecodeError, struct.error) as e:  # what damaged numbers, sizes and names lead to
        raise MatroskaError(f"damaged: {e!r}") from e


def _parse(b: bytes) -> Media:
    m, top = Media(), list(elements(b, 0, len(b)))
    if not top or top[0][0] != EBML or all(k != SEGMENT for k, *_ in top):
        raise MatroskaError("no Matroska file")
    _, _, base, end = next(x for x in top if x[0] == SEGMENT)
    n_block = 0

    def block(a: int, z: int, time: int, length: int | None, key: bool | None) -> None:
        nonlocal n_block
        track, a = read_size(b, a, z)
        if track is None or a + 3 > z:
            raise MatroskaError("a block is cut off")
        relative, flags = struct.unpack(">hB", b[a : a + 3])
        lacing = flags >> 1 & 3
        sizes, at = lace_sizes(b, a + 3, z, lacing)
        each = m.tracks.get(track, {}).get("frame_ns") or ((length or 0) * m.scale // len(sizes))
        start = (time + relative) * m.scale
        for i, size in enumerate(sizes):
            m.packets.append(Packet(track, start + i * each, len(m.clusters) - 1, n_block, at, size, bool(flags & 0x80) if key is None else key, lacing))
            at += size
        n_block += 1

    for kind, place, a, z in elements(b, base, end, TOP_LEVEL):
        if kind == INFO:
            for k, _, x, y in elements(b, a, z):
                if k == SCALE:
                    m.scale = _uint(b, x, y)
                elif k == DURATION:
                    m.duration = _float(b, x, y)
        elif kind == TRACKS:
            for k, _, x, y in elements(b, a, z):
                if k == TRACK:
                    t: dict = {}
                    for k2, _, p, q in elements(b, x, y):
                        if k2 in (NUMBER, UID, KIND):
                            t[{NUMBER: "number", UID: "uid", KIND: "kind"}[k2]] = _uint(b, p, q)
                        elif k2 == FRAME_NS:
                            t["frame_ns"] = _uint(b, p, q)
                        elif k2 == CODEC:
                            t["codec"] = b[p:q].decode()
                        elif k2 == AUDIO:
                            for k3, _, r, s in elements(b, p, q):
                                if k3 == RATE:
                                    t["rate"] = _float(b, r, s)
                                elif k3 in (CHANNELS, DEPTH):
                                    t["channels" if k3 == CHANNELS else "depth"] = _uint(b, r, s)
                    m.tracks[t["number"]] = t
        elif kind == CLUSTER:
            time = 0
            m.clusters.append((place - base, 0))
            for k, _, x, y in elements(b, a, z):
                if k == TIME:
                    time = _uint(b, x, y)
                    m.clusters[-1] = (place - base, time)
                elif k == SIMPLE:
                    block(x, y, time, None, None)
                elif k == GROUP:
                    parts = {k2: (p, q) for k2, _, p, q in elements(b, x, y)}
                    if BLOCK in parts:
                        block(*parts[BLOCK], time, _uint(b, *parts[LENGTH]) if LENGTH in parts else None, 0xFB not in parts)
        elif kind == CUES:
            for k, _, x, y in elements(b, a, z):
                if k == POINT:
                    parts = {k2: (p, q) for k2, _, p, q in elements(b, x, y)}
                    where = {k2: _uint(b, p, q) for k2, _, p, q in elements(b, *parts[CUE_PLACE])}
                    m.cues.append((_uint(b, *parts[CUE_TIME]), where[CUE_TRACK], where[CUE_CLUSTER]))
    return m


def payload(b: bytes, m: Media, track: int) -> bytes:
    return b"".join(b[p.offset : p.offset + p.size] for p in m.packets if p.track == track)


# --- writing -----------------------------------------------------------------


def size_bytes(n: int, width: int = 0) -> bytes:
    width = width or max(1, -(-(n + 1).bit_length() // 7))
    return (n + (1 << 7 * width)).to_bytes(width, "big")


def element(kind: int, data: bytes) -> bytes:
    return kind.to_bytes(-(-kind.bit_length() // 8), "big") + size_bytes(len(data)) + data


def _number(kind: int, n: int, width: int = 0) -> bytes:
    return element(kind, n.to_bytes(width or max(1, -(-n.bit_length() // 8)), "big"))


def laced_block(track: int, relative: int, frames: list[bytes], lacing: int | None = None) -> bytes:
    """The data of a block; without a wish, fixed lacing for equal frames and EBML lacing for others."""
    if lacing is None:
        lacing = 0 if len(frames) == 1 else 2 if len({len(f) for f in frames}) == 1 else 3
    head = size_bytes(track) + struct.pack(">hB", relative, 0x80 | lacing << 1)
    if lacing:
        head += bytes([len(frames) - 1])
    if lacing == 1:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == 3:
        head += size_bytes(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            d = len(b) - len(a)
            width = next(w for w in range(1, 9) if abs(d) < (1 << (7 * w - 1)) - 1)
            head += size_bytes(d + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(frames)


def mux(samples: bytes, cfg: MediaConfig) -> bytes:
    """8-bit samples as a Matroska file with one PCM track."""
    frames = [samples[i : i + cfg.frame] for i in range(0, len(samples), cfg.frame)]
    blocks = [frames[i : i + cfg.lace] for i in range(0, len(frames), cfg.lace)]
    ms = lambda n: n * 1000 // cfg.rate
    head = element(EBML, b"".join([_number(EBML_VERSION, 1), _number(READ_VERSION, 1), _number(MAX_ID, 4), _number(MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), _number(DOC_VERSION, 4), _number(DOC_READ, 2)]))
    info = element(INFO, _number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(samples) * 1000 / cfg.rate)) + element(MUXER, b"strataline") + element(WRITER, b"strataline"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", cfg.rate)) + _number(CHANNELS, 1) + _number(DEPTH, 8))
    track = _number(NUMBER, 1) + _number(UID, 1) + _number(KIND, 2) + _number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + _number(FRAME_NS, cfg.frame * 10**9 // cfg.rate) + audio
    body, cues = info + element(TRACKS, element(TRACK, track)), b""
    at, parts = len(body), [body]
    for c in range(0, len(blocks), cfg.cluster_blocks):
        step = cfg.frame * cfg.lace
        time = ms(c * step)
        data = _number(TIME, time) + b"".join(element(SIMPLE, laced_block(1, ms((c + i) * step) - time, f)) for i, f in enumerate(blocks[c : c + cfg.cluster_blocks]))
        cues += element(POINT, _number(CUE_TIME, time) + element(CUE_PLACE, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at)))
        parts.append(element(CLUSTER, data))
        at += len(parts[-1])
    parts.append(element(CUES, cues))
    return head + element(SEGMENT, b"".join(parts))


# --- columns -----------------------------------------------------------------


def padded(raw: bytes, align: int) -> bytes:
    return raw + bytes(-len(raw) % align if raw else align)


def feature(samples: bytes, m: Media) -> str:
    """What the samples are like and how they are stored; all numbers are exact."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128  # 8-bit PCM is unsigned
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    quarters = ",".join(str(int((q * q).sum())) for q in np.array_split(x, 4))
    steps = int(np.abs(np.diff(x)).sum())
    layout = zlib.crc32(b"".join(struct.pack(">qqq", p.timestamp_ns, p.offset, p.size) for p in m.packets))
    signal = f"samples={len(x)};sum={int(x.sum())};peak={int(np.abs(x).max(initial=0))};crossings={crossings};steps={steps};energy={quarters}"
    return f"{signal};tracks={len(m.tracks)};clusters={len(m.clusters)};cues={len(m.cues)};packets={len(m.packets)};laced={sum(p.lacing > 0 for p in m.packets)};layout={layout:08x}"


def store(docs: DataFrame, cfg: MediaConfig | None = None) -> DataFrame:
    """doc_id, n_bytes, media: every text as a Matroska file."""
    cfg = cfg or MediaConfig()
    rows = fields(docs, "doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # small batches bound what a worker holds
                part = batch.slice(i, 256)
                raw = [(t.as_py() or "").encode() for t in part.column("text")]
                media = [mux(padded(r, cfg.align), cfg) for r in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return in_batches(rows, work, f"doc_id {id_type}, n_bytes long, media binary")


def read(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored files hold: payload and file digests, the feature, and what is wrong with the file."""
    rows = fields(stored, "doc_id", "n_bytes", "media")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def one(b: bytes | None) -> tuple:
        if b is None:
            return (*[None] * 6, "no file")
        try:
            m = parse(b)
            back = payload(b, m, 1)
        except MatroskaError as e:
            return None, None, None, len(b), hashlib.sha256(b).hexdigest(), None, str(e)
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(b), hashlib.sha256(b).hexdigest(), feature(back, m), None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(x.as_py()) for x in batch.column("media")]
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"],
            )

    return in_batches(rows, work, f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def _packets_of(b: bytes | None) -> list[Packet]:
    try:
        return parse(b).packets if b is not None else []
    except MatroskaError:
        return []


def packets(stored: DataFrame) -> DataFrame:
    """The packet table: a row for each frame of each stored file that is whole."""
    rows = fields(stored, "doc_id", "media")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "track", "timestamp_ns", "cluster", "block", "offset", "size", "key", "lacing"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column("media")):
                found = _packets_of(x.as_py())
                cols = [batch.column("doc_id").take(pa.array([i] * len(found), pa.int64()))]
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())
                cols += [pa.array([p[k] for p in found], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(cols, names)

    return in_batches(rows, work, f"doc_id {id_type}, track int, timestamp_ns long, cluster int, block int, offset long, size long, key boolean, lacing int")
