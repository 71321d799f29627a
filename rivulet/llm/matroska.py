"""Media columns: Matroska files as binary values.

:func:`mux` stores 8-bit PCM samples in a Matroska file: EBML header, segment with info, one audio track, clusters of
laced simple blocks, and cues. :func:`parse` reads such files: elements with variable-length ids and sizes (unknown
sizes included), clusters, the four lacing kinds and cues, as a packet table with timestamps, tracks and byte ranges.

Defined results: a null text counts as empty, its payload is 192 blanks; equal texts give equal files; a null media
value has no packets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces

# Element ids of the Matroska specification (RFC 9559) and EBML (RFC 8794).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, FLAG_LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x9C
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

#: Samples (bytes) a second, of a frame, frames of a laced block, blocks of a cluster.
RATE, FRAME, LACED, BLOCKS = 48_000, 960, 8, 32
UNIT = 192
_XIPH, _FIXED, _EBML_LACE = 1, 2, 3


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length EBML size: the shortest form, or ``width`` bytes; all ones is kept for "unknown"."""
    n = width or next(n for n in range(1, 9) if value < (1 << (7 * n)) - 1)
    return (value | 1 << (7 * n)).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def pad(text: bytes) -> bytes:
    """Blanks up to a positive multiple of 192 bytes."""
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """(lacing kind, header and frames): fixed for equal sizes, else EBML (signed size differences)."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(x) for x in frames]
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return _FIXED, head + b"".join(frames)
    head += vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        n = next(n for n in range(1, 9) if abs(b - a) < (1 << (7 * n - 1)) - 1)
        head += vint(b - a + (1 << (7 * n - 1)) - 1, n)
    return _EBML_LACE, head + b"".join(frames)


_HEADER = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ, 2))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING, np.array(RATE, ">f8").tobytes()) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))))


def mux_payload(payload: bytes) -> bytes:
    """A Matroska file of 8-bit samples; one cue for each cluster. Times are in milliseconds."""
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, np.array(len(payload) * 1000 / RATE, ">f8").tobytes()) + element(MUXING_APP, b"rivulet") + element(WRITING_APP, b"rivulet"))
    parts, at, cues, place = [info, _TRACKS], 0, [], len(info) + len(_TRACKS)
    while at < len(payload):
        start = at * 1000 // RATE
        body = [uint(CLUSTER_TIME, start)]
        for _ in range(BLOCKS):
            block = payload[at : at + FRAME * LACED]
            if not block:
                break
            kind, data = lace([block[i : i + FRAME] for i in range(0, len(block), FRAME)])
            head = b"\x81" + (at * 1000 // RATE - start).to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1])
            body.append(element(SIMPLE_BLOCK, head + data))
            at += len(block)
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, place))))
        parts.append(cluster)
        place += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(parts))


class Packet(NamedTuple):
    """A frame: track, time in milliseconds, byte range in the file, cluster number, lacing kind, whether a cue points to its cluster."""

    track: int
    time_ms: float
    start: int
    end: int
    cluster: int
    lacing: int
    cued: bool


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, bytes, whether all value bits are ones)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    n = 9 - data[at].bit_length()
    raw = int.from_bytes(data[at : at + n], "big")
    value = raw & ((1 << (7 * n)) - 1)
    return (raw if keep_marker else value), n, value == (1 << (7 * n)) - 1


def elements(data: bytes, at: int, end: int, parents: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, element's start, body's start, body's end) one after another; an unknown size ends before an id in ``parents``."""
    while at < end:
        ident, n, _ = read_vint(data, at, True)
        size, m, unknown = read_vint(data, at + n)
        body = at + n + m
        stop = end
        if unknown:
            if ident == CLUSTER:
                stop = next((a for i, a, _, _ in elements(data, body, end) if i in (CLUSTER, CUES, TRACKS, INFO)), end)
        else:
            stop = body + size
            if stop > end:
                raise ValueError(f"element {ident:#x} at byte {at} ends beyond its parent")
        yield ident, at, body, stop
        at = stop


def frame_ranges(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    if not lacing:
        return [(at, end)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == _XIPH:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == _EBML_LACE:
        for i in range(count - 1):
            value, n, _ = read_vint(data, at)
            sizes.append(value if not i else sizes[-1] + value - ((1 << (7 * n - 1)) - 1))
            at += n
    else:
        sizes = [(end - at) // count] * (count - 1)
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return [*out, (at, end)]


def parse(data: bytes) -> list[Packet]:
    """The packets of a Matroska file in stored order."""
    out: list[Packet] = []
    for ident, _, body, end in elements(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        scale, rate, depth, clusters, cued = 1_000_000, {}, {}, [], set()
        for kind, start, a, b in elements(data, body, end):
            if kind == INFO:
                scale = next((int.from_bytes(data[x:y], "big") for i, _, x, y in elements(data, a, b) if i == TIMESTAMP_SCALE), scale)
            elif kind == TRACKS:
                for _, _, x, y in elements(data, a, b):
                    entry = {i: (p, q) for i, _, p, q in elements(data, x, y)}
                    if TRACK_NUMBER in entry and AUDIO in entry:
                        audio = {i: data[p:q] for i, _, p, q in elements(data, *entry[AUDIO])}
                        number = int.from_bytes(data[slice(*entry[TRACK_NUMBER])], "big")
                        rate[number] = float(np.frombuffer(audio[SAMPLING], f">f{len(audio[SAMPLING])}")[0]) if SAMPLING in audio else 8000.0
                        depth[number] = int.from_bytes(audio.get(BIT_DEPTH, b"\x08"), "big") * int.from_bytes(audio.get(CHANNELS, b"\x01"), "big")
            elif kind == CLUSTER:
                clusters.append((start - body, a, b))
            elif kind == CUES:
                for _, _, x, y in elements(data, a, b):
                    for i, _, p, q in elements(data, x, y):
                        if i == CUE_TRACK_POSITIONS:
                            cued |= {int.from_bytes(data[u:v], "big") for j, _, u, v in elements(data, p, q) if j == CUE_CLUSTER_POSITION}
        for number, (place, a, b) in enumerate(clusters):
            time = 0
            for kind, _, x, y in elements(data, a, b):
                if kind == CLUSTER_TIME:
                    time = int.from_bytes(data[x:y], "big")
                blocks = [(x, y)] if kind == SIMPLE_BLOCK else [(p, q) for i, _, p, q in elements(data, x, y) if i == BLOCK] if kind == BLOCK_GROUP else []
                for p, q in blocks:
                    track, n, _ = read_vint(data, p)
                    at = (time + int.from_bytes(data[p + n : p + n + 2], "big", signed=True)) * scale / 1e6
                    lacing = data[p + n + 2] >> 1 & 3
                    for s, e in frame_ranges(data, p + n + 3, q, lacing):
                        out.append(Packet(track, at, s, e, number, lacing, place in cued))
                        if rate.get(track) and depth.get(track):
                            at += (e - s) * 8000 / depth[track] / rate[track]
    return out


def feature(payload: bytes, packets: list[Packet]) -> str:
    """Counts of packets, clusters, cued clusters and laced packets, mean, energy and zero crossings (around 128) of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    clusters = {p.cluster for p in packets}
    return f"packets={len(packets)};clusters={len(clusters)};cued={len({p.cluster for p in packets if p.cued})};laced={sum(p.lacing > 0 for p in packets)};ms={len(payload) * 1000 // RATE};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings}"


def mux(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_bytes`` (of the text) and ``media``: each whole text as a Matroska file."""
    from pyspark.sql import types as T

    src = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = T.StructType([*[f for f in src.schema.fields if f.name != "__text"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            raw = [(x or "").encode() for x in batch.column("__text").to_pylist()]
            media = pa.array([mux_payload(pad(x)) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([len(x) for x in raw], pa.int64()), media], [*keep, "n_bytes", "media"])

    return src.mapInArrow(run, schema)


#: A packet as a column: what :func:`parse` tells of it.
_PACKET = "struct<track:int,time_ms:double,start:bigint,end:bigint,cluster:int,lacing:int,cued:boolean>"
_PACKET_KINDS = [pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]


def packet_lists(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with ``packets``: each file's packets in stored order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media"):
            found = [[] if m is None else parse(m) for m in batch.column("media").to_pylist()]
            flat = [p for own in found for p in own]
            cols = [pa.array([p[j] for p in flat], t) for j, t in enumerate(_PACKET_KINDS)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(cols, list(Packet._fields)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "n_bytes", "media")], lists], ["doc_id", "n_bytes", "media", "packets"])

    own = media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media")
    return own.mapInArrow(run, f"doc_id long, n_bytes long, media binary, packets array<{_PACKET}>")


def packets(media: DataFrame) -> DataFrame:
    """The packet table: a row for each frame of each file of ``media`` (doc_id, n_bytes, media)."""
    return packet_lists(media).select("doc_id", F.posexplode("packets").alias("packet", "p")).select("doc_id", "packet", "p.*")


def digest(n_bytes: int, media: bytes, found: list[Packet]) -> tuple:
    """What a stored file holds, read back packet by packet."""
    payload = b"".join([media[p.start : p.end] for p in found])
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, found)


_DIGEST = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_DIGEST_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *[pa.array([r[j] for r in rows], t) for j, t in enumerate(_DIGEST_KINDS)]], ["doc_id", *_DIGEST])


def digests(media: DataFrame) -> DataFrame:
    """Digests of files and their packets (doc_id, n_bytes, media, packets: see :func:`packet_lists`); a null media value gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media"):
            found = [[Packet(**p) for p in own] for own in batch.column("packets").to_pylist()]
            yield _digests(batch.column("doc_id"), [digest(*row) for row in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), found)])

    return media.filter("media is not null").select("doc_id", "n_bytes", "media", "packets").mapInArrow(run, _DIGEST_SCHEMA)
