"""Media columns: Matroska files in binary columns, and their packets as tables.

`mux` writes PCM frames as one audio track; `parse` reads any Matroska bytes:
EBML elements with variable-length ids and sizes (unknown sizes too), clusters,
SimpleBlocks and BlockGroups, the three kinds of lacing, and cues. Each packet
has its track, timestamp, cluster and byte range in the file.

Every row is read for itself; one file is held at a time. Defined results: a
null file has no packets; bytes that break off or break the format raise
ValueError in `parse`, and give one row with an error in `packet_table`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
RATE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MUXER, WRITER, DOC_TYPE = 0x4D80, 0x5741, 0x4282
MASTERS = frozenset((EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS))
TOP = frozenset((CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367))
LACINGS = ("none", "xiph", "fixed", "ebml")

#: Bytes of a frame, its milliseconds at SAMPLE_RATE, frames of a block and blocks of a cluster.
FRAME = 576
SAMPLE_RATE = 8000
FRAME_MS = 72
LACED = 8
BLOCKS = 16
PACKETS = "packet int, track long, cluster int, timestamp_ns long, offset long, size long, lacing string, keyframe boolean, error string"


# --- writing ----------------------------------------------------------------------------------------------------------


def vint(value: int) -> bytes:
    size = 1
    while value >= (1 << 7 * size) - 1:
        size += 1
    return (value | 1 << 7 * size).to_bytes(size, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """A block's payload. Lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not lacing:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            size = 1
            while abs(b - a) >= (1 << 7 * size - 1) - 1:
                size += 1
            head += ((b - a + (1 << 7 * size - 1) - 1) | 1 << 7 * size).to_bytes(size, "big")
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


def mux(frames: list[bytes], frame_ms: int = FRAME_MS, rate: int = SAMPLE_RATE) -> bytes:
    """One track of 8-bit PCM. Blocks use the kinds of lacing in turn; a cue leads to each cluster."""
    audio = element(AUDIO, element(RATE, struct.pack(">d", rate)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, frame_ms * 1_000_000) + audio)
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXER, b"columns") + element(WRITER, b"columns"))
    body, cues, at, block = bytearray(info + element(TRACKS, track)), b"", 0, 0
    while at < len(frames):
        start = at * frame_ms
        cues += element(CUE_POINT, number(CUE_TIME, start) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, len(body))))
        inside = number(CLUSTER_TIME, start)
        for _ in range(BLOCKS):
            if at >= len(frames):
                break
            group = frames[at : at + LACED]
            lacing = 1 + block % 3 if len(group) > 1 else 0
            head = vint(1) + struct.pack(">h", at * frame_ms - start)
            if block % 5 == 4:
                inside += element(BLOCK_GROUP, element(BLOCK, head + bytes([lacing << 1]) + laced(group, lacing)))
            else:
                inside += element(SIMPLE_BLOCK, head + bytes([0x80 | lacing << 1]) + laced(group, lacing))
            at += len(group)
            block += 1
        body += element(CLUSTER, inside)
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, bytes(body) + element(CUES, cues))


# --- reading ----------------------------------------------------------------------------------------------------------


@dataclass
class Media:
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)  # track, cluster, timestamp ns, offset, size, lacing, keyframe
    cues: list[tuple] = field(default_factory=list)  # ns, track, offset of the cluster
    clusters: list[int] = field(default_factory=list)


def read_vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int]:
    """Value (-1: all ones, unknown) and the place after it."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length number at {at}")
    size = 9 - data[at].bit_length()
    if at + size > end:
        raise ValueError(f"number at {at} breaks off")
    value = int.from_bytes(data[at : at + size], "big")
    if not keep_marker:
        value -= 1 << 7 * size
        if value == (1 << 7 * size) - 1:
            value = -1
    return value, at + size


def elements(data: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """id, place, begin and end of the body of each element. One of unknown size ends at an element of its parent's level."""
    while at < end:
        place = at
        ident, at = read_vint(data, at, end, keep_marker=True)
        size, at = read_vint(data, at, end)
        stop = at + size if size >= 0 else end
        if size < 0 and ident == CLUSTER:
            stop = at
            while stop < end:
                inner, begin = read_vint(data, stop, end, keep_marker=True)
                if inner in TOP:
                    break
                n, begin = read_vint(data, begin, end)
                stop = begin + max(n, 0)
        if stop > end:
            raise ValueError(f"element {ident:x} at {place} breaks off")
        yield ident, place, at, stop
        at = stop


def unsigned(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    if not lacing:
        return [end - at], at
    if at >= end:
        raise ValueError(f"lacing at {at} breaks off")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % count:
            raise ValueError(f"fixed lacing at {at} has no equal frames")
        return [(end - at) // count] * count, at
    for k in range(count - 1):
        if lacing == 1:
            n = 0
            while True:
                if at >= end:
                    raise ValueError(f"lacing at {at} breaks off")
                n, at = n + data[at], at + 1
                if data[at - 1] != 255:
                    break
        else:
            begin = at
            n, at = read_vint(data, at, end)
            if k:
                n += sizes[-1] - ((1 << 7 * (at - begin) - 1) - 1)
        sizes.append(n)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError(f"lacing before {at} has more than the block")
    return [*sizes, last], at


def parse(data: bytes) -> Media:
    out, scale, cue_list = Media(), 1_000_000, []
    for ident, _, a, b in elements(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        for part, place, c, d in elements(data, a, b):
            if part == INFO:
                for x, _, e, f in elements(data, c, d):
                    if x == TIMESTAMP_SCALE:
                        scale = unsigned(data, e, f)
            elif part == TRACKS:
                for x, _, e, f in elements(data, c, d):
                    if x == TRACK_ENTRY:
                        own = {y: data[g:h] for y, _, g, h in elements(data, e, f)}
                        out.tracks[unsigned(own.get(TRACK_NUMBER, b"\0"), 0, 8)] = {"codec": own.get(CODEC, b"").decode("ascii", "replace"), "type": unsigned(own.get(TRACK_TYPE, b"\0"), 0, 8), "frame_ns": unsigned(own.get(DEFAULT_DURATION, b"\0"), 0, 8)}
            elif part == CLUSTER:
                cluster_packets(data, c, d, len(out.clusters), scale, out)
                out.clusters.append(place)
            elif part == CUES:
                for x, _, e, f in elements(data, c, d):
                    when, found = 0, []
                    for y, _, g, h in elements(data, e, f):
                        if y == CUE_TIME:
                            when = unsigned(data, g, h)
                        elif y == CUE_POSITIONS:
                            own = {z: unsigned(data, i, j) for z, _, i, j in elements(data, g, h)}
                            found.append((own.get(CUE_TRACK, 0), a + own.get(CUE_CLUSTER, 0)))
                    cue_list += [(when, t, p) for t, p in found]
    out.cues = [(when * scale, t, p) for when, t, p in cue_list]
    return out


def cluster_packets(data: bytes, at: int, end: int, cluster: int, scale: int, out: Media) -> None:
    base = 0
    for ident, _, a, b in elements(data, at, end):
        key = None
        if ident == CLUSTER_TIME:
            base = unsigned(data, a, b)
        elif ident == BLOCK_GROUP:
            own = {x: (c, d) for x, _, c, d in elements(data, a, b)}
            if BLOCK in own:
                (a, b), key = own[BLOCK], REFERENCE not in own
        elif ident == SIMPLE_BLOCK:
            key = False
        if key is None:
            continue
        track, c = read_vint(data, a, b)
        if c + 3 > b:
            raise ValueError(f"block at {a} breaks off")
        when, flags = struct.unpack_from(">hB", data, c)
        if ident == SIMPLE_BLOCK:
            key = bool(flags & 0x80)
        lacing = flags >> 1 & 3
        sizes, c = lace_sizes(data, c + 3, b, lacing)
        step = out.tracks.get(track, {}).get("frame_ns", 0)
        for k, n in enumerate(sizes):
            out.packets.append((track, cluster, (base + when) * scale + k * step, c, n, LACINGS[lacing], key))
            c += n


# --- columns ----------------------------------------------------------------------------------------------------------


def payload(text: str | None) -> bytes:
    """UTF-8, filled up with bytes 255 to a positive multiple of FRAME."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text as a Matroska file of 8-bit samples."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                some = b.slice(k, 256)
                texts = some.column("_text").to_pylist()
                media = []
                for t in texts:
                    p = payload(t)
                    media.append(mux([p[i : i + FRAME] for i in range(0, len(p), FRAME)]))
                yield pa.RecordBatch.from_arrays([some.column("_id"), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    one = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    return one.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packet_rows(data: bytes) -> list[tuple]:
    """A file's rows of the packet table: PACKETS without the error."""
    return [(k, *p) for k, p in enumerate(parse(data).packets)]


def packet_table(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each packet of each file: key, and PACKETS."""
    kind = files.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in PACKETS.split(", ")]

    def run(batches):
        for b in batches:
            for i, m in zip(b.column(0), b.column(1), strict=True):
                if not m.is_valid:
                    continue
                try:
                    rows = [(*r, None) for r in packet_rows(m.as_py())]
                except ValueError as e:
                    rows = [(None,) * 8 + (str(e),)]
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(rows), b.column(0).type), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[key, *names])

    return files.select(key, media).mapInArrow(run, f"{key} {kind}, {PACKETS}")


def read_back(files: DataFrame) -> DataFrame:
    """Digests and features of stored files (doc_id, n_bytes, media), from the byte ranges of their packet tables. Null media give nulls."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def one(data: bytes | None):
        if data is None:
            return (None,) * 6
        media, rows = parse(data), packet_rows(data)
        got = b"".join(data[offset : offset + size] for _, _, _, _, offset, size, _, _ in rows)
        samples = np.frombuffer(got, np.uint8)
        lacing = [sum(r[6] == x for r in rows) for x in LACINGS]
        led = sum(p in media.clusters for _, _, p in media.cues)
        feature = f"packets={len(rows)} clusters={len(media.clusters)} cues={led} lacing={':'.join(map(str, lacing))} last_ns={rows[-1][3] if rows else 0} sum={int(samples.sum(dtype=np.int64))} distinct={len(np.unique(samples))}"
        return len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches):
        for b in batches:
            rows = list(zip(*(one(m.as_py()) for m in b.column(2)), strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
