"""Media columns: Matroska files written to and read from binary columns.

``packets`` parses variable-length EBML elements into a packet table with track, timestamp,
byte range, lacing and key flag, and lists tracks, clusters and cues; elements of unknown size
end where an element of a higher level begins. ``mux`` stores bytes as 8-bit PCM samples in
laced blocks, clusters and cues. Broken files raise ValueError in ``parse`` and give no
packets and an error text in ``packet_table``.

Defined results: null and empty texts are a payload of 64 zero bytes; equal texts, equal
files; very long texts become more clusters; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# Fixed values of the file format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
_TOP = frozenset((SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS))
LACING = ("none", "xiph", "fixed", "ebml")

RATE = 8000  # samples, and so bytes, a second
FRAME, FRAMES, BLOCKS = 1024, 8, 24  # bytes a frame, frames a block, blocks a cluster


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones is kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: str) -> bytes:
    """A block's body after its header: frame count, sizes, frames."""
    if lacing == "none":
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == "ebml":
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, frames: int = FRAMES, blocks: int = BLOCKS) -> bytes:
    """A Matroska file with one track of 8-bit samples."""
    cut = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    ms = lambda index: index * frame * 1000 // RATE
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"gridloom") + element(WRITING_APP, b"gridloom"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    track = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, frame * 10**9 // RATE) + audio
    out = [info, element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues = sum(map(len, out)), []
    for first in range(0, len(cut), frames * blocks):
        body = [uint(CLUSTER_TIMESTAMP, ms(first))]
        for b in range(first, min(first + frames * blocks, len(cut)), frames):
            group = cut[b : b + frames]
            lacing = "none" if len(group) == 1 else "fixed" if len(group[-1]) == len(group[0]) else "ebml" if len(group) % 2 else "xiph"
            flags = 0x80 | LACING.index(lacing) << 1
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", ms(b) - ms(first), flags) + laced(group, lacing)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, ms(first)) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        out.append(element(CLUSTER, b"".join(body)))
        at += len(out[-1])
    out.append(element(CUES, b"".join(cues)))
    head = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    return head + element(SEGMENT, b"".join(out))


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    start: int
    end: int
    lacing: str
    key: bool
    cluster: int


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float | None = None
    doc_type: str = ""
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[tuple[int, int]] = field(default_factory=list)  # place in the segment, timestamp
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster place
    packets: list[Packet] = field(default_factory=list)


def _vint(data, at: int, end: int) -> tuple[int, int]:
    """(value or -1 for unknown, next place)"""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"cut off at {at}")
    n = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def _elements(data, at: int, end: int, stop: frozenset = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, body start, body end); an element of unknown size ends at ``end``."""
    while at < end:
        width = 9 - data[at].bit_length()
        if width > 4 or at + width > end:
            raise ValueError(f"no element id at {at}")
        kind = int.from_bytes(data[at : at + width], "big")
        if kind in stop:
            return
        n, body = _vint(data, at + width, end)
        last = end if n < 0 else body + n
        if last > end:
            raise ValueError(f"element {kind:X} at {at} goes beyond its parent")
        if n < 0 and kind == CLUSTER:
            last = body
            for _, _, last in _elements(data, body, end, _TOP):  # noqa: B007
                pass
        yield kind, body, last
        at = last


def _number(data, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


def _block(data, a: int, b: int, base: int, media: Media, key: bool | None, cluster: int) -> None:
    track, at = _vint(data, a, b)
    if at + 3 > b:
        raise ValueError(f"block cut off at {a}")
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    at, kind = at + 3, LACING[flags >> 1 & 3]
    sizes = [b - at]
    if kind != "none":
        count, at = data[at] + 1, at + 1
        if kind == "fixed":
            if (b - at) % count:
                raise ValueError(f"frames of unequal size at {at}")
            sizes = [(b - at) // count] * count
        else:
            sizes = []
            for n in range(count - 1):
                if kind == "xiph":
                    size = 0
                    while data[at] == 255:
                        size, at = size + 255, at + 1
                    size, at = size + data[at], at + 1
                else:
                    before = at
                    size, at = _vint(data, at, b)
                    if n:
                        size = sizes[-1] + size - ((1 << 7 * (at - before) - 1) - 1)
                sizes.append(size)
            sizes.append(b - at - sum(sizes))
        if sizes[-1] < 0:
            raise ValueError(f"laced sizes exceed the block at {a}")
    step = media.tracks.get(track, {}).get("default_duration", 0)
    stamp = (base + relative) * media.scale
    for n, size in enumerate(sizes):
        media.packets.append(Packet(track, stamp + n * step, at, at + size, kind, bool(flags & 0x80) if key is None else key, cluster))
        at += size


def parse(data: bytes) -> Media:
    """Tracks, clusters, cues and packets of one file; byte ranges count from the file's start."""
    media = Media()
    for kind, a, b in _elements(data, 0, len(data)):
        if kind == EBML:
            for k, x, y in _elements(data, a, b):
                if k == DOC_TYPE:
                    media.doc_type = bytes(data[x:y]).decode("ascii", "replace")
        elif kind == SEGMENT:
            _segment(data, a, b, media)
    return media


def _segment(data, a: int, b: int, media: Media) -> None:
    place = a
    for kind, x, y in _elements(data, a, b):
        if kind == INFO:
            for k, s, e in _elements(data, x, y):
                if k == TIMESTAMP_SCALE:
                    media.scale = _number(data, s, e)
                elif k == DURATION:
                    media.duration = _float(data, s, e)
        elif kind == TRACKS:
            for k, s, e in _elements(data, x, y):
                if k == TRACK_ENTRY:
                    one = {}
                    for k2, s2, e2 in _elements(data, s, e):
                        if k2 == AUDIO:
                            for k3, s3, e3 in _elements(data, s2, e2):
                                if k3 == SAMPLING_FREQUENCY:
                                    one["rate"] = _float(data, s3, e3)
                                elif k3 in (CHANNELS, BIT_DEPTH):
                                    one["channels" if k3 == CHANNELS else "bits"] = _number(data, s3, e3)
                        elif k2 == CODEC_ID:
                            one["codec"] = bytes(data[s2:e2]).decode("ascii", "replace")
                        elif name := {TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration"}.get(k2):
                            one[name] = _number(data, s2, e2)
                    media.tracks[one.get("number", 0)] = one
        elif kind == CLUSTER:
            base, n = 0, len(media.clusters)
            media.clusters.append((place - a, 0))
            for k, s, e in _elements(data, x, y):
                if k == CLUSTER_TIMESTAMP:
                    base = _number(data, s, e)
                    media.clusters[n] = (place - a, base)
                elif k == SIMPLE_BLOCK:
                    _block(data, s, e, base, media, None, n)
                elif k == BLOCK_GROUP:
                    inner = list(_elements(data, s, e))
                    key = all(i[0] != REFERENCE_BLOCK for i in inner)
                    for k2, s2, e2 in inner:
                        if k2 == BLOCK:
                            _block(data, s2, e2, base, media, key, n)
        elif kind == CUES:
            for k, s, e in _elements(data, x, y):
                if k == CUE_POINT:
                    time, spots = 0, []
                    for k2, s2, e2 in _elements(data, s, e):
                        if k2 == CUE_TIME:
                            time = _number(data, s2, e2)
                        elif k2 == CUE_TRACK_POSITIONS:
                            spot = {k3: _number(data, s3, e3) for k3, s3, e3 in _elements(data, s2, e2)}
                            spots.append((spot.get(CUE_TRACK, 0), spot.get(CUE_CLUSTER_POSITION, 0)))
                    media.cues += [(time, t, c) for t, c in spots]
        place = y


def payload(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join([data[p.start : p.end] for p in media.packets if p.track == track])


PACKETS = "track int, timestamp_ns long, byte_start long, byte_end long, lacing string, key boolean, cluster int, cued boolean, error string"


def packet_table(df: DataFrame, key: str, column: str) -> DataFrame:
    """A row for each packet of each file of a binary column; a broken file has one row with its error."""

    def run(batches):
        import pandas as pd

        names = [x.split()[0] for x in PACKETS.split(", ")]
        for pdf in batches:
            for k, data in zip(pdf["key"], pdf["data"], strict=True):
                try:
                    media = parse(b"" if data is None else bytes(data))
                    cued = {c[2] for c in media.cues}
                    rows = [(p.track, p.timestamp_ns, p.start, p.end, p.lacing, p.key, p.cluster, media.clusters[p.cluster][0] in cued, None) for p in media.packets]
                except (ValueError, IndexError, struct.error) as e:
                    rows = [(None,) * 8 + (str(e),)]
                out = pd.DataFrame(rows, columns=names).astype({"track": "Int32", "timestamp_ns": "Int64", "byte_start": "Int64", "byte_end": "Int64", "key": "boolean", "cluster": "Int32", "cued": "boolean"})
                yield out.assign(file=k)[["file", *names]]

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` as key", f"`{column}` as data").mapInPandas(run, f"file {kind}, {PACKETS}")


def features(data: bytes, media: Media, read: bytes) -> str:
    """What the stored file shows: its structure, and statistics of its samples."""
    samples = np.frombuffer(read, np.uint8)
    lacings = {k: sum(p.lacing == k for p in media.packets) for k in LACING}
    track = media.tracks.get(1, {})
    return json.dumps({
        "codec": track.get("codec"), "rate": track.get("rate"), "bits": track.get("bits"), "clusters": len(media.clusters), "cues": len(media.cues),
        "packets": len(media.packets), "lacing": {k: n for k, n in lacings.items() if n}, "last_ns": media.packets[-1].timestamp_ns if media.packets else None,
        "mean": round(float(samples.mean(dtype=np.float64)), 4), "deviation": round(float(samples.std(dtype=np.float64)), 4), "zeros": int((samples == 0).sum()),
    }, separators=(",", ":"))


def stored(text: str | None) -> tuple:
    """One text through the file and back."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
    data = mux(padded)
    media = parse(data)
    read = payload(data, media)
    return len(raw), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(data, media, read)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            got = [stored(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return docs.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
