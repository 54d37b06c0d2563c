import hashlib
import random
import zlib
from collections import Counter

import pytest

from gridloom.llm import matroska as M

from .conftest import ODD


def block(track, stamp, flags, body):
    return M.vint(track) + stamp.to_bytes(2, "big", signed=True) + bytes([flags]) + body


@pytest.mark.parametrize("lacing", ["xiph", "ebml", "fixed"])
def test_lacings(lacing):
    rng = random.Random(lacing)
    for _ in range(60):
        count = rng.randint(2, 9)
        sizes = [rng.choice([0, 1, 126, 127, 128, 254, 255, 256, 510, 700, 20000]) for _ in range(count)] if lacing != "fixed" else [rng.randint(1, 300)] * count
        frames = [bytes([n]) * s for n, s in enumerate(sizes)]
        media = M.Media()
        data = block(3, -5, 0x80 | M.LACING.index(lacing) << 1, M.laced(frames, lacing))
        M._block(data, 0, len(data), 100, media, None, 0)
        assert [data[p.start : p.end] for p in media.packets] == frames
        assert {(p.track, p.timestamp_ns, p.lacing) for p in media.packets} == {(3, 95_000_000, lacing)}


def test_groups_unknown_sizes_and_cues():
    cluster = lambda t, *body: M.uint(M.CLUSTER_TIMESTAMP, t) + b"".join(body)
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block(1, 2, 0, b"abc")) + M.element(M.REFERENCE_BLOCK, b"\xff"))
    unknown = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    info = M.element(M.INFO, M.uint(M.TIMESTAMP_SCALE, 1000))
    body = info + unknown + cluster(7, M.element(M.SIMPLE_BLOCK, block(2, 1, 0x80, b"xy")), group) + unknown + cluster(9, M.element(M.SIMPLE_BLOCK, block(1, 0, 0x80, b"z")))
    cues = M.element(M.CUES, M.element(M.CUE_POINT, M.uint(M.CUE_TIME, 7) + M.element(M.CUE_TRACK_POSITIONS, M.uint(M.CUE_TRACK, 2) + M.uint(M.CUE_CLUSTER_POSITION, len(info)))))
    data = M.element(M.EBML, M.element(M.DOC_TYPE, b"webm")) + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body + cues
    media = M.parse(data)
    assert media.doc_type == "webm" and media.cues == [(7, 2, len(info))] and media.clusters[0] == (len(info), 7)
    assert [(p.track, p.timestamp_ns, data[p.start : p.end], p.key, p.cluster) for p in media.packets] == [(2, 8000, b"xy", True, 0), (1, 9000, b"abc", False, 0), (1, 9000, b"z", True, 1)]


def test_round_trip_and_cues_point_to_clusters():
    rng = random.Random(5)
    for size in [64, 1024, 1088, 8192, 8256, 64 * 7777]:
        data = rng.randbytes(size)
        stored = M.mux(data)
        media = M.parse(stored)
        assert M.payload(stored, media) == data
        assert [c[2] for c in media.cues] == [c[0] for c in media.clusters]
        assert [p.timestamp_ns for p in media.packets] == [n * 128_000_000 for n in range(len(media.packets))]


def test_broken_files_are_reported(spark):
    good = M.mux(b"a" * 64)
    rows = [(1, good), (2, good[:-20]), (3, b"\x00\x01"), (4, None), (5, b"")]
    got = M.packet_table(spark.createDataFrame(rows, "file_id long, data binary"), "file_id", "data").collect()
    by = Counter((r["file"], r["error"] is None) for r in got)
    assert by == {(1, True): 1, (2, False): 1, (3, False): 1}
    assert got[0]["cued"] and got[0]["byte_end"] - got[0]["byte_start"] == 64


def test_op5(spark, sf):
    got = {}
    for r in M.op5(spark, sf()).collect():
        got.setdefault((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]), set()).add((r["doc_id"], r["media_sha256"], r["feature"]))
    want = Counter()
    for d, t in ODD:
        raw = (t or "").encode()
        data = raw + bytes(-len(raw) % 64) or bytes(64)
        want[len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])] += 1
    assert set(got) == set(want)
    assert all(len({x[1:] for x in v}) == 1 for v in got.values())
    assert M.op5(spark, sf(empty=True)).count() == 0
