"""Token-id output as wavelet matrices, one succinct file for each shard.

A file holds one bit-plane for each bit of an id, most significant first; after each plane
the ids are stably parted by that bit. Planes are compressed in blocks and carry cumulative
counts, so that access, rank and select touch one block a plane. The file also lists the
documents' ids and lengths.

Defined results: a null or empty text has just the end id; documents lie in ascending doc_id
order, nulls first, equal ids by text; a file ends after the document that fills it, so one
very long document makes one longer file; repeated rows are written each time; an empty table makes
no files; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, slices, table, tidy
from .encoding import word_encoder

MAGIC = b"WMX1"
BLOCK = 1 << 15  # bytes of a plane compressed together
FULL = 1 << 21  # ids after which a file is closed
HEAD = struct.Struct("<4sBxxxIQ")  # magic, planes, documents, ids


def build(ids: np.ndarray, planes: int) -> list[tuple[np.ndarray, int]]:
    """(packed bits, number of zeros) for each plane."""
    out, now = [], ids
    for level in range(planes - 1, -1, -1):
        bits = (now & now.dtype.type(1 << level)).astype(bool)
        zeros = np.compress(~bits, now)
        out.append((np.packbits(bits, bitorder="little"), len(zeros)))
        now = np.concatenate([zeros, np.compress(bits, now)])
    return out


def write_file(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, planes: int = 16) -> bytes:
    """One shard as bytes; doc_ids may hold None."""
    if len(ids) and int(ids.max()) >> planes:
        raise ValueError(f"an id needs more than {planes} bits")
    press = zstandard.ZstdCompressor(level=1)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.packbits(np.array([d is None for d in doc_ids], bool), bitorder="little")
    docs = press.compress(names.tobytes() + np.asarray(lengths, "<i8").tobytes() + nulls.tobytes())
    out = [HEAD.pack(MAGIC, planes, len(doc_ids), len(ids)), struct.pack("<I", len(docs)), docs]
    for packed, zeros in build(ids, planes):
        blocks = [packed[i : i + BLOCK] for i in range(0, len(packed), BLOCK)]
        ones = np.cumsum([0, *(int(np.bitwise_count(b).sum()) for b in blocks)], dtype="<u8")
        pressed = [press.compress(b.tobytes()) for b in blocks]
        ends = np.cumsum([0, *map(len, pressed)], dtype="<u8")
        out += [struct.pack("<QI", zeros, len(blocks)), ones.tobytes(), ends.tobytes(), *pressed]
    return b"".join(out)


class WaveletFile:
    """Reads a shard; blocks of planes are opened as they are needed."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.planes, self.documents, self.size = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet file")
        at = HEAD.size
        (n,) = struct.unpack_from("<I", data, at)
        self._press = zstandard.ZstdDecompressor()
        docs = self._press.decompress(self.data[at + 4 : at + 4 + n])
        at += 4 + n
        names = np.frombuffer(docs, "<i8", self.documents)
        self.lengths = np.frombuffer(docs, "<i8", self.documents, 8 * self.documents)
        nulls = np.unpackbits(np.frombuffer(docs, np.uint8, offset=16 * self.documents), count=self.documents, bitorder="little")
        self.doc_ids = [None if x else int(d) for d, x in zip(names, nulls, strict=True)]
        self.levels = []
        for _ in range(self.planes):
            zeros, blocks = struct.unpack_from("<QI", data, at)
            at += 12
            ones = np.frombuffer(data, "<u8", blocks + 1, at)
            at += 8 * (blocks + 1)
            ends = np.frombuffer(data, "<u8", blocks + 1, at)
            at += 8 * (blocks + 1)
            self.levels.append((zeros, ones, ends, at))
            at += int(ends[-1])
        self._open: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, level: int, block: int) -> np.ndarray:
        key = level, block
        if key not in self._open:
            if len(self._open) > 256:
                self._open.clear()
            _, _, ends, at = self.levels[level]
            self._open[key] = np.frombuffer(self._press.decompress(self.data[at + int(ends[block]) : at + int(ends[block + 1])]), np.uint8)
        return self._open[key]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, BLOCK * 8)
        ones = int(self.levels[level][1][min(block, len(self.levels[level][1]) - 1)])
        if not rest:
            return ones
        packed = self._block(level, block)
        whole, bits = divmod(rest, 8)
        ones += int(np.bitwise_count(packed[:whole]).sum())
        return ones + (int(packed[whole]) & (1 << bits) - 1).bit_count() if bits else ones

    def _bit(self, level: int, i: int) -> int:
        block, rest = divmod(i, BLOCK * 8)
        return int(self._block(level, block)[rest >> 3]) >> (rest & 7) & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for level in range(self.planes):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = self.levels[level][0] + ones if bit else i - ones
        return value

    def rank(self, token: int, i: int) -> int:
        """How often a token occurs among the first i ids."""
        if token >> self.planes:
            return 0
        a, b = 0, i
        for level in range(self.planes):
            x, y = self._rank1(level, a), self._rank1(level, b)
            if token >> (self.planes - 1 - level) & 1:
                a, b = self.levels[level][0] + x, self.levels[level][0] + y
            else:
                a, b = a - x, b - y
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def select(self, token: int, k: int) -> int:
        """The place of the token's occurrence number k, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = 0
        for level in range(self.planes):
            ones = self._rank1(level, at)
            at = self.levels[level][0] + ones if token >> (self.planes - 1 - level) & 1 else at - ones
        at += k
        for level in range(self.planes - 1, -1, -1):
            zeros = self.levels[level][0]
            at = self._select(level, at - zeros, 1) if at >= zeros else self._select(level, at, 0)
        return at

    def _select(self, level: int, k: int, bit: int) -> int:
        low, high = 0, self.size
        while low < high:  # the least place with k + 1 such bits up to and with it
            mid = (low + high) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def tokens(self) -> np.ndarray:
        """All ids at once, from the last plane up."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        now = np.zeros(self.size, kind)
        for level in range(self.planes - 1, -1, -1):
            zeros, _, ends, at = self.levels[level]
            raw = b"".join(self._press.decompress(self.data[at + int(a) : at + int(b)]) for a, b in zip(ends[:-1], ends[1:], strict=True))
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.size, bitorder="little").view(bool)
            before = np.empty(self.size, kind)
            before[~bits] = now[:zeros]
            before[bits] = now[zeros:] | kind(1 << (self.planes - 1 - level))
            now = before
        return now


def _pack(end_id: int, path: str, full: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part = TaskContext.get().partitionId(), 0
        words = word_encoder(path)
        docs, sizes, held, count = [], [], [], 0

        def close():
            nonlocal docs, sizes, held, count, part
            blob = write_file(np.concatenate(held), docs, np.concatenate(sizes))
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([count], pa.int64()), pa.array([blob], pa.binary())], ["shard", "part", "n_ids", "file"])
            docs, sizes, held, count, part = [], [], [], 0, part + 1
            return out

        for batch in (part for whole in batches for part in slices(whole, 1, 12 << 20)):
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids, bounds = words.encode_many(texts)
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            if not len(ids) or int(ids.max()) < 1 << 16:
                ids = ids.astype("<u2")
            at = 0
            while at < len(names):  # documents up to the one that fills the file
                to = min(len(names), max(at + 1, int(np.searchsorted(bounds, bounds[at] + full - count))))
                docs += names[at:to]
                sizes.append(np.diff(bounds[at : to + 1]))
                held.append(ids[bounds[at] : bounds[to]])
                count, at = count + int(bounds[to] - bounds[at]), to
                if count >= full:
                    yield close()
        if docs:
            yield close()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, full: int = FULL) -> None:
    """Encode (doc_id, text) in ascending doc_id order and write the shards' files as a table of blobs."""
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = 2 * dealt.rdd.getNumPartitions()
    ordered = dealt.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidy(_pack(end_id, tokenizer, full)), "shard int, part int, n_ids long, file binary").write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, part, blob in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            wm = WaveletFile(blob.as_py())
            ids = wm.tokens().astype("<u4")
            ends = np.cumsum(wm.lengths)
            starts = ends - wm.lengths
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = wm.documents
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard.as_py()] * n, pa.int32()), pa.array([part.as_py()] * n, pa.int32()), pa.array(wm.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(wm.lengths, pa.int64()), pa.array(sums, pa.int64())],
                ["shard", "part", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and checksum of each document, from the files alone."""
    files = spark.read.parquet(path)
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", earlier(Window.orderBy("shard")).alias("start"))  # a row for each shard
    inside = files.select("shard", "part", earlier(Window.partitionBy("shard").orderBy("part")).alias("inside_shard"))
    offsets = inside.join(shards, "shard").select("shard", "part", (F.col("start") + F.col("inside_shard")).alias("before"))
    rows = files.select("shard", "part", "file").mapInArrow(_read, "shard int, part int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, ["shard", "part"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_shards(spark, path)
