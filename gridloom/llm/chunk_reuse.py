"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 32 code points cuts a text wherever its low bits are zero, so
a passage shared by many documents is cut at the same places in each. A worker encodes a
chunk once and keeps the result. Near a cut the tokens of a chunk may be wrong, as a word may
go on beyond it: each join is re-encoded with a word of context on either side, and accepted
when the context comes out as it did inside the chunks; else the whole text is encoded.

Defined results: null and empty texts have no tokens; texts of any length are encoded whole,
a chunk at a time; equal texts give equal rows; an empty table gives no rows; other columns, whatever
their names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .encoding import WordEncoder, word_encoder

MASK_BITS = 10
LEAST, MOST = 256, 8192
CACHE_CHARS = 8_000_000


def cut_points(text: str, mask_bits: int = MASK_BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a text, in code points."""
    if len(text) <= least:
        return [len(text)]
    rolled = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") * np.uint32(2654435761)
    rolled ^= rolled >> np.uint32(15)
    step = 1
    while step < 32:  # after each turn every position holds the hash of twice as many code points
        longer = rolled.copy()
        longer[step:] += (rolled[:-step] << np.uint32(step % 31)) ^ (rolled[:-step] >> np.uint32(7))
        rolled, step = longer, step * 2
    marks = np.flatnonzero((rolled & np.uint32((1 << mask_bits) - 1)) == 0) + 1
    ends, at = [], 0
    for mark in [*marks.tolist(), len(text)]:
        while mark - at > most:
            at += most
            ends.append(at)
        if mark - at >= least and mark < len(text):
            at = mark
            ends.append(at)
    if at < len(text):
        ends.append(len(text))
    return ends


class Chunk:
    """A chunk's tokens between its first and last words, and what joins need."""

    __slots__ = ("core", "head", "tail", "decimal", "decoded", "text", "count")

    def __init__(self, text: str, coder: ChunkCoder):
        self.text, self.core = text, None
        starts, ends = _spaces(text, 2), _spaces(text, -2)
        if len(starts) < 2 or len(ends) < 2 or starts[1] >= ends[0]:
            return
        encode = coder.words.encode
        whole, first, last = encode(text), encode(text[: starts[1]]), encode(text[ends[0] :])
        if len(first) + len(last) > len(whole) or not (whole.startswith(first) and whole.endswith(last)):
            return
        self.core = whole[len(first) : len(whole) - len(last)]
        self.head = (text[: starts[0]], text[starts[0] : starts[1]])
        self.tail = (text[ends[0] : ends[1]], text[ends[1] :])
        self.count = len(self.core) // 4
        self.decimal, self.decoded = coder.written(self.core)


def _spaces(text: str, n: int) -> list[int]:
    found, at = [], -1 if n > 0 else len(text)
    for _ in range(abs(n)):
        at = text.find(" ", at + 1) if n > 0 else text.rfind(" ", 0, max(at, 0))
        if at < 0:
            break
        found.append(at)
    return found if n > 0 else found[::-1]


class ChunkCoder:
    def __init__(self, words: WordEncoder):
        self.words = words
        vocabulary = {i: t for t, i in words.tokenizer.get_vocab(with_added_tokens=True).items()}
        size = max(vocabulary) + 1
        self.numbers = [str(i).encode() for i in range(size)]
        self.tokens = [vocabulary.get(i, "").encode() for i in range(size)]
        self.kept: dict[str, Chunk] = {}
        self.kept_chars = 0
        self.encoded = self.reused = self.repaired = self.fell_back = 0

    def written(self, ids: bytes) -> tuple[bytes, bytes]:
        """Decimal ids joined by spaces, and the decoded text in UTF-8."""
        listed = np.frombuffer(ids, "<u4").tolist()
        return b" ".join(map(self.numbers.__getitem__, listed)), b" ".join(map(self.tokens.__getitem__, listed))

    def chunk(self, text: str) -> Chunk:
        found = self.kept.get(text)
        if found is not None:
            self.reused += 1
            return found
        self.encoded += 1
        found = Chunk(text, self)
        if self.kept_chars + len(text) > CACHE_CHARS:
            self.kept.clear()
            self.kept_chars = 0
        self.kept[text] = found
        self.kept_chars += len(text)
        return found

    def parts(self, text: str) -> list[Chunk | bytes]:
        """The chunks of a text and, between and around them, the ids of the repaired joins."""
        encode = self.words.encode
        begin, chunks = 0, []
        for end in cut_points(text):
            chunks.append(self.chunk(text[begin:end]))
            begin = end
        out: list[Chunk | bytes] = []
        open_head, before, pending = None, "", ""  # the last good chunk's tail, then texts of chunks without a core

        def join(after: Chunk | None) -> bytes | None:
            left = open_head.tail if open_head else ("", before)
            right = after.head if after else ("", "")
            middle = (left[1] if open_head else "") + pending + right[0]
            got = encode(left[0] + middle + right[1])
            a, b = (encode(left[0]) if left[0] else b""), (encode(right[1]) if right[1] else b"")
            self.repaired += 1
            if len(a) + len(b) > len(got) or not (got.startswith(a) and got.endswith(b)):
                return None
            return got

        for chunk in chunks:
            if chunk.core is None:
                pending += chunk.text
                continue
            got = join(chunk)
            if got is None:
                self.fell_back += 1
                return [encode(text)]
            out += [got, chunk]
            open_head, pending = chunk, ""
        got = join(None)
        if got is None:
            self.fell_back += 1
            return [encode(text)]
        return [*out, got]

    def ids(self, text: str | None) -> bytes:
        return b"".join(p if isinstance(p, bytes) else p.core for p in self.parts(text or ""))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Tokens, and the SHA-256 of the decimal ids and of the decoded text."""
        count, numbers, decoded = 0, [], []
        for p in self.parts(text or ""):
            n, x, y = (len(p) // 4, *self.written(p)) if isinstance(p, bytes) else (p.count, p.decimal, p.decoded)
            if n:
                count += n
                numbers.append(x)
                decoded.append(y)
        return count, hashlib.sha256(b" ".join(numbers)).hexdigest(), hashlib.sha256(b" ".join(decoded)).hexdigest()

    def decode(self, ids: bytes) -> str:
        return self.written(ids)[1].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def chunk_coder(path: str) -> ChunkCoder:
    return ChunkCoder(word_encoder(path))


def encode_column(df: DataFrame, text: str, path: str, out: str = "ids") -> DataFrame:
    """Add the token ids of a text column as array<int>."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<int>")
    def ids(texts):
        coder = chunk_coder(path)
        return texts.map(lambda t: np.frombuffer(coder.ids(t), "<u4").astype("i4"))

    return df.withColumn(out, ids(F.col(f"`{text}`")))


def decode_column(df: DataFrame, ids: str, path: str, out: str = "decoded") -> DataFrame:
    """Add the text of an ids column, as the library's decode(ids, skip_special_tokens=False)."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def decoded(column):
        coder = chunk_coder(path)
        return column.map(lambda x: coder.decode(np.asarray([] if x is None else x, "<u4").tobytes()))

    return df.withColumn(out, decoded(F.col(f"`{ids}`")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunk_coder(path)
        for batch in batches:
            got = [coder.digests(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
