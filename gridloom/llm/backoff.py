"""Language-model scoring with stupid backoff.

Counts come from all documents, and the work is relational:

1. Documents are dealt to blocks of about BLOCK_BYTES of text, once; a block explodes its texts
   into n-grams of every order and pre-aggregates them to (n-gram, count).
2. Those rows go to the hash partition of their n-gram. There they are exploded, summed into the
   count table (n-gram, total, blocks), and joined back to it.
3. Totals of n-grams that other blocks have too return to the blocks, where scores are looked up
   and summed for each document.

A word that ends an n-gram seen at least LEAST times, n up to the model's order, scores
count(n-gram) / count(its first n - 1 words) of the longest such one, else its share among all
words; each longer n-gram that the document has there costs a factor of BACKOFF.

What travels: each text once, each n-gram at most once for each block that holds it, and its
place in the block's list and total back. The n-grams of one block for one hash partition share a row, as arrays, so there
are never more rows than n-grams. A frequent n-gram reaches its partition once a block, not once
an occurrence, so no partition is hot.

Defined results: null, empty and blank texts have no words, log score 0 and no mean; repeated
rows count each time, wherever they lie; a very long text is a block of its own, scored whole; an empty
table gives no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, give_back, setting, slices, table
from .minhash import _BLANKS, _MIX, _mix

BACKOFF = 0.4
LEAST = 2
BLOCK_BYTES = 16 << 20  # text of a block
PARTS = 256  # hash partitions, at least
OWNED = 16_000_000  # n-grams of a hash partition, about
ORDER = 2
NARROW = (1 << 31) - 1  # totals that return as an int
SLICE = 1 << 20  # text whose words are hashed at once, about
LONG = 64  # bytes; longer words are hashed one by one

_SOLID = ~np.isin(np.arange(256), [32, *_BLANKS])  # bytes of words
_FOLDED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)  # A-Z in lower case
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n of eight bytes


def gram_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of n neighbouring words, place of the last word), never across documents."""
    last = np.ones(len(words), bool)
    for k in range(n - 1):
        last[starts[starts + k < len(words)] + k] = False
    at = np.flatnonzero(last)
    hashes = words[at - n + 1]
    with np.errstate(over="ignore"):
        for k in range(n - 2, -1, -1):
            hashes = _mix(_mix(hashes * _MIX) + words[at - k])
    return hashes, at


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``hashed_words`` of one array, from its bytes: no word becomes an object of its own.

    A word's hash mixes its length and its bytes, folded, eight at a time.
    """
    import xxhash

    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    begins, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if ends[-1] else np.empty(0, np.uint8)
    folded, solid = np.zeros(len(data) + 8, np.uint8), _SOLID[data]
    folded[:-8] = _FOLDED[data]

    first, last, full = solid.copy(), solid.copy(), begins < ends
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    first[begins[full]] = solid[begins[full]]  # words never go on in the next text
    last[ends[full] - 1] = solid[ends[full] - 1]
    first = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - first

    eights = np.ndarray(len(data) + 1, "<u8", folded, strides=(1,))  # the eight bytes from each place on
    with np.errstate(over="ignore"):
        hashes = _mix(sizes.astype(np.uint64) * _MIX)
        open_ = np.flatnonzero(sizes <= LONG)
        for k in range(0, LONG, 8):
            piece = eights[first[open_] + k] & _KEPT[np.minimum(sizes[open_] - k, 8)]
            hashes[open_] = _mix(hashes[open_] * _MIX + piece)
            open_ = open_[sizes[open_] > k + 8]
    for i in np.flatnonzero(sizes > LONG).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(folded[first[i] : first[i] + sizes[i]].tobytes())
    return hashes, np.searchsorted(first, begins)


def hashed_words(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, where each text's words begin)"""
    held, starts, count = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    for batch in pa.table({"text": texts}).to_batches():
        for part in slices(batch, 0, SLICE):
            hashes, begins = _hashes(part.column(0))
            held.append(hashes)
            starts.append(begins + count)
            count += len(hashes)
    return np.concatenate(held), np.concatenate(starts)


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.concatenate([np.ones(len(ordered[:1]), bool), ordered[1:] != ordered[:-1]])


def _cuts(grams: np.ndarray, parts: int) -> np.ndarray:
    """Where each hash partition begins in sorted n-grams; partitions are equal ranges of hashes."""
    edges = ((np.arange(parts, dtype=object) << 64) + parts - 1) // parts
    return np.append(np.searchsorted(grams, edges.astype(np.uint64)), len(grams))


def _grams(parts: int, order: int):
    """A block -> for each hash partition its distinct n-grams and how often the block has them."""

    def run(block: pa.Table) -> pa.Table:
        words, starts = hashed_words(block["text"])
        every = np.concatenate([gram_hashes(words, starts, n)[0] for n in range(1, order + 1)])
        every.sort()
        first = np.flatnonzero(_runs(every))
        grams, counts = every[first], np.diff(first, append=len(every))
        cuts = _cuts(grams, parts)
        rows = np.flatnonzero(np.diff(cuts))
        cuts = np.append(cuts[rows], len(grams))
        out = pa.table({"part": pa.array(rows.astype(np.int32)), "block": pa.array(np.full(len(rows), block["block"][0].as_py()), pa.int32()), "grams": _lists(grams.view(np.int64), cuts), "counts": _lists(counts.astype(np.int32), cuts)})
        give_back()
        return out

    return run


def _scores(parts: int, order: int):
    """A block and the totals of its n-grams -> the sum of each document."""

    def run(block: pa.Table, back: pa.Table) -> pa.Table:
        words, starts = hashed_words(block["text"])
        ends = np.append(starts[1:], len(words))
        every, ends_of = map(list, zip(*[gram_hashes(words, starts, n) for n in range(1, order + 1)], strict=True))
        del words
        every = np.concatenate(every)
        sort = np.argsort(every)
        every = every[sort]
        fresh = _runs(every)
        first = np.flatnonzero(fresh)
        totals = np.diff(first, append=len(every))  # what no other block has keeps the block's count
        cuts = _cuts(every[first], parts)
        del first, every
        for part, at, total, large in zip(back["part"], back["at"], back["totals"], back["large"], strict=True):
            totals[cuts[part.as_py()] + at.values.to_numpy()] = total.values.to_numpy()
            for x in large.as_py():
                totals[cuts[part.as_py()] + x["at"]] = x["total"]
        place = np.cumsum(fresh, dtype=np.int32 if len(sort) < 1 << 31 else np.int64)
        place -= 1
        every = np.empty(len(sort))
        every[sort] = totals[place]
        del sort, place, totals
        of_order = np.split(every, np.cumsum([len(at) for at in ends_of])[:-1])

        longest = np.minimum(np.arange(ends[-1]) - np.repeat(starts, ends - starts), order - 1)  # words of context
        shorter = of_order[0]
        score, back = np.log(BACKOFF**longest * shorter), np.ones(len(longest), bool)
        for n in range(2, order + 1):
            at, count = ends_of[n - 1], of_order[n - 1]
            seen = count >= LEAST
            score[at[seen]] = np.log(BACKOFF ** (longest[at[seen]] - n + 1) * count[seen] / shorter[at[seen] - 1])
            back[at[seen]] = False
            shorter = np.zeros(len(longest))
            shorter[at] = count
        backs = np.concatenate([[0], np.cumsum(back)])
        sums = [float(score[a:b].sum()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        out = pa.table({"doc_id": block["doc_id"], "n_words": pa.array(ends - starts, pa.int64()), "n_backed_off": pa.array(backs[ends] - backs[starts], pa.int64()), "log_sum": pa.array(sums, pa.float64())})
        give_back()
        return out

    return run


def dealt_to_blocks(docs: DataFrame, block_bytes: int | None = None) -> tuple[DataFrame, int]:
    """Documents (block, doc_id, text), and how many bytes of text they have.

    The partition that a row comes from is part of its draw, so that rows that are equal in id
    and text, however many, still spread.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    draw = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(max(1, -(-size // (block_bytes or BLOCK_BYTES)))))
    return docs.select(draw.cast("int").alias("block"), "doc_id", "text").repartition("block"), size


def partitions(size: int, order: int) -> int:
    return max(PARTS, -(-size * order // (6 * OWNED)))


def count_tables(dealt: DataFrame, parts: int, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(exploded n-grams (part, block, at, gram, count), count table (part, gram, total, blocks)) of all documents.

    Both are partitioned by ``part``, a range of hashes: their join moves nothing.
    """
    asked = dealt.groupBy("block").applyInArrow(_grams(parts, order), "part int not null, block int, grams array<long>, counts array<int>").repartition("part")
    exploded = asked.select("part", "block", "counts", F.posexplode("grams").alias("at", "gram")).select("part", "block", "at", "gram", F.get("counts", F.col("at")).alias("count"))
    return exploded, exploded.groupBy("part", "gram").agg(F.sum("count").alias("total"), F.count("block").alias("blocks"))


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_backed_off, log_score, mean_log_score) for every row of docs (doc_id, text).

    n_backed_off counts words scored by their own share, first words with them. ``order`` is the longest n-gram's.
    """
    if order < 1:
        raise ValueError("a model needs an order of at least 1")
    dealt, size = dealt_to_blocks(docs)
    parts = partitions(size, order)
    exploded, counted = count_tables(dealt, parts, order)
    more = counted.where("blocks > 1").select(F.col("part").alias("p"), F.col("gram").alias("g"), "total").hint("shuffle_hash")
    found = exploded.join(more, (F.col("part") == F.col("p")) & (F.col("gram") == F.col("g")) & (F.col("total") > F.col("count")))
    narrow = F.col("total") <= NARROW  # most fit half the bytes
    back = found.groupBy("part", "block").agg(F.collect_list("at").alias("at"), F.collect_list(F.when(narrow, F.col("total")).otherwise(0).cast("int")).alias("totals"), F.collect_list(F.when(~narrow, F.struct("at", "total"))).alias("large"))
    summed = dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scores(parts, order), "doc_id long, n_words long, n_backed_off long, log_sum double")
    with setting(docs.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):  # ``part`` follows from the n-gram
        summed = checkpoint(summed)
    total = summed.agg(F.sum("n_words")).first()[0] or 1
    score = F.col("log_sum") - F.col("n_backed_off") * F.log(F.lit(float(total)))
    return summed.select("doc_id", "n_words", "n_backed_off", score.alias("log_score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_log_score"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_backed_off", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


OP8_SQL = """
WITH words AS (
  SELECT rowid_ AS r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
    SELECT row_number() OVER () AS rowid_, doc_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents)),
pairs AS (SELECT r, word, pos, lag(word) OVER (PARTITION BY r ORDER BY pos) AS before FROM words),
ones AS (SELECT word, count(*) AS n FROM words GROUP BY word),
twos AS (SELECT before, word, count(*) AS n FROM pairs WHERE before IS NOT NULL GROUP BY before, word HAVING count(*) >= 2),
total AS (SELECT greatest(count(*), 1) AS n FROM words),
scored AS (
  SELECT p.r, CASE WHEN twos.n IS NOT NULL THEN ln(twos.n / b.n)
      WHEN p.before IS NULL THEN ln(o.n / total.n) ELSE ln(0.4 * o.n / total.n) END AS s,
    CASE WHEN twos.n IS NULL THEN 1 ELSE 0 END AS backed
  FROM pairs p CROSS JOIN total JOIN ones o ON o.word = p.word
  LEFT JOIN ones b ON b.word = p.before LEFT JOIN twos ON twos.before = p.before AND twos.word = p.word),
summed AS (SELECT r, count(*) AS n_words, sum(backed) AS n_backed_off, sum(s) AS s FROM scored GROUP BY r)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_backed_off, 0) AS BIGINT) AS n_backed_off,
  round(coalesce(s, 0.0), 4) AS log_score, round(s / n_words, 6) AS mean_log_score
FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) d LEFT JOIN summed USING (r)
"""
