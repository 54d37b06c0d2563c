"""Near-duplicate groups by one-permutation MinHash.

Every text becomes the set of its word shingles, hashed to 64 bits. One permutation fills all
bins at once: a hash's top bits choose the bin, the smallest hash in it stays, and an empty bin
takes the value of a bin chosen by a hash of its own number and try (optimal densification).
Runs of ROWS bins make BANDS bucket keys.

Texts with equal sets are one class from the start. In each bucket all classes are linked with
one hub only, a star, so a bucket of n classes makes n - 1 candidate edges. Edges are confirmed
on full sets and confirmed classes joined into components. What a bucket then still holds of
different components is compared in full, small buckets pair by pair and large ones in blocks,
so no link between different texts is left to the stars.

Defined results: null, empty and blank texts have no shingles and are groups of their own; null
doc ids take part but name no group unless all its ids are null; repeated rows share a group;
very long texts are shingled whole, and a pair at exactly the threshold is linked; an empty table
gives no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, release, settled, table, tidy
from .graph import connected_components

SHINGLE = 5  # words, where a contract says nothing else
BANDS, ROWS = 48, 6
_UPPER = {c: c + 32 for c in range(65, 91)}
_BLANKS = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}
_FOLD = str.maketrans(_UPPER | _BLANKS)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, kept for at most ``limit`` of them."""

    def __init__(self, limit: int = 100_000):
        self.limit = limit

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_words = _Words()


def word_list(text: str) -> list[str]:
    """Words: maximal runs without space, tab and line ends; A-Z in lower case."""
    if text.isascii():
        folded = text.lower().translate(_ASCII_BLANKS) if _has_other_blanks(text) else text.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return [w for w in folded.split(" ") if w]
    return [w for w in text.translate(_FOLD).split(" ") if w]


_ASCII_BLANKS = {c: " " for c in _BLANKS}


def _has_other_blanks(text: str) -> bool:
    return "\x0b" in text or "\x0c" in text


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct hashed shingles, sorted."""
    if not text:
        return np.empty(0, np.uint64)
    listed = word_list(text)
    if not listed:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, listed), np.uint64, len(listed))
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, np.uint64(n))
        for k in range(n):
            out = _mix(out * _MIX + h[k : len(h) - n + 1 + k])
    return np.unique(out)


_DENSE: dict[tuple[int, int], np.ndarray] = {}


def _tries(bins: int, turn: int) -> np.ndarray:
    """Where each bin looks on a given try."""
    if (bins, turn) not in _DENSE:
        with np.errstate(over="ignore"):
            x = _mix((np.arange(bins, dtype=np.uint64) + np.uint64(1)) * _MIX + np.uint64(turn) * np.uint64(0xD6E8FEB86659FD93))
        _DENSE[bins, turn] = (x % np.uint64(bins)).astype(np.int64)
    return _DENSE[bins, turn]


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One smallest hash for each bin, of a sorted set that is not empty."""
    edges = (((np.arange(bins, dtype=object) << 64) + bins - 1) // bins).astype(np.uint64)
    return _signature(hashes, edges)


def _signature(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    bins = len(edges)
    first = np.searchsorted(hashes, edges)
    after = np.append(first[1:], len(hashes))
    full = first < after
    out = np.zeros(bins, np.uint64)
    out[full] = hashes[first[full]]
    empty, turn = np.flatnonzero(~full), 0
    while len(empty):
        at = _tries(bins, turn)[empty]
        hit = full[at]
        out[empty[hit]] = out[at[hit]]
        empty, turn = empty[~hit], turn + 1
    return out


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.arange(bands, dtype=np.uint64) + np.uint64(1)
        for k in range(rows):
            out = _mix(out * _MIX + sign.reshape(bands, rows)[:, k])
    return out


def _name(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    import xxhash

    name = xxhash.xxh3_128_intdigest(found.tobytes())
    return (name >> 64) - (1 << 63), (name & (1 << 64) - 1) - (1 << 63)


def _sign(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (((np.arange(bands * rows, dtype=object) << 64) + bands * rows - 1) // (bands * rows)).astype(np.uint64)
        for batch in batches:
            sizes, high, low, keys, ends = [], [], [], [], [0]
            for text in batch.column(1):
                found = shingle_set(text.as_py(), words)
                sizes.append(len(found))
                for column, half in zip((high, low), _name(found), strict=True):
                    column.append(half)
                if len(found):
                    keys.append(band_keys(_signature(found, edges), bands, rows).view(np.int64))
                ends.append(ends[-1] + (bands if len(found) else 0))
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), lists], ["doc_id", "text_hash", "n", "h1", "h2", "keys"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found = [], []
            for node, text, high, low in zip(*batch.columns, strict=True):
                hashes = shingle_set(text.as_py(), words)
                if _name(hashes) == (high.as_py(), low.as_py()):  # another text may have the same doc_id
                    nodes.append(node.as_py())
                    found.append(hashes.view(np.int64))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["node", "hashes"])

    return run


def _confirm(threshold: int):
    """Pairs of sets -> the pairs whose similarity reaches threshold percent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            a, b = (np.asarray(c.flatten()) for c in (left, right))
            ae, be = (np.concatenate([[0], np.cumsum(np.asarray(c.value_lengths()))]) for c in (left, right))
            good = []
            for i in range(batch.num_rows):
                x, y = a[ae[i] : ae[i + 1]], b[be[i] : be[i + 1]]
                if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                good.append(100 * same >= threshold * (len(both) - same))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return run


def _grouped(docs: DataFrame, words: int, threshold: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n, group, component_id) with shingles, and rows (doc_id, text_hash, n) without."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = checkpoint(named.mapInArrow(tidy(_sign(words, bands, rows)), "doc_id long, text_hash long, n long, h1 long, h2 long, keys array<long>"))
    some = signed.where("n > 0")
    own = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("own")
    classes = some.groupBy("h1", "h2").agg(own, F.min("n").alias("n"), F.min("keys").alias("keys"))
    classes = checkpoint(classes.select("h1", "h2", F.col("own.doc_id").alias("least"), F.col("own.text_hash").alias("least_hash"), "n", "keys", F.monotonically_increasing_id().alias("node")))
    component = checkpoint(_components(docs, classes, words, threshold))
    release(docs.sparkSession)
    owned = classes.join(component, "node", "left").select("h1", "h2", "least", F.coalesce("component", "node").alias("group"))
    leasts = owned.groupBy("group").agg(F.min("least").alias("component_id"))
    names = owned.join(leasts, "group").select("h1", "h2", "group", "component_id")
    grouped = some.select("doc_id", "text_hash", "n", "h1", "h2").join(names, ["h1", "h2"]).drop("h1", "h2")
    return grouped, signed.where("n = 0").select("doc_id", "text_hash", "n")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, threshold: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text)."""
    grouped, alone = _grouped(docs, words, threshold, bands, rows)
    out = grouped.select("doc_id", "n", "component_id").unionByName(alone.select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = SHINGLE, threshold: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs, all columns, that stay: of each group the one with the least doc_id.

    Rows equal in doc_id and text count as one.
    """
    grouped, alone = _grouped(docs, words, threshold, bands, rows)
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x"))
    stay = checkpoint(first.select("x.doc_id", "x.text_hash").unionByName(alone.select("doc_id", "text_hash").distinct()))
    stay = stay.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"))
    key = F.xxhash64(F.col("text").cast("string"))
    out = docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (key == F.col("__hash")), "left_semi")
    every = grouped.select("doc_id", "text_hash").unionByName(alone.select("doc_id", "text_hash"))
    repeated = every.groupBy("doc_id", "text_hash").count().where("count > 1")
    return out if repeated.isEmpty() else out.dropDuplicates(["doc_id", "text"])


def _components(docs: DataFrame, classes: DataFrame, words: int, threshold: int) -> DataFrame:
    """(node, component) of the classes that have a confirmed link."""
    spread = classes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("hub")).where("members > 1")
    buckets = settled(spread.join(shared.select("key", "hub"), "key").select("key", "band", "node", "n", "hub"))
    sets = _set_table(docs, classes, buckets, words)
    tried = settled(buckets.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    links = settled(_confirmed(tried, sets, threshold))
    release(docs.sparkSession)
    component = settled(connected_components(links))
    release(docs.sparkSession)
    owned = buckets.join(component, "node", "left").select("key", "band", "node", "n", F.coalesce("component", "node").alias("component"))
    open_ = owned.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    rest = settled(owned.join(open_.select("key"), "key"))
    more = _across(rest, classes, sets, tried, threshold)
    release(docs.sparkSession)
    # the stars' components and what joins them: a small graph of components
    named = component.withColumnRenamed("node", "x").withColumnRenamed("component", "c")
    ends = more.join(named, F.col("a") == F.col("x"), "left").select("b", F.coalesce("c", "a").alias("a"))
    ends = ends.join(named, F.col("b") == F.col("x"), "left").select("a", F.coalesce("c", "b").alias("b"))
    top = settled(connected_components(ends))
    every = component.unionByName(top.where("node != component").select("node", F.col("node").alias("component"))).distinct()
    over = top.select(F.col("node").alias("component"), F.col("component").alias("root"))
    return every.join(over, "component", "left").select("node", F.coalesce("root", "component").alias("component"))


def _possible(n: str, m: str, threshold: int):
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * threshold


def _across(rest: DataFrame, classes: DataFrame, sets: DataFrame, tried: DataFrame, threshold: int) -> DataFrame:
    """Confirmed links between different components that share a bucket.

    Small buckets give pairs, each from its first common bucket only. In a large one, the members
    outside its main component meet all members block by block, in memory; no pairs are listed.
    """
    sizes = rest.groupBy("key", "component").count().groupBy("key").agg(F.sum("count").alias("members"), F.max_by("component", "count").alias("main"), F.max("count").alias("most"))
    owned = settled(rest.join(sizes, "key"))
    keyed = owned.where(F.col("members") <= PAIRED).join(classes.select("node", "keys"), "node")
    one = keyed.select("key", "band", F.col("node").alias("a"), F.col("n").alias("n1"), F.col("component").alias("c1"), F.col("keys").alias("k1"))
    two = keyed.select("key", F.col("node").alias("b"), F.col("n").alias("n2"), F.col("component").alias("c2"), F.col("keys").alias("k2"))
    first = F.array_position(F.zip_with("k1", "k2", lambda x, y: x == y), True) == F.col("band") + 1
    pairs = one.join(two, "key").where((F.col("a") > F.col("b")) & (F.col("c1") != F.col("c2")) & _possible("n1", "n2", threshold) & first).select("a", "b")
    small = _confirmed(pairs.join(tried, ["a", "b"], "left_anti"), sets, threshold)
    large = owned.where(F.col("members") > PAIRED).join(sets, "node").select("key", "node", "component", "hashes", "main", F.ceil((F.col("members") - F.col("most")) / BLOCK_LEFT).cast("int").alias("left_blocks"), F.ceil(F.col("members") / BLOCK_RIGHT).cast("int").alias("right_blocks"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = large.where("component != main").select("key", block("left_blocks").alias("i"), every("right_blocks").alias("j"), "node", "component", "hashes")
    inside = large.select("key", every("left_blocks").alias("i"), block("right_blocks").alias("j"), "node", "component", "hashes")
    inside = inside.toDF("key2", "i2", "j2", "node", "component", "hashes")
    met = outside.groupBy("key", "i", "j").cogroup(inside.groupBy("key2", "i2", "j2")).applyInArrow(_meet(threshold), "a long, b long")
    return settled(small.unionByName(met))


#: Buckets of up to so many members are compared as pairs; larger ones in blocks of these sizes.
PAIRED, BLOCK_LEFT, BLOCK_RIGHT = 16, 256, 1024


def _meet(threshold: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        links = {"a": [], "b": []}
        if left.num_rows and right.num_rows:
            flat = [np.asarray(t["hashes"].combine_chunks().flatten()) for t in (left, right)]
            sizes = [np.asarray(t["hashes"].combine_chunks().value_lengths()).astype(np.int64) for t in (left, right)]
            owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
            own, place = np.unique(np.concatenate(flat), return_inverse=True)
            width, cut = len(own), len(flat[0])
            common = np.zeros((left.num_rows, right.num_rows), np.float32)
            for at in range(0, width, 4096):  # counts of common shingles, some columns at a time
                tables = []
                for side, where in enumerate((place[:cut], place[cut:])):
                    here = (where >= at) & (where < at + 4096)
                    m = np.zeros((len(sizes[side]), min(4096, width - at)), np.float32)
                    m[owner[side][here], where[here] - at] = 1
                    tables.append(m)
                common += tables[0] @ tables[1].T
            same = common.astype(np.int64)
            union = sizes[0][:, None] + sizes[1][None, :] - same
            groups = [np.asarray(t["component"]) for t in (left, right)]
            x, y = np.nonzero((100 * same >= threshold * union) & (groups[0][:, None] != groups[1][None, :]))
            names = [np.asarray(t["node"]) for t in (left, right)]
            one = {(c, d): (a, b) for a, b, c, d in zip(names[0][x].tolist(), names[1][y].tolist(), groups[0][x].tolist(), groups[1][y].tolist(), strict=True)}
            for a, b in one.values():  # one link joins two components
                links["a"].append(max(a, b))
                links["b"].append(min(a, b))
        return pa.table({k: pa.array(v, pa.int64()) for k, v in links.items()})

    return run


def _set_table(docs: DataFrame, classes: DataFrame, buckets: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of every class that shares a bucket, from the text of its least doc_id."""
    wanted = settled(classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "h1", "h2", F.col("least").alias("own"), "least_hash"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("own")) & (F.xxhash64("text") == F.col("least_hash"))).select("node", "text", "h1", "h2")
    sets = checkpoint(texts.mapInArrow(tidy(_sets(words)), "node long, hashes array<long>"))
    found, distinct = sets.agg(F.count("node"), F.count_distinct("node")).first()
    return sets if found == distinct else checkpoint(sets.groupBy("node").agg(F.min("hashes").alias("hashes")))


def _confirmed(edges: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough."""
    left = edges.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(tidy(_confirm(threshold)), "a long, b long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
