"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage of PASSAGE bytes is encoded by fixed surface
features: how often byte classes and pairs of classes occur, and how much of it repeats.
A hidden layer and gated attention (tanh times sigmoid) are learned from document labels;
the attention-weighted passage gives the score. The fit takes at most SAMPLE labelled rows,
each with all its passages, and of these rows as many as have at most PASSAGES together; of rows
with one doc_id the fit takes one; scores read every passage of every text.

Defined results: null and empty texts are one empty passage; equal texts get equal scores; rows
without a label are scored like others; a table without usable labels scores everything 0.5; very
long texts are scored over all their passages; repeated rows give equal rows; an empty table gives no rows;
other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, slices, table, tidy

PASSAGE = 1024
SAMPLE, PASSAGES = 6000, 144_000
THRESHOLD = 0.3
SLICE = 1 << 20  # bytes encoded at a time

#: Byte classes, each a set of bytes; what is in none of them is class 0.
_CLASSES = [b" ", b"\n\r\t\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"'\"", b"-_", b"|", b"$%&#*@~^+=", b"<>/\\", b"()[]{}", b":;", bytes(range(128, 256))]
N_CLASSES = len(_CLASSES) + 1
_CLASS = np.zeros(256, np.int64)
for _n, _members in enumerate(_CLASSES):
    _CLASS[list(_members)] = _n + 1
N_FEATURES = N_CLASSES + N_CLASSES * N_CLASSES + 4


def encode_passages(texts: list[bytes], passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, number of passages of each text)"""
    counts = np.array([max(1, -(-len(t) // passage)) for t in texts], np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(counts) - counts
    data = np.frombuffer(b"".join(texts), np.uint8)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    where = np.repeat(first, lengths) + inside // passage
    n = int(counts.sum())
    kind = _CLASS[data]
    ones = np.bincount(where * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(np.float32)
    same = where[1:] == where[:-1]
    pairs = np.bincount((where[1:] * N_CLASSES + kind[1:])[same] * N_CLASSES + kind[:-1][same], minlength=n * N_CLASSES**2).reshape(n, -1).astype(np.float32)
    size = np.bincount(where, minlength=n).astype(np.float32)
    distinct = _distinct(data, where, n, np.cumsum(lengths))
    share = np.maximum(size, 1)[:, None]
    return np.hstack([np.sqrt(ones / share), np.sqrt(pairs / share), (distinct / np.maximum(size, 1))[:, None], np.log1p(size)[:, None], np.log1p(np.repeat(lengths, counts).astype(np.float32))[:, None], (size == 0).astype(np.float32)[:, None]]), counts


def _distinct(data: np.ndarray, where: np.ndarray, n: int, ends: np.ndarray) -> np.ndarray:
    """How many of 4096 hashed 8-byte windows each passage touches: low where it repeats itself.

    Windows that would reach into the next text do not count.
    """
    if len(data) < 8:
        return np.zeros(n, np.float32)
    h = data[:-7].astype(np.uint32)
    for k in range(1, 8):
        h = h * np.uint32(0x01000193) ^ data[k : len(data) - 7 + k]
    h = (h * np.uint32(2654435761)) >> np.uint32(20)
    inside = np.ones(len(data), bool)
    last = (ends[:, None] - np.arange(1, 8)).ravel()
    inside[last[last >= 0]] = False
    inside = inside[:-7]
    seen = np.zeros(n << 12, bool)
    seen[((where[:-7] << 12) + h)[inside]] = True
    return seen.reshape(n, -1).sum(1).astype(np.float32)


def encode_bags(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """encode_passages over slices of bounded size."""
    held, size = [], 0
    for t in texts:
        held.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= SLICE:
            yield encode_passages(held)
            held, size = [], 0
    if held:
        yield encode_passages(held)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """h = tanh(x P); a = softmax of w (tanh(h V) * sigmoid(h U)) in a bag; score = sigmoid(sum(a h) c + b)."""

    def __init__(self, features: int, hidden: int = 32, gate: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(features, np.float32), np.ones(features, np.float32)
        self.w = {"P": draw(features, hidden), "p": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1), "c": draw(hidden, 1), "b": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict]:
        w = self.w
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["P"] + w["p"])
        v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = ((v * u) @ w["w"])[:, 0]
        starts = np.cumsum(counts) - counts
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        score = _sigmoid((z @ w["c"])[:, 0] + w["b"][0])
        return score, {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "starts": starts}

    def gradient(self, kept: dict, counts: np.ndarray, error: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean of the losses whose derivative by the logit is ``error``."""
        w, n = self.w, len(counts)
        d = (error / n)[:, None].astype(np.float32)
        g = {"c": kept["z"].T @ d, "b": d.sum(0)}
        dz = np.repeat(d @ w["c"].T, counts, axis=0)
        da = (dz * kept["h"]).sum(1)
        a = kept["a"]
        de = (a * (da - np.repeat(np.add.reduceat(a * da, kept["starts"]), counts)))[:, None]
        g["w"] = (kept["v"] * kept["u"]).T @ de
        dv, du = de @ w["w"].T * kept["u"] * (1 - kept["v"] ** 2), de @ w["w"].T * kept["v"] * kept["u"] * (1 - kept["u"])
        g["V"], g["U"] = kept["h"].T @ dv, kept["h"].T @ du
        dh = (a[:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - kept["h"] ** 2)
        g["P"], g["p"] = kept["x"].T @ dh, dh.sum(0)
        return g

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 0) -> GatedAttention:
        every = np.vstack(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.02
        rng, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                counts = np.array([len(bags[i]) for i in own])
                score, kept = self.forward(np.vstack([bags[i] for i in own]), counts)
                grad = self.gradient(kept, counts, score - labels[own])
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, g in grad.items():
                    g = g + decay * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """In double arithmetic and rounded, so that a text's neighbours in a batch leave no trace."""
        out = [self.forward(x.astype(np.float64), counts)[0] for x, counts in encode_bags(texts)]
        return np.round(np.concatenate(out), 9) if out else np.zeros(0)


def held_out(doc_id="doc_id"):
    """crc32 of the id's text, mod 5, is 0; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text, label in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            bag = np.vstack([x for x, _ in encode_bags([text.as_py()])])
            yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([label.as_py()], pa.float64()), pa.array([bag.astype(np.float32).tobytes()], pa.binary())], ["doc_id", "label", "bag"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> GatedAttention | None:
    """Fit on the ``sample`` labelled rows whose hash is smallest, without those beyond PASSAGES; None without both classes."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by ``sample``
    passages = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE))
    left, fit = PASSAGES, []
    sizes = rows.groupBy("doc_id").agg(F.max(passages).alias("n"), F.xxhash64("doc_id").alias("hash")).collect()  # at most ``sample`` ids
    for r in sorted(sizes, key=lambda r: (r["hash"], r["doc_id"])):
        if r["n"] <= left:
            left -= r["n"]
            fit.append((r["doc_id"],))
    if len(fit) < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(fit, "doc_id long")), "doc_id")
    bags = rows.select("doc_id", "text", "label").mapInArrow(tidy(_sampled), "doc_id long, label double, bag binary")
    one = bags.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("bag").alias("bag"))  # a repeated id counts once, before anything is collected
    got = {r["doc_id"]: (np.frombuffer(bytes(r["bag"]), np.float32).reshape(-1, N_FEATURES), r["label"]) for r in one.orderBy("doc_id").collect()}  # at most ``sample`` ids
    y = np.array([v for _, v in got.values()])
    if len(got) < 2 or y.min() == y.max():
        return None
    model = GatedAttention(N_FEATURES).fit([b for b, _ in got.values()], y)
    got.clear()
    give_back()
    return model


def score_documents(docs: DataFrame, model: GatedAttention | None) -> DataFrame:
    """(doc_id, score) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = batch.column(1).to_pylist()
            got = model.scores(texts) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, score double")


def keep_good(docs: DataFrame, model: GatedAttention | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        out = pd.Series(model.scores(texts.tolist()) if model else np.full(len(texts), 0.5))
        give_back()
        return out

    return docs.where(score(F.col("text").cast("string")) >= threshold)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
