import math
import random
import zlib

import numpy as np

from gridloom.llm import quality
from gridloom.llm.quality import N_FEATURES, GatedAttention, encode_bags, encode_passages

from .conftest import ODD


def made(n, seed=0):
    rng, rows = random.Random(seed), []
    for d in range(n):
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 700))]
        bad = rng.random() < 0.3
        if bad:  # only a part of the passages shows it
            at = rng.randrange(len(words))
            words[at : at + 60] = [w.upper() + "!!" for w in words[at : at + 60]]
        rows.append((d, " ".join(words), 0 if bad else 1))
    return rows


def plain_features(text):
    """Passages of 1024 bytes, one loop over bytes at a time."""
    data = text.encode()
    out = []
    for at in range(0, max(1, len(data)), 1024):
        part = data[at : at + 1024]
        kinds = [next((n + 1 for n, members in enumerate(quality._CLASSES) if b in members), 0) for b in part]
        ones, pairs, seen = [0] * quality.N_CLASSES, [0] * quality.N_CLASSES**2, set()
        for k in kinds:
            ones[k] += 1
        for a, b in zip(kinds, kinds[1:]):
            pairs[b * quality.N_CLASSES + a] += 1
        for n in range(at, min(at + 1024, len(data) - 7)):
            h = data[n]
            for b in data[n + 1 : n + 8]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
            seen.add((h * 2654435761 & 0xFFFFFFFF) >> 20)
        share = max(1, len(part))
        out.append([math.sqrt(x / share) for x in ones + pairs] + [len(seen) / share, math.log1p(len(part)), math.log1p(len(data)), float(not part)])
    return out


def plain_score(model, text):
    """The forward pass, one number at a time."""
    w = {k: v.astype(float).tolist() for k, v in model.w.items()}
    mean, scale = model.mean.astype(float).tolist(), model.scale.astype(float).tolist()
    hidden, raw = [], []
    for x in plain_features(text):
        x = [min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(x, mean, scale, strict=True)]
        h = [math.tanh(sum(v * row[j] for v, row in zip(x, w["P"], strict=True)) + w["p"][j]) for j in range(len(w["p"]))]
        gated = [math.tanh(sum(v * row[j] for v, row in zip(h, w["V"], strict=True))) / (1 + math.exp(-sum(v * row[j] for v, row in zip(h, w["U"], strict=True)))) for j in range(len(w["w"]))]
        hidden.append(h)
        raw.append(sum(g * row[0] for g, row in zip(gated, w["w"], strict=True)))
    whole = sum(math.exp(e) for e in raw)
    z = [sum(math.exp(e) / whole * h[j] for e, h in zip(raw, hidden, strict=True)) for j in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-sum(v * row[0] for v, row in zip(z, w["c"], strict=True)) - w["b"][0]))


def test_op4_against_a_plain_forward_pass(spark, tmp_path):
    rows = [*[(d, t) for d, t, _ in made(60, 5)], *[(1000 + n, t) for n, (_, t) in enumerate(ODD) if t is None or len(t) < 4000], (2000, "Ünï " * 700), (2001, "a" * 1024), (2002, "a" * 1025)]
    labels = [(d, q, 0) for d, _, q in made(60, 5)]
    where = str(tmp_path / "t")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{where}/documents.parquet")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame.write.parquet(f"{where}/labels.parquet")
    model = quality.train(docs, frame)
    got = {r["doc_id"]: r["score"] for r in quality.op4(spark, where).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        assert abs(got[d] - plain_score(model, t or "")) < 1e-5, d


def test_a_repeated_id_is_collected_once(spark, monkeypatch):
    rows = made(80, 2)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(1, rows[1][1])] * 500, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in rows], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(GatedAttention, "fit", lambda self, bags, y: seen.append(len(bags)) or self)
    quality.train(docs, labels)
    assert seen == [sum(zlib.crc32(str(d).encode()) % 5 > 0 for d, _, _ in rows)]


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    model = GatedAttention(6, hidden=4, gate=3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    counts, y = np.array([3, 1, 5]), np.array([1.0, 0.0, 1.0])
    x = rng.standard_normal((9, 6))
    score, kept = model.forward(x, counts)
    grad = model.gradient(kept, counts, score - y)
    loss = lambda: -np.mean(y * np.log(model.forward(x, counts)[0]) + (1 - y) * np.log(1 - model.forward(x, counts)[0]))
    for name, w in model.w.items():
        for at in [np.unravel_index(i, w.shape) for i in range(0, w.size, max(1, w.size // 3))]:
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            assert abs((up - loss()) / 2e-5 - grad[name][at]) < 1e-6, name
            w[at] = old


def test_every_passage_is_encoded():
    x, counts = encode_passages([b"", b"a" * 1024, b"b" * 1025, "é".encode() * 3000])
    assert counts.tolist() == [1, 1, 2, 6] and x.shape == (10, N_FEATURES) and np.isfinite(x).all()
    alone = np.vstack([e for e, _ in encode_bags(["a" * 1024])])
    assert np.allclose(alone, x[1:2])


def test_held_out_accuracy(spark, sf):
    rows = made(900)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in rows] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model).collect()}
    held = [(d, q) for d, _, q in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([(got[d] >= 0.5) == (q == 1) for d, q in held]) > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, s in got.items() if s >= 0.3}


def test_labels_of_the_fold_are_not_used(spark):
    rows = made(300, 1)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    turned = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, 0) for d, _, q in rows]
    a, b = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in ([(d, q, 0) for d, _, q in rows], turned))
    assert all(np.array_equal(a.w[k], b.w[k]) for k in a.w)


def test_fit_sees_whole_bags(spark, monkeypatch):
    """Every passage of a sampled row is learned from; beyond the bound whole rows are left out."""
    long = [d for d in range(1, 40) if zlib.crc32(str(d).encode()) % 5][:8]
    docs = spark.createDataFrame([(d, "word " * (6144 if n < 2 else 205)) for n, d in enumerate(long)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, n % 2, 0) for n, d in enumerate(long)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(GatedAttention, "fit", lambda self, bags, y: seen.append(sorted(map(len, bags))) or self)
    quality.train(docs, labels)
    monkeypatch.setattr(quality, "PASSAGES", 40)
    quality.train(docs, labels)
    assert seen[0] == [2] * 6 + [30, 30] and set(seen[1]) <= {2, 30} and sum(seen[1]) <= 40


def test_op4_on_odd_rows(spark, sf):
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(1, 11)], "doc_id long, quality int, toxic int")
    rows = quality.op4(spark, sf(labels=labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    five = {r["score"] for r in rows if r["doc_id"] in (1, 5)}
    assert len(five) == 1
    assert quality.op4(spark, sf(empty=True, labels=labels)).count() == 0


def test_without_labels(spark, sf):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.op4(spark, sf(labels=labels)).collect()} == {0.5}
