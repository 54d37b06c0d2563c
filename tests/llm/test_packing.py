import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import packing
from gridloom.llm.packing import Packing, crossover, evolve, first_packing, from_bins, mutate, pack

from .conftest import ODD


def valid(p, sizes, capacity):
    assert sorted(i for b in p.bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) == capacity - r and r >= 0 for b, r in zip(p.bins, p.room, strict=True))


def test_operators_keep_packings_whole():
    rng = random.Random(0)
    for _ in range(40):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 300))]
        a, b = (first_packing(sizes, 100, rng) for _ in range(2))
        for p in (a, b, crossover(a, b, rng), mutate(a, rng), from_bins(a.bins, sizes, 100)):
            valid(p, sizes, 100)


def best_fit_decreasing(sizes, capacity):
    out = Packing(sizes, capacity)
    out.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]))
    return out


def test_evolution_beats_or_equals_best_fit():
    rng = random.Random(3)
    worse = 0
    for seed in range(12):
        sizes = [rng.choice([34, 33, 50, 26, 25, 41, 17]) + rng.randint(-3, 3) for _ in range(120)]
        alive, _ = evolve(sizes, 100, [], seed, offspring=80)
        valid(alive[0], sizes, 100)
        worse += len(alive[0].bins) - len(best_fit_decreasing(sizes, 100).bins)
    assert worse <= 0


def test_crossover_makes_the_packing_of_the_given_tables(spark):
    """The search starts worse than the bound and reaches it by children, on every problem."""
    t = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("cast(doc_id as long) doc_id", "text")
    cut = docs.mapInArrow(packing._pieces(t, 2048, 0), "doc_id long, piece int, start long, length long, ids_crc32 long")
    items = packing.checkpoint(cut.where("length < 2048").select(F.monotonically_increasing_id().alias("item"), "length"))
    state = packing._evolved(packing.checkpoint(packing._numbered(items)), 2048, packing.ISLANDS, packing.EPOCHS).collect()
    assert state and sum(r["children"] for r in state) > 0
    lengths = [r["length"] for r in items.collect()]
    start = first_packing(lengths, 2048, random.Random(0))
    bound = -(-sum(lengths) // 2048)
    assert len(start.bins) > bound == max(-r["score"][0] for r in state) == len(best_fit_decreasing(lengths, 2048).bins)


def placed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_many_problems(spark, monkeypatch):
    monkeypatch.setattr(packing, "PROBLEM", 150)
    rng = random.Random(1)
    lengths = [rng.choice([2048, rng.randint(1, 2047), rng.randint(1, 400), 700]) for _ in range(1500)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    rows = pack(items).join(items, "item").collect()
    assert sorted(r["item"] for r in rows) == list(range(1500))
    whole = best_fit_decreasing(lengths, 2048)  # over all at once
    assert placed(rows, 2048) <= 1.005 * len(whole.bins)


def test_op9(spark, sf):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.op9(spark, sf()).collect()
    want = []
    for d, text in ODD:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(str(d), n, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048])) for n, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    total = sum(w[3] for w in want)
    assert placed(rows, 2048) == -(-total // 2048)
    assert packing.op9(spark, sf(empty=True)).count() == 0
