import random
import re

import numpy as np
import pytest

from gridloom.llm import minhash
from gridloom.llm.graph import connected_components

from .conftest import ODD


def words_of(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", folded)


def shingles(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent=80):
    """(doc_id, set size, component) of each row, all pairs compared."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def corpus(seed=0):
    """Groups whose members change more and more words, so that many pairs lie near the threshold."""
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8)))
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 30, 120]))]
        for n in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((" ".join(copy)).upper() if n % 5 == 0 else "\n".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("n", [4, 5])
def test_against_all_pairs(spark, n):
    rows = [*corpus(n), *[(d, t) for d, t in ODD]]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=n).collect()
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(brute(rows, n), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("paired", [1, 2, 10_000])
def test_blocks_and_pairs_find_the_same(spark, monkeypatch, paired):
    """Buckets compared in blocks, in pairs, and in both ways."""
    monkeypatch.setattr(minhash, "PAIRED", paired)
    monkeypatch.setattr(minhash, "BLOCK_LEFT", 3)
    monkeypatch.setattr(minhash, "BLOCK_RIGHT", 5)
    rows = [*corpus(4), *ODD]
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    for n in range(60):  # near the threshold of one another, on both sides
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((9000 + n, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=4).collect()
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(brute(rows, 4), key=key)


def test_keep_one_leaves_one_of_each_group(spark, odd):
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 0 and ids.count(1) == 1 and {2, 3, 4, 7, 8, 9, 10} <= set(ids) and ids.count(None) == 2


def test_star_edges_stay_linear(spark):
    """A bucket of n sets makes n - 1 candidates while its stars link it all."""
    rows = [(n, " ".join(f"w{k}" for k in range(100)) + f" end{n}") for n in range(300)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r["component_id"] for r in got} == {0}


def test_empty(spark, none):
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.keep_one(none).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    a, b = np.sort(base[:900]), np.sort(base[100:])
    same = np.mean([minhash.signature(a, 512) == minhash.signature(b, 512)])
    assert abs(same - 0.8) < 0.06
    assert len(set(minhash.signature(a[:3], 64).tolist())) <= 3


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100}
