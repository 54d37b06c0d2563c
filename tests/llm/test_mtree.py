import math
import random

import numpy as np

from gridloom.llm import mtree
from gridloom.llm.mtree import Search, build


def brute(rows, k=5):
    """query -> best (score, id), over integer vectors; every row counts."""
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for own, (q, mine) in enumerate(whole):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(mine, v)), i) for n, (i, v) in enumerate(whole) if n != own)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def rows_of(n, dim, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    return [(i, (centres[i % 8] + spread * rng.standard_normal(dim)).astype(np.float32).tolist()) for i in range(n)]


def test_search_of_one_tree_is_exact_and_spares_work():
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * (rng.standard_normal((20, 16))[rng.integers(0, 20, 3000)] + 0.05 * rng.standard_normal((3000, 16)))).astype(np.int64)
    ids = np.arange(3000)
    largest = float((vectors**2).sum(1).max())
    pages, router, extra, radius = build(ids, vectors, largest)
    assert sorted(np.concatenate([p.ids for p in pages if p.leaf]).tolist()) == ids.tolist()
    for q in range(0, 3000, 97):
        search = Search(pages, router, extra, largest)
        scores = vectors @ vectors[q]
        want = sorted(((-s, i) for i, s in enumerate(scores.tolist()) if i != q))[:5]
        assert search.top(q, vectors[q], 5) == [(-s, i) for s, i in want]
        assert search.top(q, vectors[q], 5, floor=-want[2][0])[:3] == [(-s, i) for s, i in want][:3]
    assert search.measured < 3000


def test_many_trees_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE", 100)
    monkeypatch.setattr(mtree, "BLOCK", 5)
    monkeypatch.setattr(mtree, "PAGE", 16)
    monkeypatch.setattr(mtree, "PIVOTS", 4)
    rows = [*rows_of(700, 6), *rows_of(60, 6, spread=0.0), *[(50, rows_of(1, 6)[0][1])] * 30]
    vectors = mtree.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = mtree.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows)


def test_ties_repeats_and_bad_vectors(spark, tmp_path):
    rng = random.Random(0)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(400)]
    rows += [(1000, None), (1001, []), (1002, [1.0, None, 0.0]), (1003, [float("nan"), 1.0, 1.0]), (1050, [float("inf"), 0.0, 0.0]), (None, [9.0, 9.0, 9.0]), (50, [1.0, 1.0, 1.0]), (50, [1.0, 1.0, 1.0]), (3, [5.0, 5.0, 5.0])]
    spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = mtree.op6(spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows)


def test_few_and_no_rows(spark, tmp_path):
    for name, rows in {"few": [(0, [1.0, 2.0]), (1, [0.5, 0.25]), (2, [0.0, 0.0])], "one": [(0, [1.0])], "no": []}.items():
        spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / name / "embeddings.parquet"))
        got = mtree.op6(spark, str(tmp_path / name)).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows)
