import math
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from gridloom.llm import backoff
from gridloom.llm.minhash import word_list

from .conftest import ODD
from .test_minhash import corpus, words_of


def brute(rows):
    texts = [words_of(t) for _, t in rows]
    one, two = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(t, t[1:]))
    total = max(1, sum(one.values()))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        score, back = 0.0, 0
        for i, w in enumerate(t):
            pair = (t[i - 1], w)
            if i and two[pair] >= 2:
                score += math.log(two[pair] / one[t[i - 1]])
            else:
                score, back = score + math.log((0.4 if i else 1) * one[w] / total), back + 1
        out.append((d, len(t), back, round(score, 3), round(score / len(t), 5) if t else None))
    return out


def test_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(backoff, "PARTS", 5)
    monkeypatch.setattr(backoff, "NARROW", 4)
    rows = [*corpus(1), *ODD]
    got = backoff.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    rounded = [(r[0], r[1], r[2], round(r[3], 3), None if r[4] is None else round(r[4], 5)) for r in got]
    near = lambda a, b: a[:3] == b[:3] and abs(a[3] - b[3]) < 0.01
    key = lambda r: (str(r[0]), r[1], r[3])
    assert all(near(a, b) for a, b in zip(sorted(rounded, key=key), sorted(brute(rows), key=key), strict=True))


def brute_of_order(rows, order):
    texts = [words_of(t) for _, t in rows]
    seen = Counter(tuple(t[i : i + n]) for t in texts for n in range(1, order + 1) for i in range(len(t) - n + 1))
    total = max(1, sum(map(len, texts)))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        score, back = 0.0, 0
        for i in range(len(t)):
            factor = 1.0
            for n in range(min(i + 1, order), 0, -1):
                gram = tuple(t[i - n + 1 : i + 1])
                if n == 1 or seen[gram] >= 2:
                    score += math.log(factor * seen[gram] / (seen[gram[:-1]] if n > 1 else total))
                    back += n == 1
                    break
                factor *= 0.4
        out.append((d, len(t), back, score))
    return out


def test_longer_contexts(spark, monkeypatch):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(backoff, "PARTS", 5)
    rows = [*corpus(2), *ODD, (70, "a"), (71, "a b"), (72, "a b c"), (73, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 3))
    scores = {}
    for order in (1, 2, 3, 4):
        got = sorted((tuple(r)[:4] for r in backoff.score_documents(docs, order).collect()), key=key)
        want = sorted(brute_of_order(rows, order), key=key)
        assert all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want, strict=True))
        scores[order] = sum(r[3] for r in got)
    assert scores[3] != scores[2]


def test_rows_repeated_across_partitions(spark):
    rows = [*corpus(3), *ODD]
    one = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r)[:4] for r in backoff.score_documents(one.unionAll(one)).collect() if r[0] is not None)
    want = sorted(r for r in brute_of_order(rows * 2, 2) if r[0] is not None)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want, strict=True))


def test_one_row_many_times(spark):
    rows = [(1, "a b c a b")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    (want,) = {r[1:] for r in brute_of_order(rows, 2)}
    got = backoff.score_documents(docs).collect()
    assert len(got) == 500
    assert all(r[1:3] == want[:2] and abs(r[3] - want[2]) < 1e-9 for r in got)


def test_count_tables(spark, monkeypatch):
    monkeypatch.setattr(backoff, "PARTS", 5)
    rows = [*corpus(4), *ODD]
    dealt, size = backoff.dealt_to_blocks(spark.createDataFrame(rows, "doc_id long, text string"), 2000)
    exploded, counted = backoff.count_tables(dealt, backoff.partitions(size, 2), 2)
    texts = [words_of(t) for _, t in rows]
    seen = Counter(tuple(t[i : i + n]) for t in texts for n in (1, 2) for i in range(len(t) - n + 1))
    assert sorted(r["total"] for r in counted.collect()) == sorted(seen.values())
    assert exploded.agg({"count": "sum"}).first()[0] == sum(seen.values())


def test_rows_that_travel_grow_with_the_input(spark):
    text = lambda n: " ".join(f"w{(n * 7919 + k * 104729) % 5000}" for k in range(300))
    sizes = []
    for n in (100, 200, 400):
        dealt, size = backoff.dealt_to_blocks(spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id long, text string"), 20_000)
        sizes.append(backoff.count_tables(dealt, backoff.partitions(size, 2))[0].select("part", "block").distinct().count())
    assert sizes[2] < 2.6 * sizes[1] < 2.6 * 2.6 * sizes[0]


def test_op8(spark, sf):
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_backed_off"], r["log_score"]) for r in backoff.op8(spark, sf()).collect())
    want = sorted((str(r[0]), r[1], r[2], r[3]) for r in brute_of_order(ODD, 2))
    assert all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-3 for a, b in zip(got, want, strict=True))
    assert backoff.op8(spark, sf(empty=True)).count() == 0


def test_hashed_words_are_the_words(monkeypatch):
    long = ["x" * n for n in (7, 8, 9, 16, 63, 64, 65, 30000)] + ["X" * 65, "é" * 32, "é" * 33, "\0", "\0\0", "a\0", "A\0\0", "é\xa0é\u2003日本\x1c\x85b"]
    split = ["glued", "to", "gether", "", None, "\x0b\x0c\r\n\t ", " a\tb\nc\rd\x0be\x0cf ", "A-Z @[`{ İ ſ K"]
    texts = [t for _, t in ODD] + long + split + [" ".join(long)] + [t for _, t in corpus(5)] + [f"{i:x} w{i} {i * i}" for i in range(20000)]
    want = [word_list(t or "") for t in texts]
    everywhere = {w for t in want for w in t}
    for at in (1 << 20, 1, 5000):
        monkeypatch.setattr(backoff, "SLICE", at)
        for kind in (pa.string(), pa.large_string()):
            whole = pa.chunked_array([pa.array(["cut", *texts[:20]], kind)[1:], pa.array([], kind), pa.array([*texts[20:], "cut"], kind)[:-1]])
            hashes, starts = backoff.hashed_words(whole)
            assert starts.tolist() == np.cumsum([0, *map(len, want)])[:-1].tolist()
            names = dict(zip((w for t in want for w in t), hashes.tolist(), strict=True))
            assert [names[w] for t in want for w in t] == hashes.tolist()
            assert len(set(names.values())) == len(everywhere)
    for none in ([], [None], ["", None, " "]):
        hashes, starts = backoff.hashed_words(pa.chunked_array([pa.array(none, pa.string())]))
        assert len(hashes) == 0 and starts.tolist() == [0] * len(none)


def test_words_are_hashed_without_an_object_each():
    texts = [" ".join(f"w{i * 200 + k}" for k in range(200)) for i in range(2000)]
    held = pa.chunked_array([pa.array(texts)])

    def seconds(run):
        taken = []
        for _ in range(3):
            began = time.process_time()
            run()
            taken.append(time.process_time() - began)
        return min(taken)

    one_by_one = seconds(lambda: [xxhash.xxh3_64_intdigest(w.encode()) for t in texts for w in word_list(t)])
    assert seconds(lambda: backoff.hashed_words(held)) < one_by_one / 2
