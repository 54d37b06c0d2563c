import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from gridloom.llm import runs
from gridloom.llm.runs import collapsed, repeated_tail, runs_of, split_words, strongest

from .conftest import ODD


def brute(words):
    """Every maximal stretch of each period, kept if that period is its smallest."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng):
    kind, words = rng.random(), []
    for _ in range(rng.randint(0, 6)):
        block = [rng.choice("ab" if kind < 0.4 else "abcde") for _ in range(rng.randint(1, 9))]
        words += block * rng.choice([1, 1, 2, 3, 4, 5, 9])
        if rng.random() < 0.5:
            words += block[: rng.randint(0, len(block))]
    return words


def test_runs_match_brute_force():
    rng = random.Random(3)
    texts = [made(rng) for _ in range(1500)]
    for text, got in zip(texts, runs_of(texts), strict=True):
        assert got == brute(text), text
    for text in texts[:200]:  # alone and together alike
        assert runs_of([text])[0] == brute(text)


@pytest.mark.parametrize("words", [list("aaaaaa"), list("aaaaa"), ["x"] * 700, list("ab") * 300 + list("ba") * 5, (list("abcab") * 40 + ["z"]) * 12, list("abcdefg") * 4, [str(i) for i in range(500)] * 4])
def test_regular_texts(words):
    assert runs_of([words])[0] == brute(words)


def test_fibonacci_words():
    a, b = "a", "ab"
    while len(b) < 900:
        a, b = b, b + a
    assert runs_of([list(b)])[0] == brute(list(b))
    assert runs_of([list(b * 5)])[0] == brute(list(b * 5))


def test_every_step_is_the_partition_of_equal_factors():
    rng = random.Random(8)
    for _ in range(60):
        texts = [made(rng) for _ in range(3)]
        flat = [w for t in texts for w in t]
        code = {w: i for i, w in enumerate(sorted(set(flat)))}
        part = runs.Partition(np.array([code[w] for w in flat], np.int64), np.cumsum([len(t) for t in texts]))
        base = np.cumsum([0] + [len(t) + 1 for t in texts])
        for length in range(1, 12):
            groups = {}
            for k, t in enumerate(texts):
                for i in range(len(t) - length + 1):
                    groups.setdefault((k, tuple(t[i : i + length])), []).append(int(base[k]) + i)
            for members in groups.values():
                if len(members) >= runs.ALIVE:  # smaller classes are left at rest
                    c = part.label[members[0]]
                    assert set(part.label[members]) == {c} and part.size[c] == len(members)
                    assert sorted(part.order[part.first[c] : part.first[c] + part.size[c]]) == members
                    assert [part.after[i] for i in members] == [*members[1:], -1] and [part.before[i] for i in members] == [-1, *members[:-1]]
            part.refine()


def test_moves_stay_small():
    """A text that repeats for long is refined with few moves: n log n, not n times the length."""
    n = 4000
    for words in (np.zeros(n, np.int64), np.arange(n) % 40, np.arange(n) % 1000):
        part, moves = runs.Partition(words, np.array([n])), 0
        for _ in range(n // 4):
            moves += len(part.splitters)
            part.refine()
        assert moves <= 2 * n * np.log2(n)


def test_strongest_and_collapsed():
    assert strongest([]) is None
    assert strongest([(9, 8, 2), (0, 6, 1), (4, 12, 2)]) == (0, 6, 1)
    assert collapsed(list("xababababy"), [(1, 8, 2)]) == list("xaby")
    assert collapsed(list("ab"), []) == list("ab")


def want(doc_id, text):
    words = split_words(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(left))


def test_op11(spark, sf, tmp_path):
    rows = [(d, t) for d, t in ODD if len(t or "") < 5000]
    rows += [(d, " ".join(random.Random(d).choices("one two three four five six seven".split(), k=d % 90))) for d in range(100, 260)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 start", "'x' period").write.parquet(str(tmp_path / "some/documents.parquet"))
    got = [tuple(r) for r in runs.op11(spark, str(tmp_path / "some")).collect()]
    assert sorted(map(str, got)) == sorted(str(want(d, t)) for d, t in rows)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 8
    whole = {r["doc_id"]: r for r in runs.op11(spark, sf()).collect()}
    assert whole[8]["n_runs"] == 1 and whole[8]["length"] >= 5000  # six thousand equal words
    assert runs.op11(spark, sf(empty=True)).count() == 0


def test_table_and_collapse(spark, odd):
    df = spark.createDataFrame([(1, "a b a b a b a b  c", 5), (2, "keep  this", 6), (3, None, 7)], "id int, text string, start int")
    assert [tuple(r) for r in runs.run_table(df, "id", "text").collect()] == [(1, 0, 8, 2)]
    assert [r["text"] for r in runs.collapse(df).orderBy("id").collect()] == ["a b c", "keep  this", None]
    assert runs.collapse(odd).columns == odd.columns and runs.collapse(odd).count() == odd.count()


def test_repeated_tail():
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert repeated_tail([], ids[0]) == [] and repeated_tail(["a"], None) == ["a"] and repeated_tail(["a"], ids[0]) == ["a"]
