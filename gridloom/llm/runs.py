"""Periodic runs of words, found by Crochemore's partition refinement.

Positions of a text are put into classes of equal factors, first of length 1, then of one word
more at a time. A class of length l + 1 follows from l by splitting with the classes that
were new at l, all but a largest child of each, so that a position is moved only when its
class at least halves. Neighbouring members of a class at a distance equal to the length begin a
primitive square; squares of one period at consecutive places merge into a run.

Spark deals the documents to tasks; within a task the texts of a slice are refined together,
their classes kept apart, as array operations over the positions moved in a step. Classes
of at most two members are left at rest: a run of exponent four or more has at least three
members in each class that it needs.

Defined results: null and empty texts, and blank ones, have no words and no runs; a text of any
length is refined whole, in memory that grows with its words; equal texts give equal runs;
other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pick, slices, table, tidy

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has at least this exponent and this many words.
EXPONENT, SHORTEST = 4, 6
#: Members a class needs to be looked at further.
ALIVE = 3
#: Bytes of text refined at once, if no single text has more.
SLICE = 6 << 20


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of start, start + 1, … for each (start, count), one after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Partition:
    """Classes of equal factors over several texts laid end to end, a mark after each.

    ``order`` holds each class's members side by side, from ``first`` on and ``size`` of them, in no
    fixed order; ``place`` is its inverse. ``after`` and ``before`` link the members of a class by
    position, and end with -1.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        """``words`` numbers words from 0; ``ends`` has the end of each text in it."""
        lengths = np.diff(ends, prepend=0)
        n = len(words) + len(ends)
        text = np.repeat(np.arange(len(ends)), lengths + 1)
        mark = ends + np.arange(len(ends))
        key = np.full(n, -1, np.int64)
        inside = np.ones(n, bool)
        inside[mark] = False
        key[inside] = words
        key += 1
        key += text * (int(key.max(initial=0)) + 1)
        self.order = np.argsort(key, kind="stable")
        sorted_key = key[self.order]
        new = np.empty(n, bool)
        new[:1] = True
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        number = np.cumsum(new) - 1
        self.label = np.empty(n, np.int64)
        self.label[self.order] = number
        self.first = np.flatnonzero(new)
        self.size = np.diff(self.first, append=n)
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.after, self.before = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        same = np.flatnonzero(~new)
        self.after[self.order[same - 1]] = self.order[same]
        self.before[self.order[same]] = self.order[same - 1]
        self.classes = len(self.first)
        # of a text's classes, all but its largest split the others
        of = text[self.order[self.first]]
        largest = np.lexsort((self.size, of))
        last = np.append(of[largest][1:] != of[largest][:-1], True)
        splits = np.ones(self.classes, bool)
        splits[largest[last]] = False
        self.splitters = self.order[np.repeat(splits, self.size)]
        starts = np.zeros(n, bool)
        starts[np.append(0, mark[:-1] + 1) if len(ends) else []] = True
        self.starts = starts

    def refine(self) -> np.ndarray:
        """Go on to factors one word longer; returns the positions that have got another next member."""
        s = self.splitters
        p = s[~self.starts[s]] - 1
        p = p[self.size[self.label[p]] >= ALIVE]
        if not len(p):
            self.splitters = p
            return p
        a, b = self.label[p], self.label[p + 1]
        by = np.lexsort((p, b, a))
        p, a, b = p[by], a[by], b[by]
        begins = np.ones(len(p), bool)
        begins[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        head = np.flatnonzero(begins)
        parent, count = a[head], np.diff(head, append=len(p))
        opens = np.ones(len(head), bool)
        opens[1:] = parent[1:] != parent[:-1]
        at, family = np.flatnonzero(opens), np.cumsum(opens) - 1
        rest = self.size[parent[at]] - np.add.reduceat(count, at)
        biggest = np.maximum.reduceat(count, at)
        leads = np.flatnonzero(count == biggest[family])
        first_lead = np.zeros(len(head), bool)
        first_lead[leads[np.unique(family[leads], return_index=True)[1]]] = True
        # where all members move, the largest group stays and keeps the label; a group larger than what
        # remains is the child that splits no further, and what remains splits in its place
        goes = ~(first_lead & (rest == 0)[family])
        spare = (first_lead & ((rest > 0) & (biggest > rest))[family])[goes]
        going = np.repeat(goes, count)
        p, head, parent, count = p[going], np.flatnonzero(begins[going]), parent[goes], count[goes]
        if not len(p):
            self.splitters = p
            return p
        new = self.classes + np.arange(len(count))
        touched = self._unlink(p, new, count, head)
        self._carve(p, parent, new, count)
        remains = parent[spare]
        members = self.order[_ranges(self.first[remains], self.size[remains])]
        self.splitters = np.append(p[~np.repeat(spare, count)], members)
        return touched

    def _unlink(self, p: np.ndarray, new: np.ndarray, count: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Take the moved members out of their lists, and link each group of them by itself."""
        old = self.label[p]
        by = np.lexsort((p, old))
        r = p[by]
        left, right = self.before[r], self.after[r]
        chain_starts, chain_ends = np.ones(len(r), bool), np.ones(len(r), bool)
        chain_starts[1:] = left[1:] != r[:-1]
        chain_ends[:-1] = right[:-1] != r[1:]
        x, y = left[chain_starts], right[chain_ends]
        self.after[x[x >= 0]] = y[x >= 0]
        self.before[y[y >= 0]] = x[y >= 0]
        self.before[p[1:]], self.after[p[:-1]] = p[:-1], p[1:]
        self.before[p[head]] = -1
        self.after[p[head[1:] - 1]] = -1
        self.after[p[-1]] = -1
        self.label[p] = np.repeat(new, count)
        return np.append(x[x >= 0], p)

    def _carve(self, p: np.ndarray, parent: np.ndarray, new: np.ndarray, count: np.ndarray) -> None:
        """Bring each parent's moved members to the front of its stretch, group by group."""
        opens = np.ones(len(parent), bool)
        opens[1:] = parent[1:] != parent[:-1]
        at = np.flatnonzero(opens)
        moved, start = np.add.reduceat(count, at), self.first[parent[at]]
        slots, where = _ranges(start, moved), self.place[p]
        vacated = where[where >= np.repeat(start + moved, moved)]
        holders = self.order[slots]
        self.place[p] = -1  # marks them; those that stay move out of the way, in the order of their parents
        stayers = holders[self.place[holders] >= 0]
        self.order[vacated], self.place[stayers] = stayers, vacated
        self.order[slots], self.place[p] = p, slots
        if self.classes + len(new) > len(self.first):
            longer = np.zeros(max(len(new), len(self.first)), np.int64)
            self.first, self.size = np.append(self.first, longer), np.append(self.size, longer)
        self.first[new], self.size[new] = slots[np.cumsum(count) - count], count
        self.first[parent[at]] += moved
        self.size[parent[at]] -= moved
        self.classes += len(new)


def squares(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(periods, positions) of primitive squares of every run of exponent ``EXPONENT`` or more; positions count a mark for each text before."""
    lengths = np.diff(ends, prepend=0)
    most = int(lengths.max(initial=0)) // EXPONENT
    part = Partition(words, ends)
    found: list[tuple[np.ndarray, int]] = []
    reach, due = 1, defaultdict(list)
    length = 1
    while length <= most:
        if length == reach:  # gaps of this length up to twice it, found once; later changes are added as they come
            reach *= 2
            due.clear()
            alive = np.flatnonzero((part.after >= 0) & (part.size[part.label] >= ALIVE))
            if not len(alive):
                break
            _file(due, alive, part.after[alive] - alive, length, reach)
        here = due.pop(length, None)
        if here is not None:
            i = np.unique(np.concatenate(here))
            i = i[(part.after[i] - i == length) & (part.size[part.label[i]] >= ALIVE)]
            found.append((i, length))
        changed = part.refine()
        length += 1
        if len(changed):
            changed = changed[(part.after[changed] >= 0) & (part.size[part.label[changed]] >= ALIVE)]
            _file(due, changed, part.after[changed] - changed, length, reach)
        elif not len(part.splitters):
            break  # nothing splits any more, and texts end: no class is left that could
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([np.full(len(i), q) for i, q in found]), np.concatenate([i for i, _ in found])


def _file(due: dict, positions: np.ndarray, gaps: np.ndarray, least: int, below: int) -> None:
    near = (gaps >= least) & (gaps < below)
    if not near.any():
        return
    positions, gaps = positions[near], gaps[near]
    by = np.argsort(gaps, kind="stable")
    positions, gaps = positions[by], gaps[by]
    cuts = np.flatnonzero(gaps[1:] != gaps[:-1]) + 1
    for group, gap in zip(np.split(positions, cuts), gaps[np.append(0, cuts)].tolist(), strict=True):
        due[gap].append(group)


def runs_of(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs as (start, length, period), by start and then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    code: dict[str, int] = defaultdict()
    code.default_factory = code.__len__
    long = [k for k, words in enumerate(texts) if len(words) >= SHORTEST]
    if not long:
        return out
    lengths = np.array([len(texts[k]) for k in long])
    ends = np.cumsum(lengths)
    words = np.fromiter((code[w] for k in long for w in texts[k]), np.int64, int(ends[-1]))
    period, position = squares(words, ends)
    by = np.lexsort((position, period))
    period, position = period[by], position[by]
    if not len(period):
        return out
    begins = np.ones(len(period), bool)
    begins[1:] = (period[1:] != period[:-1]) | (position[1:] != position[:-1] + 1)
    head = np.flatnonzero(begins)
    start, q = position[head], period[head]
    length = np.diff(head, append=len(period)) - 1 + 2 * q
    good = length >= np.maximum(SHORTEST, EXPONENT * q)
    start, q, length = start[good], q[good], length[good]
    text_start = ends - lengths + np.arange(len(long))
    text = np.searchsorted(text_start, start, "right") - 1
    for k, s, n, p in sorted(zip(text.tolist(), (start - text_start[text]).tolist(), length.tolist(), q.tolist(), strict=True), key=lambda r: (r[0], r[1], r[3])):
        out[long[k]].append((s, n, p))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length over period; ties go to the smaller start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without what a run repeats of its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def split_words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def run_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, length, period) of each run in a text column, by word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                found = runs_of([split_words(t.as_py()) for t in part.column(1)])
                rows = [(i, *r) for i, runs in enumerate(found) for r in runs]
                at = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at[0]), *at[1:]], ["key", "start", "length", "period"])

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` as key", f"cast(`{text}` as string) as text").mapInArrow(tidy(run), f"key {kind}, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """The rows of docs with each run in ``text`` cut to its first period, its words then joined by one space; others as they were."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def cut(texts):
        words = [split_words(t) for t in texts]
        found = runs_of(words)
        return texts.where([not r for r in found], [" ".join(collapsed(w, r)) for w, r in zip(words, found, strict=True)])

    return docs.withColumn("text", cut(F.col("text").cast("string")))


def repeated_tail(words: list[str], doc_id: int | None) -> list[str]:
    """The query's input: for ids whose CRC-32 ends in 0 the words repeat from one on; a null id leaves them."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                texts = [repeated_tail(split_words(t.as_py()), d.as_py()) for d, t in zip(part.column(0), part.column(1), strict=True)]
                rows = []
                for words, runs in zip(texts, runs_of(texts), strict=True):
                    best = strongest(runs)
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                    left = " ".join(collapsed(words, runs))
                    rows.append((len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest()))
                columns = [pa.array([r[k] for r in rows], pa.string() if k > 4 else pa.int64()) for k in range(7)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [c.split()[0] for c in OUT.split(", ")])

    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return docs.mapInArrow(tidy(run), OUT)
