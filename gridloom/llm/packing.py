"""Best-fit packing by a grouping genetic algorithm.

Pieces are dealt by hash into problems of about PROBLEM pieces. Each problem is solved by several
islands, each with a population of packings that starts from random orders: crossover takes whole
well-filled bins of one parent into the other, drops the bins that hold the same pieces and
best-fits what was displaced; mutation dissolves the emptiest bins and some others. Between epochs
each island's elite migrates to the next island. A search ends at ceil(tokens / capacity), which no
packing can beat, or after its generations. Badly filled bins of all problems are dissolved and
packed again together.

Defined results: a null or empty text is one piece with just the end id; only documents longer
than a sequence are cut; whole pieces fill a sequence alone; repeated rows are pieces of their
own; of equally full bins the one met first is taken; an empty table gives no rows; other columns,
whatever their names, are left alone.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, slices, table, tidy
from .encoding import word_encoder

CAPACITY = 2048
PROBLEM = 32_768  # pieces solved together, about; every problem loses up to a bin, so few large ones are better
ISLANDS, EPOCHS, POPULATION, OFFSPRING = 2, 2, 4, 30
SEARCHES = 1  # searches of one task, about: their rows are small and their work is not
EMPTIEST, OTHERS = 0.1, 0.2  # shares of the bins that a mutation dissolves
WORDS = 120_000  # pieces a worker's table keeps; packing follows stages whose workers hold memory already
DISSOLVE = 0.97  # bins filled less than this are packed again


class Packing:
    """Bins of item numbers, with the room left in each, and best-fit by a bit mask of rooms."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.mask = 0

    def add_bin(self, items: list[int]) -> None:
        room = self.capacity - sum(self.sizes[i] for i in items)
        self.bins.append(items)
        self.room.append(room)
        self._offer(len(self.bins) - 1, room)

    def _offer(self, b: int, room: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(b)
            self.mask |= 1 << room

    def best_fit(self, items: list[int]) -> None:
        """Put each item into the bin it fills most, else into a new one."""
        for i in items:
            size = self.sizes[i]
            fits = self.mask >> size
            if not fits:
                self.add_bin([i])
                continue
            room = size + (fits & -fits).bit_length() - 1
            at = self.by_room[room]
            b = at.pop()
            if not at:
                self.mask ^= 1 << room
            self.bins[b].append(i)
            self.room[b] = room - size
            self._offer(b, room - size)

    def fitness(self) -> tuple[int, int]:
        """Fewer bins, then more uneven filling; larger is better."""
        return -len(self.bins), sum(r * r for r in self.room)


def from_bins(bins: list[list[int]], sizes: list[int], capacity: int) -> Packing:
    out = Packing(sizes, capacity)
    for b in bins:
        out.add_bin(list(b))
    return out


def first_packing(sizes: list[int], capacity: int, rng: random.Random | None) -> Packing:
    """Best fit in a random order, or, without one, by falling size."""
    out, order = Packing(sizes, capacity), list(range(len(sizes)))
    if rng:
        rng.shuffle(order)
    else:
        order.sort(key=lambda i: -sizes[i])
    out.best_fit(order)
    return out


def crossover(mother: Packing, father: Packing, rng: random.Random) -> Packing:
    """The mother with a run of the father's best-filled bins."""
    order = sorted(range(len(father.bins)), key=father.room.__getitem__)
    take = max(1, len(order) // 8)
    at = rng.randrange(max(1, len(order) // 2))
    injected = [father.bins[b] for b in order[at : at + take]]
    own = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in mother.bins:
        if own.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in own]
    child = from_bins([*kept, *injected], mother.sizes, mother.capacity)
    child.best_fit(sorted(displaced, key=lambda i: -mother.sizes[i]))
    return child


def mutate(packing: Packing, rng: random.Random) -> Packing:
    """The emptiest bins and some others dissolved and best-fitted again."""
    order = sorted(range(len(packing.bins)), key=packing.room.__getitem__)
    share = lambda x: max(1, int(len(order) * x))
    gone = set(order[-share(EMPTIEST) :]) | set(rng.sample(order, share(OTHERS)))
    out = from_bins([b for n, b in enumerate(packing.bins) if n not in gone], packing.sizes, packing.capacity)
    out.best_fit(sorted((i for n in gone for i in packing.bins[n]), key=lambda i: -packing.sizes[i]))
    return out


def evolve(sizes: list[int], capacity: int, population: list[list[list[int]]], seed: int, offspring: int = OFFSPRING, wanted: int = POPULATION, immigrant: bool = False) -> tuple[list[Packing], int]:
    """One epoch on one island: (the population, best first; how many children were made).

    With ``immigrant``, best fit by falling size joins the population, so that no result is above it.
    """
    rng = random.Random(seed)
    bound = -(-sum(sizes) // capacity)
    alive = [from_bins(p, sizes, capacity) for p in population]
    while len(alive) < wanted:
        alive.append(first_packing(sizes, capacity, rng))
    if immigrant:
        alive.append(first_packing(sizes, capacity, None))
    alive.sort(key=Packing.fitness, reverse=True)
    children = 0
    while children < offspring and len(alive[0].bins) > bound:
        mother, father = (alive[min(rng.randrange(len(alive)), rng.randrange(len(alive)))] for _ in range(2))
        child = mutate(crossover(mother, father, rng), rng)
        children += 1
        if child.fitness() > alive[-1].fitness():
            alive[-1] = child
            alive.sort(key=Packing.fitness, reverse=True)
    return alive, children


def _flat(bins: list[list[int]]) -> list[int]:
    """Bin number of each item."""
    out = [0] * sum(map(len, bins))
    for n, b in enumerate(bins):
        for i in b:
            out[i] = n
    return out


def _bins(flat: list[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(flat):
        out.setdefault(b, []).append(i)
    return list(out.values())


STATE = "problem long, island int, sizes array<int>, population array<array<int>>, score array<long>, children int"


def _epoch(capacity: int, number: int, last: bool):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for problem, island, sizes, population, before in zip(pdf["problem"], pdf["island"], pdf["sizes"], pdf["population"], pdf["children"], strict=True):
                sizes = [int(s) for s in sizes]
                alive, children = evolve(sizes, capacity, [_bins([int(x) for x in p]) for p in population], (int(problem) * 1_000 + number) * ISLANDS + int(island), immigrant=last and int(island) == 0)
                best = alive[0].fitness()
                out.append((problem, island, sizes, [_flat(p.bins) for p in alive], [best[0], best[1]], int(before) + children))
            yield pd.DataFrame(out, columns=["problem", "island", "sizes", "population", "score", "children"])

    return run


def _evolved(items: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """The islands of every problem after the last epoch, as STATE, for items (problem, pos, length), pos counting from 0 in a problem."""
    listed = items.groupBy("problem").agg(F.array_sort(F.collect_list(F.struct("pos", "length"))).alias("x"))
    none = [F.array().cast("array<array<int>>").alias("population"), F.array().cast("array<long>").alias("score"), F.lit(0).alias("children")]
    last = items.agg(F.max("problem")).first()[0]
    tasks = 1 if last is None else -(-(last + 1) * islands // SEARCHES)
    state = listed.select("problem", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.length").cast("array<int>").alias("sizes"), *none)
    for n in range(epochs):
        if n:
            elite = state.select("problem", ((F.col("island") + 1) % islands).alias("island"), F.element_at("population", 1).alias("elite"))
            state = state.join(elite, ["problem", "island"]).select("problem", "island", "sizes", F.array_union("population", F.array("elite")).alias("population"), "score", "children")
        state = checkpoint(state.repartition(tasks, "problem", "island").mapInPandas(tidy(_epoch(capacity, n, n == epochs - 1)), STATE))
    return state


def _solve(items: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """(problem, pos, bin, length) from the best packing of every problem."""
    best = _evolved(items, capacity, islands, epochs).groupBy("problem").agg(F.max_by(F.struct("sizes", F.element_at("population", 1).alias("bins")), F.struct("score", "island")).alias("b"))
    return best.select("problem", F.posexplode(F.arrays_zip(F.col("b.bins").alias("bin"), F.col("b.sizes").alias("length"))).alias("pos", "x")).select("problem", F.col("pos").cast("long").alias("pos"), F.col("x.bin").alias("bin"), F.col("x.length").alias("length"))


def _numbered(items: DataFrame) -> DataFrame:
    """Deal items (item, length) by hash into problems of about PROBLEM items, numbered within each."""
    problems = max(1, -(-items.count() // PROBLEM))
    dealt = items.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(problems)).alias("problem"))
    return dealt.withColumn("pos", (F.row_number().over(Window.partitionBy("problem").orderBy("item")) - 1).cast("long"))


def pack(items: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(item, sequence_id, offset) for items (item long, length), 1 <= length <= capacity.

    ``item`` must be unique, and ``items`` give the same rows each time (a checkpoint or table).
    """
    full = items.where(F.col("length") == capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = checkpoint(_numbered(items.where(F.col("length") < capacity)))
    first = checkpoint(rest.join(_solve(rest, capacity, islands, epochs).select("problem", "pos", "bin"), ["problem", "pos"]))
    filled = first.groupBy("problem", "bin").agg((F.sum("length") >= DISSOLVE * capacity).alias("good"))
    judged = first.join(filled, ["problem", "bin"])
    again = checkpoint(_numbered(judged.where(~F.col("good")).select("item", "length")))
    second = again.join(_solve(again, capacity, islands, epochs).select("problem", "pos", "bin"), ["problem", "pos"])
    placed = judged.where("good").select("item", "length", F.lit(0).alias("turn"), "problem", "bin", "pos").unionByName(second.select("item", "length", F.lit(1).alias("turn"), "problem", "bin", "pos"))
    bins = placed.groupBy("turn", "problem", "bin").agg(F.array_sort(F.collect_list(F.struct("pos", "length", "item"))).alias("x"))
    sequence = F.shiftleft(F.col("problem"), 32) + F.col("bin").cast("long") * 2 + F.col("turn")
    walk = F.aggregate("x", F.array().cast("array<long>"), lambda a, y: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + y["length"])))
    spread = bins.withColumn("end", walk).select(sequence.alias("sequence_id"), F.explode(F.arrays_zip(F.col("x.item").alias("item"), F.zip_with("end", "x", lambda e, y: e - y["length"]).alias("offset"))).alias("y"))
    return full.unionByName(spread.select(F.col("y.item").alias("item"), "sequence_id", F.col("y.offset").alias("offset")))


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_encoder(path, WORDS)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids, bounds = words.encode_many(batch.column(1).to_pylist())
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = (bounds + np.arange(len(bounds))).tolist()
            rows = []
            for doc, a, b in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                for n, at in enumerate(range(a, b, capacity)):
                    cut = ids[at : min(at + capacity, b)]
                    rows.append((doc, n, at - a, len(cut), zlib.crc32(cut)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Cut and pack (doc_id, text); a row for each piece."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = docs.mapInArrow(tidy(_pieces(tokenizer, capacity, end_id)), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = checkpoint(cut.withColumn("item", F.monotonically_increasing_id()))
    return pieces.join(pack(pieces.select("item", "length"), capacity), "item").drop("item")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
