"""Sharding with a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child makes a weighted
hash draw, -ln(u) / weight with u hashed from (child, key), and the smallest wins,
so a child receives its weight's share. Later changes confine movement to the subtree whose
weight changes, and keep every share right:

* A gain (a new shard, or more weight for one) is a draw of its own beside the draws made
  before it. A key moves only if the new draw beats the best it had, and then it goes to the shard
  that gained, in one step; no key moves between others.
* A loss (less weight for a shard, down to none; a rack or a region is lost shard by shard) lets
  a hash choose which of the shard's keys leave, and those descend again through the tree
  without it; no other key moves.

Rules for odd rows: a null key is a key of its own; a null text counts zero bytes;
repeated rows share the shard and get different slots; texts of any length count whole; an empty
table gives no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, table, utf8_crc32


@dataclass(frozen=True)
class Change:
    """A weight that changed after the tree was built: of shard number ``shard``, or of a new one (None) in this rack."""

    region: int
    rack: int
    weight: float
    shard: int | None = None


#: Children of a path: (path, weight, shard number or -1).
Children = dict[str, list[tuple[str, float, int]]]


@dataclass(frozen=True)
class HashTree:
    """weights[region][rack][shard]; shards are numbered in that order, later ones after them."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]
    changes: tuple[Change, ...] = ()

    @staticmethod
    def uniform(regions: int, racks: int, shards: int) -> HashTree:
        return HashTree(tuple(tuple((1.0,) * shards for _ in range(racks)) for _ in range(regions)))

    def grow(self, region: int, rack: int, weight: float = 1.0) -> HashTree:
        """One more shard in a rack."""
        return HashTree(self.weights, (*self.changes, Change(region, rack, weight)))

    def reweigh(self, shard: int, weight: float) -> HashTree:
        """Another weight for a shard; 0 removes it."""
        region, rack, _ = self.shards()[shard]
        return HashTree(self.weights, (*self.changes, Change(region, rack, weight, shard)))

    def remove(self, region: int, rack: int | None = None) -> HashTree:
        """A rack or a whole region gone."""
        out = self
        for shard, (r, k, w) in self.shards().items():
            if r == region and rack in (None, k) and w:
                out = out.reweigh(shard, 0.0)
        return out

    @property
    def size(self) -> int:
        return len(self.shards())

    def shards(self, changes: int | None = None) -> dict[int, tuple[int, int, float]]:
        """number -> (region, rack, weight) after so many of the changes, by default all."""
        every = [(r, k, float(w)) for r, region in enumerate(self.weights) for k, rack in enumerate(region) for w in rack]
        for c in self.changes[:changes]:
            if c.shard is None:
                every.append((c.region, c.rack, float(c.weight)))
            else:
                every[c.shard] = (c.region, c.rack, float(c.weight))
        return dict(enumerate(every))

    def levels(self, changes: int = 0, without: int | None = None) -> list[Children]:
        """For regions, racks and shards: the children of each path, after so many of the changes."""
        top, racks, shards, seen = {}, {}, {}, {}
        for number, (r, k, w) in self.shards(changes).items():
            place = seen[r, k] = seen.get((r, k), -1) + 1
            if number != without and w > 0:
                shards.setdefault(f"{r}/{k}", []).append((f"{r}/{k}/{place}", w, number))
                top[f"{r}"] = top.get(f"{r}", 0.0) + w
                racks.setdefault(f"{r}", {}).setdefault(f"{r}/{k}", 0.0)
                racks[f"{r}"][f"{r}/{k}"] += w
        if not top:
            raise ValueError("no shard is left")
        return [{"": [(p, w, -1) for p, w in top.items()]}, {r: [(p, w, -1) for p, w in below.items()] for r, below in racks.items()}, shards]


def uniform(path: Column, key: Column) -> Column:
    """In (0, 1), from the first 52 bits of md5(path:key)."""
    bits = F.conv(F.substring(F.md5(F.concat(path, F.lit(":"), key).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def draw(path: Column, weight: Column, key: Column) -> Column:
    """-ln(u) / weight: exponential, so that the least of several draws falls on each by its weight."""
    return -F.log(uniform(path, key)) / weight


def _winner(children: Children, parent: Column, key: Column) -> Column:
    """(draw, path, number) of the child with the smallest draw; the tree is a literal, not data."""
    child = lambda p, w, n: F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight"), F.lit(n).alias("number"))
    known = F.create_map(*[x for path, below in children.items() for x in (F.lit(path), F.array(*[child(*c) for c in below]))])
    draws = F.transform(F.element_at(known, parent), lambda c: F.struct(draw(c["path"], c["weight"], key).alias("draw"), c["path"].alias("path"), c["number"].alias("number")))
    return F.array_min(draws)


def _descend(levels: list[Children], key: Column) -> tuple[Column, Column]:
    """(shard number, the least draw among regions)"""
    path, least = F.lit(""), None
    for children in levels:
        won = _winner(children, path, key)
        path, least = won["path"], won["draw"] if least is None else least
    return won["number"], least


def assign(df: DataFrame, tree: HashTree, key: Column, out: str = "shard", changed: str | None = None) -> DataFrame:
    """Add column ``out``, the shard before any change, and, if asked, ``changed``, the shard after all."""
    df = df.withColumn("__key", F.coalesce(key.cast("string"), F.lit("null"))).withColumn("__path", F.lit(""))
    for level, children in enumerate(tree.levels()):
        df = df.withColumn("__won", _winner(children, F.col("__path"), F.col("__key"))).withColumn("__path", F.col("__won.path"))
        if level == 0:
            df = df.withColumn("__best", F.col("__won.draw"))
    df = df.withColumn(out, F.col("__won.number").cast("int"))
    if changed:
        df = df.withColumn("__at", F.col(out))
        for n, c in enumerate(tree.changes):
            before, after = tree.shards(n), tree.shards(n + 1)
            whole, now = sum(w for _, _, w in before.values()), sum(w for _, _, w in after.values())
            own = before[c.shard][2] if c.shard is not None else 0.0
            if c.weight > own:  # best is exponential with rate ``whole``, wherever the key lies
                new = draw(F.lit(f"{c.region}/{c.rack}/+{n}"), F.lit(float(c.weight) - own), F.col("__key"))
                number = len(before) if c.shard is None else c.shard
                df = df.withColumn("__new", new).withColumn("__at", F.when(F.col("__new") < F.col("__best"), F.lit(number)).otherwise(F.col("__at"))).withColumn("__best", F.least("__new", "__best")).drop("__new")
            elif c.weight < own:
                stays = c.weight / now * whole / own  # of the shard's keys
                again, _ = _descend(tree.levels(n, without=c.shard), F.concat(F.lit(f"{n}|"), F.col("__key")))
                leaves = (F.col("__at") == c.shard) & (uniform(F.lit(f"-{n}"), F.col("__key")) >= F.lit(stays))
                df = df.withColumn("__at", F.when(leaves, again).otherwise(F.col("__at"))).withColumn("__best", F.col("__best") * F.lit(whole / now))
        df = df.withColumn(changed, F.col("__at").cast("int")).drop("__at")
    return df.drop("__key", "__path", "__won", "__best")


#: Rows that one task numbers.
BUCKET = 250_000


def number_slots(df: DataFrame, group: str, order: list[str], rows_per_bucket: int | None = None) -> DataFrame:
    """Add ``slot``: 0, 1, 2, … within each group by ``order``, without bringing a group to one task.

    Rows are dealt to ranges of ``order``, kept in a checkpoint as the ranges come from a sample. Each
    range counts its rows of a group (partial sums before the shuffle), the counts are summed up range by
    range, and each range numbers its own rows. Rows equal in ``order`` may lie in several ranges; their
    slots are theirs in any order.
    """
    cuts = max(1, -(-df.count() // (rows_per_bucket or BUCKET)))
    if cuts == 1:
        return df.withColumn("slot", (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long"))
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    dealt = checkpoint(tied.repartitionByRange(cuts, *order, "__tie").withColumn("__bucket", F.spark_partition_id()))
    counts = dealt.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select(F.col(group).alias("__g"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(*order, "__tie")))
    joined = ranked.join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn("slot", (F.col("__start") + F.col("__rank") - 1).cast("long")).drop("__g", "__b", "__bucket", "__start", "__rank", "__tie")


#: 4 regions of 2 racks of 5 shards: shards 0 to 39. One more goes to rack 1 of region 3.
PRODUCTION = HashTree.uniform(4, 2, 5).grow(3, 1)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        utf8_crc32("text").alias("text_crc32"),
    )
    placed = assign(rows, PRODUCTION, F.col("doc_id"), "shard", "grown_shard").withColumn("law", F.lit("key"))
    return number_slots(placed, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
