"""Sharding by best-fit-decreasing bin packing.

Equal texts form one indivisible group. Groups sorted by size enter the shard with the
tightest remaining room, found in a balanced tree of rooms; the capacity is given, or the
least at which the asked number of shards suffices.

Groups of one size class are alike, so the plan is made from the number of groups in each
class. A class is a size itself below ``EXACT`` bytes and is rounded up by less than a 2,048th
above, so a shard never exceeds its capacity, and the driver holds some tens of thousands of
classes whatever the number of documents. Each group then finds its shard by its rank in its
class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, materialize

#: Sizes under this are classes of their own; above, a class keeps the leading 12 bits, rounded up.
EXACT = 1 << 12
#: Groups of more than such a share of all bytes or rows are few enough to be joined by broadcast.
LARGE = 1 << 14


class Rooms:
    """A balanced tree (a treap) of remaining rooms, each with the ranges of bins that have it."""

    def __init__(self) -> None:
        self.root: list | None = None  # [room, priority, ranges, left, right]
        self._seed = 88172645463325252

    def _priority(self) -> int:
        self._seed ^= (self._seed << 13) & (2**64 - 1)
        self._seed ^= self._seed >> 7
        self._seed ^= (self._seed << 17) & (2**64 - 1)
        return self._seed

    def _split(self, node: list | None, room: int) -> tuple[list | None, list | None]:
        """Nodes under ``room``, and the others."""
        if node is None:
            return None, None
        if node[0] < room:
            node[4], right = self._split(node[4], room)
            return node, right
        left, node[3] = self._split(node[3], room)
        return left, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[4] = self._merge(a[4], b)
            return a
        b[3] = self._merge(a, b[3])
        return b

    def tightest(self, size: int) -> list | None:
        """The node of least room that holds ``size``."""
        node, best = self.root, None
        while node is not None:
            if node[0] >= size:
                best, node = node, node[3]
            else:
                node = node[4]
        return best

    def add(self, room: int, first: int, count: int) -> None:
        """``count`` bins from ``first`` on have this room."""
        node = self.tightest(room)
        if node is not None and node[0] == room:
            node[2].append((first, count))
            return
        left, right = self._split(self.root, room)
        self.root = self._merge(self._merge(left, [room, self._priority(), [(first, count)], None, None]), right)

    def take(self, node: list) -> tuple[int, int]:
        """A range of bins of a node; the node goes with its last."""
        found = node[2].pop()
        if not node[2]:
            left, right = self._split(self.root, node[0])
            _, right = self._split(right, node[0] + 1)
            self.root = self._merge(left, right)
        return found


class Plan:
    """Best fit of classes (size, count), descending: slots (class, first rank, groups, first bin, groups a bin), and the number of bins.

    A size over the capacity has a bin of its own. With ``most``, planning stops once more bins than that are open.
    """

    def __init__(self, sizes: list[int], counts: list[int], capacity: int, most: int | None = None) -> None:
        self.bins, self.slots = 0, []
        rooms = Rooms()
        for size, n in sorted(zip(sizes, counts, strict=True), reverse=True):
            rank = 0
            while n:
                node = rooms.tightest(size)
                if node is None:
                    # Equal groups fill a new bin before the next is opened; so many bins are opened at once.
                    each = max(1, capacity // size)
                    opened = -(-n // each)
                    if most is not None and self.bins + opened > most:
                        self.bins = most + 1
                        return
                    rooms.add(max(capacity, size), self.bins, opened)
                    self.bins += opened
                    continue
                room, (first, count) = node[0], rooms.take(node)
                each = room // size
                full = min(count, n // each)
                if full:
                    self.slots.append((size, rank, full * each, first, each))
                    rooms.add(room - each * size, first, full)
                    rank, n = rank + full * each, n - full * each
                if full < count:
                    some = 1 if n and n < each else 0
                    if some:
                        self.slots.append((size, rank, n, first + full, each))
                        rooms.add(room - n * size, first + full, 1)
                        rank, n = rank + n, 0
                    if count - full - some:
                        rooms.add(room, first + full + some, count - full - some)


def least_capacity(sizes: list[int], counts: list[int], shards: int) -> tuple[int, Plan]:
    """The least capacity (to a part in 4,096 of a shard) at which best fit needs no more than ``shards`` bins, and the plan."""
    # A size over an equal share of what is left stands alone, and the others share the rest.
    left, open_shards = sum(s * n for s, n in zip(sizes, counts, strict=True)), shards
    for size, n in sorted(zip(sizes, counts, strict=True), reverse=True):
        while n and open_shards > 1 and size * open_shards > left:
            left, open_shards, n = left - size, open_shards - 1, n - 1
        if n:
            break
    low = max(-(-left // open_shards), 1)
    step, reach = max(1, low // 4096), 0
    while (best := Plan(sizes, counts, low + reach * step, shards)).bins > shards:
        reach = max(1, reach * 2)
    below = reach // 2
    while reach - below > 1:
        mid = (reach + below) // 2
        tried = Plan(sizes, counts, low + mid * step, shards)
        if tried.bins <= shards:
            reach, best = mid, tried
        else:
            below = mid
    return low + reach * step, best


def size_class(size: Column) -> Column:
    """The class of a size: the size rounded up to its 12 leading bits, in whole numbers."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size.cast("double"))) - 11, F.lit(0))).cast("long")
    up = size + step - 1
    return up - up % step


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 16), text_crc32, and two hashes that name a group of equal texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit("second"), text).alias("h2"),
    )


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, ranks, firsts, each = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            number, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("number", "rank"))
            # Slots are sorted by class, then rank: one key says both.
            top = max(int(ranks.max()), int(rank.max())) + 1
            slot = np.searchsorted(order * top + ranks, number * top + rank, "right") - 1
            shard = firsts[slot] + (rank - ranks[slot]) // each[slot]
            yield pa.record_batch([batch.column(batch.schema.get_field_index(c)) for c in ("h1", "h2")] + [pa.array(shard.astype(np.int64))], names=["h1", "h2", "shard"])

    return run


def pack_shards(docs: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """Every row with its shard and slot: doc_id, size, text_crc32, shard, slot.

    Give ``capacity`` to use as few shards of so many bytes as best fit needs (a group over it has
    a shard of its own, no other shard exceeds it), or ``shards`` for that many shards of near
    equal bytes. Slots are gapless from 0 in each shard. A null text has size 16 and is equal to an
    empty one; a null doc_id keeps its row; repeated rows have slots of their own; an empty table
    gives an empty result. Needs doc_id and text; other columns are ignored.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = docs.sparkSession
    rows = materialize(sized(docs), "sized")
    count = rows.count()
    groups = materialize(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).withColumn("cls", size_class(F.col("bytes"))), "groups")
    classes = sorted((r["cls"], r["count"]) for r in groups.groupBy("cls").count().collect())
    sizes, counts = [c for c, _ in classes], [n for _, n in classes]
    plan = Plan(sizes, counts, capacity) if capacity else least_capacity(sizes, counts, shards)[1]
    number = {c: i for i, c in enumerate(sizes)}
    slots = np.array(sorted((number[s], rank, first, each) for s, rank, _, first, each in plan.slots), np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast(tuple(slots.T))
    # One row a class, bounded like the classes.
    named = groups.join(F.broadcast(spark.createDataFrame(list(number.items()), "cls long, number long")), "cls")
    salts = int(min(65536, max(64, count // 20_000)))
    ranked = gapless_rank(named.select("h1", "h2", "bytes", "number"), ["number"], ["bytes", "h1", "h2"], "rank", salts)
    placed = materialize(ranked.mapInArrow(_place(shared), "h1 long, h2 long, shard long"), "placed")
    # Groups with more than a LARGE-th of all bytes or rows, so 2 * LARGE at most, meet their rows by broadcast: none is shuffled to one task.
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy = groups.where((F.col("bytes") > total // LARGE) | (F.col("n") > count // LARGE)).select("h1", "h2")
    large = F.broadcast(materialize(heavy.join(placed.hint("merge"), ["h1", "h2"]), "large"))
    first = rows.join(large, ["h1", "h2"])
    rest = rows.join(large, ["h1", "h2"], "left_anti").join(placed.hint("merge"), ["h1", "h2"])
    both = first.unionByName(rest).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"))
    salts = int(min(65536, max(64, count // 100_000)))
    return gapless_rank(both, ["shard"], ["doc_id", "size", "text_crc32"], "slot", salts)


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Forty shards of near equal bytes.

    A null text counts 16 bytes, as an empty one does; repeated rows, and rows without an id, each have a slot, equal texts the same shard where
    they fit; other columns are ignored; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_shards(docs, shards=40).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


__all__ = ["Plan", "Rooms", "least_capacity", "op8_sharding", "pack_shards", "size_class", "sized"]
