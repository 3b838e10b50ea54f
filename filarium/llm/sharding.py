"""Sharding by best-fit decreasing bin packing.

Texts that are equal form a group that stays in one shard. Groups, largest first, enter the bin of
the tightest remaining capacity that still takes them; the capacities lie in a balanced tree. No
task sees all groups: shares of bounded size pack their own groups into bundles of fixed capacity,
and bundles are packed in turn until one share holds them all. Rows meet their group's shard by
input partition and group, so a group with any part of all rows stays spread over its partitions.

Null texts count as empty. Rows with equal or null ids are rows of their own. Columns other than
doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

#: Groups or bundles of a share, about; also the most bundles that the driver packs.
SHARE = 200_000
#: Bundles that fill a shard, at least, in ``even``.
FINE = 1024
#: A bundle filled to this part is done in ``fixed``; the others are packed again.
FULL = 0.99


class Rooms:
    """Bins by remaining capacity: a tree of two levels whose leaves split when they are full."""

    LEAF = 512

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.last: list[tuple[int, int]] = []

    def add(self, room: int, number: int) -> None:
        item = (room, number)
        at = min(bisect_left(self.last, item), len(self.leaves) - 1)
        leaf = self.leaves[at]
        insort(leaf, item)
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[at:at + 1] = [leaf[:half], leaf[half:]]
            self.last[at:at + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self.last[at:at + 1] = [leaf[-1]]

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes the bin of the least room that is not below ``size``; ties go to the first bin."""
        item = (size, -1)
        at = bisect_left(self.last, item)
        if at == len(self.last):
            return None
        leaf = self.leaves[at]
        found = leaf.pop(bisect_left(leaf, item))
        if leaf:
            self.last[at] = leaf[-1]
        elif len(self.leaves) > 1:
            del self.leaves[at], self.last[at]
        else:
            self.last = []
        return found


class Bins:
    """Best fit into bins of one capacity; what is larger gets a bin of its own."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.made = capacity, Rooms(), 0

    def place(self, size: int) -> int:
        room, number = self.rooms.take(size) or (self.capacity, self.made)
        self.made += number == self.made
        if room > size:
            self.rooms.add(room - size, number)
        return number


def rows_of(docs: DataFrame) -> DataFrame:
    """Rows (row, part, doc_id, size, text_crc32, key): sizes and checksums of texts, written once.

    ``part`` is the input partition and ``row`` a number of the row in the written table.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.unhex(F.sha2(text, 256)).alias("key"), F.monotonically_increasing_id().alias("row"))
    return stored(base.withColumn("part", F.shiftright("row", 33)), "rows")


def bundles(items: DataFrame, capacity: int, share: int = SHARE) -> tuple[DataFrame, int]:
    """Rows (key, bytes) with a ``bundle`` each, packed share by share, and the number of shares."""
    shares = max(1, -(-items.count() // share))
    dealt = (items.withColumn("_share", F.pmod(F.xxhash64("key"), F.lit(shares)))
             .repartition(shares, "_share").sortWithinPartitions("_share", F.col("bytes").desc(), "key"))

    def run(batches):
        now, bins = None, None
        for t in batches:
            out = []
            for p, size in zip(t.column(2).to_pylist(), t.column(1).to_pylist()):
                if p != now:
                    now, bins = p, Bins(capacity)
                out.append((p << 36) + bins.place(size))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(out, pa.int64())], names=["key", "bytes", "bundle"])

    kind = items.schema["key"].dataType.simpleString()
    return stored(dealt.select("key", "bytes", "_share").mapInArrow(run, f"key {kind}, bytes long, bundle long"), "bundles"), shares


def _again(placed: DataFrame, capacity: int, share: int, whole=lambda b: F.lit(False)) -> DataFrame:
    """Packs bundles that are not whole again and again, until one share has met them all or few go together any more."""
    made = stored(placed.groupBy("bundle").agg(F.sum("bytes").alias("bytes")), "bundles")
    done = made.where(whole(F.col("bytes")))
    small, shares = bundles(made.where(~whole(F.col("bytes"))).withColumnRenamed("bundle", "key"), capacity, share)
    if shares > 1 and small.select("bundle").distinct().count() < 0.95 * small.count():
        small = _again(small, capacity, share, whole)
    names = small.select("key", (F.col("bundle") * 2 + 1).alias("to")).union(done.select("bundle", F.col("bundle") * 2))
    return placed.join(names, placed["bundle"] == names["key"]).select(placed["key"], placed["bytes"], F.col("to").alias("bundle"))


def fixed(groups: DataFrame, capacity: int, share: int = SHARE) -> DataFrame:
    """Rows (key, bytes, shard): groups in as few shards of ``capacity`` bytes as best fit finds.

    Each share packs its groups; shards that it left open are packed again with those of the
    others. Shard numbers have gaps. A group above the capacity gets a shard of its own.
    """
    placed, shares = bundles(groups, capacity, share)
    if shares > 1:
        placed = _again(placed, capacity, share, lambda b: b >= FULL * capacity)
    return placed.withColumnRenamed("bundle", "shard")


def _fit(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    bins, out = Bins(capacity), []
    for s in sizes:
        out.append(bins.place(s))
        if bins.made > shards:
            return None
    return out


def spread(sizes: list[int], shards: int) -> list[int]:
    """Shard of each size, given largest first: best fit under the least capacity found that needs no more shards.

    What is above the average of the rest gets a shard of its own first.
    """
    total, alone = sum(sizes), 0
    while alone < min(len(sizes), shards - 1) and sizes[alone] * (shards - alone) >= total:
        total -= sizes[alone]
        alone += 1
    rest, left = sizes[alone:], shards - alone
    if not rest:
        return list(range(alone))
    low = max(-(-total // left), rest[0])
    step, best = 1, _fit(rest, low, left)
    high = low
    while best is None:
        low, high, step = high + 1, high + step, step * 2
        best = _fit(rest, high, left)
    while low < high:
        mid = (low + high) // 2
        found = _fit(rest, mid, left)
        if found is None:
            low = mid + 1
        else:
            best, high = found, mid
    return list(range(alone)) + [alone + b for b in best]


def even(groups: DataFrame, shards: int, share: int = SHARE, fine: int = FINE) -> DataFrame:
    """Rows (key, bytes, shard) with shards 0 to ``shards`` - 1 of nearly equal bytes.

    Groups are bundled until at most about ``share`` bundles are left, each at most a ``fine``-th of a shard
    unless one group is larger; these go to shards under the least capacity that best fit needs.
    ``share`` must be far above ``shards``.
    """
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    unit = max(1, total // min(shards * fine, share // 4))
    placed, shares = bundles(groups, unit, share)
    if shares > 1:
        placed = stored(_again(placed, unit, share), "bundles")
    made = (placed.groupBy("bundle").agg(F.sum("bytes").alias("bytes"))
            .select("bytes", "bundle").orderBy(F.col("bytes").desc(), "bundle").toArrow().to_pydict())
    to = spread(made["bytes"], shards)
    names = groups.sparkSession.createDataFrame(list(zip(made["bundle"], to)), "bundle long, shard int")
    return placed.join(F.broadcast(names), "bundle").select("key", "bytes", "shard")  # at most about 2 * shards * fine + share names


def slots(rows: DataFrame) -> DataFrame:
    """Adds ``slot``, a gapless number within ``shard``, to rows with (shard, part, row).

    Rows are numbered within their partition; counts of partitions, and of runs of 1024 of them, give the starts.
    """
    counts = (rows.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("run", F.shiftright("part", 10)))
    runs = counts.groupBy("shard", "run").agg(F.sum("n").alias("n"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "run", F.coalesce(F.sum("n").over(before("shard", "run")), F.lit(0)).alias("a"))
    starts = (counts.withColumn("b", F.coalesce(F.sum("n").over(before("shard", "run", "part")), F.lit(0)))
              .join(runs, ["shard", "run"]).select("shard", "part", (F.col("a") + F.col("b")).alias("start")))
    own = rows.withColumn("i", F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1)
    return own.join(starts, ["shard", "part"]).withColumn("slot", F.col("start") + F.col("i")).drop("start", "i")


def shard(docs: DataFrame, shards: int = 16, share: int = SHARE) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law ``bytes``: sizes near equal, equal texts together."""
    rows = rows_of(docs)
    here = stored(rows.groupBy("key", "part").agg(F.sum("size").alias("bytes")), "groups")
    to = even(here.groupBy("key").agg(F.sum("bytes").alias("bytes")), shards, share).select("key", "shard")
    placed = rows.join(here.select("key", "part").join(to, "key"), ["key", "part"])
    return slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                                F.lit(None).cast("int").alias("grown_shard"))
