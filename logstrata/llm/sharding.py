"""Minimax contiguous partition of documents into shards.

Documents of equal text are one atomic group. Groups stand in the order of
their MD5, and each shard takes a contiguous run of them. The capacity of a
shard is the smallest for which a greedy pass (fill a shard until the next
group doesn't fit) needs no more than the wanted number of shards; it is found
by binary search, so no contiguous partition in this order has a smaller largest
shard. What that capacity leaves free is shared out: a group above the even share
gets a shard of its own if that costs nothing, and the rest of the shards are
dealt to the two sides by the same rule; and where greedy cuts need fewer shards
than there are, the first takes an even share and the rest is partitioned again. So a shard
stays empty only if there are fewer groups than shards.

The driver holds sums for the 65,536 blocks of groups that share the first 16
bits of their MD5, whatever the corpus. Where a cut falls inside a block, the
block is opened: its groups are fetched if they are at most ``FETCH``, else its
own sums by the next 16 bits. Rows learn their shard by comparing their MD5 with
the cuts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logstrata.llm.scratch import Scratch

#: Rows that one look at the groups brings to the driver, at most.
FETCH = 1 << 16
#: Rows of a group that are numbered together, and the largest number of such parts.
PART_ROWS, MOST_PARTS = 512, 1 << 16
#: Hexadecimal digits of a key that one level of sums takes.
DIGITS = 4


class Span:
    """The children of one prefix of keys in order: sums of sub-blocks, or groups (``leaf``)."""

    def __init__(self, found, before: tuple[int, int, int], leaf: bool):
        found = found.sort_values("child")
        self.keys, self.first, self.leaf = list(found["child"]), list(found["first"]), leaf
        self.bytes, self.rows, self.groups, self.largest = (found[c].to_numpy(np.int64) for c in ("bytes", "n", "groups", "largest"))
        self.ends, self.row_ends, self.group_ends = (b + np.cumsum(x) for b, x in zip(before, (self.bytes, self.rows, self.groups), strict=True))

    def before(self, i: int) -> tuple[int, int, int]:
        """Bytes, rows and groups before a child."""
        return int(self.ends[i] - self.bytes[i]), int(self.row_ends[i] - self.rows[i]), int(self.group_ends[i] - self.groups[i])


class Line:
    """The groups (key, bytes, n) in order of their keys, as sums that are opened where a cut falls. Places are bytes before."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.opened: dict[str, Span] = {}
        self.root = self._sums("", (0, 0, 0))
        self.total = int(self.root.ends[-1]) if self.root.keys else 0

    def _sums(self, prefix: str, before: tuple[int, int, int]) -> Span:
        child = F.substring("key", 1, len(prefix) + DIGITS).alias("child")
        inside = self.groups.where(F.col("key").startswith(prefix)) if prefix else self.groups
        return Span(inside.groupBy(child).agg(F.min("key").alias("first"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.count("*").alias("groups"), F.max("bytes").alias("largest")).toPandas(), before, False)

    def prepare(self, places: list[int], around: int = 6) -> None:
        """Opens blocks around some places in one go, as far as they have no more than ``FETCH`` groups together."""
        root, wanted, size = self.root, {}, 0
        if not root.keys:
            return
        for far in range(around + 1):
            for at in np.searchsorted(root.ends, places, "right"):
                for i in {max(0, at - far), min(len(root.keys) - 1, at + far)}:
                    if root.groups[i] > 1 and root.keys[i] not in wanted and root.keys[i] not in self.opened and size + root.groups[i] <= FETCH:
                        wanted[root.keys[i]] = i
                        size += int(root.groups[i])
        if wanted:
            found = self._fetched(F.substring("key", 1, DIGITS).isin(list(wanted)))
            for key, own in found.groupby(found["child"].str[:DIGITS]):
                self.opened[key] = Span(own, root.before(wanted[key]), True)

    def _fetched(self, which):
        return self.groups.where(which).select(F.col("key").alias("child"), F.col("key").alias("first"), "bytes", "n", F.lit(1).alias("groups"), F.col("bytes").alias("largest")).toPandas()

    def open(self, span: Span, i: int) -> Span:
        key = span.keys[i]
        if key not in self.opened:
            if sum(len(s.keys) for s in self.opened.values()) > 32 * FETCH:
                self.opened.clear()
            fits = span.groups[i] <= FETCH
            self.opened[key] = Span(self._fetched(F.col("key").startswith(key)), span.before(i), True) if fits else self._sums(key, span.before(i))
        return self.opened[key]

    def _at(self, place: int) -> tuple[Span, int]:
        """The smallest child known that holds the byte after a place, or begins there."""
        span = self.root
        while True:
            i = int(np.searchsorted(span.ends, place, "right"))
            if span.before(i)[0] == place or span.leaf or span.groups[i] == 1:
                return span, i
            span = self.open(span, i)

    def cut(self, start: int, capacity: int, end: int) -> int:
        """The end of the shard that starts at ``start``: before the first group that doesn't fit, ``end`` at most."""
        goal = start + capacity
        if goal >= end:
            return end
        span, i = self._at(goal)
        return span.before(i)[0]

    def cuts(self, start: int, end: int, capacity: int, shards: int) -> list[int] | None:
        """The ends of the shards of [start, end), or None if they are too many."""
        found = [start]
        while found[-1] < end:
            at = self.cut(found[-1], capacity, end)
            if at <= found[-1] or len(found) > shards:
                return None
            found.append(at)
        return found[1:]

    def least(self, start: int, end: int, shards: int) -> int:
        """The smallest capacity for [start, end)."""
        low = high = max(1, -(-(end - start) // shards))
        step = max(1, low >> 10)
        while self.cuts(start, end, high, shards) is None:
            low, high, step = high + 1, min(end - start, high + step), 2 * step
        while low < high:
            middle = (low + high) // 2
            if self.cuts(start, end, middle, shards) is None:
                low = middle + 1
            else:
                high = middle
        return high

    def largest(self, start: int, end: int, more_than: int) -> tuple[int, int] | None:
        """A largest group of [start, end), where it starts and ends, if it has more than so many bytes."""
        best: tuple[int, int] | None = None
        looked = [self.root]
        while looked:
            span = looked.pop()
            for i in np.flatnonzero((span.largest > more_than) & (span.ends > start) & (span.ends - span.bytes < end)):
                if span.largest[i] <= more_than:
                    continue
                if span.leaf or span.groups[i] == 1:
                    best, more_than = (span.before(i)[0], int(span.ends[i])), int(span.largest[i])
                else:
                    looked.append(self.open(span, i))
        return best

    def partition(self, start: int, end: int, shards: int) -> list[int]:
        """The ends of the shards of [start, end)."""
        done: list[int] = []
        while start < end:
            capacity = self.least(start, end, shards)
            even = -(-(end - start) // shards)
            big = self.largest(start, end, even) if capacity > even and shards > 1 else None
            dealt = self._dealt([(start, big[0]), (big[1], end)], shards - 1, capacity) if big else None
            if big and dealt:
                return done + self.partition(start, big[0], dealt[0]) + [big[1]] + self.partition(big[1], end, dealt[1])
            found = self.cuts(start, end, capacity, shards)
            if len(found) == shards:
                return done + found
            # Not more than the even share: greedy cuts of the rest at this capacity need one shard more at most.
            first = self.cut(start, even, end)
            done.append(first if first > start else found[0])
            start, shards = done[-1], shards - 1
        return done

    def _dealt(self, sides: list[tuple[int, int]], shards: int, capacity: int) -> list[int] | None:
        """How many shards each of two sides gets so that the larger of their capacities is least; None if that is above ``capacity``."""
        (a, b), (c, d) = sides
        if a == b or c == d:
            share = [0 if a == b else shards, 0 if c == d else shards]
            rest = (c, d) if a == b else (a, b)
            return share if rest[0] == rest[1] or shards and self.least(*rest, shards) <= capacity else None
        if shards < 2:
            return None
        groups = [self._groups_before(y) - self._groups_before(x) for x, y in sides]
        if sum(groups) <= shards:
            return groups
        # The least number for the left that makes it no worse than the right; neither gets more shards than groups.
        low, high = max(1, shards - groups[1]), min(shards - 1, groups[0])
        while low < high:
            middle = (low + high) // 2
            if self.least(a, b, middle) <= self.least(c, d, shards - middle):
                high = middle
            else:
                low = middle + 1
        worst = {n: max(self.least(a, b, n), self.least(c, d, shards - n)) for n in {low, max(1, shards - groups[1], low - 1)}}
        n = min(worst, key=lambda k: (worst[k], k))
        return [n, shards - n] if worst[n] <= capacity else None

    def _groups_before(self, place: int) -> int:
        if place >= self.total:
            return int(self.root.group_ends[-1])
        span, i = self._at(place)
        return span.before(i)[2]

    def first_after(self, cut: int) -> tuple[str | None, int]:
        """The key of the first group after a cut, and the number of rows before it."""
        if cut >= self.total:
            return None, int(self.root.row_ends[-1])
        span, i = self._at(cut)
        return span.first[i], span.before(i)[1]


def minimax_shards(docs: DataFrame, shards: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ``bytes``, shard, slot, grown_shard (null).

    Size is the UTF-8 length plus 1. Null texts are a group of their own, with size 1 and a null
    text_crc32. Slots number the rows of a shard from 0 in the order of groups, inside a group by
    parts of rows and then by doc_id. Repeated rows are separate rows. No rows give no rows. Shards
    at the end stay empty if there are fewer groups than shards.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    raw = F.col(text).cast("binary")
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.coalesce(F.unhex(F.md5(raw)), F.lit(b"")).alias("g")
    )
    rows = scratch.table(sized, "rows")
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = scratch.table(groups.withColumn("key", F.hex("g")).withColumn("block", F.substring("key", 1, DIGITS)), "groups")
    line = Line(groups)
    line.prepare([line.total * i // shards for i in range(1, shards)])
    cuts = line.partition(0, line.total, shards)
    starts = [(None, 0), *[line.first_after(c) for c in cuts[:-1]]]
    # Of the 65,536 blocks: rows before each.
    before = spark.createDataFrame([(k, line.root.before(i)[1]) for i, k in enumerate(line.root.keys)], "block string, rows_before long")
    shard = sum((F.col("key") >= F.lit(key)).cast("int") for key, _ in starts[1:]) if len(starts) > 1 else F.lit(0)
    start = F.element_at(F.array(*[F.lit(n).cast("long") for _, n in starts]), F.col("shard") + 1)
    in_block = Window.partitionBy("block").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("earlier", F.coalesce(F.sum("n").over(in_block), F.lit(0)))
    placed = placed.join(F.broadcast(before), "block").withColumn("shard", shard)
    placed = placed.select("g", "shard", "n", (F.col("rows_before") + F.col("earlier") - start).alias("base"))
    # Rows of a large group are numbered in parts, so that no task sorts the whole group.
    parts = F.least(F.ceil(F.col("n") / PART_ROWS), F.lit(MOST_PARTS))
    row = rows.join(placed, "g").withColumn("part", F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), parts).cast("int")).repartition("g", "part")
    counted = row.where(F.col("n") > PART_ROWS).groupBy("g", "part").agg(F.count("*").alias("in_part"))
    in_group = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("g", "part", F.coalesce(F.sum("in_part").over(in_group), F.lit(0)).alias("parts_before"))
    numbered = row.withColumn("nth", F.row_number().over(Window.partitionBy("g", "part").orderBy("doc_id")) - 1)
    numbered = numbered.join(offsets, ["g", "part"], "left")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.coalesce("parts_before", F.lit(0)) + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
