"""Problem 9: items of varying length into containers of fixed capacity by sum-of-squares packing.

Items are dealt by a hash of their row number into lanes of about ``lane_items``; each lane is one ordered stream, packed online.
With N(h) the number of open containers filled to h, an item of size s goes to the level (0 = a new container) that makes
the sum of N(h)^2 over partly filled levels smallest; ties go to the fullest level. The state is the array N and the open
containers of each level, which the rule itself keeps few. At the end of a lane its open containers are themselves
items of a second, much smaller packing (lanes of lanes), so that splitting the work into lanes costs next to no space.
Row numbers are those of a written table, so a task that runs again gives the same containers, and repeated rows spread evenly.

Defined cases: an item larger than the capacity is split into full containers and a rest, any other item is whole; items
of size 0 or null take no space, get a row with a null container; negative sizes count as 0; repeated rows are items of
their own; null ids are packed like others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandbase.runtime import cut, ship

LANE_SHIFT = 36
_OUT = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("part_no", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("container", pa.int64())])


class SumOfSquares:
    """Online packing of one stream into containers numbered from ``first``."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def full(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, size: int) -> int:
        """The container of an item with 0 < size <= capacity."""
        last = self.capacity - size  # the fullest level it fits into
        n = self.count
        # Moving a container from level h to h + size changes the sum of squares by 2 (N(h + size) - N(h) + 1); a new one
        # by 2 N(size) + 1; a container that becomes full leaves the sum, as one at level 0 isn't in it.
        change = 2 * (n[size : self.capacity + 1] - n[: last + 1] + 1)
        change[last] = 1 - 2 * n[last]
        change[0] = 2 * n[size] + 1 if last else 0
        change[1:][n[1 : last + 1] == 0] = np.iinfo(np.int64).max
        level = last - int(np.argmin(change[::-1]))
        if level == 0:
            where = self.full()
        else:
            where = self.open[level].pop()
            n[level] -= 1
        if level + size < self.capacity:
            self.open[level + size].append(where)
            n[level + size] += 1
        return where

    def leftovers(self) -> Iterator[tuple[int, int]]:
        for level in range(self.capacity - 1, 0, -1):
            for where in self.open[level]:
                yield where, level


def _packed(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, box = None, None
        for batch in batches:
            rows: list[tuple] = []
            for of, key, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if of != lane:
                    lane, box = of, SumOfSquares(capacity, of << LANE_SHIFT)
                if not n:
                    rows.append((key, 0, 0, 0, 0, None))
                for part, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((key, n, part, start, length, box.full() if length == capacity else box.place(length)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT, strict=True)], schema=_OUT)

    return run


def _streams(items: DataFrame, lanes: int) -> DataFrame:
    return items.repartition(lanes, "lane").sortWithinPartitions("lane", "order", "key", "size")


def pack(df: DataFrame, key: Column, size: Column, capacity: int = 2048, lane_items: int = 25_000) -> DataFrame:
    """(key, n_tokens, part_no, start, length, container): one row for each item, or for each part of a split one."""
    ship(df.sparkSession)
    kept = df.select(key.cast("bigint").alias("key"), F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0).cast("bigint")).alias("size"))
    kept = cut(kept, "sizes")  # the sizes are costly (a tokenizer's) and read twice
    lanes = max(1, -(-kept.count() // lane_items))
    numbered = kept.withColumn("row", F.monotonically_increasing_id())  # of a written table: the same when a task runs again
    items = numbered.select(F.pmod(F.xxhash64("row"), F.lit(lanes)).alias("lane"), "key", "size", F.xxhash64("row", F.lit(7)).alias("order"))
    schema = "key bigint, n_tokens bigint, part_no bigint, start bigint, length bigint, container bigint"
    placed = _streams(items, lanes).select("lane", "key", "size").mapInArrow(_packed(capacity), schema)
    if lanes == 1:
        return placed
    placed = cut(placed, "placed")
    level = placed.filter("container is not null").groupBy("container").agg(F.sum("length").alias("size")).filter(F.col("size") < capacity)
    wide = max(1, -(-lanes // 512))
    again = level.select((F.pmod(F.xxhash64("container"), F.lit(wide)) + lanes).alias("lane"), F.col("container").alias("key"), "size", (-F.col("size")).alias("order"))
    moved = _streams(again, wide).select("lane", "key", "size").mapInArrow(_packed(capacity), schema).select(F.col("key").alias("container"), F.col("container").alias("to"))
    return placed.join(moved, "container", "left").select("key", "n_tokens", "part_no", "start", "length", F.coalesce("to", "container").alias("container"))
