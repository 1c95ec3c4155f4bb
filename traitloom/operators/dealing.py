"""Dealing members out to two sides in order, each to the side that is smaller so far.

Where a member of both sides goes depends on all before it, through one number: how many more
the left side has. What a range of members does to that number is a function, and functions
of ranges compose, so no task sees all members: ranges are summarised by themselves, the
number at each range's start follows from the summaries in order, and ranges are then dealt
by themselves.

The function of a range never parts two numbers of one parity and at times joins two that
are next to each other: one member of both sides takes -1 and 1 to 0, or 0 and 2 to 1. So all
starts are followed at once as two stacks, those at or below zero and those above, whose
entries only meet at the tops; a member costs a few steps, however many starts there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from traitloom.sources.scratch import materialise

ONLY_LEFT, ONLY_RIGHT, BOTH = 1, -1, 0


class Starts:
    """Where all starts of one parity from ``low`` to ``high`` have got to."""

    def __init__(self, low: int, high: int):
        self.high = high
        # Entries are [least start, value less the stack's shift]; tops are next to zero.
        self.left = [[d, d] for d in range(low, high + 1, 2) if d <= 0]
        self.right = [[d, d] for d in range(high, low - 1, -2) if d > 0]
        self.shift_left = self.shift_right = 0

    def step(self, kind: int) -> None:
        left, right = self.left, self.right
        self.shift_left += 1 if kind >= BOTH else -1
        self.shift_right += 1 if kind > BOTH else -1
        if left and left[-1][1] + self.shift_left > 0:
            start, _ = left.pop()
            if right and right[-1][1] + self.shift_right == 1:
                right[-1][0] = start
            else:
                right.append([start, 1 - self.shift_right])
        elif right and right[-1][1] + self.shift_right <= 0:
            start, _ = right.pop()
            if not (left and left[-1][1] + self.shift_left == 0):
                left.append([start, -self.shift_left])

    def entries(self) -> list[tuple[int, int, bool]]:
        """(start, end, flat): from each start on, up to the next entry's, all ends are that one if flat, else as far apart as their starts."""
        found = [(s, v + self.shift_left) for s, v in self.left] + [(s, v + self.shift_right) for s, v in reversed(self.right)]
        out: list[tuple[int, int, bool]] = []
        for k, (start, end) in enumerate(found):
            last = found[k + 1][0] - 2 if k + 1 < len(found) else self.high
            flat = last > start
            if flat or not out or out[-1][2] or end - start != out[-1][1] - out[-1][0]:
                out.append((start, end, flat))
        return out


def dealt(members: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """(key, side): members of one side alone are L or R; those of both go, in the order of their keys, to the side that is smaller so far, left if equal.

    ``members`` has each key once and every row has a side. Of the ranges only counts and the
    starts at which their functions bend come to the driver, one after another.
    """
    kind = F.when(left & right, BOTH).when(left, ONLY_LEFT).otherwise(ONLY_RIGHT).cast("int")
    ranged = materialise(members.select(F.col(key).alias("key"), kind.alias("kind")).repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ranged")
    counts = {r["part"]: r for r in ranged.groupBy("part").agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in (("l", ONLY_LEFT), ("r", ONLY_RIGHT), ("b", BOTH))]).collect()}
    bounds, ahead, both, seen = {}, 0, 0, 0
    for part in sorted(counts):
        c = counts[part]
        size = c["l"] + c["r"] + c["b"]
        odd = seen % 2
        # Beyond its own size from zero a range only shifts.
        low, high = max(ahead - both, -size), min(ahead + both, size)
        bounds[part] = (low + (low - odd) % 2, high - (high - odd) % 2, size)
        ahead, both, seen = ahead + c["l"] - c["r"], both + c["b"], seen + size
    ordered = ranged.repartition("part").sortWithinPartitions("part", "key")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, starts = None, None

        def told() -> pa.RecordBatch:
            rows = starts.entries()
            return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))]], names=["part", "start", "end", "flat"])

        for batch in batches:
            for own, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != part:
                    if part is not None:
                        yield told()
                    part, starts = own, Starts(*bounds[own][:2])
                starts.step(k)
        if part is not None:
            yield told()

    entries = ordered.select("part", "kind").mapInArrow(summarise, "part int, start long, end long, flat boolean").orderBy("part", "start").toLocalIterator()
    at, begins, row = 0, {}, next(entries, None)
    for part in sorted(counts):
        begins[part], chosen = at, None
        while row is not None and row["part"] == part:
            chosen = row if row["start"] <= at else chosen
            row = next(entries, None)
        c, size = counts[part], bounds[part][2]
        if abs(at) > size:
            at += c["l"] - c["r"] + (c["b"] if at < 0 else -c["b"])
        else:
            at = chosen["end"] if chosen["flat"] else chosen["end"] + at - chosen["start"]

    kind_of_key = to_arrow_type(ranged.schema["key"].dataType)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, more = None, 0
        for batch in batches:
            sides = []
            for own, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != part:
                    part, more = own, begins[own]
                goes_left = k > 0 or (k == BOTH and more <= 0)
                more += 1 if goes_left else -1
                sides.append("L" if goes_left else "R")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind_of_key), pa.array(sides)], names=[key, "side"])

    return ordered.select("key", "part", "kind").mapInArrow(deal, T.StructType([T.StructField(key, ranged.schema["key"].dataType), T.StructField("side", T.StringType())]))
