"""Sets of members as rows of 64: a block's number and a long with a bit for each member.

Such sets are merged and counted block by block, so no row grows with a set, and a union is
one ``bit_or`` that is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.sources.records import number


def member_blocks(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, block, bits) of rows (keys, member); members that are no whole numbers are numbered first. Null members are left out."""
    rows = rows.select(*keys, F.col(member).alias("__member")).where("__member IS NOT NULL")
    at = F.col("__member")
    if not isinstance(rows.schema["__member"].dataType, (T.LongType, T.IntegerType, T.ShortType)):
        ids = number(rows.select("__member").distinct(), "__member", "", "__at").select(F.col("__member").alias("__numbered"), F.col("__at").cast("long").alias("__at"))
        rows, at = rows.join(ids, F.col("__member") == F.col("__numbered")), F.col("__at")
    bit = F.expr("shiftleft(1L, cast(at & 63 AS int))")
    return rows.select(*keys, at.cast("long").alias("at")).groupBy(*keys, F.shiftright("at", 6).alias("block")).agg(F.bit_or(bit).alias("bits"))


def distinct_counts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): the size of the union of all blocks of a key."""
    return blocks.groupBy(*keys, "block").agg(F.bit_or("bits").alias("bits")).groupBy(*keys).agg(F.sum(F.bit_count("bits")).alias("n"))
