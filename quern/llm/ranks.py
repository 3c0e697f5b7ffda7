"""Ranks within groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.scratch import materialize

#: Rows one task ranks, about.
BLOCK_ROWS = 200_000
#: Rows of sizes (a group, a value and three numbers each) up to which they are broadcast.
BROADCAST_ROWS = 100_000


def _sized(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def ranked(rows: DataFrame, group: list[str], tie: str, value: str | None = None) -> DataFrame:
    """``rows`` with ``rank`` 0.. within ``group``, by ``value``; rows of one value in any fixed order (by ``tie``, which tells them apart).

    Counts by group and value say where each value begins. A value with more rows than one task ranks
    is cut into blocks by a hash of ``tie``, as many as it needs itself, whatever the other groups hold.
    """
    keys = [*group, *([value] if value else [])]
    sizes = materialize(rows.groupBy(*keys).agg(F.count("*").alias("_n")), "group-sizes")
    earlier = Window.partitionBy(*group).orderBy(*(value and [value] or group)).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) if value else F.lit(0)
    blocks = F.ceil(F.col("_n") / BLOCK_ROWS).cast("int")
    cut = rows.join(_sized(sizes.select(*keys, first.cast("long").alias("_first"), blocks.alias("_blocks"))), keys)
    cut = cut.withColumn("_block", F.pmod(F.xxhash64(tie), F.col("_blocks")))
    within = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(tie)) - 1
    if sizes.where(F.col("_n") > BLOCK_ROWS).isEmpty():
        return cut.withColumn("rank", F.col("_first") + within).drop("_first", "_blocks", "_block")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(cut.groupBy(*keys, "_block").agg(F.count("*").alias("_n")), "block-sizes")
    starts = starts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    cut = cut.withColumn("_within", within).join(_sized(starts), [*keys, "_block"])
    return cut.withColumn("rank", F.col("_first") + F.col("_before") + F.col("_within")).drop("_first", "_blocks", "_block", "_within", "_before")
