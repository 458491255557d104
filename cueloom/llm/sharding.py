"""Contiguous shards of nearly equal size, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.checkpoints import freeze


def with_prefix_sums(table: DataFrame, size: str, order: list[str]) -> DataFrame:
    """Add ``before`` (the sizes of all rows that stand before a row), ``rank`` (how many rows do) and ``total`` (all sizes).

    The rows are dealt by range of the order columns and written; each partition's total is summed, the few
    totals are added up in order, and each row adds its own partition's running sum. No task sees more than
    its range, and only one row per partition is broadcast. Rows equal in all order columns stand in any order,
    which is fixed once they are written.
    """
    parts = max(1, table.sparkSession.sparkContext.defaultParallelism)
    dealt = table.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
    dealt = freeze(dealt.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "by_range")
    totals = dealt.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"), F.sum("_bytes").over(Window.partitionBy()).alias("total"))
    here = Window.partitionBy("_part").orderBy("_place")
    own = dealt.withColumn("_sum", F.sum(size).over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)).withColumn("_n", F.row_number().over(here) - 1)
    return own.join(F.broadcast(totals), "_part").withColumn("before", F.col("_bytes") + F.col("_sum")).withColumn("rank", F.col("_rows") + F.col("_n")).drop("_part", "_place", "_sum", "_n", "_bytes", "_rows")


def shards_by_bytes(docs: DataFrame, n_shards: int, size: Column, order: list[str], keep: dict[str, Column]) -> DataFrame:
    """Put each row into one of n_shards contiguous shards whose sizes are as near to equal as whole rows allow.

    A row goes where the middle of its own stretch of the global prefix sum falls, so no cut is further from its
    target than half a row. Returns the keep columns, ``size``, ``shard`` and ``slot`` (gapless from 0 in the
    shard, in order). order names keep columns. Sizes must be positive. An empty table gives no rows; a row
    larger than a shard's target leaves neighbouring shards empty rather than being cut.
    """
    sized = docs.select(*[c.alias(k) for k, c in keep.items()], size.cast("long").alias("size"))
    placed = with_prefix_sums(sized, "size", order)
    shard = F.least(F.lit(n_shards - 1), F.floor((2 * F.col("before") + F.col("size")).cast("double") * n_shards / (2.0 * F.col("total"))))
    placed = placed.withColumn("shard", shard.cast("int"))
    starts = placed.groupBy("shard").agg(F.min("rank").alias("_start"))
    return placed.join(F.broadcast(starts), "shard").select(*keep, "size", "shard", (F.col("rank") - F.col("_start")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard. Its files hold ranges of slots in order, so a shard is written by many tasks.

    All columns are written but shard, which the folders name; null values stay null, and an empty table gives no folders.
    """
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
