"""Positions of rows in a global order, without a task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with `_rank` (from 0) of each row among those of its group, by the columns in order, and `_n`, the rows of the group.

    Rows are range-partitioned by (group, order). One row for each group and partition it lies in carries how many rows of the group come before, so a
    group may hold any share of the rows. The group may not be null. Rows equal in all order columns get different ranks in no defined order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    # Within a partition the ids count the sorted rows.
    placed = cut(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    pieces = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumns({"_before": before, "_n": F.sum("_rows").over(whole)})
    rank = F.col("_at") - F.col("_first") + F.col("_before")
    return placed.join(pieces, [group, "_part"]).withColumn("_rank", rank).drop("_part", "_at", "_first", "_rows", "_before")
