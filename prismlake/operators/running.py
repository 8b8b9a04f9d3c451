"""Distributed running sums: range partitions, their totals, then local sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.session import discard, durable, partitions


def ranges(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with `_part`, the number of the range of group and order that a row is in; written, as a second evaluation may draw other bounds. Rows equal in both are in one range."""
    written = durable(df)
    ranged = durable(written.repartitionByRange(partitions(df.sparkSession), *group, *order).withColumn("_part", F.spark_partition_id()))
    discard(written)
    return ranged


def offsets(totals: DataFrame, group: list[str], value: str) -> DataFrame:
    """totals (`_part`, group, ...), a row for each range and group, with `_before`: the sum of value over the group's earlier ranges."""
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_before", F.coalesce(F.sum(value).over(earlier), F.lit(0))).drop(value)


def running_before(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str, is_written: bool = False) -> DataFrame:
    """Add `name`: the sum of value over the rows of the same group that come earlier in order.

    The group columns must not be null. Rows are range-partitioned by group and
    order, so that a hot group spreads over many partitions; each partition's total
    per group (at most partitions + groups rows) gives the offset of the next ones.
    Rows equal in the whole order are interchangeable. The ranged rows are written to
    the shared folder once, as a second evaluation may draw other bounds. is_written:
    df is little more than a table that is written already, and is not written again first.
    """
    n = partitions(df.sparkSession)
    at = f"{name}_part"
    # Written first, as drawing the bounds reads all rows once more.
    written = df if is_written else durable(df)
    ranged = durable(written.repartitionByRange(n, *[F.col(c) for c in group], *order).withColumn(at, F.spark_partition_id()).withColumn(f"{name}_value", value))
    if not is_written:
        discard(written)
    totals = ranged.groupBy(at, *group).agg(F.sum(f"{name}_value").alias(f"{name}_total"))
    earlier = Window.partitionBy(*group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(at, *group, F.coalesce(F.sum(f"{name}_total").over(earlier), F.lit(0)).alias(f"{name}_offset"))
    local = Window.partitionBy(at, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn(name, F.sum(f"{name}_value").over(local) - F.col(f"{name}_value"))
    return (
        summed.join(offsets, [at, *group])
        .withColumn(name, F.col(name) + F.col(f"{name}_offset"))
        .drop(at, f"{name}_offset", f"{name}_value")
    )


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """df with `name`, every row's number in an order over the whole table, by ranges."""
    ranked = running_before(df.withColumn("_all", F.lit(0)), ["_all"], order, F.lit(1), name).drop("_all")
    return ranked.withColumn(name, F.col(name).cast("long") + start)
