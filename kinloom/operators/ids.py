"""Global positions without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinloom.schemas import MASTER_ID
from kinloom.session import Scratch, materialize, shuffle_partitions


def global_position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """1-based position of every row in the total order `order`.

    Rows are range-partitioned once and written, so that the partition a row is in
    is a fact on disk; positions are then local ranks plus the partition's offset.
    Only one count per partition is ever looked at together.
    """
    n = shuffle_partitions(df.sparkSession)
    keyed = df.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = materialize(
        keyed.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return (
        ranged.withColumn("_local", local)
        .join(F.broadcast(offsets), "_part")  # at most one row per shuffle partition
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_part", "_local", "_before", *keys)
    )


def running_total(
    scratch: Scratch, df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str | None, name: str = "before"
) -> DataFrame:
    """`df` with the sum of `value` (None: the number of rows) before each row, in its group and order.

    The rows are dealt by ranges of (groups, order) and written, so the part a row is in
    is a fact on disk. A total is then one sum per part and group plus a window inside one
    part, and a group of any size is spread over as many parts as it fills.
    `groups` must not be null.
    """
    amount = F.lit(1).cast("long") if value is None else F.col(value)
    ranged = scratch.put(
        df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()), f"ranged_{name}"
    )
    sums = ranged.groupBy("_part", *groups).agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *groups, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = (
        Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(offsets, ["_part", *groups])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_part", "_inside", "_offset")
    )


def master_ids(components: DataFrame, column: str = "component") -> DataFrame:
    """`MC00001`, `MC00002`, ... in the order of the component ids."""
    return global_position(components.select(column).distinct(), column).select(
        column, F.format_string("MC%05d", "position").alias(MASTER_ID)
    )
