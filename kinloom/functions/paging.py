"""Lists per key that stay bounded however many rows a key holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.ids import running_total
from kinloom.session import Scratch

PAGE_ROWS = 10_000


def with_page(df: DataFrame, keys: list[str], order: Sequence[str], page_rows: int = PAGE_ROWS) -> DataFrame:
    """Add `page`, so that a key's pages in sequence are its rows in `order`, `page_rows` to a page.

    Keys of one page need no position. The rows of larger keys are dealt by ranges of
    (key, order), which spreads a key with a third of all rows before anything collects it.
    """
    scratch = Scratch(df.sparkSession, "pages")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = scratch.put(sizes.filter(F.col("_rows") > page_rows).select(*keys), "large")
    placed = running_total(scratch, df.join(large, keys, "left_semi"), keys, order, None, "_place")
    paged = placed.withColumn("page", F.floor(F.col("_place") / page_rows).cast("int")).drop("_place")
    return df.join(large, keys, "left_anti").withColumn("page", F.lit(0)).unionByName(paged)


def paged_lists(df: DataFrame, keys: list[str], item: Column, name: str) -> DataFrame:
    """Sorted lists of `item` per key and page; together the pages hold every row, in order."""
    return (
        with_page(df.withColumn("_item", item), keys, ("_item",))
        .groupBy(*keys, "page")
        .agg(F.array_sort(F.collect_list("_item")).alias(name))
    )
