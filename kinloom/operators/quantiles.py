"""Exact weighted quantiles of several columns without gathering a column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.ids import running_total
from kinloom.session import Scratch


def quantiles(df: DataFrame, columns: dict[str, Column], q: float, weight: Column) -> dict[str, float]:
    """The `q`-quantile of each column, every row counted `weight` times; columns without a value are left out.

    Values and their weights are counted first. Running totals over ranges of values then tell
    which value holds the place q * (n - 1), and between two places values are interpolated, as
    the builtin `percentile` does. Only those two values of a column leave the cluster.
    """
    scratch = Scratch(df.sparkSession, "quantiles")
    cells = F.array(*[F.struct(F.lit(c).alias("of"), v.cast("double").alias("value")) for c, v in columns.items()])
    counted = (
        df.select(weight.cast("long").alias("n"), F.inline(cells)).filter("value is not null").groupBy("of", "value").agg(F.sum("n").alias("n"))
    )
    counted = scratch.put(counted, "counted")
    totals = counted.groupBy("of").agg(((F.sum("n") - 1) * F.lit(q)).alias("place"))  # a row per column
    placed = running_total(scratch, counted, ("of",), ("value",), "n").join(F.broadcast(totals), "of")
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("value")))
    found = placed.groupBy("of", "place").agg(at(F.floor("place")).alias("low"), at(F.ceil("place")).alias("high")).collect()
    scratch.clear()
    share = {r.of: r.place % 1 for r in found}
    return {r.of: r.low if r.low == r.high else (1 - share[r.of]) * r.low + share[r.of] * r.high for r in found}
