"""Weighted quantiles against writing every row out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.operators.quantiles import quantiles


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_quantiles_equal_sorted_rows(spark, q):
    rng = np.random.default_rng(1)
    rows = [(float(round(x, 2)), int(k), int(w)) for x, k, w in zip(rng.normal(size=500), rng.integers(0, 4, 500), rng.integers(1, 9, 500))]
    rows += [(None, 3, 5), (7.5, None, 100_000)]  # a hot value
    df = spark.createDataFrame(rows, "x double, k int, w int").repartition(5)
    got = quantiles(df, {"x": F.col("x"), "k": F.col("k")}, q, F.col("w"))
    for place, name in enumerate(("x", "k")):
        every = np.repeat([r[place] for r in rows if r[place] is not None], [r[2] for r in rows if r[place] is not None])
        assert got[name] == pytest.approx(np.quantile(every, q), abs=1e-12)
    wanted = df.agg(F.percentile("x", q, F.col("w")), F.percentile("k", q, F.col("w"))).first()
    assert (got["x"], got["k"]) == pytest.approx(tuple(wanted), abs=1e-12)


def test_columns_without_values(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert quantiles(df, {"x": F.col("x"), "y": F.col("y")}, 0.5, F.lit(1)) == {"y": 1.0}
    assert quantiles(df.limit(0), {"y": F.col("y")}, 0.5, F.lit(1)) == {}
