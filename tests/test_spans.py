"""Large blocks are dealt to spans: rows are moved a bounded number of times, pairs stay the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.operators import patterns


def blocks_of(spark, sizes):
    rows = [(f"b{i}", f"r{i}-{j}", 1, f"0{j % 50}") for i, n in enumerate(sizes) for j in range(n)]
    return spark.createDataFrame(rows, "block string, rep string, copies long, phone string")


@pytest.mark.parametrize("sizes", [[200] * 12, [60] * 9 + [3] * 40, [400] + [2] * 2000, [2] * 50, []])
def test_rows_are_moved_a_bounded_number_of_times(spark, sizes):
    keyed = blocks_of(spark, sizes)
    out = patterns.dealt(keyed, 20, 30)
    rows = out.count()
    assert rows <= patterns.SPREAD * sum(sizes)  # a block of 200 went to ten tiles each
    largest = [r["n"] for r in out.filter("grp.of IS NOT NULL").groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(largest, default=0) <= 2 * (20 << patterns.LONGEST)
    met = set()
    large_ones = out.filter("grp.of IS NOT NULL").select("grp.of", "grp.i", "grp.j", "side", "rep").toPandas()
    for _, part in large_ones.groupby(["of", "i", "j"]):
        own = part[part.side == patterns.BOTH].rep.tolist()
        left, right = (part[part.side == s].rep.tolist() for s in (patterns.LEFT, patterns.RIGHT))
        pairs = [(min(a, b), max(a, b)) for i, a in enumerate(own) for b in own[i + 1 :]] + [(min(a, b), max(a, b)) for a in left for b in right]
        assert not met & set(pairs) and len(pairs) == len(set(pairs))
        met |= set(pairs)
    assert len(met) == sum(n * (n - 1) // 2 for n in sizes if n > 20)


def test_parts_of_a_group_hold_every_pair_once():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for sides in (np.zeros(95, np.int32), rng.integers(1, 3, 95).astype(np.int32)):
        table = pa.table({
            "grp": pa.array([{"of": "b", "i": 0, "j": 1}] * 95), "side": pa.array(sides), "_like": pa.array([f"p{i % 9}" for i in range(95)]),
            "rep": pa.array([f"r{i:02}" for i in range(95)]),
        })
        met = []
        for part in patterns.by_tiles(table, 10):
            assert len(part) <= 20
            side, rep = part.column("side").to_numpy(), part.column("rep").to_pylist()
            met += [frozenset((rep[i], rep[j])) for i in range(len(rep)) for j in range(i + 1, len(rep))
                    if side[i] == side[j] == patterns.BOTH or {side[i], side[j]} == {patterns.LEFT, patterns.RIGHT}]
        n = {s: int((sides == s).sum()) for s in (0, 1, 2)}
        assert len(met) == len(set(met)) == n[0] * (n[0] - 1) // 2 + n[1] * n[2]
