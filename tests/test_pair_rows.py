"""What a candidate pair's members bring along, and how large blocks are found."""

import pytest
from pyspark.sql import functions as F

from kinloom.operators import blocking, compare
from kinloom.sources.derived import derived_records
from kinloom.sources.tables import linkage_pool
from tests.conftest import TESTDATA


@pytest.fixture(scope="module")
def vectors(spark):
    return blocking.collapse(blocking.captures(linkage_pool(derived_records(spark, TESTDATA)))).cache()


def test_members_bring_the_keys_of_earlier_rules_only(vectors):
    marked = vectors.withColumns(blocking._rule_keys(blocking.BLOCKING_RULES))
    sizes = [F.size(blocking._earlier(i)).alias(f"n{i}") for i in range(len(blocking.BLOCKING_RULES))]
    assert {tuple(r) for r in marked.select(*sizes).collect()} == {(0, 2, 4, 6, 8, 10)}
    plan = blocking.candidate_pairs(vectors, carried=("rep", "copies"))._jdf.queryExecution().optimizedPlan()
    shuffled = plan.toString().split("RepartitionByExpression")[1]
    assert "earlier" in shuffled and "key5_1" not in plan.schema().toString()


@pytest.mark.parametrize(("buckets", "tile_rows"), [(1, 3), (7, 3), (4096, 20), (2, 10_000)])
def test_large_blocks_are_found_through_buckets(vectors, monkeypatch, buckets, tile_rows):
    monkeypatch.setattr(blocking, "LEAST_BUCKETS", buckets)
    rules = [F.struct(F.lit(i).alias("rule"), F.xxhash64(F.lit(1), *r).alias("half_1"), F.xxhash64(F.lit(2), *r).alias("half_2"))
             for i, r in enumerate(blocking.BLOCKING_RULES[:3])]
    keyed = vectors.select(F.inline(F.array(*rules)))
    on = ["rule", "half_1", "half_2"]
    got = {tuple(r) for r in blocking._hot_blocks(keyed, on, tile_rows, vectors.count()).collect()}
    want = keyed.groupBy(*on).count().filter(F.col("count") > tile_rows).collect()
    assert got == {(r.rule, r.half_1, r.half_2, -(-r["count"] // tile_rows)) for r in want}


def test_levels_need_no_other_columns(vectors):
    of = lambda pairs: {tuple(r) for r in compare.gammas(pairs).select("l.rep", "r.rep", *[f"gamma_{f}" for f in compare.COMPARED]).toDF(*"ab", *compare.COMPARED).collect()}
    lean = blocking.candidate_pairs(vectors, carried=("rep", *compare.READ))
    assert of(lean) == of(blocking.candidate_pairs(vectors)) and "capture" not in lean.schema["l"].dataType.names
