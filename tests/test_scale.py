"""What has to hold for keys and tables of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.functions import paging
from kinloom.operators import anomaly, blocking, forest, train
from kinloom.operators.components import connected_components
from kinloom.operators.ids import running_total
from kinloom.plans import noise, stages
from kinloom.session import Scratch


def test_pages_in_sequence_are_the_order(spark):
    rows = spark.range(2500).select(F.when(F.col("id") < 2000, "hot").otherwise("cold").alias("k"), ((F.col("id") * 7919) % 2500).alias("at"))
    pages = paging.paged_lists(rows, ["k"], F.struct("at"), "items").unionByName(paging.paged_lists(rows.limit(0), ["k"], F.struct("at"), "items"))
    small = paging.with_page(rows, ["k"], ("at",), page_rows=300).groupBy("k", "page").agg(F.sort_array(F.collect_list("at")).alias("items"))
    for k, n in (("hot", 7), ("cold", 2)):
        mine = small.filter(F.col("k") == k).orderBy("page").collect()
        assert [r.page for r in mine] == list(range(n)) and all(len(r["items"]) == 300 for r in mine[:-1])
        joined = [x for r in mine for x in r["items"]]
        assert joined == sorted(joined) and len(joined) == rows.filter(F.col("k") == k).count()
    assert sorted(r.page for r in pages.collect()) == [0, 0]


def test_random_pairs_come_from_the_whole_pool(spark):
    fields = {c: F.concat(F.lit(c), (F.col("id") % 97).cast("string")) for c in blocking.COMPARED}
    pool = spark.range(30_000).select(F.format_string("R%06d", "id").alias("source_record_id"), *[v.alias(c) for c, v in fields.items()])
    pool = pool.withColumn("date_of_birth", F.lit("1990-01-01"))
    captured = blocking.captures(pool)
    pairs = train.random_pairs(captured, max_pairs=60_000)
    left = pairs.select("l.source_record_id").distinct().count()
    assert left == captured.count()  # every capture takes part, not a prefix
    few = train.random_pairs(captured, max_pairs=1000)
    assert 700 < few.count() < 1300


def test_each_tree_draws_from_all_rows(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x"))
    samples = forest.tree_samples(rows, "k", ["x"], seed=1, trees=20, sample=64)
    assert [len(s) for s in samples] == [64] * 20
    seen = np.concatenate(samples)[:, 0]
    assert len(np.unique(seen)) > 1100 and abs(seen.mean() - 10_000) < 800
    assert [len(s) for s in forest.tree_samples(rows.limit(10), "k", ["x"], 1, 3, 64)] == [10] * 3


def test_conflicts_list_every_value(spark):
    linked = spark.createDataFrame(
        [("M", d, p) for d, p in zip(("1990-01-01", "1991-01-01", "1992-01-01"), ("A1 1A", "a11a", "B2"))],
        f"{anomaly.MASTER_ID} string, date_of_birth string, postcode string",
    )
    got = {r.field: list(r["values"]) for r in anomaly.conflict_summaries(linked).collect()}
    assert got == {"date_of_birth": ["1990-01-01", "1991-01-01", "1992-01-01"], "postcode": ["A11A", "B2"]}


def test_a_hub_joins_are_split(spark):
    """A node with a third of the edges: the large star joins two plain shuffles, so AQE splits it."""
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    }
    before = {k: spark.conf.get(k) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        i = F.col("id")
        edges = spark.range(60_000).select((i + 1).alias("a"), F.when(i % 3 == 0, F.lit(0).cast("long")).otherwise(i - i % 50).alias("b"))
        got = connected_components(edges, "a", "b")
        assert got.filter("component <> 0").count() == 0
        scratch = Scratch(spark, "t")
        both = scratch.put(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        least = scratch.put(both.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = both.repartition(8).join(least, "a")
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_leave_one_table(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 1)], "a long, b long")
    assert {(r.node, r.component) for r in connected_components(edges, "a", "b").collect()} == {(k, 1) for k in (1, 2, 3, 8, 9)}


def test_running_total_of_a_hot_group(spark):
    rows = spark.range(900).select(F.lit("one").alias("g"), (F.col("id") % 100).alias("o"), "id", F.lit(3).cast("long").alias("v"))
    got = running_total(Scratch(spark, "t"), rows, ("g",), ("o", "id"), "v").orderBy("o", "id").collect()
    assert [r.before for r in got] == list(range(0, 2700, 3))


def test_benchmark_is_kept_and_read_in_level_order(spark, tmp_path):
    store = stages.Store(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        noise.run_benchmark(store, 10)
    with pytest.raises(ValueError, match="missing"):
        noise.stored_benchmark(store)
    noise.run_benchmark(store, 200, ("heavy", "pristine"))
    rows = noise.stored_benchmark(store).collect()
    assert [r.noise_level for r in rows] == ["pristine", "heavy"]
    assert rows[0].linkage_f1 == 1.0 and all(r.linkage_f1 >= r.baseline_f1 for r in rows)
    store.new_version()
    assert store.has("benchmark_results")
