"""Frames that Spark takes for smaller than they are stay off the driver."""

import re

from pyspark.sql import functions as F

from kinloom.llm import jaccard, simhash
from kinloom.session import Scratch


def test_replicas_are_not_broadcast(spark):
    fps = spark.range(2_000).select(F.xxhash64("id").alias("fp"))
    homes = simhash._replicas(fps, 0)
    met = simhash._met(homes, simhash._replicas(fps, simhash.THRESHOLD), simhash.THRESHOLD)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search("BroadcastHashJoin|BroadcastExchange", plan)
    # Spark's own guess of the replicas, 61 a fingerprint, is below its limit for broadcasts.
    guessed = int(simhash._replicas(fps, simhash.THRESHOLD)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert guessed < 2_000 * 61 * 16
    met.collect()
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()


def test_the_stage_of_near_duplicates_broadcasts_no_replicas(spark, monkeypatch):
    plans = []

    def put(self, df, name, *rest, write=Scratch.put):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name, *rest)

    monkeypatch.setattr(Scratch, "put", put)
    nodes = spark.range(2_000).select("id", F.lit(9).cast("long").alias("n"), F.xxhash64("id").alias("fp"))
    jaccard.near(nodes, Scratch(spark, "near")).collect()
    meeting = [p for p in plans if "MapInArrow" in p and "Join" in p]
    assert meeting
    for plan in meeting:
        lines = plan.splitlines()
        depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
        for at, line in enumerate(lines):
            if "BroadcastExchange" in line:
                end = next((i for i in range(at + 1, len(lines)) if depth[i] <= depth[at]), len(lines))
                assert "MapInArrow" not in "".join(lines[at:end])
