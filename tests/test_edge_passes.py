"""What clustering, confidence and sweep take from edges in one pass equals what joins of all edges give."""

import numpy as np
from pyspark.sql import functions as F

from kinloom.operators import components, link
from kinloom.operators.evaluate import SWEEP_THRESHOLDS
from kinloom.plans.inputs import FIXED_MODEL
from kinloom.session import materialize
from kinloom.sources.derived import derived_records
from tests.conftest import TESTDATA


def parts(edges, left="l", right="r"):
    return {tuple(r) for r in components.connected_components(edges, left, right).collect()}


def test_what_hangs_keeps_the_components_of_every_level(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(f"n{a:03}", f"n{b:03}", int(k)) for a, b, k in zip(*rng.integers(0, 120, (2, 900)), rng.integers(1, 6, 900))]
    edges = spark.createDataFrame(rows, "l string, r string, level int").repartition(2)
    for at_once in (1 << 18, 10):
        monkeypatch.setattr(components, "SPANNED", at_once)
        fewer = components.spanned(edges, "l", "r", "level")
        assert fewer.columns == edges.columns
        if at_once > 900:
            assert fewer.count() <= 2 * 119  # a task leaves a tree, and all of its batches are one
        for level in range(1, 6):
            assert parts(fewer.filter(F.col("level") >= level)) == parts(edges.filter(F.col("level") >= level))


def test_confidence_needs_no_join_of_edges(spark):
    made = link.link(derived_records(spark, TESTDATA), FIXED_MODEL)
    for threshold in (0.3, 0.75, 0.99):
        placed = materialize(link.cluster_edges(made.members, made.edges, made.copies, threshold), "placed")
        joined = link.record_confidence(placed, made.edges, made.copies)
        once = link.record_confidence(placed, made.edges, made.copies, threshold)
        assert {tuple(r) for r in once.collect()} == {tuple(r) for r in joined.collect()}
        assert once._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_dendrogram_equals_components_of_every_threshold(spark):
    made = link.link(derived_records(spark, TESTDATA), FIXED_MODEL)
    levels = sorted(SWEEP_THRESHOLDS)
    top, merges = link.dendrogram(made.edges, levels)
    top = {r.rep: r.component for r in top.collect()}
    into = {(r.threshold, r.component): r.into for r in merges.collect()}
    for t in levels:
        want = dict(parts(made.edges.filter(F.col("match_probability") >= t), link.LEFT, link.RIGHT))
        nodes = {r.rep for r in made.members.select("rep").distinct().collect()}
        for n in nodes:
            own = top.get(n, n)
            assert into.get((t, own), own) == want.get(n, n)
