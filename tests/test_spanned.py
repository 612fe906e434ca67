"""Edges replaced by what they connect, batch by batch, and likely pairs against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from kinloom.operators import blocking, compare, score
from kinloom.operators.components import connected_components, spanned
from kinloom.plans.inputs import FIXED_MODEL
from kinloom.sources.derived import derived_records
from kinloom.sources.tables import linkage_pool
from tests.conftest import TESTDATA


def test_spanned_keeps_components_with_fewer_rows(spark):
    rng = np.random.default_rng(5)
    pairs = [(f"n{c:03}-{i:02}", f"n{c:03}-{j:02}") for c in range(60) for i, j in rng.integers(0, 12, (40, 2)).tolist()]
    edges = spark.createDataFrame(pairs + [("x", "x"), ("q", None)], "l string, r string").repartition(3)
    fewer = spanned(edges, "l", "r")
    of = lambda e: {tuple(r) for r in connected_components(e, "l", "r").collect()}
    assert of(fewer) == of(edges) and fewer.count() <= 3 * 12 * 60


def test_scores_of_pairs_picked_in_groups_equal_scores_of_all_pairs(spark):
    vectors = score.with_frequencies(blocking.collapse(blocking.captures(linkage_pool(derived_records(spark, TESTDATA)))))
    pairs = compare.gammas(blocking.candidate_pairs(vectors))
    tf = {f: F.greatest(F.col(f"l.tf_{f}"), F.col(f"r.tf_{f}")) for f in score.FREQUENCY_FIELDS}
    rated = pairs.withColumn("p", score.probability(score.match_weight(FIXED_MODEL, tf)))
    ids = [F.col("l.rep"), F.col("r.rep"), F.col("l.copies"), F.col("r.copies")]
    for keep in (0.05, 0.9):
        want = {tuple(r) for r in rated.filter(F.col("p") >= keep).select(*ids, F.round("p", 9), *score.GAMMA_COLUMNS).collect()}
        found = score.score_pairs(vectors, FIXED_MODEL, keep=keep).withColumn("match_probability", F.round("match_probability", 9))
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
