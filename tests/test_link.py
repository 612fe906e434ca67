import random
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinloom.functions.text import _batch_similarity, jaro_winkler
from kinloom.operators import blocking, evaluate, link, train
from kinloom.operators.compare import TOP_LEVEL
from kinloom.plans.inputs import FIXED_MODEL
from kinloom.sources.derived import derived_records
from kinloom.sources.tables import linkage_pool

TESTDATA = "/root/testdata/sf0.001"
WORDS = st.text(alphabet="abcAB .@", min_size=1, max_size=80)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=40))
def test_jaro_winkler_matches_duckdb(pairs):
    left, right = ([min(p) for p in pairs], [max(p) for p in pairs])
    frame = pd.DataFrame({"l": left, "r": right})  # noqa: F841 - read by DuckDB
    want = duckdb.sql("SELECT jaro_winkler_similarity(l, r) AS s FROM frame").df()["s"].to_numpy()
    assert np.abs(jaro_winkler(left, right) - want).max() < 1e-9


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=40))
def test_skipped_pairs_are_below_the_floor(pairs):
    import pyarrow as pa

    left, right = ([p[0] for p in pairs], [p[1] for p in pairs])
    got = np.asarray(_batch_similarity(pa.array(left), pa.array(right), 0.7))
    full = jaro_winkler(left, right)
    assert ((got == full) | ((got == 0) & (full < 0.7))).all()


@pytest.fixture(scope="module")
def pool(spark):
    return linkage_pool(derived_records(spark, TESTDATA))


@pytest.fixture(scope="module")
def vectors(pool):
    return blocking.collapse(blocking.captures(pool)).cache()


def test_the_matcher_never_sees_the_truth(pool):
    assert "person_index" not in pool.columns


def pairs_of(df):
    return sorted((r[0], r[1], r[2]) for r in df.select("rule", "l.rep", "r.rep").toDF("rule", "l", "r").collect())


def test_tiles_do_not_change_the_pairs(vectors):
    plain = pairs_of(blocking.candidate_pairs(vectors))
    assert plain == pairs_of(blocking.candidate_pairs(vectors, tile_rows=3))
    assert len({(a, b) for _, a, b in plain}) == len(plain) and all(a < b for _, a, b in plain)


def test_counts_without_pairs_match_the_pairs(spark, pool):
    rows = [r.asDict() for r in pool.withColumn("initial", F.substring("first_name", 1, 1)).collect()]
    fired = [0] * len(blocking.BLOCKING_RULES)
    for a, b in combinations(rows, 2):
        for i, rule in enumerate(blocking.BLOCKING_RULES):
            if all(a[c] is not None and a[c] == b[c] for c in rule):
                fired[i] += 1
                break
    got = [r["new_pairs"] for r in blocking.union_pair_counts(pool).orderBy("rule").collect()]
    assert got == fired


def test_em_matches_plain_python():
    rng = random.Random(2)
    fields = ("phone", "postcode")
    u = {"phone": [0.9, 0.05, 0.03, 0.02], "postcode": [0.8, 0.1, 0.05, 0.05]}
    patterns = np.array([[a, b] for a in range(-1, 4) for b in range(-1, 4)])
    counts = np.array([float(rng.randrange(1, 200)) for _ in patterns])
    m, share = train.fit_m(patterns, counts, fields, u, 0.1, max_iterations=7, tolerance=0.0)
    want = {f: [0.05 / TOP_LEVEL[f]] * TOP_LEVEL[f] + [0.95] for f in fields}
    lam = 0.1
    for _ in range(7):
        post = []
        for row in patterns:
            pm, pu = lam, 1 - lam
            for f, level in zip(fields, row):
                if level >= 0:
                    pm, pu = pm * want[f][level], pu * u[f][level]
            post.append(pm / (pm + pu))
        for j, f in enumerate(fields):
            total = sum(p * c for p, c, row in zip(post, counts, patterns) if row[j] >= 0)
            fresh = [sum(p * c for p, c, row in zip(post, counts, patterns) if row[j] == i) / total for i in range(TOP_LEVEL[f] + 1)]
            want[f] = [max(x, 1e-6) for x in fresh]
        lam = sum(p * c for p, c in zip(post, counts)) / counts.sum()
    assert share == pytest.approx(lam, rel=1e-4)
    for f in fields:
        assert m[f] == pytest.approx(want[f], rel=1e-3)


def test_random_pairs_are_distinct_and_bounded(pool):
    pairs = train.random_pairs(blocking.captures(pool), max_pairs=2_000)
    rows = [(r[0], r[1]) for r in pairs.select("l.source_record_id", "r.source_record_id").collect()]
    assert 1_500 <= len(rows) <= 3_500
    assert len({frozenset(p) for p in rows}) == len(rows) and all(a != b for a, b in rows)


def test_exact_copies_stay_one_row_and_end_in_one_cluster(spark, pool):
    first = pool.filter("email IS NOT NULL AND phone IS NOT NULL").limit(1)
    many = spark.range(500).select(F.format_string("ZZZ%05d", "id").alias("source_record_id")).crossJoin(first.drop("source_record_id"))
    both = pool.unionByName(many)
    vectors = blocking.collapse(blocking.captures(both))
    assert vectors.agg(F.max("copies")).first()[0] >= 500
    found = link.link(both, FIXED_MODEL)
    copied = found.clusters.filter("source_record_id LIKE 'ZZZ%'")
    assert copied.select("master_citizen_id").distinct().count() == 1 and copied.count() == 500


def test_same_result_for_any_number_of_partitions(spark, pool):
    def ids():
        return sorted(map(tuple, link.link(pool, FIXED_MODEL).clusters.collect()))

    before = ids()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert ids() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trained_linkage_beats_the_best_rule(spark):
    records = derived_records(spark, TESTDATA)
    found = link.link(records)
    rows = {r["method"]: r for r in evaluate.evaluate_linkage(found.clusters, records).collect()}
    assert rows["linkage"]["f1_gain_over_best_baseline"] > 0
