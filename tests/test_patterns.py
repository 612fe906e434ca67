"""Counting agreement patterns in bounded groups, against listing every pair."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinloom.functions.text import edit_distance
from kinloom.operators import blocking, compare, patterns, train
from kinloom.schemas import COMPARED
from kinloom.session import materialize
from kinloom.sources.derived import derived_records
from kinloom.sources.tables import linkage_pool
from tests.conftest import TESTDATA


@pytest.fixture(scope="module")
def vectors(spark):
    """Captures of the smallest table, some values made odd or missing."""
    odd = F.pmod(F.xxhash64("source_record_id"), F.lit(11))
    records = linkage_pool(derived_records(spark, TESTDATA)).withColumns(
        {
            "date_of_birth": F.when(odd == 0, "1960-13-45").when(odd == 1, "").otherwise(F.col("date_of_birth")),
            "email": F.when(odd == 2, None).when(odd == 3, "@").otherwise(F.col("email")),
            "postcode": F.when(odd == 4, "é 1").otherwise(F.col("postcode")),
            "first_name": F.when(odd == 5, "Zoë").otherwise(F.col("first_name")),
            "address": F.when(odd == 6, None).otherwise(F.col("address")),
        }
    )
    return materialize(blocking.collapse(blocking.captures(records)), "vectors")


def listed(vectors, rule, fields):
    names = [f"gamma_{f}" for f in fields]
    pairs = compare.gammas(blocking.candidate_pairs(vectors, (rule,)), fields)
    counted = pairs.groupBy(*names).agg(F.sum((F.col("l.copies") * F.col("r.copies")).cast("double")).alias("w"))
    return {tuple(r[n] for n in names): r.w for r in counted.collect()}


@pytest.mark.parametrize("rule", train.TRAINING_RULES)
@pytest.mark.parametrize(("tile", "group"), [(patterns.TILE, patterns.GROUP), (7, 25)])
def test_patterns_equal_listed_pairs(vectors, rule, tile, group):
    fields = tuple(f for f in COMPARED if f not in rule)
    found = patterns.pair_patterns(vectors, rule, fields, tile, group)
    names = [f"gamma_{f}" for f in fields]
    got = {tuple(r[n] for n in names): r.w for r in found.groupBy(*names).agg(F.sum("w").alias("w")).collect()}
    assert got == listed(vectors, rule, fields) and len(got) > 10


def test_no_group_holds_a_whole_block(vectors):
    one = vectors.withColumn("postcode", F.lit("AB1 2CD"))
    fields = ("first_name", "phone")
    found = patterns.pair_patterns(one, ("postcode",), fields, tile=50, group=50)
    n = one.agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("copies")).alias("own")).first()
    assert found.agg(F.sum("w")).first()[0] == (n.n * n.n - n.own) / 2


@pytest.mark.parametrize(("most", "segment"), [(4000, 500), (900, 7), (50, 2000)])
def test_random_pairs_are_counted_as_listed(vectors, most, segment):
    captured = vectors.select(F.col("rep").alias("source_record_id"), *COMPARED)
    wanted = {(r.field, r.level): r.n for r in train.level_counts(compare.gammas(train.random_pairs(captured, most))).collect()}
    ring, n, steps = train.ring_of(captured, most)
    counted = patterns.ring_levels(ring, n, steps, COMPARED, segment).groupBy("field", "level").agg(F.sum("n").alias("n"))
    assert {(r.field, r.level): r.n for r in counted.collect()} == wanted and sum(wanted.values()) == 7 * n * steps


@pytest.mark.parametrize("rows", [0, 1, 2, 3])
def test_rings_of_few_captures(vectors, rows):
    captured = vectors.orderBy("rep").limit(rows).select(F.col("rep").alias("source_record_id"), *COMPARED)
    ring, n, steps = train.ring_of(captured)
    counted = patterns.ring_levels(ring, n, steps, ("phone",)).agg(F.sum("n")).first()[0]
    assert (counted or 0) == train.random_pairs(captured).count()


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abcé😀", max_size=12), st.text("abcé😀", max_size=12)), min_size=1, max_size=30), st.integers(0, 10))
def test_edit_distance(pairs, limit):
    left, right = (np.array([p[k] for p in pairs] + [None], dtype=object)[:-1] for k in (0, 1))
    wanted = [d if (d := slow_distance(a, b)) <= limit else -1 for a, b in pairs]
    assert edit_distance(left, right, limit).tolist() == wanted
