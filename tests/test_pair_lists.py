"""Pairs listed from blocks: each once, under its first rule, without a join and without the compared texts."""

from itertools import combinations

import numpy as np
import pytest

from kinloom.operators import blocking

FIELDS = ("first_name", "last_name", "email", "phone", "date_of_birth", "postcode", "initial")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    few = {"first_name": 3, "last_name": 4, "email": 40, "phone": 40, "date_of_birth": 5, "postcode": 5, "initial": 2}
    draw = lambda f: None if rng.random() < 0.1 else f"{f[0]}{rng.integers(few[f])}"
    made = [(f"R{i:03}", int(rng.integers(1, 4)), *[draw(f) for f in FIELDS]) for i in range(150)]
    return made + [(None, 1, *made[0][2:]), ("R007", 1, *made[7][2:])]  # without an id, and an id that comes twice


def brute_force(rows):
    of = [dict(zip(("rep", "copies", *FIELDS), r)) for r in rows if r[0] is not None]
    agree = lambda a, b, rule: all(a[c] is not None and a[c] == b[c] for c in rule)
    out = []
    for a, b in combinations(sorted(of, key=lambda r: r["rep"]), 2):
        rule = next((i for i, rule in enumerate(blocking.BLOCKING_RULES) if agree(a, b, rule)), None)
        if rule is not None and a["rep"] < b["rep"]:
            out.append((rule, a["rep"], b["rep"], a["copies"], b["copies"]))
    return sorted(out)


@pytest.mark.parametrize("tile_rows", [4_000, 40, 3])
def test_pairs_are_those_of_all_pairs(spark, rows, tile_rows):
    vectors = spark.createDataFrame(rows, f"rep string, copies long, {', '.join(f + ' string' for f in FIELDS)}")
    pairs = blocking.candidate_pairs(vectors.repartition(3), tile_rows=tile_rows, carried=("rep", "copies"))
    assert pairs.schema["l"].dataType.names == pairs.schema["r"].dataType.names == ["rep", "copies"]
    got = pairs.select("rule", "l.rep", "r.rep", "l.copies", "r.copies").toDF("rule", "a", "b", "m", "n").collect()
    assert sorted(map(tuple, got)) == brute_force(rows)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert tile_rows < 150 or "Join" not in plan, plan


def test_all_columns_are_carried_unless_named(spark, rows):
    vectors = spark.createDataFrame(rows, f"rep string, copies long, {', '.join(f + ' string' for f in FIELDS)}")
    vectors = vectors.select("copies", "rep", *FIELDS)
    found = blocking.candidate_pairs(vectors).collect()
    of = {tuple(r) for r in vectors.collect()}
    assert found and all(tuple(r.l) in of and tuple(r.r) in of for r in found)
