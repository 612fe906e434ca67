"""Pair counts of the rules: dealt out as hashes by many tasks, however few files the records come from."""

from itertools import combinations

from kinloom.operators import blocking
from kinloom.schemas import COMPARED


def test_unions_are_counted_over_hashes_in_many_tasks(spark, monkeypatch):
    values = [
        ("Al", "Ash", "1990-01-01", "a@x", "1", None, "P1"), ("Al", "Ash", "1990-01-01", None, "1", None, "P1"),
        ("A", "lAsh", None, "a@x", None, None, "P1"), ("Amy", "Ash", "1990-01-01", "", "2", None, "P2"),
        ("Bo", None, "1990-01-01", "", "2", None, "P1"), ("Bo", "Ash", "1991-01-01", "b@x", None, None, None),
    ] * 3
    records = spark.createDataFrame(values, ", ".join(f"{c} string" for c in COMPARED)).coalesce(1)
    written = []
    plain = blocking.materialize
    monkeypatch.setattr(blocking, "materialize", lambda df, name="stage": written.append((name, df)) or plain(df, name))
    got = blocking.union_pair_counts(records).orderBy("rule").collect()
    name, marked = written[0]
    assert name == "marked" and {f.dataType.simpleString() for f in marked.schema} == {"bigint"}
    assert marked.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))

    rows = [{**dict(zip(COMPARED, v)), "initial": v[0][:1]} for v in values]
    fires = [{i for i, r in enumerate(blocking.BLOCKING_RULES) if all(a[c] is not None and a[c] == b[c] for c in r)} for a, b in combinations(rows, 2)]
    for i, row in enumerate(got):
        assert row.pairs == sum(i in f for f in fires)
        assert row.new_pairs == sum(bool(f) and min(f) == i for f in fires)
        assert row.pairs_so_far == sum(bool(f) and min(f) <= i for f in fires)
