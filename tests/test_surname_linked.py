"""The coarse clustering comes from the records' own rows: no join, no votes for columns that no feature reads."""

from conftest import TESTDATA
from kinloom.operators import anomaly, profile
from kinloom.plans import inputs
from kinloom.plans.queries import QUERIES, flat


def test_features_join_only_their_own_aggregates(spark):
    linked = inputs.surname_linked(spark, TESTDATA)
    joined = profile.linked_records(inputs.surname_clusters(spark, TESTDATA), inputs.records(spark, TESTDATA))
    assert linked.columns == joined.columns
    assert "Join" not in linked._jdf.queryExecution().optimizedPlan().toString()
    got = QUERIES["features"](spark, TESTDATA)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    want = flat(anomaly.features(joined, profile.build_profiles(joined)))
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
