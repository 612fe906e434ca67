import pytest
from pyspark.sql import functions as F

from kinloom.operators import anomaly, evaluate


def metrics(df):
    return df.first().asDict()


def test_hand_derived_partition(partition_fixture):
    records, clusters = partition_fixture
    labelled = evaluate.linkage_partition(clusters, records)
    sums = evaluate.contingency(labelled).first()
    assert (sums["agreeing_pairs"], sums["predicted_pairs"], sums["true_pairs"]) == (4, 6, 5)
    m = metrics(evaluate.partition_metrics(labelled))
    assert m["pairwise_precision"] == pytest.approx(4 / 6, abs=1e-6)
    assert m["pairwise_recall"] == pytest.approx(4 / 5, abs=1e-6)
    shape = [m[c] for c in ("predicted_clusters", "true_citizens", "exactly_resolved", "over_split_citizens", "over_merged_clusters")]
    assert shape == [4, 4, 1, 1, 1]


def test_perfect_partition(partition_fixture):
    records, _ = partition_fixture
    m = metrics(evaluate.partition_metrics(records.select(F.col("person_index").cast("string").alias("predicted_id"), "person_index")))
    assert (m["pairwise_f1"], m["adjusted_rand_index"], m["exactly_resolved"]) == (1.0, 1.0, 4)


def test_degenerate_baselines_bracket(partition_fixture):
    records, _ = partition_fixture
    by = {r["method"]: r for r in evaluate.partition_metrics(evaluate.baseline_partitions(records), by=("method",)).collect()}
    assert by["no_linkage"]["pairwise_precision"] == 1.0 and by["no_linkage"]["pairwise_recall"] == 0.0
    assert by["all_one_cluster"]["pairwise_recall"] == 1.0 and by["all_one_cluster"]["predicted_clusters"] == 1


def test_missing_keys_never_merge(partition_fixture):
    records, _ = partition_fixture
    blank = records.withColumn("email", F.lit(None).cast("string"))
    m = metrics(evaluate.partition_metrics(evaluate.baseline_partition(blank, "exact_email")))
    assert (m["predicted_clusters"], m["pairwise_recall"]) == (8, 0.0)


def test_unknown_baseline_and_missing_truth(partition_fixture):
    records, _ = partition_fixture
    with pytest.raises(ValueError, match="unknown baseline"):
        evaluate.baseline_partition(records, "nope")
    with pytest.raises(ValueError, match="ground truth"):
        evaluate.baseline_partition(records.drop("person_index"), "exact_email")


def test_error_labels(partition_fixture):
    records, clusters = partition_fixture
    linked = clusters.join(records, "source_record_id")
    labels = {r[0]: r[1] for r in anomaly.error_labels(linked).collect()}
    assert labels == {"C1": False, "C2": True, "C3": True, "C4": True}
