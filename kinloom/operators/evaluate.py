"""Partition quality against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.expr import pair_count, squeezed
from kinloom.schemas import RECORD_ID, TRUTH, require
from kinloom.session import materialize

# The thresholds of the sweep and the clustering threshold.
SWEEP_THRESHOLDS = (0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 0.995, 0.999)
CLUSTER_THRESHOLD = 0.75

# Baseline names, weakest first.
BASELINES = ("no_linkage", "exact_email", "exact_name_dob", "surname_dob_postcode", "all_one_cluster")


def baseline_key(method: str) -> Column:
    """The rule's linking key; NULL declines to link the record."""
    bar = F.lit("|")
    first, last, dob = F.lower("first_name"), F.lower("last_name"), F.col("date_of_birth")
    keys = {
        "no_linkage": F.lit(None).cast("string"),
        "exact_email": F.nullif(F.lower("email"), F.lit("")),
        "exact_name_dob": F.concat(first, bar, last, bar, dob),
        "surname_dob_postcode": F.concat(last, bar, dob, bar, F.lower(squeezed("postcode"))),
        "all_one_cluster": F.lit("ALL"),
    }
    if method not in keys:
        raise ValueError(f"unknown baseline '{method}', known: {', '.join(keys)}")
    return keys[method]


def _own_cluster(key: Column) -> Column:
    return F.coalesce(key, F.concat(F.lit("SINGLETON:"), F.col(RECORD_ID)))


def baseline_partition(records: DataFrame, method: str) -> DataFrame:
    require(records, (TRUTH,), "generation (with ground truth)")
    return records.select(_own_cluster(baseline_key(method)).alias("predicted_id"), TRUTH)


def baseline_partitions(records: DataFrame, methods: tuple[str, ...] = BASELINES) -> DataFrame:
    """Every rule's partition in one pass over the records."""
    require(records, (TRUTH,), "generation (with ground truth)")
    labelled = [
        F.struct(F.lit(m).alias("method"), _own_cluster(baseline_key(m)).alias("predicted_id")) for m in methods
    ]
    return records.select(F.inline(F.array(*labelled)), TRUTH)


def linkage_partition(clusters: DataFrame, records: DataFrame) -> DataFrame:
    return clusters.join(records.select(RECORD_ID, TRUTH), RECORD_ID).select(
        F.col("master_citizen_id").alias("predicted_id"), TRUTH
    )


def contingency(labelled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pair sums and cluster shapes per group, never the pairs themselves.

    Rows count once, or `n` times if there is such a column. Counts collapse to (cluster,
    person) cells first, map-side, so one cluster holding most records is just one row per
    mapper; the cells are written once and all sums read them.
    """
    n = F.sum("n") if "n" in labelled.columns else F.count(F.lit(1))
    cells = materialize(labelled.groupBy(*by, "predicted_id", TRUTH).agg(n.alias("n")), "cells")
    clusters = cells.groupBy(*by, "predicted_id").agg(
        F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts"), F.min(TRUTH).alias(TRUTH)
    )
    people = cells.groupBy(*by, TRUTH).agg(
        F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts"), F.min("predicted_id").alias("predicted_id")
    )
    # A person is resolved exactly when the single part on either side is the other.
    exact = (
        clusters.filter("parts = 1")
        .join(people.filter("parts = 1"), [*by, "predicted_id", TRUTH])
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("exactly_resolved"))
    )
    summed = lambda c: F.coalesce(F.sum(pair_count(F.col(c))).cast("double"), F.lit(0.0))
    parts = [
        cells.groupBy(*by).agg(summed("n").alias("agreeing_pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("records")),
        clusters.groupBy(*by).agg(
            summed("size").alias("predicted_pairs"),
            F.count(F.lit(1)).alias("predicted_clusters"),
            F.count_if(F.col("parts") > 1).alias("over_merged_clusters"),
        ),
        people.groupBy(*by).agg(
            summed("size").alias("true_pairs"),
            F.count(F.lit(1)).alias("true_citizens"),
            F.count_if(F.col("parts") > 1).alias("over_split_citizens"),
        ),
        exact,
    ]
    if by:
        out = parts[0]
        for other in parts[1:]:
            out = out.join(other, list(by), "left")
        return out.withColumn("exactly_resolved", F.coalesce("exactly_resolved", F.lit(0)))
    # Without groups each part is a single row: side by side.
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    out = keyed[0]
    for other in keyed[1:]:
        out = out.join(other, "_one")
    return out.drop("_one")


def partition_metrics(labelled: DataFrame, by: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """Pairwise precision, recall and F1, cluster shapes, adjusted Rand index."""
    agree, pred, true, n = (F.col(c) for c in ("agreeing_pairs", "predicted_pairs", "true_pairs", "records"))
    precision = F.when(pred > 0, agree / F.nullif(pred, F.lit(0.0))).otherwise(1.0)
    recall = F.when(true > 0, agree / F.nullif(true, F.lit(0.0))).otherwise(1.0)
    p, r = F.col("_p"), F.col("_r")
    total = n.cast("double") * (n - 1) / 2.0
    expected = pred * true / F.nullif(total, F.lit(0.0))
    best = (pred + true) / 2.0
    rand = F.when((n < 2) | (best == expected), 0.0).otherwise(
        (agree - expected) / F.nullif(best - expected, F.lit(0.0))
    )
    return (
        contingency(labelled, by)
        .withColumn("_p", precision)
        .withColumn("_r", recall)
        .select(
            *by,
            F.round(p, digits).alias("pairwise_precision"),
            F.round(r, digits).alias("pairwise_recall"),
            F.round(F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0), digits).alias("pairwise_f1"),
            "predicted_clusters",
            "true_citizens",
            "exactly_resolved",
            "over_split_citizens",
            "over_merged_clusters",
            F.round(rand, digits).alias("adjusted_rand_index"),
        )
    )


def evaluate_linkage(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """The linkage next to every rule baseline, with the gain over the best rule."""
    labelled = linkage_partition(clusters, records).withColumn("method", F.lit("linkage"))
    scored = partition_metrics(labelled.unionByName(baseline_partitions(records)), by=("method",))
    order = {m: i for i, m in enumerate(BASELINES)}
    rank = F.coalesce(*[F.when(F.col("method") == m, i) for m, i in order.items()])
    rule = scored.filter("method <> 'linkage'").agg(
        F.max_by(F.struct("method", "pairwise_f1"), F.struct("pairwise_f1", -rank)).alias("best")
    )
    return (
        scored.withColumn("_one", F.lit(1))
        .join(rule.withColumn("_one", F.lit(1)), "_one")
        .drop("_one")
        .withColumn("linkage_errors", F.col("over_split_citizens") + F.col("over_merged_clusters"))
        .withColumn("is_best_baseline", F.col("method") == F.col("best.method"))
        .withColumn("f1_gain_over_best_baseline", F.round(F.col("pairwise_f1") - F.col("best.pairwise_f1"), 6))
        .drop("best")
    )


def sweep_readings(points: DataFrame) -> DataFrame:
    """What the sweep says: the best threshold and whether recall moves at all."""
    best = F.max_by("threshold", F.struct("pairwise_f1", -F.col("threshold")))
    return points.agg(
        F.max(F.when(F.col("is_current"), F.col("threshold"))).alias("current_threshold"),
        best.alias("best_threshold"),
        F.max("pairwise_f1").alias("best_f1"),
        F.max(F.when(F.col("is_current"), F.col("pairwise_f1"))).alias("current_f1"),
        (F.max("pairwise_recall") - F.min("pairwise_recall") < 1e-6).alias("recall_is_flat"),
        F.max("edge_count").alias("edge_count"),
    ).withColumn("better_threshold_exists", F.col("best_threshold") != F.col("current_threshold"))
