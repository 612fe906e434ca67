"""Profiles whose structure looks unusual, with reasons and a check against truth.

Only linkage structure goes in: counts of records, agencies, spellings and services.
Nothing about who a person is may become a feature.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions import expr
from kinloom.operators.forest import grow_forest, score_and_attribute, tree_samples
from kinloom.operators.lof import local_outlier_factors
from kinloom.operators.quantiles import quantiles
from kinloom.operators.ranking import ranking_metrics
from kinloom.schemas import MASTER_ID, TRUTH, require
from kinloom.session import materialize

# Features with their plain names.
FEATURES = {
    "record_count": "linked records",
    "agency_count": "distinct agencies",
    "records_per_agency": "records per agency",
    "distinct_first_names": "different first-name spellings",
    "distinct_dobs": "different dates of birth",
    "distinct_postcodes": "different postcodes",
    "hospital_visits": "hospital visits",
    "benefits_count": "benefit types",
    "prescriptions_count": "prescriptions",
    "education_count": "qualifications",
}
# What the features must not contain.
FORBIDDEN = ("age", "marital_status", "date_of_birth", "postcode", "city", "current_city", "current_postcode", "preferred_name")
CONFLICT_FIELDS = {"date_of_birth": "date of birth", "postcode": "postcode"}
CONTAMINATION = 0.05
TOP_FACTORS = 3
LOF_NEIGHBOURS = 50
SEED = 6999
MAD_SCALE = 1.4826
SIGMA_FLOOR = 1e-9


def check_contamination(contamination: float) -> float:
    if not 0.01 <= contamination <= 0.5:
        raise ValueError(f"contamination must lie between 0.01 and 0.5, not {contamination}")
    return contamination


def features(linked: DataFrame, profiles: DataFrame) -> DataFrame:
    """The ten structural features per profile; of profiles, `cluster_aggregates` is all that they need."""
    strain = linked.groupBy(MASTER_ID).agg(
        F.count_distinct(F.lower("first_name")).alias("distinct_first_names"),
        F.count_distinct("date_of_birth").alias("distinct_dobs"),
        F.count_distinct(F.lower(expr.squeezed("postcode"))).alias("distinct_postcodes"),
    )
    counted = profiles.select(
        MASTER_ID,
        "record_count",
        "agency_count",
        (F.col("record_count") / F.nullif(F.col("agency_count"), F.lit(0))).alias("records_per_agency"),
        "hospital_visits",
        F.size("benefits_received").cast("long").alias("benefits_count"),
        F.size("current_prescriptions").cast("long").alias("prescriptions_count"),
        F.size("education_history").cast("long").alias("education_count"),
    )
    return counted.join(strain, MASTER_ID).select(MASTER_ID, *FEATURES)


def distinct_vectors(featured: DataFrame) -> DataFrame:
    """Feature vectors with the number of profiles behind each; small integers repeat."""
    return featured.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("weight"), F.min(MASTER_ID).alias("id"))


def medians(vectors: DataFrame) -> dict[str, float]:
    return quantiles(vectors, {f: F.col(f) for f in FEATURES}, 0.5, F.col("weight"))


def forest_scores(featured: DataFrame, contamination: float = CONTAMINATION, seed: int = SEED) -> DataFrame:
    """The anomaly table: score 0-100, flag, top factors with their evidence.

    Each tree is grown on its own sample of all profiles; the forest is then scored, in
    the tasks, once per distinct feature vector.
    """
    check_contamination(contamination)
    vectors = materialize(distinct_vectors(featured), "vectors")
    forest, size = grow_forest(tree_samples(featured, MASTER_ID, list(FEATURES), seed), seed)
    middle = medians(vectors)
    run = score_and_attribute(featured.sparkSession, forest, size, [middle[f] for f in FEATURES], list(FEATURES))
    scored = materialize(vectors.withColumn("s", run).withColumn("raw", F.get("s", F.lit(0))), "scored")
    limits = scored.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).first()
    lo, hi = limits["lo"], limits["hi"]
    cut = quantiles(scored, {"raw": F.col("raw")}, 1.0 - contamination, F.col("weight"))["raw"]
    raw = F.col("raw")
    score = (raw - lo) / (hi - lo) * 100 if hi > lo else F.lit(0.0)
    factors = []
    for j, (f, label) in enumerate(FEATURES.items()):
        value, mid = F.col(f).cast("double"), F.lit(middle[f])
        factors.append(
            F.struct(
                (-F.get("s", F.lit(j + 1))).alias("order"),
                F.lit(-j).alias("column"),
                F.lit(f).alias("feature"),
                F.lit(label).alias("label"),
                F.round(value, 2).alias("value"),
                F.round(mid, 2).alias("population_median"),
                F.when(value > mid, "above").when(value < mid, "below").otherwise("at").alias("direction"),
                F.round(F.get("s", F.lit(j + 1)), 6).alias("contribution"),
            )
        )
    ranked = F.slice(F.array_sort(F.array(*factors)), 1, TOP_FACTORS)
    shown = ("feature", "label", "value", "population_median", "direction", "contribution")
    top = F.transform(
        F.filter(ranked, lambda x: x["order"] < 0), lambda x: F.struct(*[x[c].alias(c) for c in shown])
    )
    per_vector = scored.select(
        *FEATURES,
        score.alias("anomaly_score"),
        (raw > F.lit(cut)).alias("is_anomaly"),
        F.lit(contamination).alias("contamination"),
        top.alias("top_factors"),
        "raw",
    )
    return featured.join(per_vector, list(FEATURES)).select(
        MASTER_ID, "anomaly_score", "is_anomaly", "contamination", "top_factors", "raw"
    )


def factor_rows(results: DataFrame) -> DataFrame:
    return results.select(MASTER_ID, F.posexplode("top_factors").alias("pos", "f")).select(
        MASTER_ID, (F.col("pos") + 1).alias("factor_rank"), "f.*"
    )


def identity_conflicts(linked: DataFrame) -> DataFrame:
    """Values a cluster's records disagree on, one row per value: nothing is cut."""
    pairs = F.array(
        F.struct(F.lit("date_of_birth").alias("field"), F.col("date_of_birth").alias("value")),
        F.struct(F.lit("postcode").alias("field"), F.upper(expr.squeezed("postcode")).alias("value")),
    )
    values = linked.select(MASTER_ID, F.inline(pairs)).filter("value <> ''").distinct()
    disputed = values.groupBy(MASTER_ID, "field").agg(F.count(F.lit(1)).alias("value_count")).filter("value_count > 1")
    label = F.coalesce(*[F.when(F.col("field") == f, text) for f, text in CONFLICT_FIELDS.items()])
    return values.join(disputed, [MASTER_ID, "field"]).withColumn("label", label)


def conflict_summaries(linked: DataFrame) -> DataFrame:
    """Per cluster: its disputed fields with all their values, sorted.

    A list holds different dates of birth or postcodes, of which there are only so many.
    """
    rows = identity_conflicts(linked)
    return rows.groupBy(MASTER_ID, "field", "label", "value_count").agg(F.sort_array(F.collect_list("value")).alias("values"))


def anomaly_totals(results: DataFrame) -> DataFrame:
    flagged = F.count_if("is_anomaly")
    return results.agg(
        F.count(F.lit(1)).alias("total_profiles_analyzed"),
        flagged.alias("anomalies_detected"),
        (F.count(F.lit(1)) - flagged).alias("normal_count"),
        F.round(F.coalesce(flagged / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100, F.lit(0.0)), 2).alias("pct_anomalous"),
        F.coalesce(F.max("contamination"), F.lit(CONTAMINATION)).alias("contamination"),
    )


def score_histogram(results: DataFrame) -> DataFrame:
    labels = [(i, label) for i, label in enumerate(expr.SCORE_BUCKETS)]
    frame = results.sparkSession.createDataFrame(labels, "label_order int, label string")
    counts = results.groupBy(expr.score_bucket(F.col("anomaly_score")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(frame).join(counts, "label", "left").select(
        "label_order", "label", F.coalesce("n", F.lit(0)).alias("n")
    )


def anomaly_queue(results: DataFrame, profiles: DataFrame, linked: DataFrame, limit: int = 50) -> DataFrame:
    """The most anomalous profiles with factors and conflicts, worst first."""
    worst = results.orderBy(F.desc("anomaly_score"), MASTER_ID).limit(limit)
    conflicts = (
        conflict_summaries(linked.join(worst.select(MASTER_ID), MASTER_ID, "left_semi"))
        .groupBy(MASTER_ID)
        .agg(F.array_sort(F.collect_list(F.struct("field", "label", "value_count", "values"))).alias("conflicts"))
    )
    return (
        worst.join(profiles, MASTER_ID)
        .join(conflicts, MASTER_ID, "left")
        .select(
            MASTER_ID,
            "preferred_name",
            "agency_count",
            "record_count",
            F.round("confidence_score", 6).alias("confidence_score"),
            F.round("anomaly_score", 2).alias("anomaly_score"),
            F.when(F.col("is_anomaly"), "Anomalous").otherwise("Normal").alias("status"),
            "top_factors",
            "conflicts",
        )
    )


def error_labels(linked: DataFrame) -> DataFrame:
    """Clusters that merge several people or hold only a part of one."""
    require(linked, (TRUTH,), "generation (with ground truth)")
    cells = linked.select(MASTER_ID, TRUTH).distinct()
    split = cells.groupBy(TRUTH).agg((F.count(F.lit(1)) > 1).alias("is_split"))
    return cells.join(split, TRUTH).groupBy(MASTER_ID).agg(
        ((F.count(F.lit(1)) > 1) | F.bool_or("is_split")).alias("is_error")
    )


def robust_z(featured: DataFrame) -> DataFrame:
    """Largest distance from the median over all features, in robust deviations."""
    vectors = materialize(distinct_vectors(featured), "vectors")
    middle = medians(vectors)
    apart = {f: F.abs(F.col(f) - F.lit(middle[f])) for f in FEATURES}
    mad = quantiles(vectors, apart, 0.5, F.col("weight"))
    z = [apart[f] / F.lit(max(float(mad[f]) * MAD_SCALE, SIGMA_FLOOR)) for f in FEATURES]
    return featured.select(MASTER_ID, F.greatest(*z).alias("score"))


def lof_scores(featured: DataFrame, k: int = LOF_NEIGHBOURS) -> DataFrame:
    """Local outlier factor on standardised features, per profile."""
    vectors = materialize(distinct_vectors(featured), "vectors")
    w = F.col("weight").cast("double")
    moments = vectors.agg(
        F.sum(w).alias("n"),
        *[F.sum(F.col(f) * w).alias(f"s_{f}") for f in FEATURES],
    ).first()
    mean = {f: moments[f"s_{f}"] / moments["n"] for f in FEATURES}
    spread = vectors.agg(*[(F.sum(F.pow(F.col(f) - F.lit(mean[f]), F.lit(2)) * w) / moments["n"]).alias(f) for f in FEATURES]).first()
    scaled = [(F.col(f) - F.lit(mean[f])) / F.lit(float(np.sqrt(spread[f])) or 1.0) for f in FEATURES]
    factors = local_outlier_factors(vectors.select("id", F.array(*scaled).alias("vector"), "weight"), k)
    per_vector = vectors.join(factors, "id").select(*FEATURES, F.col("lof").alias("score"))
    return featured.join(per_vector, list(FEATURES)).select(MASTER_ID, "score")


def compare_detectors(linked: DataFrame, profiles: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """How well each detector's ranking surfaces real linkage errors, best first by rank."""
    check_contamination(contamination)
    featured = materialize(features(linked, profiles), "features")
    scores = {
        "isolation_forest": forest_scores(featured, contamination).select(MASTER_ID, F.col("raw").alias("score")),
        "local_outlier_factor": lof_scores(featured),
        "max_robust_zscore": robust_z(featured),
    }
    labels = error_labels(linked)
    every = None
    for name, frame in scores.items():
        tagged = frame.withColumn("detector", F.lit(name))
        every = tagged if every is None else every.unionByName(tagged)
    return detector_metrics(every, labels, contamination)


def detector_metrics(scores: DataFrame, labels: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    labelled = scores.join(labels, MASTER_ID, "left").select(
        "detector", F.col(MASTER_ID).alias("id"), "score", F.coalesce("is_error", F.lit(False)).alias("label")
    )
    measured = ranking_metrics(labelled, contamination)
    best = measured.agg(F.max_by("detector", F.struct("average_precision", "detector")).alias("best"))
    return (
        measured.withColumn("_one", F.lit(1))
        .join(F.broadcast(best.withColumn("_one", F.lit(1))), "_one")
        .withColumn("is_best", F.col("detector") == F.col("best"))
        .drop("_one", "best")
        .orderBy(F.desc("average_precision"), "detector")
    )
