import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.functions import expr
from kinloom.operators import anomaly, forest, lof
from kinloom.operators.ids import global_position
from kinloom.operators.ranking import ranking_metrics


def rank(spark, scores, labels, share):
    rows = [("d", f"{i:03d}", s, bool(label)) for i, (s, label) in enumerate(zip(scores, labels))]
    return ranking_metrics(spark.createDataFrame(rows, "detector string, id string, score double, label boolean"), share).first()


def test_average_precision(spark):
    s = [0.9, 0.8, 0.2, 0.1]
    assert rank(spark, s, [1, 1, 0, 0], 0.5)["average_precision"] == 1.0
    assert rank(spark, s, [0, 0, 1, 1], 0.5)["average_precision"] == pytest.approx((1 / 3 + 1 / 2) / 2, abs=1e-6)
    assert rank(spark, s, [0, 0, 0, 0], 0.5)["average_precision"] == 0.0


def test_precision_at_k(spark):
    s, labels = [0.9, 0.8, 0.7, 0.1], [1, 0, 1, 1]
    assert rank(spark, s, labels, 0.5)["precision_at_k"] == 0.5
    assert rank(spark, s, labels, 1.0)["precision_at_k"] == 0.75


def test_global_position_is_a_total_order(spark):
    values = [random.Random(1).randrange(50) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v int")
    got = {r["id"]: r["position"] for r in global_position(df, "v", "id").collect()}
    want = {i: n + 1 for n, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    assert got == want


def feature_frame(spark, rows):
    schema = "master_citizen_id string, " + ", ".join(f"{f} double" for f in anomaly.FEATURES)
    return spark.createDataFrame([(f"MC{i:05d}", *map(float, r)) for i, r in enumerate(rows)], schema)


def test_attribution_finds_the_extreme_feature(spark):
    rng = np.random.default_rng(0)
    rows = rng.integers(1, 4, size=(400, 10)).astype(float)
    rows[-1] = 2
    rows[-1, 0] = 200
    got = anomaly.forest_scores(feature_frame(spark, rows)).filter("master_citizen_id = 'MC00399'").first()
    assert got["top_factors"][0]["feature"] == "record_count"
    assert got["top_factors"][0]["direction"] == "above"


def test_constant_features_score_zero(spark):
    got = anomaly.forest_scores(feature_frame(spark, [[2] * 10] * 50)).agg(F.max("anomaly_score"), F.count_if("is_anomaly")).first()
    assert tuple(got) == (0.0, 0)


def test_scores_span_the_scale_and_flag_a_share(spark):
    rng = np.random.default_rng(1)
    got = anomaly.forest_scores(feature_frame(spark, rng.integers(0, 30, size=(600, 10))))
    low, high, flagged = got.agg(F.min("anomaly_score"), F.max("anomaly_score"), F.count_if("is_anomaly")).first()
    assert low == 0.0 and high == pytest.approx(100.0) and 15 <= flagged <= 30


def test_no_demographic_features():
    assert not set(anomaly.FEATURES) & set(anomaly.FORBIDDEN)
    with pytest.raises(ValueError):
        anomaly.check_contamination(0.6)


def test_average_path_length():
    assert forest.average_path(1) == 0 and forest.average_path(2) == 1
    assert float(forest.average_path(256)) == pytest.approx(10.2448, abs=1e-3)


def brute_lof(points, weights, k):
    x = np.repeat(points, weights, axis=0)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    kdist = np.take_along_axis(d, near, axis=1)[:, -1]
    reach = np.maximum(kdist[near], np.take_along_axis(d, near, axis=1))
    lrd = 1.0 / (reach.mean(axis=1) + 1e-10)
    out = lrd[near].mean(axis=1) / lrd
    return out[np.concatenate([[0], np.cumsum(weights)[:-1]])]


@pytest.mark.parametrize("cell_points", [4000, 30])
def test_lof_matches_brute_force(spark, monkeypatch, cell_points):
    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(size=(150, 3)), rng.normal(5, 0.3, size=(60, 3)), [[20, 20, 20]]])
    weights = rng.integers(1, 4, size=len(points))
    frame = spark.createDataFrame(
        [(f"p{i:04d}", [float(v) for v in p], int(w)) for i, (p, w) in enumerate(zip(points, weights))],
        "id string, vector array<double>, weight long",
    )
    original = lof.neighbours
    monkeypatch.setattr(lof, "neighbours", lambda p, k: original(p, k, cell_points))
    got = {r["id"]: r["lof"] for r in lof.local_outlier_factors(frame, 10).collect()}
    want = brute_lof(points, weights, 10)
    assert len(got) == len(points)
    assert max(abs(got[f"p{i:04d}"] - w) for i, w in enumerate(want)) < 1e-6


def test_buckets(spark):
    row = spark.range(1).select(expr.score_bucket(F.lit(100.0)), expr.score_bucket(F.lit(19.9)), expr.probability_bucket(F.lit(0.95))).first()
    assert tuple(row) == ("80-100", "0-20", "0.95 - 0.99")


def test_whole_years_is_birthday_aware(spark):
    pairs = [("2000-02-29", "2001-02-28", 0), ("2000-02-29", "2001-03-01", 1), ("1990-06-02", "2025-06-01", 34), ("1990-06-01", "2025-06-01", 35)]
    df = spark.createDataFrame(pairs, "a string, b string, n int")
    rows = df.select(expr.whole_years(F.to_date("a"), F.to_date("b")).alias("y"), "n").collect()
    assert all(r["y"] == r["n"] for r in rows)
