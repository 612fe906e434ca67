"""Ranking quality: average precision, precision and recall at k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.ids import global_position


def _ranked(scored: DataFrame, by: str, name: str) -> DataFrame:
    """1-based rank within `by`: best score first, ties by id as a stable sort of ids."""
    placed = global_position(scored, by, -F.col("score"), "id", name="_place")
    starts = placed.groupBy(by).agg((F.min("_place") - 1).alias("_start"))
    return placed.join(F.broadcast(starts), by).withColumn(name, F.col("_place") - F.col("_start")).drop("_place", "_start")


def ranking_metrics(scored: DataFrame, share: float, by: str = "detector") -> DataFrame:
    """Metrics per `by` of (id, score, label boolean); k is a share of the rows.

    Ranks come from range partitions plus offsets, so no task ever holds a ranking.
    """
    ranked = _ranked(scored.select(by, "id", "score", "label"), by, "rank")
    hits = _ranked(ranked.filter("label").select(by, "id", "score", "rank"), by, "hit")
    precision = hits.groupBy(by).agg(F.avg(F.col("hit") / F.col("rank")).alias("ap"))
    totals = ranked.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("label").alias("positives")
    ).withColumn("k", F.greatest(F.bround(F.col("rows") * F.lit(share)).cast("long"), F.lit(1).cast("long")))
    # Only the ranks up to k of few rankings: totals has one row per ranking.
    top = ranked.join(F.broadcast(totals.select(by, "k")), by).filter("rank <= k").groupBy(by).agg(
        F.count_if("label").alias("found"), F.count(F.lit(1)).alias("taken")
    )
    base = F.col("positives") / F.col("rows")
    return (
        totals.join(precision, by, "left")
        .join(top, by)
        .select(
            by,
            "rows",
            "positives",
            "k",
            F.round(base, 6).alias("base_rate"),
            F.round(F.coalesce("ap", F.lit(0.0)), 6).alias("average_precision"),
            F.round(F.col("found") / F.col("taken"), 6).alias("precision_at_k"),
            F.round(F.coalesce(F.col("found") / F.nullif(F.col("positives"), F.lit(0)), F.lit(0.0)), 6).alias("recall_at_k"),
            F.round(F.coalesce(F.coalesce("ap", F.lit(0.0)) / F.nullif(base, F.lit(0.0)), F.lit(0.0)), 2).alias("lift_over_random"),
        )
    )
