"""Match probability of candidate pairs."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.blocking import BLOCKING_RULES, Rule
from kinloom.operators.compare import TOP_LEVEL, own_gammas
from kinloom.operators.patterns import wanted_pairs
from kinloom.operators.train import MatchModel
from kinloom.schemas import COMPARED
from kinloom.session import materialize

# Score below which a pair is dropped; fields weighted by frequency.
KEEP_THRESHOLD = 0.05
FREQUENCY_FIELDS = ("last_name", "postcode")


def frequency_value(field: str) -> Column:
    """The value whose frequency counts: what the exact level compares."""
    value = F.col(field)
    return F.replace(value, F.lit(" "), F.lit("")) if field == "postcode" else value


def term_frequencies(vectors: DataFrame, field: str) -> DataFrame:
    """Share of the records (copies included) that carry each value."""
    counted = (
        vectors.filter(F.col(field).isNotNull())
        .groupBy(frequency_value(field).alias("value"))
        .agg(F.sum("copies").alias("n"))
    )
    total = counted.agg(F.sum("n").alias("total")).withColumn("_one", F.lit(1))
    return (
        counted.withColumn("_one", F.lit(1))
        .join(total, "_one")
        .select("value", "n", (F.col("n") / F.col("total")).alias("tf"))
    )


def with_frequencies(vectors: DataFrame) -> DataFrame:
    """Attach `tf_<field>` to the captures, once, so that pairs carry it already."""
    if f"tf_{FREQUENCY_FIELDS[0]}" in vectors.columns:
        return vectors
    out = vectors
    for field in FREQUENCY_FIELDS:
        table = term_frequencies(vectors, field).select(
            F.col("value").alias(f"_v_{field}"), F.col("tf").alias(f"tf_{field}")
        )
        out = (
            out.withColumn("_v", frequency_value(field))
            .join(table, F.col("_v") == F.col(f"_v_{field}"), "left")
            .drop("_v", f"_v_{field}")
        )
    return materialize(out, "weighted")


def match_weight(model: MatchModel, frequency: dict[str, Column]) -> Column:
    """log2 of the match odds: the prior plus one term per comparable field."""
    weight = F.lit(math.log2(model.prior / (1 - model.prior)))
    for f in COMPARED:
        level = F.col(f"gamma_{f}")
        terms = [0.0] + [math.log2(m / u) for m, u in zip(model.m[f], model.u[f])]
        weight = weight + F.get(F.array(*[F.lit(t) for t in terms]), level + 1)
        if f in frequency:
            adjust = F.log2(F.lit(model.u[f][-1]) / frequency[f])
            weight = weight + F.when((level == TOP_LEVEL[f]) & frequency[f].isNotNull(), adjust).otherwise(0.0)
    return weight


def probability(weight: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(2.0), -weight))


GAMMA_COLUMNS = tuple(f"gamma_{f}" for f in COMPARED)


def score_pairs(
    vectors: DataFrame,
    model: MatchModel,
    rules: tuple[Rule, ...] = BLOCKING_RULES,
    keep: float = KEEP_THRESHOLD,
) -> DataFrame:
    """Scored pairs of distinct captures: ids, copies, probability, levels.

    Pairs are looked at where their captures are; only those that may reach `keep` become rows.
    """
    weighted = with_frequencies(vectors)
    tf = {f: f"tf_{f}" for f in FREQUENCY_FIELDS}
    found = wanted_pairs(weighted, rules, COMPARED, _may_reach(model, keep), tuple(tf.values()))
    return (
        found.withColumn("match_probability", probability(match_weight(model, {f: F.col(c) for f, c in tf.items()})))
        .filter(F.col("match_probability") >= keep)
        .select(
            F.col("rep_l").alias("source_record_id_l"),
            F.col("rep_r").alias("source_record_id_r"),
            "copies_l",
            "copies_r",
            "match_probability",
            *GAMMA_COLUMNS,
        )
    )


def _may_reach(model: MatchModel, keep: float) -> Callable[[pa.Table], np.ndarray]:
    """For a group of captures: the patterns that may score `keep` with the rarest values of the group."""
    least = math.log2(keep / (1 - keep)) if 0 < keep < 1 else -math.inf if keep <= 0 else math.inf
    weight, exact = np.array([math.log2(model.prior / (1 - model.prior))]), {}
    for f in COMPARED:
        terms = np.array([0.0] + [math.log2(m / u) for m, u in zip(model.m[f], model.u[f])])
        weight = (weight[:, None] + terms).ravel()
        exact = {g: np.repeat(at, len(terms)) for g, at in exact.items()}
        if f in FREQUENCY_FIELDS:
            exact[f] = np.tile(np.arange(len(terms)) == len(terms) - 1, len(weight) // len(terms))
    top = {f: model.u[f][-1] for f in FREQUENCY_FIELDS}

    def wanted(table: pa.Table) -> np.ndarray:
        most = weight.copy()
        for f, at in exact.items():
            rarest = pc.min(table.column(f"tf_{f}")).as_py()
            if rarest:
                most[at] += math.log2(top[f] / rarest)
        return most >= least - 1e-6

    return wanted


def score_copies(
    vectors: DataFrame,
    model: MatchModel,
    rules: tuple[Rule, ...] = BLOCKING_RULES,
    keep: float = KEEP_THRESHOLD,
) -> DataFrame:
    """Score of a capture's copies among themselves: one row for all their pairs."""
    blocked = F.lit(False)
    for rule in rules:
        present = F.lit(True)
        for c in rule:
            present = present & F.col(c).isNotNull()
        blocked = blocked | present
    copied = with_frequencies(vectors).filter((F.col("copies") > 1) & blocked)
    weight = match_weight(model, {f: F.col(f"tf_{f}") for f in FREQUENCY_FIELDS})
    return (
        own_gammas(copied)
        .withColumn("match_probability", probability(weight))
        .filter(F.col("match_probability") >= keep)
        .select("rep", "copies", "match_probability", *GAMMA_COLUMNS)
    )
