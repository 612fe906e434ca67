"""Match model: prior, u from random pairs, m by expectation-maximisation."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.blocking import (
    BLOCKING_RULES,
    DETERMINISTIC_RULES,
    Rule,
    captures,
    collapse,
    union_pair_counts,
)
from kinloom.operators.compare import TOP_LEVEL, own_gammas, with_parts
from kinloom.operators.ids import global_position
from kinloom.operators.patterns import pair_patterns, ring_levels
from kinloom.schemas import COMPARED
from kinloom.session import materialize

# Training settings.
RECALL = 0.6
MAX_RANDOM_PAIRS = 2_000_000
SEED = 42
TRAINING_RULES: tuple[Rule, ...] = (("first_name", "last_name"), ("date_of_birth",), ("postcode",))

FLOOR = 1e-6
MAX_ITERATIONS = 25
TOLERANCE = 1e-4

Levels = dict[str, list[float]]  # probability per level 0..top


@dataclass(frozen=True)
class MatchModel:
    """Everything scoring needs; small, serialisable, independent of the data size."""

    prior: float
    m: Levels
    u: Levels

    def as_dict(self) -> dict:
        return asdict(self)


def prior_estimate(records: DataFrame, recall: float = RECALL) -> DataFrame:
    """Chance that two random records match: sure pairs / recall / all pairs."""
    n = records.agg(F.count(F.lit(1)).alias("records")).withColumn("_one", F.lit(1))
    sure = union_pair_counts(records, DETERMINISTIC_RULES).agg(F.max("pairs_so_far").alias("deterministic_pairs"))
    total = F.col("records").cast("double") * (F.col("records") - 1) / 2
    return (
        sure.withColumn("_one", F.lit(1))
        .join(n, "_one")
        .select(
            "records",
            "deterministic_pairs",
            (F.col("deterministic_pairs") / recall / F.nullif(total, F.lit(0.0))).alias("prior"),
        )
    )


def ring_of(captured: DataFrame, max_pairs: int = MAX_RANDOM_PAIRS, seed: int = SEED) -> tuple[DataFrame, int, int]:
    """(captures with their place `pos` in a ring in hash order, their number, how many next ones each meets).

    That makes about `max_pairs` different random pairs of captures from the whole pool. A pool
    larger than `max_pairs` is thinned by the hash to about that many captures, each with one partner.
    """
    order = F.xxhash64(F.lit(seed), F.col("source_record_id"))
    share = min(1.0, max_pairs / max(captured.count(), 1))
    drawn = with_parts(captured).withColumn("_h", order).filter(F.pmod("_h", F.lit(1 << 40)) < int(share * (1 << 40)))
    ring = materialize(global_position(drawn, "_h", "source_record_id", name="pos").drop("_h"), "ring")
    n = ring.count()
    return ring, n, max(min((n - 1) // 2, -(-max_pairs // max(n, 1))), 1)


def random_pairs(captured: DataFrame, max_pairs: int = MAX_RANDOM_PAIRS, seed: int = SEED) -> DataFrame:
    """The random pairs of the ring, listed: an equi-join on places."""
    ring, n, steps = ring_of(captured, max_pairs, seed)
    side = F.struct(*[c for c in ring.columns if c != "pos"])
    offsets = F.sequence(F.lit(1), F.lit(steps)) if n > 1 else F.array().cast("array<int>")
    left = ring.select(side.alias("l"), "pos", F.explode(offsets).alias("step"))
    meets = (F.col("pos") + F.col("step") - 1) % F.lit(max(n, 1)) + 1
    right = ring.select(side.alias("r"), F.col("pos").alias("meets"))
    return left.withColumn("meets", meets).join(right, "meets").select("l", "r")


def level_counts(pairs_with_gammas: DataFrame, fields: tuple[str, ...] = COMPARED) -> DataFrame:
    """Histogram of levels per field in one pass."""
    long = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"gamma_{f}").alias("level")) for f in fields])
    return pairs_with_gammas.select(F.inline(long)).groupBy("field", "level").agg(F.count(F.lit(1)).alias("n"))


def _normalise(counts: list[float]) -> list[float]:
    total = sum(counts)
    shares = [max(c / total, FLOOR) if total else 1.0 / len(counts) for c in counts]
    return [s / sum(shares) for s in shares]


def u_probabilities(captured: DataFrame, max_pairs: int = MAX_RANDOM_PAIRS, seed: int = SEED) -> Levels:
    """Shares of the levels among the random pairs, which are counted where the ring is and not listed."""
    ring, n, steps = ring_of(captured, max_pairs, seed)
    counted = ring_levels(ring, n, steps, COMPARED).groupBy("field", "level").agg(F.sum("n").alias("n"))
    seen = {(r["field"], r["level"]): r["n"] for r in counted.collect()}  # at most 7 x 6 rows
    return {f: _normalise([seen.get((f, i), 0) for i in range(top + 1)]) for f, top in TOP_LEVEL.items()}


def gamma_patterns(vectors: DataFrame, rule: Rule, fields: tuple[str, ...]) -> DataFrame:
    """Pair counts per combination of levels among the pairs of one rule.

    Copies count by weight: l.copies x r.copies pairs between two captures, and
    n over 2 pairs inside one. Pairs are counted in bounded groups of captures and
    never listed. At most 6^k patterns exist, whatever the data size.
    """
    names = [f"gamma_{f}" for f in fields]
    between = pair_patterns(vectors, rule, fields)
    keyed = F.lit(True)
    for c in rule:
        keyed = keyed & F.col(c).isNotNull()
    inside = own_gammas(vectors.filter(keyed & (F.col("copies") > 1))).select(
        *names, (F.col("copies").cast("double") * (F.col("copies") - 1) / 2).alias("w")
    )
    return between.unionByName(inside).groupBy(*names).agg(F.sum("w").alias("pairs"))


def fit_m(
    patterns: np.ndarray,
    counts: np.ndarray,
    fields: tuple[str, ...],
    u: Levels,
    start: float,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
) -> tuple[Levels, float]:
    """EM over pattern counts with u held fixed; returns m and the match share."""
    m = {}
    for f in fields:
        top = TOP_LEVEL[f]
        m[f] = np.array([0.05 / top] * top + [0.95])
    share = start
    for _ in range(max_iterations):
        like_m = np.full(len(counts), share)
        like_u = np.full(len(counts), 1.0 - share)
        for j, f in enumerate(fields):
            level = patterns[:, j]
            known = level >= 0
            like_m[known] *= m[f][level[known]]
            like_u[known] *= np.asarray(u[f])[level[known]]
        match = counts * like_m / np.maximum(like_m + like_u, 1e-300)
        moved = 0.0
        for j, f in enumerate(fields):
            level = patterns[:, j]
            known = level >= 0
            weight = np.bincount(level[known], weights=match[known], minlength=TOP_LEVEL[f] + 1)
            fresh = np.array(_normalise(list(weight)))
            moved = max(moved, float(np.abs(fresh - m[f]).max()))
            m[f] = fresh
        fresh_share = float(np.clip(match.sum() / counts.sum(), FLOOR, 1 - FLOOR))
        moved = max(moved, abs(fresh_share - share))
        share = fresh_share
        if moved < tolerance:
            break
    return {f: list(map(float, v)) for f, v in m.items()}, share


def start_share(prior: float, rule: Rule, u: Levels) -> float:
    """The prior, raised by what agreeing on the blocked fields already says."""
    odds = prior / (1 - prior)
    for f in rule:
        odds *= 0.95 / u[f][-1]
    return float(np.clip(odds / (1 + odds), FLOOR, 1 - FLOOR))


def train(pool: DataFrame, vectors: DataFrame | None = None, max_random_pairs: int = MAX_RANDOM_PAIRS) -> MatchModel:
    """Prior, then u, then one EM pass per training rule; m averages the passes."""
    captured = captures(pool)
    if vectors is None:
        vectors = materialize(collapse(captured), "captures")
    prior = float(np.clip(prior_estimate(captured).first()["prior"] or FLOOR, 1e-12, 1 - FLOOR))
    u = u_probabilities(captured, max_random_pairs)
    passes: dict[str, list[list[float]]] = {f: [] for f in COMPARED}
    for rule in TRAINING_RULES:
        fields = tuple(f for f in COMPARED if f not in rule)
        rows = gamma_patterns(vectors, rule, fields).collect()  # bounded by the number of patterns
        if not rows:
            continue
        table = np.array([[r[f"gamma_{f}"] for f in fields] for r in rows], dtype=np.int64)
        counts = np.array([r["pairs"] for r in rows], dtype=float)
        order = np.lexsort(table.T[::-1])
        m, _ = fit_m(table[order], counts[order], fields, u, start_share(prior, rule, u))
        for f in fields:
            passes[f].append(m[f])
    fallback = {f: [0.05 / top] * top + [0.95] for f, top in TOP_LEVEL.items()}
    m = {f: _normalise(list(np.mean(passes[f], axis=0))) if passes[f] else fallback[f] for f in COMPARED}
    return MatchModel(prior=prior, m=m, u=u)


__all__ = ["BLOCKING_RULES", "MatchModel", "fit_m", "prior_estimate", "train", "u_probabilities"]
