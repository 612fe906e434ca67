"""Isolation forest (Liu et al. 2008): each tree grown on a sample of all rows, scored everywhere."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TREES = 100
SAMPLE = 256
EULER = 0.5772156649015329


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Expected depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n > 1, 1.0, 0.0)
    large = n > 2
    safe = np.where(large, n, 3.0)
    return np.where(large, 2.0 * (np.log(safe - 1) + EULER) - 2.0 * (safe - 1) / safe, out)


def grow_tree(rows: np.ndarray, rng: np.random.Generator, limit: int) -> np.ndarray:
    """Nodes as (feature or -1, cut, left, right, path length at a leaf)."""
    nodes: list[list[float]] = []
    todo = [(rows, 0, -1, 2)]
    while todo:
        part, depth, parent, slot = todo.pop()
        if parent >= 0:
            nodes[parent][slot] = len(nodes)
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or not len(open_features):
            nodes.append([-1, 0.0, -1, -1, depth + float(average_path(len(part)))])
            continue
        f = int(rng.choice(open_features))
        cut = rng.uniform(low[f], high[f])
        here = len(nodes)
        nodes.append([f, cut, -1, -1, 0.0])
        goes_left = part[:, f] <= cut
        todo += [(part[~goes_left], depth + 1, here, 3), (part[goes_left], depth + 1, here, 2)]
    return np.array(nodes, dtype=float)


def tree_samples(rows: DataFrame, row_id: str, features: list[str], seed: int, trees: int = TREES, sample: int = SAMPLE) -> list[np.ndarray]:
    """`sample` rows for each tree, drawn without replacement from all of `rows` by a hash of tree and row.

    Every row is a candidate of a tree with twice the chance it needs; of its candidates a
    tree takes the first by hash. What reaches the driver is trees x sample rows, the
    algorithm's own parameters.
    """
    share = min(1.0, 2 * sample / max(rows.count(), 1))
    draw = lambda t: F.xxhash64(F.lit(seed), F.col(row_id), t)
    picked = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(draw(t), F.lit(1 << 40)) < int(share * (1 << 40)))
    chosen = rows.select(row_id, *features, F.explode(picked).alias("tree"))
    first = F.row_number().over(Window.partitionBy("tree").orderBy(draw(F.col("tree")), row_id))
    taken = chosen.withColumn("_n", first).filter(F.col("_n") <= sample).orderBy("tree", "_n").collect()
    drawn: dict[int, list] = {}
    for r in taken:
        drawn.setdefault(r["tree"], []).append([float(r[f]) for f in features])
    return [np.array(drawn[t]) for t in sorted(drawn)]


def grow_forest(samples: list[np.ndarray], seed: int, sample: int = SAMPLE) -> tuple[list[np.ndarray], int]:
    """A tree on each sample."""
    rng = np.random.default_rng(seed)
    size = min(sample, max(map(len, samples), default=0))
    limit = math.ceil(math.log2(max(size, 2)))
    return [grow_tree(rows, rng, limit) for rows in samples], size


def anomaly_scores(forest: list[np.ndarray], size: int, x: np.ndarray) -> np.ndarray:
    """Higher is more anomalous, between 0 and 1."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for nodes in forest:
        feature, cut = nodes[:, 0].astype(np.int64), nodes[:, 1]
        left, right = nodes[:, 2].astype(np.int64), nodes[:, 3].astype(np.int64)
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                break
            r, a = rows[inner], at[inner]
            at[inner] = np.where(x[r, feature[a]] <= cut[a], left[a], right[a])
        total += nodes[at, 4]
    return np.power(2.0, -total / len(forest) / max(float(average_path(size)), 1e-12))


def score_and_attribute(
    spark: SparkSession, forest: list[np.ndarray], size: int, medians: list[float], features: list[str]
) -> Column:
    """array<double>: the score, then how far it falls with each feature at its median."""
    shared = spark.sparkContext.broadcast((forest, size, np.array(medians)))  # trees x 511 nodes at most

    @F.arrow_udf("array<double>")
    def run(*columns: pa.Array) -> pa.Array:
        trees, n, middle = shared.value
        x = np.column_stack([np.asarray(c.cast(pa.float64())) for c in columns])
        base = anomaly_scores(trees, n, x)
        out = [base]
        for j in range(x.shape[1]):
            y = x.copy()
            y[:, j] = middle[j]
            out.append(base - anomaly_scores(trees, n, y))
        flat = np.column_stack(out).ravel()
        offsets = np.arange(0, len(flat) + 1, len(out), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return run(*[F.col(f) for f in features])
