"""Connected components by alternating large-star and small-star (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.session import Scratch

MAX_ROUNDS = 100
SPANNED = 1 << 18  # edges a task holds while it looks for what they connect, twice that at most


def _least_neighbour(edges: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return edges.groupBy(*by, "a").agg(F.min("b").alias("m"))


def _large_star(both: DataFrame, least: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest one around it."""
    return (
        both.join(least, [*by, "a"])
        .filter("b > a")
        .select(*by, F.col("b").alias("a"), F.least("a", "m").alias("b"))
    )


def _small_star(edges: DataFrame, least: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Hang every node and its smaller neighbours on the smallest of them."""
    moved = F.array(
        F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y"))
    )
    return (
        edges.join(least, [*by, "a"])
        .select(*by, F.inline(moved))
        .filter("x <> y")
        .select(*by, F.col("x").alias("a"), F.col("y").alias("b"))
        .distinct()
    )


def connected_components(edges: DataFrame, left: str, right: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, component): the component is the smallest node id in it.

    With `by`, independent graphs are solved in the same rounds. Minima combine
    map-side. Where hubs gather edges (the large star) they are written before they are
    joined back: both inputs of the join are then plain shuffles, the shape in which AQE
    splits a hub's edges over many tasks. Rounds alternate between two tables in the shared
    workspace, end as soon as every node hangs on one root, and only the last table stays.
    """
    scratch = Scratch(edges.sparkSession, "components")
    state = scratch.put(
        edges.filter(F.col(left) != F.col(right))
        .select(*by, F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .distinct(),
        "stars0",
    )
    for step in range(1, MAX_ROUNDS + 1):
        if _settled(state, by):
            break
        both = state.unionByName(state.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
        hung = scratch.put(_large_star(both, scratch.put(_least_neighbour(both, by), "least"), by), "hung")
        state = scratch.put(_small_star(hung, _least_neighbour(hung, by), by), f"stars{step % 2}")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    scratch.clear(keep=(f"stars{(step - 1) % 2}",))
    roots = state.select(*by, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(*by, F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _least_root(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches over the edges."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        if (least == root[a]).all() and (least == root[b]).all():
            return root
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]


def spanned(edges: DataFrame, left: str, right: str, level: str | None = None) -> DataFrame:
    """(left, right) with the same components: of what a task's edges connect, every node hangs on the least one.

    For edges that lie by the groups they were found in. With `level`, a positive number, a column
    of that name says at which level a node hangs, and the edges of any level or above have the same
    components as before. Edges are looked at SPANNED at a time, with what is left of those before;
    a task gives about a row per node, SPANNED or more of them as they come up.
    """
    names = [left, right, "level"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= 2 * SPANNED:
                held = [_hung(held)]
                rows = len(held[0])
                if rows >= SPANNED:
                    yield from held
                    held, rows = [], 0
        if held:
            yield _hung(held)

    number = F.lit(1) if level is None else F.col(level)
    plain = edges.filter(F.col(left) != F.col(right)).select(left, right, number.cast("int").alias("level"))
    found = plain.mapInArrow(of, plain.schema).toDF(*names)
    return found.drop("level") if level is None else found.withColumnRenamed("level", level)


def _hung(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """What edges (end, end, level) connect at each level and above, as nodes that hang on the least one."""
    ends = pa.chunked_array([b.column(k) for k in (0, 1) for b in batches]).combine_chunks()
    level = np.concatenate([b.column(2).to_numpy() for b in batches])
    coded = ends.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
    nodes = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    place = rank[coded.indices.to_numpy()]
    a, b = place[: len(level)], place[len(level) :]
    root, hangs, on, at = np.arange(len(order)), [], [], []
    for step in np.unique(level)[::-1]:
        here = level == step
        # Where the edges above have brought both ends already, nothing is added.
        x, y = root[a[here]], root[b[here]]
        merged = _least_root(x, y, len(order))
        moved = np.flatnonzero(merged != np.arange(len(order)))
        hangs.append(moved)
        on.append(merged[moved])
        at.append(np.full(len(moved), step, dtype=np.int32))
        root = merged[root]
    found = [nodes.take(pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *part]))) for part in (hangs, on)]
    at = pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *at]))
    return pa.RecordBatch.from_arrays([*found, at], names=list(batches[0].schema.names))


def _settled(state: DataFrame, by: tuple[str, ...]) -> bool:
    """Whether every edge ends at a root: no node hangs on two others, and none that hangs has others on it."""
    ends = state.select(*by, F.col("a").alias("n"), F.lit(1).alias("hangs")).unionByName(
        state.select(*by, F.col("b").alias("n"), F.lit(0).alias("hangs"))
    )
    nodes = ends.groupBy(*by, "n").agg(F.sum("hangs").alias("hangs"), F.min("hangs").alias("holds"))
    return nodes.filter((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") == 0))).isEmpty()
