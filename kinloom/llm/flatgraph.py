"""Near-duplicate embeddings by search in a flat, robust-pruned proximity graph.

1. Equal directions become one node that counts its copies.
2. Overlapping shards. Cells of more than `SHARD` nodes are cut at centers that are fitted to a
   bounded sample of the cell; a node goes to its `overlap` nearest cells and is at home in the
   nearest. Cells that are still too large are cut again (only nodes at home go to several parts),
   so no task holds more than a cell.
3. Graph. In each shard a node gets neighbours out of its nearest and of some distant nodes by
   robust pruning: a candidate goes if a chosen neighbour is nearer to it than 1/ALPHA of its
   distance. Neighbours point back. The adjacency lists of a node's shards are united.
4. Search. A home shard holds its nodes, their united lists, and the near neighbours that other
   shards found for them. Every node at home is looked for from the shard's medoids with a beam;
   around it the search goes on over all neighbours of nodes within reach until it finds no more.
5. Links are cosines in double precision; in-task groups leave as stars, so rows stay linear in
   the number of nodes, and components join the stars of all shards.
6. Audit. The links of a bounded random set of nodes are counted over all nodes; below the wanted
   recall the graph is built anew with twice the overlap.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.components import connected_components
from kinloom.session import Scratch

COSINE = 0.9
RECALL = 0.9
SHARD = 4000  # nodes of a cell, beyond which it is cut
CELL = 1000  # nodes of a cell after a cut, on average
CENTERS = 256  # of a cut, at most
SAMPLE = 16_384  # nodes that centers are fitted to
OVERLAP = 3
DEGREE, POOL, FAR, ALPHA = 24, 48, 16, 1.2
BEAM, STEP = 32, 4  # candidates kept, and expanded at once
SLACK = 0.05  # nodes this far below the cosine still lead on to others
AUDIT = 256  # nodes whose links are counted over all nodes
LEVELS = 12


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit(rows: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """`k` centers of unit vectors by k-means on the sphere."""
    rng = np.random.default_rng(seed)
    centers = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(6):
        of = (rows @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, rows)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centers)
    return centers


def build(rows: np.ndarray, seed: int = 2) -> np.ndarray:
    """Neighbours of each of the unit vectors by robust pruning, back edges included; -1 fills up."""
    n, rng = len(rows), np.random.default_rng(seed)
    if n == 1:
        return np.full((1, 1), -1)
    near, far = min(POOL, n - 1), min(FAR, n - 1)
    chosen = np.full((n, DEGREE), -1)
    for start in range(0, n, 256):
        own = np.arange(start, min(n, start + 256))
        sims = rows[own] @ rows.T
        sims[np.arange(len(own)), own] = -9
        pool = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        pool = np.concatenate([pool, (own[:, None] + rng.integers(1, n, (1, far))) % n], axis=1)
        dist = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(sims, pool, axis=1), 0))
        order = np.argsort(dist, axis=1, kind="stable")
        pool, dist = np.take_along_axis(pool, order, axis=1), np.take_along_axis(dist, order, axis=1)
        vectors = rows[pool]
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("nad,nbd->nab", vectors, vectors, optimize=True), 0))
        alive, line = np.ones(pool.shape, dtype=bool), np.arange(len(own))
        for slot in range(DEGREE):
            best = np.where(alive, dist, np.inf).argmin(axis=1)
            some = alive[line, best]
            chosen[own[some], slot] = pool[line, best][some]
            alive &= ALPHA * between[line, best] > dist
            alive[line, best] = False
            if not alive.any():
                break
    return _with_back_edges(chosen)


def _with_back_edges(chosen: np.ndarray) -> np.ndarray:
    """Up to DEGREE of the nodes that chose a node are added to its own choice."""
    n = len(chosen)
    a, slot = np.nonzero(chosen >= 0)
    b = chosen[a, slot]
    return pack(n, np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([slot, slot + DEGREE]), 2 * DEGREE)


def pack(n: int, a: np.ndarray, b: np.ndarray, rank: np.ndarray, width: int) -> np.ndarray:
    """Edges as a row of neighbours for each of n nodes, by rank, each once, at most `width`."""
    keep = np.lexsort((rank, b, a))
    a, b, rank = a[keep], b[keep], rank[keep]
    once = np.ones(len(a), dtype=bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, rank = a[once], b[once], rank[once]
    keep = np.lexsort((rank, a))
    a, b = a[keep], b[keep]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    fits = place < width
    table = np.full((n, max(1, min(width, int(place.max(initial=0)) + 1))), -1)
    table[a[fits], place[fits]] = b[fits]
    return table


def medoids(rows: np.ndarray, seed: int = 3) -> np.ndarray:
    """A node in the middle of each of about root n parts."""
    k = max(1, min(64, int(len(rows) ** 0.5)))
    centers = fit(rows, k, seed)
    return np.unique((rows @ centers.T).argmax(axis=0))


def search(rows: np.ndarray, graph: np.ndarray, queries: np.ndarray, limit: float) -> np.ndarray:
    """For each query (the number of a row) the rows with a cosine of `limit` or more that the graph leads to."""
    starts, n = medoids(rows), len(rows)
    hits = np.zeros((len(queries), n), dtype=bool)
    for begin in range(0, len(queries), 256):
        own = rows[queries[begin : begin + 256]]
        hits[begin : begin + 256] = _walk(rows, graph, own, starts, limit)
    return hits


def _walk(rows: np.ndarray, graph: np.ndarray, own: np.ndarray, starts: np.ndarray, limit: float) -> np.ndarray:
    count, n = len(own), len(rows)
    line = np.arange(count)[:, None]
    visited, within, hit = (np.zeros((count, n), dtype=bool) for _ in range(3))
    beam = np.broadcast_to(starts, (count, len(starts))).copy()
    score = own @ rows[starts].T
    done = np.zeros(beam.shape, dtype=bool)
    visited[:, starts] = True
    within[line, beam], hit[line, beam] = score >= limit - SLACK, score >= limit
    while True:
        if beam.shape[1] > BEAM:
            top = np.argpartition(-score, BEAM - 1, axis=1)[:, :BEAM]
            beam, score, done = (np.take_along_axis(x, top, axis=1) for x in (beam, score, done))
        open_ = np.where(done, -np.inf, score)
        if not np.isfinite(open_).any():
            break
        width = min(STEP, beam.shape[1])
        pick = np.argpartition(-open_, width - 1, axis=1)[:, :width]
        live = np.isfinite(np.take_along_axis(open_, pick, axis=1))
        nodes = np.where(live, np.take_along_axis(beam, pick, axis=1), -1)
        np.put_along_axis(done, pick, True, axis=1)
        next_ = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(count, -1)
        next_ = np.sort(next_, axis=1)
        fresh = next_ >= 0
        fresh[:, 1:] &= next_[:, 1:] != next_[:, :-1]
        fresh &= ~visited[line, next_]
        q, k = np.nonzero(fresh)
        found = np.full(next_.shape, -np.inf)
        at = next_[q, k]
        visited[q, at] = True
        found[q, k] = value = np.einsum("kd,kd->k", own[q], rows[at])
        within[q, at], hit[q, at] = value >= limit - SLACK, value >= limit
        beam, score = np.concatenate([beam, next_], axis=1), np.concatenate([score, found], axis=1)
        done = np.concatenate([done, ~fresh], axis=1)
    # From here on over every node within reach, whatever the beam held.
    frontier = within.copy()
    while frontier.any():
        q, v = np.nonzero(frontier)
        frontier = np.zeros_like(frontier)
        for start in range(0, len(q), 20_000):
            part = slice(start, start + 20_000)
            at = graph[v[part]]
            flat = (q[part][:, None] * n + at)[at >= 0]
            flat = np.unique(flat[~visited.ravel()[flat]])
            visited.ravel()[flat] = True
            a, b = flat // n, flat % n
            value = np.einsum("kd,kd->k", own[a], rows[b])
            hit[a, b] = value >= limit
            frontier[a, b] = value >= limit - SLACK
    return hit


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of n nodes reaches over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


# --- the same on Spark


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _valid(vector: Column) -> Column:
    """Whether a vector has a direction: not null, of finite numbers, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, key, vec): unit vectors, and a key of 128 bits for the direction to twelve digits; null where there is none."""
    kind = vectors.select(F.col(vec_id).alias("vec_id")).schema["vec_id"].dataType.simpleString()
    given = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("raw"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = [None if x is None else unit(np.array([x]))[0] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec, type=pa.list_(pa.float64()))], names=["vec_id", "vec"])

    made = given.select("vec_id", F.when(_valid(F.col("raw")), F.col("raw")).alias("raw")).mapInArrow(of, f"vec_id {kind}, vec array<double>")
    # Adding zero makes one of the two zeros.
    rough = F.transform("vec", lambda x: F.round(x, 12) + F.lit(0.0))
    key = F.concat(F.hex(F.xxhash64(F.lit(1), rough)), F.lit(":"), F.hex(F.xxhash64(F.lit(2), rough)))
    return made.select("vec_id", F.when(F.col("vec").isNotNull(), key).alias("key"), "vec")


def shards(nodes: DataFrame, scratch: Scratch, overlap: int = OVERLAP, shard: int = SHARD, cell: int = CELL) -> DataFrame:
    """(shard, id, vec, copies, home): cells of at most `shard` nodes; each node in several, at home in one.

    Vectors of different lengths never meet.
    """
    members = scratch.put(
        nodes.select(F.size("vec").cast("string").alias("shard"), "id", "vec", "copies", F.lit(True).alias("home")), "members0"
    )
    for level in range(1, LEVELS + 1):
        sizes = scratch.put(members.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard), f"sizes{level % 2}")
        if sizes.isEmpty():
            break
        members = scratch.put(_cut(members, sizes, overlap, cell, level), f"members{level % 2}")
    else:
        warnings.warn("some cells are still larger than wanted")
    return members


def _cut(members: DataFrame, sizes: DataFrame, overlap: int, cell: int, level: int) -> DataFrame:
    large = members.join(sizes, "shard")
    part = lambda size: F.pmod(F.xxhash64("id", F.lit(level)), F.ceil(F.col("n") / size))

    def centers(table: pa.Table) -> pa.Table:
        n, rows = table.column("n")[0].as_py(), _matrix(table.column("vec"))
        k = min(CENTERS, max(2 * overlap, -(-overlap * n // cell)))
        found = fit(rows, k, level)
        return pa.table({"shard": table.column("shard").slice(0, 1), "n": pa.array([n]), "centers": pa.array([found.ravel()])})

    def assign(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select([]).append_column("shard", pa.array([], pa.string()))
        vec = _matrix(rows.column("vec"))
        sims = vec @ _matrix(fitted.column("centers"))[0].reshape(-1, vec.shape[1]).T
        home = np.array(rows.column("home").to_pylist())
        near = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
        # Guests of the cell stay in one of its parts, so copies add up over the levels and do not multiply.
        at, rank = np.nonzero(home[:, None] | (np.arange(near.shape[1]) == 0))
        out, first = rows.take(pa.array(at)), home[at] & (rank == 0)
        paths = [f"{s}/{c}" for s, c in zip(out.column("shard").to_pylist(), near[at, rank].tolist())]
        return pa.table(
            {"shard": pa.array(paths), "id": out.column("id"), "vec": out.column("vec"), "copies": out.column("copies"), "home": pa.array(first)}
        )

    sample = large.filter(part(SAMPLE) == 0).select("shard", "n", "vec")
    fitted = sample.groupBy("shard").applyInArrow(centers, "shard string, n long, centers array<double>")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / SAMPLE) - 1))
    fitted = fitted.select("shard", "centers", blocks.alias("block"))
    cut = large.withColumn("block", part(SAMPLE)).groupBy("shard", "block").cogroup(fitted.groupBy("shard", "block"))
    cut = cut.applyInArrow(assign, members.schema)
    return members.join(sizes, "shard", "left_anti").select(*members.columns).unionByName(cut)


def adjacency(members: DataFrame) -> DataFrame:
    """(id, other, cosine): the edges of all shards."""

    def of(table: pa.Table) -> pa.Table:
        rows, ids = _matrix(table.column("vec")), table.column("id").to_numpy()
        graph = build(rows)
        a, slot = np.nonzero(graph >= 0)
        b = graph[a, slot]
        return pa.table({"id": ids[a], "other": ids[b], "cosine": np.einsum("kd,kd->k", rows[a], rows[b])})

    return members.select("shard", "id", "vec").groupBy("shard").applyInArrow(of, "id long, other long, cosine double")


def links(members: DataFrame, nodes: DataFrame, scratch: Scratch, limit: float = COSINE) -> DataFrame:
    """(id, links, root): for nodes at home how many vectors they link with, copies counted; for all that were met a node they reach."""
    edges = scratch.put(adjacency(members), "edges")
    united = scratch.put(edges.groupBy("id").agg(F.collect_set("other").alias("others")), "united")
    homes = members.filter("home").select("id", F.col("shard"))
    met = edges.filter(F.col("cosine") >= limit - 2 * SLACK).join(homes, "id").select("shard", F.col("other").alias("id")).distinct()
    guests = met.join(members.select("shard", "id"), ["shard", "id"], "left_anti").join(nodes.select("id", "vec", "copies"), "id")
    present = members.unionByName(guests.withColumn("home", F.lit(False)).select(*members.columns))

    def of(table: pa.Table) -> pa.Table:
        rows, ids = _matrix(table.column("vec")), table.column("id").to_numpy()
        copies, home = table.column("copies").to_numpy(), np.array(table.column("home").to_pylist())
        lists = table.column("others").combine_chunks()
        order = np.argsort(ids)
        ends = np.repeat(np.arange(len(ids)), lists.value_lengths().fill_null(0).to_numpy())
        others = lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(ids[order], others), len(ids) - 1)
        here = ids[order][at] == others
        a, b = ends[here], order[at[here]]
        graph = pack(len(ids), a, b, np.zeros(len(a), dtype=np.int64), len(ids))
        own = np.flatnonzero(home)
        hits = search(rows, graph, own, limit)
        hits[:, own] |= hits[:, own].T
        hits[np.arange(len(own)), own] = False
        q, v = np.nonzero(hits)
        root = roots(len(ids), own[q], v)
        counted = np.zeros(len(ids), dtype=np.int64)
        counted[own] = hits @ copies + copies[own] - 1
        touched = home | (root != np.arange(len(ids)))
        return pa.table(
            {"id": ids[touched], "links": pa.array(counted[touched], mask=~home[touched]), "root": ids[root[touched]]}
        )

    joined = present.join(united, "id", "left").select("shard", "id", "vec", "copies", "home", "others")
    return scratch.put(joined.groupBy("shard").applyInArrow(of, "id long, links long, root long"), "links")


def audit(nodes: DataFrame, found: DataFrame, limit: float = COSINE, queries: int = AUDIT) -> float:
    """The share of links found, for `queries` nodes drawn by hash, of those counted over all nodes."""
    drawn = nodes.select("id", "vec", "copies", F.size("vec").alias("size")).orderBy(F.xxhash64("id", F.lit(9))).limit(queries).collect()
    if not drawn:
        return 1.0
    lengths = {r.size for r in drawn}
    asked = {n: ([r.id for r in drawn if r.size == n], np.array([r.vec for r in drawn if r.size == n])) for n in lengths}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            sizes, copies = batch.column(0).value_lengths().to_numpy(), batch.column(1).to_numpy()
            for n, (ids, rows) in asked.items():
                at = np.flatnonzero(sizes == n)
                if len(at):
                    near = _matrix(batch.column(0).take(pa.array(at))) @ rows.T >= limit
                    for i, count in zip(ids, (copies[at] @ near).tolist()):
                        sums[i] = sums.get(i, 0) + int(count)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["id", "n"])

    true = nodes.select("vec", "copies").mapInArrow(of, "id long, n long").groupBy("id").agg((F.sum("n") - 1).alias("n"))
    got = true.join(found.filter("links is not null"), "id").agg(F.sum("n").alias("n"), F.sum(F.least("n", "links")).alias("found")).first()
    return got.found / got.n if got.n else 1.0


def near_duplicates(
    vectors: DataFrame, limit: float = COSINE, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding",
    shard: int = SHARD, overlap: int = OVERLAP,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of `vectors`.

    `n_links` counts the other rows found with a cosine of `limit` or more, `component_id` is the
    smallest id that can be reached over links, and the rows that bear it are kept. Vectors that
    are null, zero or not finite link with nothing, nor do vectors of different lengths. Repeated
    rows link with each other; null ids take part, and stand for a component only if it has no other.
    """
    scratch = Scratch(vectors.sparkSession, "flatgraph")
    rows = scratch.put(directions(vectors, vec_id, embedding), "rows")
    grouped = rows.filter("key is not null").groupBy("key").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"))
    # The number is a fact once it is written.
    nodes = scratch.put(grouped.withColumn("id", F.monotonically_increasing_id()), "nodes")
    while True:
        found = links(shards(nodes, scratch, overlap, shard), nodes, scratch, limit)
        reached = audit(nodes, found, limit)
        if reached >= recall:
            break
        if overlap >= CENTERS:
            warnings.warn(f"audited recall {reached:.3f}")
            break
        overlap *= 2
    linked = connected_components(found.filter("id <> root"), "id", "root")
    named = found.filter("links is not null").select("id", "links").join(linked.withColumnRenamed("node", "id"), "id", "left")
    named = scratch.put(nodes.select("id", "key").join(named, "id").select("key", "links", F.coalesce("component", "id").alias("component")), "named")
    least = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least")).join(named, "key")
    least = scratch.put(least.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    marked = rows.select("vec_id", "key").join(named, "key", "left").join(least, "component", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return marked.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
