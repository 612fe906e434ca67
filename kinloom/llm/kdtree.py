"""Shards by a k-d tree over document metadata, split at weighted medians until leaves reach the target bytes.

Each node is cut along the dimension in which it is widest (its range over that of the whole
table). Places in a node are ordered by that dimension, then by a hash, so that a value that
many documents share (a hot source) is cut as well, and last by a number that every row gets,
so that a row which is repeated a third of the time is cut, too. The cut is the exact weighted
quantile, read off a distributed running total. A node that has to give an odd number of leaves is
cut in that proportion. The tree is as large as the number of shards; documents stay where
they are until a node's splits are joined to them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.ids import running_total
from kinloom.session import Scratch


def size_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1 for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc(text: Column) -> Column:
    """CRC-32 of the text's UTF-8 bytes; of nothing for a null text."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


DIMENSIONS = ("__kd_d0", "__kd_d1", "__kd_d2")


def dimensions(docs: DataFrame) -> dict[str, Column]:
    """Metadata as longs: source and language by a hash that keeps equal values together, and the size."""
    return {
        "__kd_d0": F.crc32(F.coalesce("source", F.lit("")).cast("binary")),
        "__kd_d1": F.crc32(F.coalesce("lang", F.lit("")).cast("binary")),
        "__kd_d2": size_bytes(F.col("text")),
    }


ROW = "__kd_t3"
TIES = ("__kd_t0", "__kd_t1", "__kd_t2", ROW)


def numbered(docs: DataFrame, scratch: Scratch, *without: str) -> DataFrame:
    """`docs`, written once but for the columns in `without`, with those the tree looks at: dimensions, size and ties, the last a number of the row."""
    crc = text_crc(F.col("text"))
    ties = {
        "__kd_t0": F.xxhash64("doc_id", crc), "__kd_t1": F.coalesce(F.col("doc_id").try_cast("long"), F.lit(0)), "__kd_t2": crc,
        ROW: F.monotonically_increasing_id(),
    }
    return scratch.put(docs.withColumns({**dimensions(docs), **ties}).drop(*without), "numbered", "zstd")


def build(rows: DataFrame, leaves: int | None = None, target_bytes: int | None = None) -> list[list[tuple]]:
    """Splits of numbered rows by level: (node, dimension, value, four ties, leaves of the left child, of the right child).

    With `target_bytes` there are as many leaves as reach it, and at least `leaves`; without it exactly `leaves`.
    A row goes right if its (value, ties) is larger. Nodes are numbered by their first leaf.
    """
    scratch, dims = Scratch(rows.sparkSession, "kdtree"), list(DIMENSIONS)
    nodes = rows.select(F.lit(0).alias("node"), F.col("__kd_d2").alias("size"), *dims, *TIES)
    spans = [F.struct(F.min(d), F.max(d)) for d in dims]
    whole = nodes.agg(F.sum("size").alias("bytes"), *[s.alias(d) for s, d in zip(spans, dims)]).first()
    if not whole.bytes:
        return []
    ranges = {d: max(1, whole[d][1] - whole[d][0]) for d in dims}
    open_nodes = {0: max(leaves or 1, math.ceil(whole.bytes / target_bytes) if target_bytes else 1)}
    levels = []
    while any(n > 1 for n in open_nodes.values()):
        found = nodes.groupBy("node").agg(F.sum("size").alias("bytes"), *[s.alias(d) for s, d in zip(spans, dims)]).collect()
        todo = []
        for r in found:
            n = open_nodes.get(r.node, 1)
            if n > 1:
                widest = max(dims, key=lambda d: ((r[d][1] - r[d][0]) / ranges[d], -dims.index(d)))
                todo.append((r.node, widest, n // 2, n - n // 2, r.bytes * (n // 2) / n))
        if not todo:
            break
        chosen = rows.sparkSession.createDataFrame(todo, "node int, dim string, l int, r int, goal double")
        value = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in dims])
        keyed = nodes.join(F.broadcast(chosen), "node").withColumn("_value", value)  # a row per open node, fewer than the shards
        placed = running_total(scratch, keyed, ("node",), ("_value", *TIES), "size")
        # A row whose middle lies before the goal goes left.
        left = F.col("before") + F.col("size") / 2 <= F.col("goal")
        cuts = (
            placed.groupBy("node", "dim", "l", "r")
            .agg(F.max(F.when(left, F.struct("_value", *TIES))).alias("cut"))
            .collect()
        )
        level = []
        open_nodes = {k: n for k, n in open_nodes.items() if n <= 1}
        for c in cuts:
            cut = tuple(c.cut) if c.cut else (-(1 << 62),) * 5  # all goes right
            level.append((c.node, int(c.dim[-1]), *cut, c.l, c.r))
            open_nodes[c.node], open_nodes[c.node + c.l] = c.l, c.r
        levels.append(level)
        nodes = scratch.put(_descend(nodes, level, "node"), f"level{len(levels) % 2}")
    scratch.clear()
    return levels


def _descend(df: DataFrame, level: list[tuple], node: str) -> DataFrame:
    cuts = [f"__kd_c{i}" for i in range(5)]
    schema = f"{node} int, __kd_dim int, {' long, '.join(cuts)} long, __kd_l int, __kd_r int"
    splits = F.broadcast(df.sparkSession.createDataFrame(level, schema))  # fewer rows than shards
    value = F.element_at(F.array(*DIMENSIONS), F.col("__kd_dim") + 1)
    own = F.struct(value.alias(cuts[0]), *[F.col(t).alias(c) for t, c in zip(TIES, cuts[1:])])
    right = F.col("__kd_l").isNotNull() & (own > F.struct(*cuts))
    moved = df.join(splits, node, "left").withColumn(node, F.when(right, F.col(node) + F.col("__kd_l")).otherwise(F.col(node)))
    return moved.select(*df.columns)


def assign(rows: DataFrame, levels: list[list[tuple]]) -> DataFrame:
    """Numbered rows with their leaf as `shard`; nothing is shuffled."""
    out = rows.withColumn("shard", F.lit(0))
    for level in levels:
        out = _descend(out, level, "shard")
    return out.drop(*DIMENSIONS, *TIES)


def shard_rows(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row per row of `docs`.

    The law is `bytes`: shards' sizes are near equal, apart by about the size of a document, also
    if one row makes up most of the table. Null and empty texts have size 1. `slot` runs from 0 in
    each shard; grown_shard is null, as only the law `key` has it. Null and repeated ids are placed
    like any other.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    rows = numbered(docs.select("doc_id", "text", "source", "lang"), scratch, "text")
    placed = assign(rows.withColumns({"size": F.col("__kd_d2"), "text_crc32": F.col("__kd_t2"), "_twin": F.col(ROW)}), build(rows, leaves=shards))
    narrow = placed.select("doc_id", "size", "text_crc32", "shard", "_twin")
    ranked = running_total(scratch, narrow, ("shard",), ("doc_id", "text_crc32", "_twin"), None, "slot")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(docs: DataFrame, shards: int | None = None, target_bytes: int = 1 << 28) -> DataFrame:
    """`docs` with a column `shard`, rows of a shard stored together; a column of that name is replaced.

    Shards hold about `target_bytes` at most; there are at least `shards` of them. Every row is
    kept, repeated ones and those without id, text, source or language too; an empty table has no shards.
    """
    rows = numbered(docs.drop("shard"), Scratch(docs.sparkSession, "sharded"))
    out = assign(rows, build(rows, shards, target_bytes))
    return out.repartitionByRange("shard", "doc_id").sortWithinPartitions("shard", "doc_id")
