"""Near-duplicates by SimHash, found with anchor points of a covering code.

A fingerprint has 64 bits. Its first 46 bits are cut into two words of the binary Golay
code of length 23, which is perfect: every word has exactly one codeword within 3 bits.
The anchors are the pairs of codewords, and the pair nearest to a fingerprint is its home.

If two fingerprints differ in at most `t` bits, i of them in the first word and j in the
second (i + j <= t), then the home of one lies within 3 + i and 3 + j bits of the other.
So every fingerprint is replicated to all anchors within the covering radius plus the
threshold, counted per word (61 on average for t = 2), and an anchor compares its home
fingerprints with all replicas there. Every pair is seen, at the home of its smaller one,
exactly once. The 18 bits outside the code only take part in the comparison.

An anchor that is home to many fingerprints (a large group of near copies) would have to
compare all pairs among them. There the covering code is refined to the code of all words,
radius 0: fingerprints within t bits share a word half way, so each is sent to the words
within t/2 of it (65), at most 65 fingerprints meet in a word, and those are linked in a
star. That is linear in the group and leaves exactly the same components.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import text_key
from kinloom.operators.components import connected_components
from kinloom.session import Scratch

SHINGLE = 3
THRESHOLD = 2
CROWDED = 128  # home fingerprints of an anchor, from which on it is refined

# Generator polynomial, length, dimension and radius of the Golay code.
GOLAY, LENGTH, CHECKS, RADIUS = 0b110001110101, 23, 11, 3
WORD = (1 << LENGTH) - 1

_GAP = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded piece at a time."""
    start = 0
    while start < len(data):
        gap = _GAP.search(data, start + _PIECE)
        end = gap.start() if gap else len(data)
        yield data[start:end].split()
        start = end


def simhash(data: bytes | None) -> int:
    """Bit i is set if it is set in over half of the hashes of the 3-word shingles, repeats included.

    A-Z count as a-z. Fewer than three words make one shingle; without words the result is 0.
    """
    ones, total, carried = np.zeros(64, dtype=np.int64), 0, []
    for words in _pieces((data or b"").lower()):
        words = carried + words
        if len(words) < SHINGLE:
            carried = words
            continue
        columns = [words[i:] for i in range(SHINGLE)]
        ones, total = _count(ones, [b" ".join(x) for x in zip(*columns)]), total + len(words) - SHINGLE + 1
        carried = words[1 - SHINGLE :]
    if not total and carried:
        ones, total = _count(ones, [b" ".join(carried)]), 1
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<i8")[0])


def _count(ones: np.ndarray, shingles: list[bytes]) -> np.ndarray:
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype="<u8", count=len(shingles))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return ones + bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key, fp): one row per row of `docs`; `key` tells repeated ids apart by their text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array((simhash(x.as_py()) for x in batch.column(2)), type=pa.int64(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["doc_id", "key", "fp"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(of, f"doc_id {kind}, key long, fp long")


@lru_cache
def _syndromes() -> np.ndarray:
    """Remainders of all words by the generator, by bytes of the word."""
    unit = []
    for i in range(24):
        r = 1 << i
        for k in range(i, CHECKS - 1, -1):
            if r >> k & 1:
                r ^= GOLAY << (k - CHECKS)
        unit.append(r)
    table = np.zeros((3, 256), dtype=np.int64)
    for place in range(3):
        for byte in range(256):
            for k in range(8):
                if byte >> k & 1:
                    table[place, byte] ^= unit[8 * place + k]
    return table


@lru_cache
def _cosets(excess: int) -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error words that lead to a codeword within RADIUS + excess, and how far beyond RADIUS."""
    found: list[list[tuple[int, int]]] = [[] for _ in range(1 << CHECKS)]
    table = _syndromes()
    for weight in range(RADIUS + excess + 1):
        for places in combinations(range(LENGTH), weight):
            e = sum(1 << p for p in places)
            s = table[0, e & 255] ^ table[1, e >> 8 & 255] ^ table[2, e >> 16]
            found[s].append((e, max(0, weight - RADIUS)))
    wide = max(map(len, found))
    errors = np.zeros((1 << CHECKS, wide), dtype=np.int64)
    beyond = np.full((1 << CHECKS, wide), 99, dtype=np.int64)
    for s, row in enumerate(found):
        errors[s, : len(row)], beyond[s, : len(row)] = zip(*row)
    return errors, beyond


def anchors(fps: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within the radius plus `excess` bits of each fingerprint; excess 0 is the home."""
    table, (errors, beyond) = _syndromes(), _cosets(excess)
    halves = [fps & WORD, fps >> LENGTH & WORD]
    syndromes = [table[0, h & 255] ^ table[1, h >> 8 & 255] ^ table[2, h >> 16] for h in halves]
    near = beyond[syndromes[0]][:, :, None] + beyond[syndromes[1]][:, None, :] <= excess
    row, i, j = np.nonzero(near)
    first = halves[0][row] ^ errors[syndromes[0][row], i]
    second = halves[1][row] ^ errors[syndromes[1][row], j]
    return row, second << LENGTH | first


def _replicas(fps: DataFrame, excess: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for start in range(0, len(values), 2000):
                part = values[start : start + 2000]
                row, anchor = anchors(part, excess)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row])], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(of, "anchor long, fp long")


def _halfway(fps: DataFrame, threshold: int) -> DataFrame:
    """Links of fingerprints that share a word within half the threshold: a star around the smallest."""
    flips = np.array(
        [sum(1 << p for p in places) for w in range(threshold // 2 + 1) for places in combinations(range(64), w)], dtype=np.uint64
    ).view(np.int64)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for start in range(0, len(values), 2000):
                part = values[start : start + 2000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((part[:, None] ^ flips).ravel()), pa.array(part.repeat(len(flips)))], names=["word", "fp"]
                )

    met = fps.mapInArrow(of, "word long, fp long").groupBy("word").agg(F.collect_set("fp").alias("fps"))
    least = F.array_min("fps")
    return met.filter(F.size("fps") > 1).select(least.alias("a"), F.explode("fps").alias("b")).filter("a <> b").distinct()


def _met(homes: DataFrame, replicas: DataFrame, threshold: int) -> DataFrame:
    """(a, b): fingerprints at home in an anchor with the replicas there that differ in `threshold` bits or fewer.

    Spark takes the replicas for a table of the size of the fingerprints they are made of, an anchor
    for each instead of 61: left to itself it broadcasts them, and their rows fill the driver.
    """
    guests = replicas.select("anchor", F.col("fp").alias("guest")).hint("merge")
    differing = F.bit_count(F.col("fp").bitwiseXOR(F.col("guest")))
    return (
        homes.join(guests, "anchor")
        .filter((F.col("fp") < F.col("guest")) & (differing <= threshold))
        .select(F.col("fp").alias("a"), F.col("guest").alias("b"))
    )


def links(fps: DataFrame, scratch: Scratch, threshold: int = THRESHOLD, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect exactly what differs in `threshold` bits or fewer.

    `threshold` must be even. At anchors that are not crowded these are all such pairs.
    """
    if threshold % 2:
        raise ValueError("the threshold must be even")
    homes = scratch.put(_replicas(fps, 0), "homes")
    full = scratch.put(homes.groupBy("anchor").count().filter(F.col("count") > crowded).select("anchor"), "crowded")
    pairs = _met(homes.join(full, "anchor", "left_anti"), _replicas(fps, threshold), threshold)
    gathered = _replicas(fps, threshold).join(full, "anchor", "left_semi").select("fp").distinct()
    return scratch.put(pairs.unionByName(_halfway(gathered, threshold)), "links")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, key, fingerprint, component_id, first_key): one row per row of `docs`.

    Fingerprints link at `threshold` or fewer differing bits; `component_id` is the smallest
    doc_id that can be reached over links, with `first_key` the key of that row. Null and
    empty texts have fingerprint zero and link like any other. Rows with a null doc_id take
    part; a component of such rows alone has a null id. Repeated rows each give a row.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.put(fingerprints(docs), "fingerprints")
    least = F.min_by(F.struct("doc_id", "key"), F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    distinct = scratch.put(marked.groupBy("fp").agg(least.alias("first")), "distinct")
    linked = connected_components(links(distinct, scratch, threshold, crowded), "a", "b")
    joined = scratch.put(linked.join(distinct, linked.node == distinct.fp).select("fp", "component", "first"), "linked")
    of_first = F.struct(F.col("first.doc_id").isNull(), F.col("first.doc_id"), F.col("first.key"))
    roots = scratch.put(joined.groupBy("component").agg(F.min_by("first", of_first).alias("root")), "roots")
    moved = joined.join(roots, "component").select("fp", "root")
    named = scratch.put(
        distinct.join(moved, "fp", "left").select("fp", F.coalesce("root", "first").alias("first")), "named"
    )
    return marked.join(named, "fp").select(
        "doc_id",
        "key",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        F.col("first.key").alias("first_key"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stand for their group, columns unchanged.

    A group's row with the smallest doc_id stays (of equal ids, that with the smallest text
    key; rows that repeat it exactly count once).
    """
    found = near_duplicates(docs)
    stands = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("first_key"))
    stays = Scratch(docs.sparkSession, "representatives").put(
        found.filter(stands).select(F.struct("doc_id", "key").alias("_row")).distinct(), "stays"
    )
    # One struct as the key: nulls in it compare as equal, and join and deduplication share one exchange.
    keyed = docs.withColumn("_row", F.struct("doc_id", text_key(F.col("text")).alias("key")))
    return keyed.join(stays, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")
