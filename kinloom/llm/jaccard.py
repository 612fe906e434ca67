"""Near-duplicates by the stages' rule: sets of 5-word shingles with a Jaccard similarity of 0.8 or more.

Texts of equal sets are one node. A node has a SimHash fingerprint of its set, and fingerprints meet at the anchors
of the covering code (`simhash.links`, its radius and threshold). What meets there is verified by the exact Jaccard,
and what that links is a component.

A fingerprint cannot carry the whole rule: at similarity 0.8 two differ in about ten of 64 bits, and a covering code
for a threshold that holds nearly all such pairs sends each fingerprint to more anchors than there are documents
(61 for 2 bits, 1,235 for 4). An exact comparison follows for what fingerprints leave apart. The nodes it has to look
at are told by MinHash: BANDS bands of ROWS minima, so that a pair at 0.8 shares none in (1 - 0.8^4)^25 = 2 of a
million cases, and more alike pairs more rarely still. First every such bucket is a star around the node that meets
most others, which joins components of near copies. The nodes of buckets that still hold several components
are then compared across components by prefix filtering, which loses nothing: shingles are
ordered by the number of these nodes that hold them, and sets with a similarity of 0.8 or more have
one in common among the first fifth of each. Texts that only share a frequent passage have rarer
shingles in front and never meet. For each shingle, the nodes outside its largest component meet all
nodes that hold it, so rows are linear in the size of a group of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import text_key
from kinloom.llm.simhash import THRESHOLD, _pieces
from kinloom.llm.simhash import links as anchored
from kinloom.operators.components import connected_components
from kinloom.session import Scratch

SHINGLE = 5
# Similarity as a ratio of whole numbers, so that the comparison is exact.
SIMILAR, OF = 4, 5
BANDS, ROWS = 25, 4
WORDS = 8  # longs that mark the shingles of a prefix
AT_ONCE = 500  # texts whose shingles a task holds, and shingles it works on

_DRAWN = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_FACTORS, _SHIFTS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; A-Z count as a-z, fewer than five words make one shingle."""
    found, carried = [], []
    for words in _pieces((data or b"").lower()):
        words = carried + words
        hashes = (xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), 7) for i in range(len(words) - SHINGLE + 1))
        found.append(np.fromiter(hashes, dtype=np.uint64))
        carried = words[1 - SHINGLE :]
    if carried and not any(map(len, found)):
        found.append(np.array([xxhash.xxh64_intdigest(b" ".join(carried), 7)], dtype=np.uint64))
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of minima; no words, no bands."""
    if not len(hashes):
        return hashes
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), AT_ONCE):
        np.minimum(least, (hashes[start : start + AT_ONCE, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * _MIX
        key ^= key >> np.uint64(29)
    return key


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set: bit i is set if it is set in over half of the hashes; without any, 0."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), AT_ONCE):
        ones += np.unpackbits(hashes[start : start + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from all others, as two longs."""
    whole = xxhash.xxh128_intdigest(hashes.tobytes())
    return (whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63)


def _text_keys() -> dict[str, Column]:
    """128 bits that tell a text from all others."""
    return {"key": text_key(F.col("text")), "key2": F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(2))}


def _signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, key2, high, low, n, fp, bands): one row per row of `docs`."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(start, AT_ONCE) for b in batches for start in range(0, b.num_rows, AT_ONCE)):
            sets = [shingles(x.as_py()) for x in batch.column(3)]
            digests = [_digest(s) for s in sets]
            made = [
                pa.array([d[0] for d in digests], type=pa.int64()),
                pa.array([d[1] for d in digests], type=pa.int64()),
                pa.array(map(len, sets), type=pa.int64(), size=len(sets)),
                pa.array(map(fingerprint, sets), type=pa.int64(), size=len(sets)),
                pa.array([bands(s).view(np.int64) for s in sets], type=pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), *made], names=["doc_id", "key", "key2", "high", "low", "n", "fp", "bands"]
            )

    keys = _text_keys()
    narrow = docs.select("doc_id", *[c.alias(n) for n, c in keys.items()], F.col("text").cast("binary").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(of, f"doc_id {kind}, key long, key2 long, high long, low long, n long, fp long, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(id, shingles) of texts with the id of their node."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1)):
                found = shingles(text.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node.as_py()], type=pa.int64()), pa.array([found.view(np.int64)], type=pa.list_(pa.int64()))],
                    names=["id", "shingles"],
                )

    return texts.select("id", F.col("text").cast("binary")).mapInArrow(of, "id long, shingles array<long>")


def prefixes(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(shingle, id, component, n, place, bits, lost): of sets (id, component, n, shingles), the shingles two similar sets must share one of.

    Shingles are ordered by the number of sets that hold them; a set of n needs the first
    n - ceil(0.8 n) + 1. Those that no other set holds come first and are only counted. `bits`
    are WORDS longs that mark the set's shingles of this table, `lost` those that share a bit.
    """
    held = sets.select("id", F.explode("shingles").alias("shingle"))
    common = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    lists = held.join(common, "shingle").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("common"))
    alone = F.col("n") - F.size("common")
    needed = F.col("n") - F.ceil(F.col("n") * SIMILAR / OF) + 1
    first = F.slice("common", 1, F.greatest(needed - alone, F.lit(0)).cast("int"))
    found = sets.select("id", "component", "n").join(lists, "id").select("id", "component", "n", alone.alias("alone"), first.alias("first"))
    marks = lambda word: F.aggregate("first", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(_bit(x["shingle"], word)))
    found = found.withColumn("bits", F.array(*map(marks, range(WORDS))))
    found = found.withColumn("lost", F.size("first") - _ones(F.col("bits")))
    rows = found.select("id", "component", "n", "alone", "lost", "bits", F.posexplode("first").alias("at", "x"))
    return scratch.put(
        rows.select(F.col("x.shingle").alias("shingle"), "id", "component", "n", (F.col("alone") + F.col("at")).alias("place"), "bits", "lost"),
        "prefixes",
    )


def _bit(shingle: Column, word: int) -> Column:
    """The shingle's bit, if it is in this word of the marks."""
    place = F.pmod(shingle, F.lit(64 * WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    return F.when(F.floor(place / 64) == word, bit).otherwise(F.lit(0).cast("long"))


def _ones(bits: Column) -> Column:
    """How many bits are set. A loop over the words: spelled out, a join that counts them is a long method to compile."""
    return F.aggregate(bits, F.lit(0), lambda acc, x: acc + F.bit_count(x))


def across(held: DataFrame) -> DataFrame:
    """(a, b, m, n): pairs of sets of different components that share a shingle of their prefixes and may be similar."""
    shares = held.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("rows"))
    main = shares.groupBy("shingle").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("rows", "component")).alias("main"))
    marked = held.join(main.filter("parts > 1").select("shingle", "main"), "shingle")
    small = marked.filter("component <> main")
    left = small.select(
        "shingle", F.col("id").alias("a"), F.col("component").alias("of"), F.col("n").alias("m"), F.col("place").alias("from"),
        F.col("bits").alias("marks"), F.col("lost").alias("gone"),
    )
    # Pairs of two small ones come up twice; the one with the smaller id in front counts.
    once = (F.col("component") == F.col("main")) | (F.col("a") < F.col("id"))
    sized = F.least("m", "n") * OF >= F.greatest("m", "n") * SIMILAR
    # What the first shingle in common leaves of both sets has to hold all that they share.
    rest = F.least(F.col("m") - F.col("from"), F.col("n") - F.col("place"))
    enough = rest * (SIMILAR + OF) >= (F.col("m") + F.col("n")) * SIMILAR
    # Of their first fifths two sets share no more than the bits they share and those that fell together;
    # of the rest, no more than the longer rest. (Whichever prefix ends first holds all they share up to there.)
    both = _ones(F.zip_with("bits", "marks", lambda x, y: x.bitwiseAND(y)))
    most = both + F.least("lost", "gone") + F.ceil(F.greatest("m", "n") * SIMILAR / OF) - 1
    likely = most * (SIMILAR + OF) >= (F.col("m") + F.col("n")) * SIMILAR
    return left.join(marked, "shingle").filter((F.col("component") != F.col("of")) & once & sized & enough & likely).select(
        "a", F.col("id").alias("b"), "m", "n"
    )


def near(nodes: DataFrame, scratch: Scratch, threshold: int = THRESHOLD) -> DataFrame:
    """(a, m, b, n): candidates among nodes (id, n, fp) that connect all whose fingerprints are linked at the anchors.

    Nodes of one fingerprint are a star around the smallest, which stands for them in links to other fingerprints.
    """
    first = scratch.put(nodes.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("first")), "first")
    same = nodes.join(first, "fp").filter(F.col("id") != F.col("first.id"))
    of = lambda k: first.select(F.col("fp").alias(k), F.col("first").alias(f"of_{k}"))
    met = anchored(first.select("fp"), scratch, threshold).join(of("a"), "a").join(of("b"), "b")
    return same.select(F.col("first.id").alias("a"), F.col("first.n").alias("m"), F.col("id").alias("b"), "n").unionByName(
        met.select(F.col("of_a.id").alias("a"), F.col("of_a.n").alias("m"), F.col("of_b.id").alias("b"), F.col("of_b.n").alias("n"))
    )


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, key, group): one row per row of `docs`; rows of a group are connected by similarities of 0.8 or more.

    Texts without words are one group. Null ids take part; repeated rows each give a row.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    marked = scratch.put(_signatures(docs), "signatures")
    digest = marked.groupBy("high", "low").agg(
        F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min(F.struct("key", "key2")).alias("text")
    )
    nodes = scratch.put(digest.withColumn("id", F.monotonically_increasing_id()), "nodes")  # a number is a fact once written
    close = scratch.put(near(nodes.select("id", "n", "fp"), Scratch(docs.sparkSession, "fingerprints")), "close")
    buckets = scratch.put(nodes.select("id", "n", F.explode("bands").alias("band")), "buckets")
    shared = scratch.put(buckets.join(buckets.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "band"), "shared")
    # The text that variants were made of is alike to more of them than they are to each other: it meets the most.
    meets = shared.groupBy("id").agg(F.sum("size").alias("meets"))
    stars = shared.join(meets, "id").groupBy("band").agg(F.max(F.struct("meets", "id", "n")).alias("pivot"))
    met = scratch.put(shared.join(stars, "band"), "met")
    # One text stands for the texts of a node; a text that is repeated leaves each task once.
    compared = met.select("id").unionByName(close.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    wanted = nodes.join(compared, "id", "left_semi").select("text", "id")
    texts = docs.select(F.struct(*[c.alias(n) for n, c in _text_keys().items()]).alias("_key"), F.col("text").alias("_text"))
    texts = texts.groupBy("_key").agg(F.first("_text").alias("_text"))
    sets = scratch.put(_sets(texts.join(wanted.withColumnRenamed("text", "_key"), "_key").select("id", F.col("_text").alias("text"))), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b) with sizes (m, n), those that are as similar as the rule asks."""
        alike = (F.least("m", "n") * OF >= F.greatest("m", "n") * SIMILAR) & (F.col("a") != F.col("b"))
        pairs = scratch.put(pairs.filter(alike).select("a", "b", "m", "n").distinct(), f"pairs{name}")
        of = lambda k: sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}"))
        both = F.size(F.array_intersect("sa", "sb"))
        found = pairs.join(of("a"), "a").join(of("b"), "b").filter(both * (SIMILAR + OF) >= (F.col("m") + F.col("n")) * SIMILAR)
        return scratch.put(found.select("a", "b"), f"links{name}")

    copies = verified(close, "0")
    copied = scratch.put(connected_components(copies, "a", "b"), "copied")
    stars = met.select(F.col("pivot.id").alias("a"), F.col("pivot.n").alias("m"), F.col("id").alias("b"), "n").distinct()
    of = lambda k: copied.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    apart = stars.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    first = scratch.put(copies.unionByName(verified(apart, "1")), "first")
    linked = scratch.put(connected_components(first, "a", "b"), "linked").withColumnRenamed("node", "id")
    placed = scratch.put(met.select("band", "id", "n").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    several = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band")
    open_ = scratch.put(placed.join(several, "band", "left_semi").select("id", "n", "component").distinct(), "open")
    second = verified(across(prefixes(open_.join(sets, "id"), scratch)), "2")
    links = scratch.put(first.unionByName(second), "links")
    named = nodes.select("id", "high", "low").join(connected_components(links, "a", "b").withColumnRenamed("node", "id"), "id", "left")
    named = scratch.put(named.select("high", "low", F.coalesce("component", "id").alias("group")), "named")
    out = scratch.put(marked.join(named, ["high", "low"]).select("doc_id", "key", "group"), "groups")
    scratch.clear(keep=("groups",))
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stand for their group, columns unchanged.

    A group's row with the smallest doc_id stays (of equal ids, that with the smallest text
    key; rows that repeat it exactly count once). Null, empty and blank texts are one group.
    """
    least = F.min_by(F.struct("doc_id", "key"), F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    stays = groups(docs).groupBy("group").agg(least.alias("_row")).select("_row")
    stays = Scratch(docs.sparkSession, "representatives").put(stays, "stays")
    keyed = docs.withColumn("_row", F.struct("doc_id", text_key(F.col("text")).alias("key")))
    return keyed.join(stays, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")
