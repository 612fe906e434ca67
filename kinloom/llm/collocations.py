"""Collocations from a weighted de Bruijn graph of the corpus.

Nodes are phrases of LONGEST - 1 words, edges the phrases of LONGEST words that overlap two nodes.
Every word of a piece starts one gram: the longest, of up to LONGEST words, that the piece still
holds. Counted over the corpus these are the edges and, shorter ones, the corrections for the ends
of pieces. All other counts are flow: a phrase occurs as often as the grams that it begins.

1. Solid phrases. No phrase of `min_count` occurrences holds a rarer one. From two words up to a node,
   phrases of solid ones are counted by their hash, and those that are frequent enough go to a bitmap
   of bounded size. A hash that two phrases share, or a full bitmap, only lets more phrases through.
2. Grams. A gram also ends where it would hold a phrase that is not solid. What is left is counted by
   its words, so all counts from here on are exact.
3. Flow. Prefix by prefix, the counts of ever shorter phrases; those below `min_count` go.
4. Paths. Where all occurrences of a node come over one edge and leave over one edge, the edges are
   joined; such a unary path is found by pointer doubling in a number of rounds logarithmic in its length.
5. Phrases. Scores from the counts; a phrase inside a path is overlapped by as many occurrences as the path has.

Tasks hold at most `BUFFER` words at a time, count them and pass counts on, so a gram that makes up
a third of a corpus is one row of a task. No row of any step belongs to a word alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinloom.operators.components import MAX_ROUNDS
from kinloom.session import Scratch

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
UNKNOWN = "und"
# The signs that end a piece, and the score of a phrase whose parts never occur without each other, twice.
ENDS, SCALE = b".,;:!?\n\x0b\f\r", 2_000_000
# Of every 100 occurrences of a phrase, so many within one longer phrase make it a part of that.
PART_OF = 80

BUFFER = 1 << 21  # words a task holds
SLICE = 1 << 20  # bytes of a text split at a time
BITMAP_BITS = 28  # the bitmap has at most two to this power bits, 32 MB
BITMAP_LOAD = 16  # and otherwise at least so many for each phrase
CHUNK_BITS = 15  # a chunk of Spark's bitmap functions

_PLAIN = bytes.maketrans(ENDS + b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"." * len(ENDS) + b" abcdefghijklmnopqrstuvwxyz")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


class _Ids(dict):
    """Numbers words as they come; a full stop, which no word can be, is the end of a piece and has number 0."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _slices(data: bytes) -> Iterator[list[bytes]]:
    """The words and ends of pieces of a text, a bounded slice at a time."""
    data, start = data.translate(_PLAIN), 0
    while start < len(data):
        gap = data.find(b" ", start + SLICE)
        end = gap if gap >= 0 else len(data)
        yield data[start:end].replace(b".", b" . ").split()
        start = end


def _buffers(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[list[bytes], np.ndarray, list[str], np.ndarray]]:
    """(words, numbers, langs, lang of each) of a task's texts, in buffers.

    Grams begin at all but the last `longest` - 1 numbers of a buffer; these lead the next one.
    """
    ids, langs, parts, of, held = _Ids(), {}, [], [], 0
    tail = longest - 1

    def flush() -> tuple:
        return list(ids), np.concatenate(parts), list(langs), np.concatenate(of)

    def add(words: list[bytes], lang: str) -> None:
        nonlocal held
        number = langs.setdefault(lang, len(langs))
        parts.append(np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words)))
        of.append(np.full(len(words), number, dtype=np.int64))
        held += len(words)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for words in _slices(text.as_py()):
                add(words, lang)
                if held >= BUFFER:
                    full = flush()
                    yield full
                    ids, langs, parts, of, held = _Ids(), {}, [], [], 0
                    for w, k in zip(full[1][-tail:], full[3][-tail:]):
                        add([full[0][w]], full[2][k])
            add([b"."], lang)
    if held:
        add([b"."] * tail, "")
        yield flush()


def _solid(
    words: list[bytes], numbers: np.ndarray, langs: list[str], of: np.ndarray, maps: list[np.ndarray], longest: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, solid) of the phrases of two, three ... words that begin at each number.

    A phrase is solid if it lies in one piece, the phrases in it are solid and its bit is set;
    the phrases one word longer than those of the last map are the last, and need no bit.
    """
    hashed = np.fromiter((xxhash.xxh64_intdigest(w, 11) for w in words), dtype=np.uint64, count=len(words))[numbers]
    lang = np.fromiter((xxhash.xxh64_intdigest(x.encode(), 12) for x in langs), dtype=np.uint64, count=len(langs))
    key, solid = hashed ^ lang[of], numbers > 0
    for size in range(2, min(len(maps) + 2, longest) + 1):
        key = key[:-1] * _ODD
        key ^= key >> np.uint64(31)
        key = (key + hashed[size - 1 :]) * _ODD2
        key ^= key >> np.uint64(29)
        solid = solid[:-1] & solid[1:]
        if size - 2 < len(maps):
            solid &= _bits(key, maps[size - 2])
        yield key, solid


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )


def solid_phrases(docs: DataFrame, maps: Broadcast, min_count: int, longest: int = LONGEST) -> DataFrame:
    """(phrase): hashes of the phrases one word longer than those of the last map that occur `min_count` times, by chance a few others."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, numbers, langs, lang in _buffers(batches, longest):
            *_, (key, solid) = _solid(words, numbers, langs, lang, maps.value, longest)
            starts = len(numbers) - longest + 1
            found, count = np.unique(key[:starts][solid[:starts]], return_counts=True)
            for start in range(0, len(found), 100_000):
                part = slice(start, start + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(found[part].view(np.int64)), pa.array(count[part])], names=["phrase", "n"])

    counted = _read(docs).mapInArrow(of, "phrase long, n long").groupBy("phrase").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count).select("phrase")


def solid_maps(docs: DataFrame, min_count: int, scratch: Scratch, longest: int = LONGEST, bits: int = BITMAP_BITS) -> Broadcast:
    """The bitmaps of solid phrases of two words, three, and so on up to a node."""
    context, maps = docs.sparkSession.sparkContext, []
    for size in range(2, max(longest, 3)):
        sent = context.broadcast(maps)
        maps = [*maps, bitmap(scratch.put(solid_phrases(docs, sent, min_count, longest), f"solid{size}"), bits)]
    return context.broadcast(maps)


def bitmap(phrases: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """The bytes of a bitmap of the hashes' highest bits, at most two to the power `bits` of them."""
    wanted = phrases.count() * BITMAP_LOAD
    bits = min(max(wanted.bit_length(), CHUNK_BITS), bits)
    place = F.shiftrightunsigned("phrase", 64 - bits)
    chunks = phrases.groupBy(F.shiftright(place, CHUNK_BITS).alias("chunk")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1))).alias("bits")
    )
    found = np.zeros(1 << (bits - 3), dtype=np.uint8)
    size = 1 << (CHUNK_BITS - 3)
    for row in chunks.toLocalIterator():
        found[row.chunk * size : (row.chunk + 1) * size] = np.frombuffer(row.bits, dtype=np.uint8)
    return found


def _bits(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    bits = len(found).bit_length() + 2
    place = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return (found[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def grams(docs: DataFrame, maps: Broadcast, longest: int = LONGEST) -> DataFrame:
    """(lang, words, size, n): the longest solid gram that begins at each word, counted."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, numbers, langs, lang in _buffers(batches, longest):
            starts = np.flatnonzero(numbers[: len(numbers) - longest + 1])
            going = [solid[starts] for _, solid in _solid(words, numbers, langs, lang, maps.value, longest)]
            columns, gram = [numbers[starts]], lang[starts]
            for k in range(longest):
                if k:
                    columns.append(np.where(going[k - 1], numbers[starts + k], 0))
                    # One number for the gram so far: exact, and below the number of starts again.
                    gram = np.unique(gram, return_inverse=True)[1]
                gram = gram * len(words) + columns[-1]
            _, first, count = np.unique(gram, return_index=True, return_counts=True)
            for start in range(0, len(first), 50_000):
                at = first[start : start + 50_000]
                rows = zip(*(c[at].tolist() for c in columns))
                text = [b" ".join([words[w] for w in row if w]) for row in rows]
                size = sum((c[at] > 0).astype(np.int32) for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([langs[x] for x in lang[starts[at]].tolist()]),
                        pa.array(text, type=pa.binary()).cast(pa.string()),
                        pa.array(size),
                        pa.array(count[start : start + 50_000]),
                    ],
                    names=["lang", "words", "size", "n"],
                )

    found = _read(docs).mapInArrow(of, "lang string, words string, size int, n long")
    return found.groupBy("lang", "words", "size").agg(F.sum("n").alias("n"))


def flow(counted: DataFrame, scratch: Scratch, min_count: int, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, words, size, n) of all phrases of up to `longest` words that occur `min_count` times, (lang, total) of words).

    The count of a phrase is the flow out of it: the grams one word longer that it begins, and the
    pieces that end with it.
    """
    levels = [counted.filter(F.col("size") == longest)]
    for size in range(longest - 1, 0, -1):
        out = levels[-1].select("lang", F.substring_index("words", " ", size).alias("words"), "n")
        ends = counted.filter(F.col("size") == size).select("lang", "words", "n")
        summed = out.unionByName(ends).groupBy("lang", "words").agg(F.sum("n").alias("n"))
        levels.append(scratch.put(summed.withColumn("size", F.lit(size)), f"flow{size}"))
    total = levels[-1].groupBy("lang").agg(F.sum("n").alias("total"))
    solid = [x.select("lang", "words", F.col("size").cast("int").alias("size"), "n").filter(F.col("n") >= min_count) for x in levels]
    everything = solid[0]
    for x in solid[1:]:
        everything = everything.unionByName(x)
    return scratch.put(everything, "phrases"), scratch.put(total, "totals")


def paths(phrases: DataFrame, scratch: Scratch, longest: int = LONGEST) -> DataFrame:
    """(lang, words array, n): the maximal unary paths of the graph, each edge in exactly one.

    An edge goes on to the next if both weigh what the node between them does: then every
    occurrence of the one is followed by the other. No path is a circle, as pieces end.
    """
    tail = F.substring_index("words", " ", 1 - longest)
    edges = phrases.filter(F.col("size") == longest).select("lang", "words", "n")
    nodes = phrases.filter(F.col("size") == longest - 1).select("lang", F.col("words").alias("node"), F.col("n").alias("flow"))
    out = edges.withColumn("node", F.substring_index("words", " ", longest - 1)).join(nodes, ["lang", "node"]).filter("n = flow")
    into = edges.withColumn("node", tail).join(nodes, ["lang", "node"]).filter("n = flow")
    before = into.select("lang", "node", F.col("words").alias("earlier")).join(out.select("lang", "node", "words"), ["lang", "node"])
    state = scratch.put(
        edges.join(before.select("lang", "words", "earlier"), ["lang", "words"], "left")
        .select("lang", "words", "n", F.coalesce("earlier", "words").alias("head"), F.col("earlier").isNotNull().cast("long").alias("place")),
        "heads0",
    )
    for step in range(1, MAX_ROUNDS + 1):
        # An edge's pointer goes where the edge it points at points; the first edge of a path points at itself.
        behind = state.filter("place > 0").select("lang", F.col("words").alias("head"), F.col("head").alias("far"), F.col("place").alias("more"))
        if state.join(behind, ["lang", "head"], "left_semi").isEmpty():
            break
        state = scratch.put(
            state.join(behind, ["lang", "head"], "left")
            .select("lang", "words", "n", F.coalesce("far", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")),
            f"heads{step % 2}",
        )
    else:
        raise RuntimeError(f"paths did not settle in {MAX_ROUNDS} rounds")
    last = F.transform(F.array_sort(F.collect_list(F.struct("place", F.substring_index("words", " ", -1).alias("word")))), lambda x: x["word"])
    gathered = state.groupBy("lang", "head").agg(last.alias("ends"), F.first("n").alias("n"))
    words = F.concat(F.split(F.substring_index("head", " ", longest - 1), " "), F.col("ends"))
    return scratch.put(gathered.select("lang", words.alias("words"), "n"), "paths")


def _parts_of_paths(found: DataFrame, size: int) -> DataFrame:
    """(lang, words, n) of the phrases of `size` words along the paths."""
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - (size - 1)), lambda i: F.concat_ws(" ", F.slice("words", i, size)))
    return found.select("lang", F.explode(F.array_distinct(windows)).alias("words"), "n")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, longest: int = LONGEST, bitmap_bits: int = BITMAP_BITS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words.

    `a` is how often a phrase occurs (at least `min_count` times), `l` and `r` how often the two
    parts of its worst cut do, `n` how many words the language has. Phrases that lie within a
    longer one in at least `PART_OF` of 100 cases are left out. Counted over all rows of `docs`:
    repeated rows count each time, null texts are empty, a null lang is `und`, ids are not read.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    maps = solid_maps(docs, min_count, scratch, longest, bitmap_bits)
    counted = scratch.put(grams(docs, maps, longest), "grams", "zstd")
    phrases, totals = flow(counted, scratch, min_count, longest)
    scratch.clear(keep=("phrases", "totals"))
    found = paths(phrases, scratch, longest)

    candidates = phrases.filter("size > 1")
    # The most occurrences of any longer phrase around a phrase: of paths, and of the phrases shorter than an edge.
    around = None
    for size in range(2, longest):
        here = _parts_of_paths(found, size)
        for longer in range(size + 1, longest):
            wider = candidates.filter(F.col("size") == longer).select("lang", F.split("words", " ").alias("words"), "n")
            here = here.unionByName(_parts_of_paths(wider, size))
        around = here if around is None else around.unionByName(here)
    if around is not None:
        most = around.groupBy("lang", "words").agg(F.max("n").alias("most"))
        candidates = candidates.join(most, ["lang", "words"], "left").filter(
            F.coalesce(F.col("most"), F.lit(0)).cast("decimal(38,0)") * 100 < F.col("n").cast("decimal(38,0)") * PART_OF
        )
    return best(scored(scratch.put(candidates.select("lang", "words", "size", "n"), "candidates"), phrases), totals, top)


def scored(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut; of equal scores that after the fewest words."""
    cuts = candidates.select("lang", "words", "size", "n", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    halves = F.array(
        F.struct(F.lit(True).alias("front"), F.expr("substring_index(words, ' ', cut)").alias("part")),
        F.struct(F.lit(False).alias("front"), F.expr("substring_index(words, ' ', cut - size)").alias("part")),
    )
    counts = phrases.select("lang", F.col("words").alias("part"), F.col("n").alias("m"))
    of = lambda front: F.max(F.when(F.col("front") == front, F.col("m")))
    joined = cuts.select("lang", "words", "n", "cut", F.inline(halves)).join(counts, ["lang", "part"])
    whole = joined.groupBy("lang", "words", "n", "cut").agg(of(True).alias("l"), of(False).alias("r"))
    score = F.expr(f"(cast({SCALE} as decimal(18,0)) * cast(n as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    return (
        whole.groupBy("lang", "words", "n")
        .agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))
        .select("lang", F.col("words").alias("phrase"), F.col("n").alias("a"), "x.l", "x.r", "x.score")
    )


def best(phrases: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language; first those of many parts, so that no task sorts a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    few = phrases.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
