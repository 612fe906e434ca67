"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, overlap check.

Every passage of every document is a query. The index holds the test items: postings carry
a term's BM25 weight in an item, divided by the score the item gives itself, so a score is
the share of an item's weight that a passage covers and one threshold fits all items.

Per passage, terms are sorted by their largest weight. Terms whose bounds together stay
below the threshold cannot lift an item over it alone; the others (the pivot and above) name
the blocks that can hold a hit. A block is scored only if the largest weights of its terms
in that block, plus what the skipped terms can add, reach the threshold. Hits are exact.

A hit counts if the passage also repeats the item's question and its answer close together:
of either, at least `overlap` of the words appear in the same order in one window of about
twice the item's own length, however long the passage is. An item of fewer than FEW words has
to appear word for word without gaps, and a single word only counts as a text of its own.

Documents are never moved: the index goes to them, in blocks of items of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
FEW = 4  # words below which an item counts only word for word
BLOCK = 8  # postings that share one bound
TOGETHER = 50_000  # words of texts that are looked up in one go
INDEX_BYTES = 32 << 20  # text of the items that one index, sent to all executors, may hold

_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: cut after the last question mark that something follows, else the last third is the answer."""
    question, mark, answer = text.rpartition("?")
    if mark and tokens(question) and tokens(answer):
        return tokens(question), tokens(answer)
    found = tokens(text)
    cut = len(found) - len(found) // 3
    return found[:cut], found[cut:]


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bits of one integer as the row of the table."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for word in b:
        hit = row & places.get(word, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def repeats(question: list[str], answer: list[str], inside: list[str], overlap: float) -> tuple[float, float] | None:
    """Shares of question and answer in the window that repeats both best; None if none repeats `overlap` of each."""

    def shares(part: list[str]) -> tuple[float, float]:
        return tuple(common_words(x, part) / len(x) if x else 1.0 for x in (question, answer))

    item = question + answer
    n = len(item)
    if n == 1:
        return (1.0, 1.0) if inside == item else None
    if n < FEW:
        return (1.0, 1.0) if any(inside[k : k + n] == item for k in range(len(inside) - n + 1)) else None
    best = shares(inside)
    if min(best) < overlap or len(inside) <= 2 * n:
        return best if min(best) >= overlap else None
    step = max(1, n // 4)
    best = max((shares(inside[k : k + 2 * n]) for k in range(0, len(inside) - 2 * n + step, step)), key=min)
    return best if min(best) >= overlap else None


@dataclass
class Index:
    """Terms are numbered by rising bound. Postings of term t: begin[t] to begin[t + 1], by item."""

    terms: dict[str, int]
    bound: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    block_begin: np.ndarray  # the blocks of term t
    block_key: np.ndarray  # term * n_blocks + block, sorted
    block_bound: np.ndarray
    n_blocks: int
    ids: list
    parts: list[tuple[list[str], list[str]]]
    window: int

    @staticmethod
    def build(items: list[tuple[object, str]], frequency: dict[str, int], n_items: int, mean_length: float) -> Index:
        # Items that begin alike stand together, so that block bounds are tight.
        items = sorted(items, key=lambda x: (sorted(tokens(x[1]), key=lambda w: -frequency[w])[:4], str(x[0])))
        rows = []
        for k, (_, text) in enumerate(items):
            found = tokens(text)
            counts = {w: found.count(w) for w in set(found)}
            norm = K1 * (1 - B + B * len(found) / mean_length)
            weights = {
                w: np.log1p((n_items - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in counts.items()
            }
            total = sum(weights.values())
            rows += [(w, k, v / total) for w, v in weights.items()]
        bounds: dict[str, float] = {}
        for w, _, v in rows:
            bounds[w] = max(bounds.get(w, 0.0), v)
        terms = {w: t for t, w in enumerate(sorted(bounds, key=lambda w: (bounds[w], w)))}
        rows = sorted((terms[w], k, v) for w, k, v in rows)
        term, item = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)
        weight = np.array([r[2] for r in rows])
        n_blocks = len(items) // BLOCK + 1
        key, start = np.unique(term * n_blocks + item // BLOCK, return_index=True)
        numbers = np.arange(len(terms) + 1)
        return Index(
            terms,
            np.array(sorted(bounds.values())),
            np.searchsorted(term, numbers),
            item,
            weight,
            np.searchsorted(key, numbers * n_blocks),
            key,
            np.maximum.reduceat(weight, start) if len(rows) else weight,
            n_blocks,
            [i for i, _ in items],
            [split_item(text) for _, text in items],
            max([8, *(len(tokens(text)) for _, text in items)]),
        )

    def _ranges(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, place) of the places of many ranges."""
        size = end - begin
        owner = np.repeat(np.arange(len(size)), size)
        return owner, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)

    def hits(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) from distinct (passage, term) pairs sorted by passage and term, hence by bound."""
        bound = self.bound[term]
        first = np.searchsorted(passage, passage)
        running = np.cumsum(bound)
        below = running - (running[first] - bound[first])  # in the passage, up to and with this term
        pivot = below >= threshold - 1e-9
        if not pivot.any():
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        skipped = np.zeros(passage[-1] + 1)
        np.maximum.at(skipped, passage[~pivot], below[~pivot])
        at = np.flatnonzero(pivot)
        owner, place = self._ranges(self.block_begin[term[at]], self.block_begin[term[at] + 1])
        pairs = passage[at][owner] * self.n_blocks + self.block_key[place] % self.n_blocks
        found, inverse = np.unique(pairs, return_inverse=True)
        reach = np.bincount(inverse, self.block_bound[place]) + skipped[found // self.n_blocks]
        found = found[reach >= threshold - 1e-9]
        # All terms of the passage again, now with their bounds in this very block.
        whose, block = found // self.n_blocks, found % self.n_blocks
        owner, place = self._ranges(np.searchsorted(passage, whose), np.searchsorted(passage, whose, side="right"))
        key = term[place] * self.n_blocks + block[owner]
        spot = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
        there = self.block_key[spot] == key
        reach = np.bincount(owner[there], self.block_bound[spot[there]], minlength=len(found))
        good = there & (reach >= threshold - 1e-9)[owner]
        owner, key = owner[good], key[good]
        # The postings of these terms in these blocks.
        start = term[place[good]]
        mine, posting = self._ranges(self.begin[start], self.begin[start + 1])
        inside = self.item[posting] // BLOCK == block[owner[mine]]
        mine, posting = mine[inside], posting[inside]
        scored = whose[owner[mine]] * (self.n_blocks * BLOCK) + self.item[posting]
        hit, inverse = np.unique(scored, return_inverse=True)
        score = np.bincount(inverse, self.weight[posting], minlength=len(hit))
        over = score >= threshold - 1e-9
        return hit[over] // (self.n_blocks * BLOCK), hit[over] % (self.n_blocks * BLOCK), score[over]

    def search(self, texts: list[str | None], threshold: float, overlap: float) -> Iterator[list[tuple]]:
        """Per text: (item id, first word of the passage, score, question overlap, answer overlap), the best passage per item.

        Passages are twice as long as the longest item and overlap by half, so each copy of
        an item lies whole in one of them; `repeats` then looks at windows of the item's own size. Texts are looked up together, TOGETHER words at a time.
        """
        held: list[list[str]] = []
        words = 0
        for text in texts:
            held.append(tokens(text))
            words += len(held[-1])
            if words >= TOGETHER:
                yield from self._search(held, threshold, overlap)
                held, words = [], 0
        yield from self._search(held, threshold, overlap)

    def _search(self, texts: list[list[str]], threshold: float, overlap: float) -> list[list[tuple]]:
        best: list[dict[int, tuple]] = [{} for _ in texts]
        sizes = np.array([len(found) // self.window + 1 for found in texts], dtype=np.int64)
        first = np.cumsum(sizes) - sizes  # the number of each text's first passage
        get, n = self.terms.get, sum(map(len, texts))
        ids = np.fromiter((get(w, -1) for found in texts for w in found), dtype=np.int64, count=n)
        lengths = np.array([len(found) for found in texts], dtype=np.int64)
        begin = np.repeat(first, lengths)
        passage = begin + (np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // self.window
        known = ids >= 0
        ids, passage, begin = ids[known], passage[known], begin[known]
        if not len(ids):
            return [[] for _ in texts]
        both = np.concatenate([passage, np.maximum(passage - 1, begin)])
        pair = np.unique(both * len(self.terms) + np.concatenate([ids, ids]))
        for p, k, score in zip(*self.hits(pair // len(self.terms), pair % len(self.terms), threshold)):
            t = int(np.searchsorted(first, p, side="right")) - 1
            start = int(p - first[t]) * self.window
            inside = texts[t][start : start + 2 * self.window]
            question, answer = self.parts[k]
            # A single word is compared with all of a text.
            told = repeats(question, answer, texts[t] if len(question) + len(answer) == 1 else inside, overlap)
            if told:
                row = (self.ids[k], start, float(score), *told)
                if k not in best[t] or (row[2], -row[1]) > (best[t][k][2], -best[t][k][1]):
                    best[t][k] = row
        return [[found[k] for k in sorted(found)] for found in best]


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", index_bytes: int = INDEX_BYTES) -> list[Index]:
    """Indexes over all items, each with at most about `index_bytes` of text. Items without words are left out.

    Document frequencies and the mean length are those of all items. Items whose text
    repeats are each indexed.
    """
    spark = items.sparkSession
    usable = items.select(F.col(item_id).alias("id"), F.col(text).alias("t")).filter(F.col("t").rlike(r"[\p{L}\p{N}_]"))
    size = usable.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if not size:
        return []
    parts = -(-size // index_bytes)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [tokens(x.as_py()) for x in batch.column(0)]
            pairs = [w for found in lists for w in set(found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([""] * len(lists) + pairs), pa.array([*map(len, lists), *[0] * len(pairs)], type=pa.int64())], names=["w", "n"]
            )

    counted = usable.select("t").mapInArrow(measure, "w string, n long").groupBy("w").agg(F.count("*").alias("df"), F.sum("n").alias("n"))
    total = counted.filter("w = ''").first()
    found = []
    for k in range(parts):
        part = [(r.id, r.t) for r in usable.filter(F.pmod(F.xxhash64("id", "t"), F.lit(parts)) == k).collect()]
        part = [x for x in part if tokens(x[1])]
        if not part:
            continue
        mine = spark.createDataFrame([(w,) for w in {w for _, t in part for w in tokens(t)}], "w string")
        frequency = {r.w: r.df for r in counted.join(mine, "w").select("w", "df").collect()}
        found.append(Index.build(part, frequency, total.df, total.n / total.df))
    return found


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """(doc_id, item_id, passage, score, question_overlap, answer_overlap): what every document holds of the items.

    `passage` is the number of the passage's first word. Documents with a null or empty
    text hold nothing; a repeated row gives its rows again; null ids pass through.
    """
    spark = docs.sparkSession
    types = [docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {types[0]}, item_id {types[1]}, passage long, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    names = [x.split()[0] for x in schema.split(", ")]
    for index in indexes(items, index_bytes=index_bytes):
        sent = spark.sparkContext.broadcast(index)

        def of(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                found = index.search(batch.column(1).to_pylist(), threshold, overlap)
                rows = [(k, *hit) for k, hits in enumerate(found) for hit in hits]
                columns = list(zip(*rows)) or [[] for _ in range(6)]
                ids = batch.column(0).take(pa.array(columns[0], type=pa.int64()))
                rest = [pa.array(c) for c in columns[1:]] if rows else None
                if rest:
                    yield pa.RecordBatch.from_arrays([ids, *rest], names=names)

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(of, schema))
    return out


def drop_contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """The rows of `docs` that hold no item, columns unchanged; they stay where they are."""
    spark = docs.sparkSession
    for index in indexes(items, index_bytes=index_bytes):
        sent = spark.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not hits for hits in sent.value.search(texts, threshold, overlap)], type=pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
