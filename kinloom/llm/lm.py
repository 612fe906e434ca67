"""Scoring of whole documents by a recurrent language model that is trained on the corpus.

Counting, encoding, training and scoring are Spark jobs:

1. tokens of the training documents are counted (partial counts per batch, one shuffle);
2. documents are encoded once: ids of the model's vocabulary, the unigram sum over frequent
   tokens (a table of at most HEAD_TOKENS, sent to all tasks), and the rest of their tokens by
   name, which meet their counts in a join;
3. every training document is learned once. Training runs in two rounds: in each, every task
   takes its share of a round's documents from the common weights, and Spark averages the
   tasks' weights, by tokens, weight by weight;
4. all documents are scored with the final weights.

A word outside the model's vocabulary has the model's probability of the vocabulary's
stand-in times its unigram share among such words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm import gru
from kinloom.llm.simhash import _pieces
from kinloom.session import Scratch

HEAD_TOKENS = 1 << 18  # most frequent tokens that are sent to all tasks, at most
ROUNDS = 2
RATE = 0.05
LANES, STEPS = 256, 32
SCORING_LANES, SCORING_STEPS = 512, 64
END = b""  # the end of a document; no word is empty
FLUSH = 200_000  # distinct tokens a task holds before it passes its counts on


def text_bytes(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def held_out(doc_id: Column) -> Column:
    """One document in ten by its id; a null id counts as the empty text and is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) over `docs`: words with A-Z as a-z, and one end per document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), type=pa.binary()), pa.array(held.values(), type=pa.int64())], names=["token", "c"]
            )
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                for words in _pieces(text.as_py().lower()):
                    held.update(words)
                held[END] += 1
                if len(held) > FLUSH:
                    yield told()
        if held:
            yield told()

    return docs.select(text_bytes(docs)).mapInArrow(of, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _head(counts: DataFrame) -> tuple[list[tuple[bytes, int]], int]:
    """The most frequent tokens with counts, most frequent first, and the least count among them.

    All tokens of the same count are in or out, so the table is the same in any order.
    """
    # Bins of counts, eight to an octave; within a bin that is cut, every token is out.
    edge = F.floor(F.log2("c") * 8).cast("int")
    bins = counts.groupBy(edge.alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("bin")).collect()
    taken, least = 0, None
    for b in bins:
        if taken + b.n > HEAD_TOKENS:
            break
        taken, least = taken + b.n, b.least
    if least is None:
        return [], 1 << 62
    rows = [(bytes(r.token), r.c) for r in counts.filter(F.col("c") >= least).collect()]
    return sorted(rows, key=lambda r: (-r[1], r[0])), least


def _long_first(encoded: DataFrame) -> DataFrame:
    """A task's longest documents first, so that its lanes end about together."""
    return encoded.sortWithinPartitions(F.octet_length("ids").desc(), "row")


def _average(encoded: DataFrame, flat: np.ndarray, shape: gru.Shape, round_: int) -> np.ndarray:
    """The weights after one round, averaged over tasks in proportion to the tokens they learned from."""
    sent = encoded.sparkSession.sparkContext.broadcast(flat)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = (np.frombuffer(x.as_py(), dtype="<u2").astype(np.int64) for batch in batches for x in batch.column(0))
        learned, seen = gru.train(sent.value, shape, docs, LANES, STEPS, RATE / (1 + round_))
        if seen:
            values = np.append(learned.astype(np.float64) * seen, seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["k", "v"])

    mine = ~F.col("held_out") & (F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == round_)
    sums = _long_first(encoded.filter(mine).select("row", "ids")).select("ids").mapInArrow(learn, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    rows = sums.toArrow()
    if not rows.num_rows:
        return flat
    values = np.empty(len(flat) + 1)
    values[rows.column("k").to_numpy()] = rows.column("v").to_numpy()
    return (values[:-1] / values[-1]).astype(np.float32)


def score_documents(docs: DataFrame, shape: gru.Shape = gru.Shape()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of `docs`.

    A null text counts as empty: its only token is the end. Scores are log10. Repeated rows
    are learned from and scored each; without training documents the model is uniform.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    training = docs.filter(~held_out(F.col("doc_id")))
    counts = scratch.put(count_tokens(training), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    below = total + 0.1 * (distinct + 1)
    head, least = _head(counts)
    # The vocabulary's first id is the stand-in for all other words.
    words = [t for t, _ in head[: shape.words - 1]]
    inside = sum(c for _, c in head[: shape.words - 1])
    frequency = np.zeros(shape.words)
    frequency[0] = total - inside
    frequency[1 : len(words) + 1] = [c for _, c in head[: shape.words - 1]]
    others = np.log10(below) - np.log10(total - inside + 0.1 * (distinct - len(words) + 1))
    # By rank in the head: the id in the vocabulary, and the unigram share. The last entry is for all other tokens.
    ids_of = np.zeros(len(head) + 1, dtype="<u2")
    ids_of[: len(words)] = np.arange(1, len(words) + 1)
    share_of = np.append(np.log10((np.array([c for _, c in head], dtype=float) + 0.1) / below), 0.0)
    sent = spark.sparkContext.broadcast(({t: k for k, (t, _) in enumerate(head)}, ids_of, share_of))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, ids_of, share_of = sent.value
        rank = ranks.get
        for batch in batches:
            rows = []
            for text in batch.column(0):
                ids, tail, known, base, outside, n_outside = [], [], 0, 0.0, 0.0, 0
                for words in (*_pieces(text.as_py().lower()), [END]):
                    found = np.fromiter(map(rank, words, repeat(-1)), dtype=np.int64, count=len(words))
                    ids.append(ids_of[found])
                    rare = np.flatnonzero(found < 0)
                    tail += [words[k] for k in rare]
                    known += len(words) - len(rare)
                    base += float(share_of[found].sum())
                    strange = found[ids[-1] == 0]
                    outside += float(share_of[strange].sum())
                    n_outside += len(strange)
                rows.append((b"".join(i.tobytes() for i in ids), tail, known, base, outside, n_outside))
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *[pa.array(c, type=t) for c, t in zip(columns, types)]],
                names=["doc_id", "held_out", "ids", "tail", "known", "base", "outside", "n_outside"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = scratch.put(
        docs.select(text_bytes(docs), "doc_id", held_out(F.col("doc_id")).alias("held_out"))
        .mapInArrow(encode, f"doc_id {kind}, held_out boolean, ids binary, tail array<binary>, known long, base double, outside double, n_outside long")
        .withColumn("row", F.monotonically_increasing_id()),
        "encoded",
        "zstd",
    )
    # The other tokens meet their counts by name; a token that training did not see counts zero.
    rare = encoded.select("row", F.explode("tail").alias("token"))
    seen = rare.join(counts.filter(F.col("c") < least), "token", "left")
    rest = seen.groupBy("row").agg(
        F.count("c").alias("rest_known"), F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(below))).alias("rest")
    )
    flat = gru.initial(shape, frequency)
    for k in range(ROUNDS):
        flat = _average(encoded, flat, shape, k)
    model = spark.sparkContext.broadcast(flat)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def texts() -> Iterator[np.ndarray]:
            for batch in batches:
                kept.append(batch.drop_columns(["ids"]))
                for x in batch.column("ids"):
                    yield np.frombuffer(x.as_py(), dtype="<u2").astype(np.int64)

        found = gru.score(model.value, shape, texts(), SCORING_LANES, SCORING_STEPS) / np.log(10)
        at = 0
        for batch in kept:
            yield batch.append_column("neural", pa.array(found[at : at + batch.num_rows]))
            at += batch.num_rows

    n_tokens = (F.octet_length("ids") / 2).cast("long")
    narrow = encoded.select("row", "doc_id", "held_out", "known", "base", "outside", "n_outside", n_tokens.alias("n_tokens"), "ids")
    schema = ", ".join(f"{n} {t}" for n, t in narrow.drop("ids").dtypes) + ", neural double"
    scored = _long_first(narrow).mapInArrow(score, schema).join(rest, "row", "left")
    base = F.col("base") + F.coalesce("rest", F.lit(0.0))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("neural") + F.col("outside") + F.coalesce("rest", F.lit(0.0)) + F.lit(float(others)) * F.col("n_outside")).alias("score"),
    )
