"""Fill-in-the-middle: the lines of a text are cut in three blocks, and the middle one is asked for last.

A text is a bytearray. Two cuts split its lines into prefix, middle and suffix, the sentinels
are inserted in front of the three blocks, and the blocks are brought into the order of the form
by rotations in place, each of three reversals. Restoring finds the sentinels, rotates the other
way and deletes them. Nothing but the array itself grows with the text: reversals move it in
pieces of `STEP` bytes.

Forms: `psm` is prefix, suffix, middle; `spm` is suffix, prefix, middle; `plain` is the text as
it is: an empty one, one that holds a sentinel, or one that the rate leaves alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm.common import fresh

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
STEP = 1 << 16
_REST = bytes(range(0x80, 0xC0))  # bytes that continue a code point

FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
]


def reverse(data: bytearray, start: int, end: int) -> None:
    """Turn data[start:end] around in place."""
    while end - start > 2 * STEP:
        left = data[start : start + STEP]
        data[start : start + STEP] = data[end - STEP : end][::-1]
        data[end - STEP : end] = left[::-1]
        start, end = start + STEP, end - STEP
    data[start:end] = data[start:end][::-1]


def rotate(data: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange data[start:middle] and data[middle:end] in place."""
    reverse(data, start, middle)
    reverse(data, middle, end)
    reverse(data, start, end)


def count_lines(data: bytes | bytearray) -> int:
    return data.count(b"\n") + (len(data) > 0 and not data.endswith(b"\n"))


def line_offset(data: bytes | bytearray, lines: int, start: int = 0) -> int:
    """Where the first `lines` lines from `start` on end."""
    for _ in range(lines):
        start = data.find(b"\n", start) + 1 or len(data)
    return start


def _chars(data: bytearray, start: int, end: int) -> int:
    """Code points of data[start:end]."""
    return sum(len(data[i : min(i + STEP, end)].translate(None, _REST)) for i in range(start, end, STEP))


def encode(data: bytearray, draws: tuple[int, int, int, int], rate: int, suffix_first: int) -> tuple[int, str, int | None, int | None]:
    """Bring a text into its form in place: (lines, form, code points of the prefix, of the middle).

    The first two draws choose the cuts, the third is held against `rate` and the fourth
    against `suffix_first`, both in percent.
    """
    n = count_lines(data)
    if not data or draws[2] % 100 >= rate or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None
    first, second = sorted(d % (n + 1) for d in draws[:2])
    cut = line_offset(data, first)
    end = line_offset(data, second - first, cut)
    chars = _chars(data, 0, cut), _chars(data, cut, end)
    data[end:end] = SUFFIX
    data[cut:cut] = MIDDLE
    data[0:0] = PREFIX
    cut, end = cut + MARK, end + 2 * MARK
    if draws[3] % 100 < suffix_first:
        rotate(data, 0, end, len(data))
        return n, "spm", *chars
    rotate(data, cut, end, len(data))
    return n, "psm", *chars


def decode(data: bytearray, form: str) -> None:
    """The text again, in place."""
    if form == "plain":
        return
    if form == "psm":
        cut = data.find(SUFFIX)
        moved = data.find(MIDDLE, cut)
        rotate(data, cut, moved, len(data))  # middle before suffix
        end = cut + len(data) - moved
    else:
        start = data.find(PREFIX)
        rotate(data, 0, start, len(data))  # prefix and middle before suffix
        cut, end = data.find(MIDDLE), len(data) - start
    del data[end : end + MARK]
    del data[cut : cut + MARK]
    del data[:MARK]


def draws(seed: int, doc_id: object) -> tuple[int, int, int, int]:
    """Four whole numbers below 2^32 that depend on nothing but the seed and the id; a null id counts as ''."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def transform(
    docs: DataFrame, rate: int = 100, suffix_first: int = 50, seed: int = 7, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """`docs` with n (lines), form, prefix_chars, middle_chars (null if plain) and output.

    Of the texts that can be cut, `rate` percent are, `suffix_first` percent of them as spm. A
    null text counts as an empty one, and a null id draws like an empty id; repeated rows are
    treated alike. Columns of `docs` by the names of the results are replaced by these.
    """
    kept = docs.drop(*[f.name for f in FIELDS if f.name not in (text, doc_id)])
    names = [fresh(kept, x) for x in ("_text", "_id")]
    given = kept.withColumns({names[0]: F.coalesce(F.col(text), F.lit("")).cast("binary"), names[1]: F.col(doc_id).cast("string")})
    schema = T.StructType([f for f in kept.schema.fields if f.name not in {x.name for x in FIELDS}] + FIELDS)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.num_columns - 2
            outputs, rest = [], []
            for value, name in zip(batch.column(own), batch.column(own + 1)):
                data = bytearray(value.as_py())
                rest.append(encode(data, draws(seed, name.as_py()), rate, suffix_first))
                outputs.append(bytes(data))
            columns = [pa.array(x, type=t) for x, t in zip(list(zip(*rest)) or [[]] * 4, (pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            held = [batch.column(i) for i, f in enumerate(batch.schema.names[:own]) if f in schema.names[: -len(FIELDS)]]
            yield pa.RecordBatch.from_arrays([*held, *columns, pa.array(outputs, type=pa.binary()).cast(pa.string())], names=schema.names)

    return given.mapInArrow(of, schema)


def restore(done: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """`done` with the text that each output was made of; a null output gives a null."""
    kept = done.drop(name)
    columns = [*kept.columns, fresh(kept, "_output"), fresh(kept, "_form")]
    given = kept.select("*", F.col(output).cast("binary").alias(columns[-2]), F.col(form).alias(columns[-1]))
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.StringType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, texts = batch.num_columns - 2, []
            for value, kind in zip(batch.column(own), batch.column(own + 1)):
                data = bytearray(value.as_py() or b"")
                decode(data, kind.as_py() or "plain")
                texts.append(bytes(data) if value.is_valid else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(own)), pa.array(texts, type=pa.binary()).cast(pa.string())], names=schema.names
            )

    return given.mapInArrow(of, schema)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): one row per row of `docs`."""
    done = restore(transform(docs.select("doc_id", "text")).drop("text"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256")
    )
