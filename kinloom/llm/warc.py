"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with a seek table (a skippable
frame of compressed and uncompressed frame sizes), and an index maps every record to its
bundle, frame, and offset inside the uncompressed frame. A record is read by one seek and
one frame.

Tasks write their own bundles straight to the shared folder, under names no other attempt
uses, and report the index rows. What a lost attempt left behind is in no index.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.session import Scratch, workspace

FRAME_BYTES = 1 << 18  # uncompressed bytes after which a frame is closed
BUNDLE_BYTES = 1 << 26  # compressed bytes after which a bundle is closed
RUN, TASK_RUNS = 64, 8  # frames read in a run, and runs read by a task: 128 MB
MIN_PAYLOAD = 0  # smaller payloads are stored in full each time

# Marks of the seekable Zstandard format, the revisit profile, the date of all records.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id string, bundle string, frame long, offset long, length long"
RECORDS = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary"


def storage(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder and the folder's path in it."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def _uri(page_id: str | None) -> str:
    return f"<urn:page:{'' if page_id is None else 'id:' + quote(page_id, safe='')}>"


def _page(uri: str) -> str | None:
    name = uri.removeprefix("<urn:page:").removesuffix(">")
    return unquote(name.removeprefix("id:")) if name else None


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream: io.BytesIO) -> Iterator[dict]:
    """The records of an uncompressed frame; payloads are checked against their digests."""
    while stream.readline().strip():
        head = {}
        while line := stream.readline().strip():
            name, _, value = line.decode().partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit, digest = head["WARC-Type"] == "revisit", head["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
        url = head.get("WARC-Target-URI")
        yield {
            "page_id": _page(head["WARC-Record-ID"]),
            "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
            "payload_digest": digest,
            "record_type": head["WARC-Type"],
            "refers_to": _page(head["WARC-Refers-To"]) if revisit else None,
            "url": None if url is None else unquote(url),
            "payload": None if revisit else payload,
        }


class BundleWriter:
    """Frames and their seek table in one file."""

    def __init__(self, folder: str) -> None:
        fs, path = storage(folder)
        fs.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self.frames: list[tuple[int, int]] = []
        self.held = bytearray()
        self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        place = len(self.frames), len(self.held)
        self.held += data
        if len(self.held) >= FRAME_BYTES:
            self.close_frame()
        return place

    def close_frame(self) -> None:
        if self.held:
            packed = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(bytes(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.held)))
            self.written += len(packed)
            self.held = bytearray()

    def close(self) -> None:
        self.close_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Frames of a bundle by number."""

    def __init__(self, folder: str, name: str) -> None:
        fs, path = storage(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        self.file.seek(size - 9)
        count, _, mark = struct.unpack("<IBI", self.file.read(9))
        if mark != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        self.file.seek(size - 9 - 8 * count)
        self.sizes = list(struct.iter_unpack("<II", self.file.read(8 * count)))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        self.file.seek(self.starts[k])
        return zstandard.ZstdDecompressor().decompress(self.file.read(self.sizes[k][0]), max_output_size=self.sizes[k][1])

    def close(self) -> None:
        self.file.close()


def write_archives(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Writes a record per row of `pages` (page_id, url, html) into bundles under `folder`; returns the index.

    Of the rows whose payloads are equal and have at least `min_payload` bytes, those with the
    smallest page_id are responses, the others revisit them; smaller payloads are all responses.
    A null html is an empty payload. Rows that repeat a page_id give a record each. A null
    page_id comes after all others.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"))
    first = scratch.put(first, "first")
    # A plain equi-join of two shuffles: a payload that a third of the pages share is split over tasks.
    joined = rows.join(first, "digest").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("first").cast("string").alias("first"),
        ((F.octet_length("payload") >= min_payload) & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            index = []
            for page_id, url, data, digest, refers_to, revisit in zip(*(batch.column(k) for k in range(6))):
                bundle = bundle or BundleWriter(folder)
                page_id = page_id.as_py()
                name = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                packed = record(page_id, url.as_py(), data.as_py(), name, refers_to.as_py(), revisit.as_py())
                index.append((page_id, bundle.name, *bundle.add(packed), len(packed)))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if index:
                columns = list(zip(*index))
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(columns, types)], names=["page_id", "bundle", "frame", "offset", "length"]
                )
        if bundle:
            bundle.close()

    return scratch.put(joined.mapInArrow(write, INDEX), "index")


def _batches(rows: list[dict]) -> pa.RecordBatch:
    types = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=types.get(n, pa.string())) for n in names], names=names)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles that the index names, frame by frame."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, frames in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = BundleReader(folder, name)
                for k in sorted(frames):
                    yield _batches(list(parse(io.BytesIO(reader.frame(k)))))
                reader.close()

    frames = index.select("bundle", "frame", _run()).distinct()
    runs = frames.groupBy("bundle", "run").agg(F.collect_list("frame").alias("frames"))
    return _dealt(runs.select("bundle", "frames")).mapInArrow(read, RECORDS)


def _run() -> Column:
    """Frames are dealt out in runs of RUN of a bundle."""
    return F.floor(F.col("frame") / RUN).alias("run")


def _dealt(runs: DataFrame) -> DataFrame:
    """Runs, few bytes each but many to read, over as many tasks as their number asks for."""
    runs = Scratch(runs.sparkSession, "runs").put(runs, "runs")
    return runs.repartition(max(1, -(-runs.count() // TASK_RUNS)))


def fetch(index: DataFrame, folder: str, page_ids: DataFrame) -> DataFrame:
    """The records of the given ids (column page_id, string), each from its own place."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, at, data = BundleReader(folder, name), None, b""
                for place in sorted(places, key=lambda p: (p["frame"], p["offset"])):
                    if place["frame"] != at:
                        at, data = place["frame"], reader.frame(place["frame"])
                    yield _batches(list(parse(io.BytesIO(data[place["offset"] : place["offset"] + place["length"]]))))
                reader.close()

    wanted = index.join(page_ids.select("page_id").distinct(), "page_id", "left_semi")
    runs = wanted.groupBy("bundle", _run()).agg(F.collect_list(F.struct("frame", "offset", "length")).alias("places"))
    return _dealt(runs.select("bundle", "places")).mapInArrow(read, RECORDS)


def archive_folder(spark: SparkSession) -> str:
    return f"{workspace(spark)}/archives-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """What the archives of `pages` say when they are read back: one row per row of `pages`."""
    folder = archive_folder(pages.sparkSession)
    kind = pages.schema["page_id"].dataType
    found = read_archives(write_archives(pages, folder, min_payload), folder)
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
