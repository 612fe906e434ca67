"""Operators on pages, and the recurrent network by itself."""

import base64
import collections
import hashlib
import io
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.llm import gru, urls, warc
from tests.llm.helpers import CLASHES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [
        (5, "http://a.org/x", "same"),
        (3, "http://a.org/y?q=1", "same"),
        (3, "http://a.org/y?q=1", "same"),  # a repeated row
        (9, None, None),
        (8, "", ""),
        (None, "http://b.net/\n weird %20 é", "same"),
        (1, "no scheme", "é€😀\r\n\r\nWARC/1.1\r\n"),
        (2, "HTTP://EXAMPLE.ORG/es/1#x", "y" * 400_000),
        (4, "https://sub.example.org/en/12?a=b&c=d", "z"),
        (6, "https://x.com?/de/", "z2"),
        (7, "ftp://x.com/de/", "z3"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(f"extra {c}") for c in CLASHES})


# --- WARC


def expected(rows, least=0):
    first = {}
    for i, h in rows:
        if i is not None and len(h) >= least:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, h in rows:
        revisit = len(h) >= least and h in first and first[h] != i
        name = base64.b32encode(hashlib.sha1(h).digest()).decode()
        out.append((i, len(h), name, "revisit" if revisit else "response", first[h] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 3, 100])
def test_archives_read_back_what_was_written(odd_pages, least):
    rows = [(r.page_id, (r.html or "").encode()) for r in odd_pages.collect()]
    got = warc.round_trip(odd_pages, least).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, least)
    assert warc.round_trip(odd_pages.filter("page_id > 100")).count() == 0


def test_round_trip_of_all_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    assert sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str) == expected(rows)


def test_reading_back_is_dealt_to_many_tasks(spark):
    frames = spark.range(10_004).select(F.lit("b").alias("bundle"), F.col("id").alias("frame"))
    runs = frames.groupBy("bundle", warc._run()).agg(F.collect_list("frame").alias("frames"))
    parts = [r.n for r in warc._dealt(runs).groupBy(F.spark_partition_id()).agg(F.sum(F.size("frames")).alias("n")).collect()]
    assert len(parts) > 10 and sum(parts) == 10_004 and max(parts) <= 64 * 12


def test_a_record_is_fetched_from_its_frame(spark, odd_pages, monkeypatch):
    folder = warc.archive_folder(spark)
    index = warc.write_archives(odd_pages, folder)
    got = warc.fetch(index, folder, spark.createDataFrame([("2",), ("1",), ("77",)], "page_id string")).collect()
    assert {r.page_id: (r.url, bytes(r.payload)) for r in got} == {
        "2": ("HTTP://EXAMPLE.ORG/es/1#x", b"y" * 400_000),
        "1": ("no scheme", "é€😀\r\n\r\nWARC/1.1\r\n".encode()),
    }
    weird = warc.fetch(index, folder, odd_pages.filter("page_id = 9").select(F.col("page_id").cast("string"))).collect()
    assert weird[0].url is None and weird[0].payload is None and weird[0].refers_to == "8"  # an empty payload like that of 8


def test_frames_are_independent_and_listed(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 1000)
    writer = warc.BundleWriter(str(tmp_path))
    data = [warc.record(str(k), f"http://a/{k}", bytes([65 + k % 26]) * 300, "x", None, False) for k in range(20)]
    places = [writer.add(d) for d in data]
    writer.close()
    reader = warc.BundleReader(str(tmp_path), writer.name)
    assert len(reader.sizes) > 4
    for d, (frame, offset) in zip(data, places):
        assert reader.frame(frame)[offset : offset + len(d)] == d
    # Any decoder of the format reads the bundle as one stream and skips the table.
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader((tmp_path / writer.name).read_bytes(), read_across_frames=True).read()
    assert whole == b"".join(data)


def test_a_damaged_payload_is_noticed():
    good = warc.record("1", "http://a/", b"payload", base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), None, False)
    assert next(warc.parse(io.BytesIO(good)))["payload"] == b"payload"
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(good.replace(b"\r\n\r\npayload", b"\r\n\r\npayl0ad"))))


# --- URLs


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def best_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def check_urls(pages):
    rows = urls.filter_urls(pages).collect()
    want = collections.Counter((r.page_id, *split_url(r.url), *best_rule(*split_url(r.url))) for r in pages.collect())
    assert collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in rows) == want
    assert {r.verdict for r in rows} <= {"allow", "block"}


def test_rules_equal_brute_force(spark, odd_pages):
    check_urls(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    check_urls(odd_pages)
    assert urls.filter_urls(odd_pages.filter("page_id > 100")).count() == 0


def test_features(spark):
    url = "https://www.a-b.example.com/en/12?x=1&y=2#top"
    host, path = urls.host_and_path(F.lit(url))
    r = spark.range(1).select(*[c.alias(k) for k, c in urls.features(F.lit(url), host, path).items()]).first()
    counts = collections.Counter(url)
    bits = -sum(n / len(url) * np.log2(n / len(url)) for n in counts.values())
    assert (r.length, r.depth, r.labels, r.hyphens, r.parameters, r.fragment, r.secure) == (len(url), 2, 4, 1, 2, 1, 1)
    assert abs(r.entropy - bits) < 1e-9 and abs(r.digit_ratio - 4 / len(url)) < 1e-9


def test_trees_learn_on_held_out_urls(spark):
    """Labels that follow from lexical signs: many digits and parameters, or a bad site."""
    i = F.col("id")
    bad = (i * 7919) % 10 < 3
    site = F.when(bad & (i % 2 == 0), "cheap-pills.example.com").otherwise(F.concat(F.lit("site"), (i % 13).cast("string"), F.lit(".example.net")))
    tail = F.when(bad & (i % 2 == 1), F.concat(F.lit("?a=1&b=2&c="), F.lpad(i.cast("string"), 12, "7"))).otherwise(F.lit(""))
    urls_ = spark.range(4000).select(F.concat(F.lit("http://"), site, F.lit("/en/"), i.cast("string"), tail).alias("url"), bad.cast("int").alias("label"), i)
    model = urls.train(urls_.filter(i % 4 != 0), sample_rows=2000)
    judged = urls.judge(urls_.filter(i % 4 == 0), model)
    assert judged.filter(F.col("blocked") == (F.col("label") == 1)).count() >= 0.97 * judged.count()


# --- the network


def test_gradients():
    shape, rng = gru.Shape(4, 3, 4), np.random.default_rng(0)
    docs = [rng.integers(0, 12, n) for n in (5, 3, 9, 1, 7, 2)]
    flat = gru.initial(shape, rng.integers(1, 50, 12)).astype(np.float64)
    window = next(gru.Lanes(iter(docs), 3, 6, 12).windows())

    def loss(weights, grad=None):
        grad = np.zeros_like(weights) if grad is None else grad
        return gru.gradient(gru.views(weights, shape), window, np.zeros((3, 4)), gru.views(grad, shape))[0]

    grad = np.zeros_like(flat)
    loss(flat, grad)
    for k in range(0, len(flat), 7):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-3
        down[k] -= 1e-3
        assert abs((loss(up) - loss(down)) / 2e-3 - grad[k]) < 2e-4


def test_a_document_scores_the_same_however_it_is_dealt():
    shape, rng = gru.Shape(4, 3, 4), np.random.default_rng(3)
    docs = [rng.integers(0, 12, n) for n in (50, 3, 1, 17, 200, 8)]
    flat = gru.initial(shape, np.ones(12))
    together = gru.score(flat, shape, docs, 3, 6)
    alone = [gru.score(flat, shape, [d], 1, 32)[0] for d in docs]
    assert np.allclose(together, alone, rtol=1e-5)


def test_probabilities_sum_to_one():
    shape = gru.Shape(4, 3, 4)
    w = gru.views(gru.initial(shape, np.arange(12)), shape)
    hidden = np.repeat(np.random.default_rng(4).normal(size=(1, 4)).astype(np.float32), 12, axis=0)
    logp, _ = gru.log_probabilities(w, hidden, np.arange(12))
    assert abs(np.exp(logp).sum() - 1) < 1e-5


def test_training_learns_order():
    shape = gru.Shape(8, 3, 4)
    docs = [np.arange(k, k + 24) % 12 for k in range(12)] * 20
    flat = gru.initial(shape, np.ones(12))
    learned, seen = gru.train(flat, shape, docs, 8, 12, 0.1)
    assert seen == 24 * 240
    before, after = (gru.score(f, shape, docs[:12], 4, 12).sum() for f in (flat, learned))
    assert after > 0.5 * before
