"""Collocations against counts of all phrases."""

import collections
import re

import numpy as np
import pytest

from kinloom.llm import collocations
from kinloom.session import Scratch
from tests.llm.helpers import empty_documents, odd_documents


def pieces_of(rows):
    for lang, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            yield lang or "und", tuple(re.findall("[^\x20\x09]+", piece))


def counts(rows, longest=4):
    f = collections.Counter()
    for lang, words in pieces_of(rows):
        for size in range(1, longest + 1):
            f.update((lang, words[i : i + size]) for i in range(len(words) - size + 1))
    return f


def slow(rows, least, top):
    f = counts(rows)
    total = collections.Counter()
    for (lang, words), n in f.items():
        total[lang] += n * (len(words) == 1)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = collections.Counter()
    for (lang, words), a in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                part = (lang, words[i : i + size])
                inside[part] = max(inside[part], a)
    out = collections.defaultdict(list)
    for (lang, words), a in candidates.items():
        if 100 * inside[lang, words] >= 80 * a:
            continue
        cuts = [(f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
        out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, rank, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    }


def got(spark, rows, least, top, **more):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return {tuple(r) for r in collocations.collocations(docs, least, top, **more).collect()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)] + ["É", "é", " x", "A", "b"]
    passage = " ".join(f"p{i}" for i in range(60))  # one long unary path
    made = []
    for i in range(300):
        text = " ".join(words[min(44, int(x))] + "., !;\n\t"[int(y) if y < 7 else 3] for x, y in zip(rng.exponential(6, 60), rng.integers(0, 25, 60)))
        made.append((["en", "de", None, "und"][i % 4], f"{text} {passage}" if i % 3 == 0 else text))
    return [*made, ("en", None), ("en", ""), ("fr", "the " * 500), ("fr", " . , ")]


@pytest.mark.parametrize("bits", [collocations.BITMAP_BITS, 15])
def test_phrases_equal_brute_force(spark, rows, bits):
    wanted = slow(rows, 5, 50)
    assert len(wanted) > 100
    assert got(spark, rows, 5, 50, bitmap_bits=bits) == wanted


def test_buffers_begin_every_gram_once(rows, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "BUFFER", 29)
    monkeypatch.setattr(collocations, "SLICE", 17)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([x or "und" for x, _ in rows]), pa.array([(t or "").encode() for _, t in rows])], names=["lang", "text"]
    )
    seen, buffers = collections.Counter(), 0
    for words, numbers, langs, lang in collocations._buffers(iter([batch]), 4):
        buffers += 1
        for i in range(len(numbers) - 3):
            for size in range(1, 5):
                gram = numbers[i : i + size]
                if gram.all():
                    seen[langs[lang[i]], tuple(words[w].decode() for w in gram)] += 1
    assert buffers > 100 and seen == counts(rows)


def test_paths_hold_every_edge_once(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string")
    scratch = Scratch(spark, "test")
    maps = collocations.solid_maps(docs, 5, scratch)
    phrases, _ = collocations.flow(scratch.put(collocations.grams(docs, maps), "grams"), scratch, 5)
    f = counts(rows)
    assert {(r.lang, tuple(r.words.split(" "))): r.n for r in phrases.collect()} == {k: n for k, n in f.items() if n >= 5}
    found = collocations.paths(phrases, scratch).collect()
    edges = collections.Counter((r.lang, tuple(r.words[i : i + 4])) for r in found for i in range(len(r.words) - 3))
    assert set(edges) == {k for k, n in f.items() if n >= 5 and len(k[1]) == 4} and set(edges.values()) == {1}
    assert all(f[r.lang, tuple(r.words[i : i + 4])] == r.n for r in found for i in range(len(r.words) - 3))
    assert any(len(r.words) >= 60 for r in found)
    for r in found:  # unary: each inner node occurs as often as the path; maximal: at the ends it does not
        assert all(f[r.lang, tuple(r.words[i : i + 3])] == r.n for i in range(1, len(r.words) - 3))


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_other_lengths(spark, rows, longest):
    f = counts(rows, longest)
    docs, scratch = spark.createDataFrame(rows, "lang string, text string"), Scratch(spark, "test")
    counted = scratch.put(collocations.grams(docs, collocations.solid_maps(docs, 5, scratch, longest), longest), "grams")
    phrases, _ = collocations.flow(counted, scratch, 5, longest)
    assert {(r.lang, tuple(r.words.split(" "))): r.n for r in phrases.collect()} == {k: n for k, n in f.items() if n >= 5}
    assert collocations.collocations(docs, 5, 20, longest).count() > 0


def test_counts_pass_64_bits(spark):
    n = 10**13
    phrases = spark.createDataFrame([("en", "a", 1, 3 * n), ("en", "b", 1, 2 * n), ("en", "a b", 2, n)], "lang string, words string, size int, n long")
    row = collocations.scored(phrases.filter("size = 2"), phrases).first()
    assert (row.l, row.r, row.score) == (3 * n, 2 * n, 400_000)


def test_odd_rows(spark):
    odd = odd_documents(spark)
    rows = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    docs = odd.withColumnsRenamed({"start": "words", "end": "n", "hash": "phrase"})
    assert {tuple(r) for r in collocations.collocations(docs, 2, 30).collect()} == slow(rows, 2, 30)
    assert collocations.collocations(empty_documents(spark)).count() == 0
