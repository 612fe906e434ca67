"""The near-duplicates stage against the Jaccard similarity of all pairs."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from kinloom.llm import jaccard
from kinloom.session import Scratch
from tests.llm.helpers import empty_documents, odd_documents

FOLDER = "/root/testdata/sf0.01"


def sets_of(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def stand(texts):
    """Smallest id of each group, groups from all pairs that share a shingle."""
    sets, root = {i: sets_of(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def link(i, j):
        a, b = sorted((find(i), find(j)))
        root[b] = a

    holders = collections.defaultdict(list)
    for i, found in sets.items():
        for s in found or {None}:
            holders[s].append(i)
    for i, j in {(a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}:
        common = len(sets[i] & sets[j])
        if sets[i] == sets[j] or 5 * common >= 4 * len(sets[i] | sets[j]):
            link(i, j)
    return {find(i) for i in texts}


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    wanted = stand({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} == wanted


def connected(nodes, pairs):
    """The smallest node that each of the nodes reaches."""
    least = {i: i for i in nodes}
    for _ in nodes:
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return least
    return least


def test_fingerprints_meet_at_anchors(spark):
    """Candidates connect exactly the fingerprints that all pairs within two bits connect."""
    sets = {jaccard.shingles(t.encode()).tobytes() for (t,) in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").dropna().collect()}
    rows = []
    for i, data in enumerate(sorted(sets)):
        hashes = np.frombuffer(data, dtype=np.uint64)
        bits = sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in hashes) > len(hashes))
        assert jaccard.fingerprint(hashes) & (1 << 64) - 1 == bits
        rows.append((i, len(hashes), jaccard.fingerprint(hashes)))
    fps = np.array([fp for _, _, fp in rows], dtype=np.int64)
    close = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count((fps[i] ^ fps).view(np.uint64)) <= 2).tolist() if i < j]
    found = jaccard.near(spark.createDataFrame(rows, "id long, n long, fp long"), Scratch(spark, "test")).collect()
    assert close and all(rows[a][1] == m and rows[b][1] == n for a, m, b, n in found)
    nodes = [i for i, _, _ in rows]
    assert connected(nodes, [(a, b) for a, _, b, _ in found]) == connected(nodes, close)


def test_near_copies_are_linked_by_their_fingerprints(spark, monkeypatch):
    """Without any MinHash band, copies within two bits are one group; texts of unlike sets never are."""
    words = [f"word{i}" for i in range(600)]
    whole = " ".join(words)
    of = lambda text: jaccard.fingerprint(jaccard.shingles(text.encode()))
    copies = (" ".join([*words[:at], "other", *words[at + 1 :]]) for at in range(600))
    near = [t for t in copies if (of(t) ^ of(whole)).bit_count() <= 2][:3]
    rows = list(enumerate([whole, *near, " ".join(reversed(words))], 1))
    monkeypatch.setattr(jaccard, "bands", lambda hashes: hashes[:0])
    kept = {r.doc_id for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) == 3 and kept == stand(dict(rows)) == {1, 5}


def cloud(texts, words, most, seed):
    """Texts of a common one with a few words changed: all alike, only few pairs alike enough."""
    rng = np.random.default_rng(seed)
    base = [f"base{i}" for i in range(words)]
    for i in range(texts):
        made = list(base)
        for at in rng.choice(words, int(rng.integers(3, most)), replace=False):
            made[at] = f"other{i}x{at}"
        yield i, " ".join(made)


@pytest.mark.parametrize(("texts", "most"), [(800, 6), (200, 5)])
def test_crowded_buckets_lose_no_link(spark, texts, most):
    """Every text shares buckets with hundreds of others; pairs at 0.8 are few and are all found."""
    rows = [*cloud(texts, 150, most, 3), *((10_000 + i, t + " and a last word") for i, t in cloud(30, 150, most, 3))]
    kept = {r.doc_id for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = stand(dict(rows))
    assert kept == wanted and len(wanted) < len(rows) - 20


def test_a_frequent_passage_makes_no_pairs(spark):
    """Texts that share two thirds of their shingles have other shingles in front."""
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, " ".join([passage, *(f"own{i}x{k}" for k in range(40))])) for i in range(600)]
    scratch = Scratch(spark, "test")
    sets = spark.createDataFrame(
        [(i, i, len(s), s.view("int64").tolist()) for i, t in rows if len(s := jaccard.shingles(t.encode()))],
        "id long, component long, n long, shingles array<long>",
    )
    assert jaccard.across(jaccard.prefixes(sets, scratch)).count() == 0
    # A group of near copies next to one other text: rows by the size of the group, not by its square.
    near = [(i, 0 if i else 1, len(s), s.view("int64").tolist()) for i, t in ((i, f"{passage} {' '.join(['q'] * (i % 7))}") for i in range(400)) if len(s := jaccard.shingles(t.encode()))]
    pairs = jaccard.across(jaccard.prefixes(spark.createDataFrame(near, sets.schema), scratch))
    assert pairs.count() <= 400 * 20 and pairs.select("a", "b").distinct().count() == 399


def test_stage_drops_near_copies(spark):
    words = [f"word{i}" for i in range(100)]
    change = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(words))
    texts = {1: change(), 2: change(50), 3: change(20, 21, 22), 4: change(10, 40, 70), 5: " ".join(reversed(words))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, FOLDER).collect()}
    assert kept == stand(texts) == {1, 4, 5}


def test_odd_rows(spark):
    odd = odd_documents(spark)
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (1, 2)").count() == 1
    assert jaccard.keep_one(empty_documents(spark)).count() == 0
