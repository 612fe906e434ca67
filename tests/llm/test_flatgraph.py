"""The flat graph against all pairs; the whole query also against SQL in tests/test_queries.py."""

import math

import numpy as np
import pytest

from kinloom.llm import flatgraph
from kinloom.session import Scratch

FOLDER = "/root/testdata/sf0.001"


def slow(rows, limit=0.9):
    """(vec_id, n_links, component_id, kept) of each row, from all pairs."""
    good = [i for i, (_, x) in enumerate(rows) if x and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    root = list(range(len(rows)))
    count = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    units = {i: np.array(rows[i][1], dtype=float) for i in good}
    units = {i: x / np.sqrt(x @ x) for i, x in units.items()}
    for a in good:
        for b in good:
            if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= limit:
                count[a] += 1
                count[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = {}
    for i, (name, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(name)
    least = {k: min((n for n in names if n is not None), default=None) for k, names in groups.items()}
    return sorted(((n, count[i], least[find(i)], n == least[find(i)]) for i, (n, _) in enumerate(rows)), key=str)


def spark_rows(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


@pytest.fixture(scope="module")
def rows(spark):
    """The given vectors, a large and some small groups of near copies, chains, and copies."""
    rng = np.random.default_rng(4)
    made = [list(r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    for size, noise in ((150, 0.2), (8, 0.25), (3, 0.05)):
        base = np.array(made[size])
        made += [list(base + rng.normal(size=64) * noise * np.linalg.norm(base) / 8) for _ in range(size)]
    start, turn = np.eye(64)[:2]
    made += [list(start * math.cos(i * 0.4) + turn * math.sin(i * 0.4)) for i in range(5)]  # each links with the next alone
    made += [made[3]] * 40
    order = rng.permutation(len(made))
    return [(int(1000 + i), [float(np.float32(c)) for c in made[k]]) for i, k in enumerate(order)]


@pytest.mark.parametrize("shard", [flatgraph.SHARD, 200])
def test_links_equal_all_pairs(spark, rows, shard, monkeypatch):
    monkeypatch.setattr(flatgraph, "CELL", 100)
    got = sorted((tuple(r) for r in flatgraph.near_duplicates(spark_rows(spark, rows), shard=shard).collect()), key=str)
    wanted = slow(rows)
    assert [x[0] for x in got] == [x[0] for x in wanted]
    true, found = sum(x[1] for x in wanted), sum(x[1] for x in got)
    assert all(g[1] <= w[1] for g, w in zip(got, wanted)) and found >= (0.97 if shard == 200 else 1) * true
    if shard > 200:
        assert got == wanted


def test_cells_are_bounded_and_have_one_home(spark, rows, monkeypatch):
    scratch = Scratch(spark, "test")
    made = flatgraph.directions(spark_rows(spark, rows), "vec_id", "embedding").dropDuplicates(["key"])
    nodes = scratch.put(made.selectExpr("vec_id as id", "vec", "1L as copies"), "nodes")
    monkeypatch.setattr(flatgraph, "CELL", 60)
    cells = flatgraph.shards(nodes, scratch, overlap=3, shard=100).toPandas()
    assert cells.groupby("shard").size().max() <= 100
    assert cells[cells.home].id.is_unique and set(cells[cells.home].id) == {r.id for r in nodes.collect()}
    assert not cells.duplicated(["shard", "id"]).any()


def test_robust_pruning_and_search():
    rows = flatgraph.unit(np.random.default_rng(1).normal(size=(700, 16)))
    graph = flatgraph.build(rows)
    assert all(i not in set(x) for i, x in enumerate(graph)) and graph.shape[1] <= 2 * flatgraph.DEGREE
    near = rows @ rows.T >= 0.7
    hits = flatgraph.search(rows, graph, np.arange(700), 0.7)
    assert not (hits & ~near).any() and hits.sum() >= 0.98 * near.sum()


def test_audit_counts_what_is_missing(spark, rows):
    scratch = Scratch(spark, "test")
    made = flatgraph.directions(spark_rows(spark, rows), "vec_id", "embedding").dropDuplicates(["key"])
    nodes = scratch.put(made.selectExpr("vec_id as id", "vec", "1L as copies"), "nodes")
    counts = {n: k for n, k, *_ in slow([(r.id, list(r.vec)) for r in nodes.collect()])}
    found = lambda f: spark.createDataFrame([(n, f(k)) for n, k in counts.items()], "id long, links long")
    assert flatgraph.audit(nodes, found(lambda k: k), queries=2000) == 1
    assert flatgraph.audit(nodes, found(lambda k: k // 2), queries=2000) < 0.51
    assert flatgraph.audit(nodes.limit(0), found(lambda k: k)) == 1


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, []), (5, [0.0, -0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
        (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (None, None), (10, [-1.0, -0.0]), (2, [3.0, 0.0]), (11, [1e-30, 1e-31]),
    ]
    got = sorted((tuple(r) for r in flatgraph.near_duplicates(spark_rows(spark, rows)).collect()), key=str)
    assert got == slow(rows)
    assert flatgraph.near_duplicates(spark_rows(spark, rows).limit(0)).count() == 0
    wide = spark.createDataFrame([(1, [1e300, 1e300], "x"), (2, [1.0, 1.0], "y")], "id long, v array<double>, key string")
    assert [r.n_links for r in flatgraph.near_duplicates(wide, vec_id="id", embedding="v").collect()] == [1, 1]
