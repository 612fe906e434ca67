"""Values compared as bits, and the patterns of large blocks taken from tables of levels, against plain loops."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kinloom.functions.text import Texts, edit_distance, jaro_winkler
from kinloom.operators import patterns

RNG = np.random.default_rng(3)
WORDS = sorted({"".join(RNG.choice(list("abc1 é"), RNG.integers(1, 12))).strip() or "x" for _ in range(90)})
LONG = [w + "abcdefg " * 12 for w in WORDS[:12]]


@pytest.mark.parametrize("words", [WORDS, WORDS[:40] + LONG, [chr(300 + i) + "ab" for i in range(300)]])
def test_texts_compare_as_plain_functions_do(words):
    values = np.array(words, dtype=object)
    texts = Texts(values)
    a, b = (x.ravel() for x in np.indices((len(words), len(words))))
    for limit in (1, 2, 10):
        assert (texts.edit_distance(a, b, limit) == edit_distance(values[a], values[b], limit)).all()
    for floor in (0.7, 0.88):
        plain = jaro_winkler(np.minimum(values[a], values[b]).tolist(), np.maximum(values[a], values[b]).tolist())
        found = texts.similarity(a, b, floor)
        assert (found[plain >= floor] == plain[plain >= floor]).all() and (found[plain < floor] < floor).all()


def group(n, sides):
    pick = lambda values: [None if RNG.random() < 0.1 else str(x) for x in RNG.choice(values, n)]
    blocks = ["one"] * n if sides else RNG.choice(["one", "two", "few"], n, p=[0.6, 0.37, 0.03])
    return pa.table({
        "side": RNG.choice([patterns.LEFT, patterns.RIGHT], n) if sides else np.full(n, patterns.BOTH),
        "block": pa.array(list(blocks), pa.string()),
        "copies": RNG.choice([1, 1, 1, 2, 5], n),
        "phone": pa.array(pick(WORDS), pa.string()),
        "first_name": pa.array(pick(WORDS[:9]), pa.string()),
    })


@pytest.mark.parametrize("sides", [False, True])
def test_tables_count_every_pair_of_a_block_once(sides):
    table, fields = group(2600, sides), ("first_name", "phone")
    rows = table.to_pylist()
    compared = [patterns.Field(f, table) for f in fields]
    left, right = np.triu_indices(len(rows), 1)
    block, side = (np.array(table.column(c).to_pylist()) for c in ("block", "side"))
    meet = block[left] == block[right] if not sides else side[left] != side[right]
    left, right = left[meet], right[meet]
    copies = table.column("copies").to_numpy()
    levels = np.stack([f.levels(left, right) for f in compared], axis=1)
    want = Counter()
    keys, place = np.unique(levels, axis=0, return_inverse=True)
    for key, weight in zip(keys, np.bincount(place.ravel(), weights=(copies[left] * copies[right]).astype(float))):
        want[tuple(key)] += weight
    got = patterns.count_patterns(table, fields)
    assert {tuple(k): w for k, w in zip(*got)} == dict(want)
