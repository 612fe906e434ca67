"""Jaro-Winkler similarity, the one string measure Spark has no builtin for."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 4096
_PAIRS = 1 << 18  # pairs whose letters are counted at a time


def _codes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character codes as a padded matrix, one byte wide where they fit."""
    width = max(words.dtype.itemsize // 4, 1)
    codes = words.astype(f"U{width}").view(np.uint32).reshape(len(words), width)
    return codes, np.char.str_len(words)


def _jaro_winkler_chunk(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Aligned similarities; each word's matched positions are the bits of integers."""
    a, la = _codes(left)
    b, lb = _codes(right)
    if max(a.max(initial=0), b.max(initial=0)) < 256:
        a, b = a.astype(np.uint8), b.astype(np.uint8)
    n, wa, wb = len(a), a.shape[1], b.shape[1]
    if max(wa, wb) > 63:
        return _jaro_winkler_long(a, la, b, lb)
    same_at = np.zeros((n, wa, 64), dtype=bool)
    np.equal(a[:, :, None], b[:, None, :], out=same_at[:, :, :wb])
    equal = np.packbits(same_at, axis=2, bitorder="little").view(np.uint64).reshape(n, wa)
    one = np.uint64(1)
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    ends = (one << lb.astype(np.uint64)) - one
    free, taken_a = ends.copy(), np.zeros(n, dtype=np.uint64)
    for i in range(wa):
        high = (one << np.minimum(i + window + 1, 63).astype(np.uint64)) - one
        low = (one << np.maximum(i - window, 0).astype(np.uint64)) - one
        hits = np.where(i < la, equal[:, i] & free & high & ~low, np.uint64(0))
        found = hits & (~hits + one)
        free ^= found
        taken_a |= (found != 0).astype(np.uint64) << np.uint64(i)
    taken_b = ends & ~free
    matches = np.bitwise_count(taken_a).astype(np.int64)
    swaps = _swaps(a, b, taken_a, taken_b, matches)
    return _winkler(a, la, b, lb, matches, swaps // 2)


def _swaps(a: np.ndarray, b: np.ndarray, taken_a: np.ndarray, taken_b: np.ndarray, matches: np.ndarray) -> np.ndarray:
    """Walk both words' matched characters in order and count disagreements."""
    one = np.uint64(1)
    swaps = np.zeros(len(a), dtype=np.int64)
    rest_a, rest_b, rows = taken_a.copy(), taken_b.copy(), np.arange(len(a))
    flat_a, flat_b, row_a, row_b = a.ravel(), b.ravel(), rows * a.shape[1], rows * b.shape[1]
    for _ in range(int(matches.max(initial=0))):
        bit_a, bit_b = rest_a & (~rest_a + one), rest_b & (~rest_b + one)
        at_a = np.minimum(np.bitwise_count(bit_a - one), a.shape[1] - 1)
        at_b = np.minimum(np.bitwise_count(bit_b - one), b.shape[1] - 1)
        swaps += (bit_a != 0) & (flat_a.take(row_a + at_a) != flat_b.take(row_b + at_b))
        rest_a ^= bit_a
        rest_b ^= bit_b
    return swaps


def _jaro_winkler_long(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """The same for words beyond 63 characters, with boolean matrices."""
    n, wa, wb = len(a), a.shape[1], b.shape[1]
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    columns, rows = np.arange(wb), np.arange(n)
    inside = columns[None, :] < lb[:, None]
    free, taken_a = inside.copy(), np.zeros((n, wa), dtype=bool)
    for i in range(wa):
        near = np.abs(columns[None, :] - i) <= window[:, None]
        hits = free & near & (b == a[:, i : i + 1]) & (i < la)[:, None]
        first = hits.argmax(axis=1)
        found = hits[rows, first]
        taken_a[:, i] = found
        free[rows[found], first[found]] = False
    taken_b = inside & ~free
    matches = taken_a.sum(axis=1)
    seq_a = np.take_along_axis(a, np.argsort(~taken_a, axis=1, kind="stable"), axis=1)
    seq_b = np.take_along_axis(b, np.argsort(~taken_b, axis=1, kind="stable"), axis=1)
    short = min(wa, wb)
    counted = np.arange(short)[None, :] < matches[:, None]
    swaps = ((seq_a[:, :short] != seq_b[:, :short]) & counted).sum(axis=1) // 2
    return _winkler(a, la, b, lb, matches, swaps)


def _winkler(
    a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, matches: np.ndarray, swaps: np.ndarray
) -> np.ndarray:
    m = np.maximum(matches, 1)
    jaro = (matches / np.maximum(la, 1) + matches / np.maximum(lb, 1) + (matches - swaps) / m) / 3.0
    jaro = np.where(matches == 0, 0.0, jaro)
    four = min(4, a.shape[1], b.shape[1])
    same = (a[:, :four] == b[:, :four]) & (np.arange(four)[None, :] < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1.0 - jaro), jaro)


def jaro_winkler(left: list[str], right: list[str]) -> np.ndarray:
    """Similarities of aligned lists: prefix scale 0.1, at most 4 characters."""
    a, b = np.asarray(left, dtype=np.str_), np.asarray(right, dtype=np.str_)
    parts = [_jaro_winkler_chunk(a[i : i + _CHUNK], b[i : i + _CHUNK]) for i in range(0, len(a), _CHUNK)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _letter_counts(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each letter (code modulo 32) occurs per word."""
    rows = np.repeat(np.arange(len(codes)), sizes)
    letters = codes[np.arange(codes.shape[1])[None, :] < sizes[:, None]].astype(np.int64) % 32
    return np.bincount(rows * 32 + letters, minlength=len(codes) * 32).reshape(len(codes), 32).astype(np.uint8)


def _can_reach(words_l: np.ndarray, words_r: np.ndarray, il: np.ndarray, ir: np.ndarray, floor: float) -> np.ndarray:
    """Which pairs could score `floor`: matches never exceed the shared letters."""
    a, la = _codes(words_l)
    b, lb = _codes(words_r)
    shared = np.minimum(_letter_counts(a, la)[il], _letter_counts(b, lb)[ir]).sum(axis=1, dtype=np.int64)
    jaro = (shared / np.maximum(la[il], 1) + shared / np.maximum(lb[ir], 1) + 1.0) / 3.0
    four = min(4, a.shape[1], b.shape[1])
    prefix = np.cumprod(a[il, :four] == b[ir, :four], axis=1).sum(axis=1)
    return jaro + prefix * 0.1 * np.maximum(1.0 - jaro, 0.0) >= floor - 1e-9


def _batch_similarity(left: pa.Array, right: pa.Array, floor: float) -> pa.Array:
    """Similarity per row of a batch, computed once per distinct pair of values.

    Pairs that cannot reach `floor` come back as 0 without being compared.
    """
    valid = np.asarray(left.is_valid()) & np.asarray(right.is_valid())
    out = np.zeros(len(valid))
    if valid.any():
        dl, dr = left.dictionary_encode(), right.dictionary_encode()
        il = np.asarray(dl.indices.fill_null(0))[valid].astype(np.int64)
        ir = np.asarray(dr.indices.fill_null(0))[valid].astype(np.int64)
        pairs, place = np.unique(il * len(dr.dictionary) + ir, return_inverse=True)
        il, ir = pairs // len(dr.dictionary), pairs % len(dr.dictionary)
        words_l = np.array(dl.dictionary.to_pylist(), dtype=np.str_)
        words_r = np.array(dr.dictionary.to_pylist(), dtype=np.str_)
        scores = np.zeros(len(pairs))
        near = np.flatnonzero(_can_reach(words_l, words_r, il, ir, floor))
        scores[near] = jaro_winkler(words_l[il[near]], words_r[ir[near]])
        out[valid] = scores[place]
    return pa.array(out, mask=~valid)


class Texts:
    """Distinct texts in the form that comparisons look at, aligned pairs of them named by place.

    Per text: where each letter stands (bits of one integer) and, as bits too, how often letters
    occur (up to four of each of 32 classes, `lost` counts the rest), so that what two texts can
    have in common is a bit count. Long texts and large alphabets are compared without.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.words = np.array(["" if v is None else v for v in values], dtype=np.str_)
        codes, self.sizes = _codes(self.words)
        n, rows = len(codes), np.arange(len(codes))
        top = int(codes.max(initial=0)) + 1
        letters = np.flatnonzero(np.bincount(codes.ravel(), minlength=top))
        number = np.zeros(top, dtype=np.int64)
        number[letters] = np.arange(len(letters))
        self.symbols = number[codes]
        inside = np.arange(codes.shape[1])[None, :] < self.sizes[:, None]
        classes = np.repeat(rows, self.sizes) * 32 + codes[inside].astype(np.int64) % 32
        counts = np.bincount(classes, minlength=n * 32).reshape(n, 32)
        few = np.minimum(counts, 4).astype(np.uint64)
        bits = ((np.uint64(1) << few) - np.uint64(1)) << (4 * (np.arange(32) % 16)).astype(np.uint64)
        self.marks = [np.bitwise_or.reduce(bits[:, :16], axis=1), np.bitwise_or.reduce(bits[:, 16:], axis=1)]
        self.lost = counts.sum(axis=1) - few.sum(axis=1).astype(np.int64)
        self.packed = codes.shape[1] <= 63 and len(letters) <= 256
        if self.packed:
            self.places = np.zeros((n, len(letters)), dtype=np.uint64)
            for i in range(codes.shape[1]):
                at = np.flatnonzero(inside[:, i])
                self.places[at, self.symbols[at, i]] |= np.uint64(1 << i)
            self.letters = len(letters)
            self.at = np.ascontiguousarray(self.symbols.T)
            self.flat = self.places.ravel()

    @cached_property
    def rank(self) -> np.ndarray:
        return np.unique(self.words, return_inverse=True)[1]

    @cached_property
    def starts(self) -> list[np.ndarray]:
        """By length up to four: a number for the text's first letters, of its own if it has fewer."""
        own = -1 - np.arange(len(self.words))
        return [np.where(self.sizes >= k, np.unique(self.words.astype(f"U{k}"), return_inverse=True)[1], own) for k in range(1, 5)]

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """At least the number of letters two texts have in common."""
        found = sum(np.bitwise_count(m[a] & m[b]).astype(np.int64) for m in self.marks)
        return found + np.minimum(self.lost[a], self.lost[b])

    def edit_distance(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Levenshtein distances, -1 beyond `limit`."""
        out = np.full(len(a), -1, dtype=np.int64)
        for start in range(0, len(a), _PAIRS):
            x, y = a[start : start + _PAIRS], b[start : start + _PAIRS]
            # The longer text's letters that the other does not have cost an edit each.
            near = np.flatnonzero(np.maximum(self.sizes[x], self.sizes[y]) - self._shared(x, y) <= limit)
            for part in np.array_split(near, -(-len(near) // _CHUNK) or 1):
                compare = self._edits if self.packed else lambda i, j: edit_distance(self.words[i], self.words[j], limit)
                found = compare(x[part], y[part])
                out[start + part] = np.where(found <= limit, found, -1)
        return out

    def _edits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances a column of the matrix at a time, its differences as bits (Myers 1999)."""
        la, lb = self.sizes[a], self.sizes[b]
        one = np.uint64(1)
        last = np.maximum(lb - 1, 0).astype(np.uint64)
        up, down = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), dtype=np.uint64)
        score = lb.astype(np.int64)
        first = b * self.letters
        for i in range(int(la.max(initial=0))):
            equal = self.flat.take(self.at[i].take(a) + first)
            vertical = equal | down
            across = (((equal & up) + up) ^ up) | equal
            more, less = down | ~(across | up), up & across
            step = ((more >> last) & one).astype(np.int64) - ((less >> last) & one).astype(np.int64)
            score += np.where(i < la, step, 0)
            more, less = (more << one) | one, less << one
            up, down = less | ~(vertical | more), more & vertical
        return np.where(lb == 0, la, score)

    def similarity(self, a: np.ndarray, b: np.ndarray, floor: float) -> np.ndarray:
        """Jaro-Winkler similarities, the smaller text first; 0 where they cannot reach `floor`."""
        out = np.zeros(len(a))
        for start in range(0, len(a), _PAIRS):
            x, y = a[start : start + _PAIRS], b[start : start + _PAIRS]
            swap = self.rank[x] > self.rank[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            near = np.flatnonzero(self._bound(x, y, self._shared(x, y)) >= floor - 1e-9)
            for part in np.array_split(near, -(-len(near) // _CHUNK) or 1):
                if self.packed:
                    out[start + part] = self._similar(x[part], y[part], floor)
                else:
                    out[start + part] = jaro_winkler(self.words[x[part]], self.words[y[part]])
        return out

    def _bound(self, a: np.ndarray, b: np.ndarray, matches: np.ndarray) -> np.ndarray:
        """The similarity at most, if so many letters match."""
        la, lb = np.maximum(self.sizes[a], 1), np.maximum(self.sizes[b], 1)
        jaro = (matches / la + matches / lb + 1.0) / 3.0
        prefix = sum((s[a] == s[b]).astype(np.int64) for s in self.starts)
        return jaro + prefix * 0.1 * np.maximum(1.0 - jaro, 0.0)

    def _similar(self, a: np.ndarray, b: np.ndarray, floor: float) -> np.ndarray:
        la, lb = self.sizes[a], self.sizes[b]
        one = np.uint64(1)
        window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        free, taken = (one << lb.astype(np.uint64)) - one, np.zeros(len(a), dtype=np.uint64)
        ends = free.copy()
        first = b * self.letters
        for i in range(int(la.max(initial=0))):
            high = (one << np.minimum(i + window + 1, 63).astype(np.uint64)) - one
            low = (one << np.maximum(i - window, 0).astype(np.uint64)) - one
            hits = np.where(i < la, self.flat.take(self.at[i].take(a) + first) & free & high & ~low, np.uint64(0))
            found = hits & (~hits + one)
            free ^= found
            taken |= (found != 0).astype(np.uint64) << np.uint64(i)
        matches = np.bitwise_count(taken).astype(np.int64)
        at = np.flatnonzero(self._bound(a, b, matches) >= floor - 1e-9)
        out = np.zeros(len(a))
        x, y = self.symbols[a[at]], self.symbols[b[at]]
        swaps = _swaps(x, y, taken[at], (ends & ~free)[at], matches[at])
        out[at] = _winkler(x, la[at], y, lb[at], matches[at], swaps // 2)
        return out


def edit_distance(left: np.ndarray, right: np.ndarray, limit: int) -> np.ndarray:
    """Levenshtein distances of aligned texts, -1 beyond `limit`."""
    out = np.full(len(left), -1, dtype=np.int64)
    sizes = np.array([abs(len(x) - len(y)) for x, y in zip(left, right)], dtype=np.int64)
    near = np.flatnonzero(sizes <= limit)  # as many insertions at least
    for start in range(0, len(near), _CHUNK):
        at = near[start : start + _CHUNK]
        out[at] = _edit_chunk(left[at].astype(np.str_), right[at].astype(np.str_), limit)
    return out


def _edit_chunk(left: np.ndarray, right: np.ndarray, limit: int) -> np.ndarray:
    a, la = _codes(left)
    b, lb = _codes(right)
    places = np.arange(b.shape[1] + 1, dtype=np.int32)
    row = np.broadcast_to(places, (len(a), len(places))).copy()
    out = np.where(la == 0, lb, 0)
    for i in range(1, a.shape[1] + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        np.minimum(row[:, :-1] + (b != a[:, i - 1 : i]), row[:, 1:] + 1, out=new[:, 1:])
        # Insertions run along the row: the least of what is before, one more for each place.
        row = np.minimum.accumulate(new - places, axis=1) + places
        ended = la == i
        out[ended] = row[ended, lb[ended]]
    return np.where(out <= limit, out, -1)


def similarities(pairs: dict[str, tuple[Column, Column, float]]) -> Column:
    """One struct column with the Jaro-Winkler similarity of each named pair.

    Each pair names the lowest value anybody asks about; below it, 0 stands for all.

    All pairs go through a single Arrow exchange. A pair whose values are equal or
    missing is sent as NULL, so it costs nothing and comes back as NULL.
    """
    names = list(pairs)
    floors = [floor for _, _, floor in pairs.values()]
    schema = ", ".join(f"{n} double" for n in names)

    @F.arrow_udf(f"struct<{schema}>")
    def compare(*columns: pa.Array) -> pa.Array:
        found = [_batch_similarity(columns[2 * i], columns[2 * i + 1], floor) for i, floor in enumerate(floors)]
        return pa.StructArray.from_arrays(found, names)

    arguments = []
    for left, right, _ in pairs.values():
        differ = left != right
        arguments += [F.when(differ, F.least(left, right)), F.when(differ, F.greatest(left, right))]
    # Declared non-deterministic only to be evaluated once: the optimizer would copy a
    # deterministic call into every filter that depends on it.
    return compare.asNondeterministic()(*arguments)
