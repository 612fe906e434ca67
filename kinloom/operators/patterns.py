"""Agreement patterns of all pairs within blocks, counted without a row per pair.

A block's pairs are counted where its captures are: every two values of a field are compared
once per group of captures, however many pairs show them, and a pair is then an entry of one
small table per field. What leaves a task are counts per pattern.

Groups are bounded: many small blocks share one, a block of more than `TILE` captures is one of its
own. Blocks whose captures are too many for that are dealt to spans, and every two spans make a
group; spans are as short as rows that are dealt again may cost (`_span`). A task looks at a group
by tiles, so it holds the rows of two spans, and tables of two tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.text import Texts
from kinloom.operators.blocking import Rule, block_key, blocks
from kinloom.operators.compare import EDIT_LIMITS, EMAIL_FLOOR, NAME_FLOOR, NAME_STEPS, TOP_LEVEL
from kinloom.operators.ids import running_total
from kinloom.session import Scratch, materialize, shuffle_partitions

TILE = 3_000
LONGEST = 5  # a span is a tile doubled so many times at most
SPREAD = 2  # times the rows that may be dealt, written or sorted for spans
GROUP = 2_000  # captures of small blocks in a group, on average
PAIRS = 1 << 21  # pairs a task looks up at a time
WHOLE = 100  # captures of a block from which on its pairs are a table and not a list
ROWS, COLUMNS = 512, 1024  # of that table, at a time
TASKS = 4  # per shuffle partition

BOTH, LEFT, RIGHT = 0, 1, 2  # whether a capture meets all of its block in the group, or those of the other tile

# What a field's level is read from, its text first.
SOURCES = {
    "first_name": ("first_name",),
    "last_name": ("last_name",),
    "date_of_birth": ("date_of_birth", "born"),
    "email": ("email", "user"),
    "phone": ("phone",),
    "address": ("address",),
    "postcode": ("postcode", "code", "outward", "area"),
}
class Values:
    """The distinct values of a field in a group, as comparisons look at them."""

    def __init__(self, rows: pa.Table) -> None:
        self.columns = {c: np.array(rows.column(c).to_pylist() + [None], dtype=object)[:-1] for c in rows.column_names}
        self.texts: dict[str, Texts] = {}
        self.numbers: dict[str, np.ndarray] = {}

    def text(self, column: str) -> Texts:
        if column not in self.texts:
            self.texts[column] = Texts(self.columns[column])
        return self.texts[column]

    def same(self, column: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if column not in self.numbers:
            seen: dict[str, int] = {}
            found = [-1 if v is None else seen.setdefault(v, len(seen)) for v in self.columns[column]]
            self.numbers[column] = np.array(found, dtype=np.int64)
        number = self.numbers[column]
        return (number[a] == number[b]) & (number[a] >= 0)


def _name_levels(field: str, values: Values, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    found = values.text(field).similarity(a, b, NAME_FLOOR)
    return np.sum([found >= step for step in NAME_STEPS], axis=0)


def _date_levels(field: str, values: Values, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    text, born = values.columns[field], values.columns["born"]
    known = np.array([x is not None for x in born], dtype=bool)
    day = np.array([0 if x is None else x for x in born], dtype=np.int64)
    place = {x: i for i, x in enumerate(text)}
    turned = np.array([place.get(f"{x[:5]}{x[8:10]}-{x[5:7]}", -1) for x in text], dtype=np.int64)
    days = np.abs(day[a] - day[b])
    close = values.text(field).edit_distance(a, b, max(EDIT_LIMITS[field])) >= 0
    level = np.select([(turned[a] == b) | close, days <= 31, days <= 366], [3, 2, 1], 0)
    return np.where(known[a] & known[b], level, -1)


def _email_levels(field: str, values: Values, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    level = np.where(values.same("user", a, b), 3, 0)
    for column, found in ((field, 2), ("user", 1)):
        at = np.flatnonzero(level == 0)
        level[at] = np.where(values.text(column).similarity(a[at], b[at], EMAIL_FLOOR) >= EMAIL_FLOOR, found, 0)
    return level


def _edit_levels(field: str, values: Values, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    limits = EDIT_LIMITS[field]
    found = values.text(field).edit_distance(a, b, max(limits))
    return np.sum([(found >= 0) & (found <= limit) for limit in limits], axis=0)


def _code_levels(field: str, values: Values, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parts = [values.same(c, a, b) for c in ("code", "outward", "area")]
    return np.select(parts, [3, 2, 1], 0)


LEVELS: dict[str, Callable] = {
    "first_name": _name_levels,
    "last_name": _name_levels,
    "date_of_birth": _date_levels,
    "email": _email_levels,
    "phone": _edit_levels,
    "address": _edit_levels,
    "postcode": _code_levels,
}


class Field:
    """The levels of a field among the captures of a group, each pair of values compared when first seen."""

    def __init__(self, name: str, table: pa.Table) -> None:
        text = table.column(name).combine_chunks().dictionary_encode()
        self.name, self.size = name, len(text.dictionary)
        self.codes = text.indices.fill_null(self.size).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.zeros(self.size + 1, dtype=np.int64)
        first[self.codes[::-1]] = np.arange(len(self.codes))[::-1]
        self.values = Values(table.take(pa.array(first[: self.size])).select(list(SOURCES[name])))
        self.known = np.full((self.size + 1, self.size + 1), -9, dtype=np.int8)
        self.known[self.size, :] = self.known[:, self.size] = -1
        own = TOP_LEVEL[name]
        readable = [v is not None for v in self.values.columns["born"]] if name == "date_of_birth" else np.ones(self.size, dtype=bool)
        self.known[np.arange(self.size), np.arange(self.size)] = np.where(readable, own, -1)

    def _compare(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = np.minimum(a, b), np.maximum(a, b)
        self.known[x, y] = LEVELS[self.name](self.name, self.values, x, y)
        self.known[y, x] = self.known[x, y]

    def levels(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = self.codes[left], self.codes[right]
        found = self.known[a, b]
        if (found == -9).any():
            wide = self.size + 1
            fresh = np.zeros(wide * wide, dtype=bool)
            new = found == -9
            fresh[np.minimum(a[new], b[new]) * wide + np.maximum(a[new], b[new])] = True
            places = np.flatnonzero(fresh)
            self._compare(places // wide, places % wide)
            found = self.known[a, b]
        return found

    def table(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(levels of the values in `left` by those in `right`, each row's place in them); all are compared."""
        (a, x), (b, y) = (np.unique(self.codes[rows], return_inverse=True) for rows in (left, right))
        step = max(1, PAIRS // len(b))
        for start in range(0, len(a), step):
            part = a[start : start + step]
            i, j = np.nonzero(self.known[np.ix_(part, b)] == -9)
            i, j = part[i], b[j]
            once = (i < j) | ~(np.isin(i, b) & np.isin(j, a))
            self._compare(i[once], j[once])
        return self.known[np.ix_(a, b)], x, y


def _pairs(block: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a group as places of its rows, which are sorted by block."""
    if (side == BOTH).all():
        ends = np.searchsorted(block, block, side="right")
        partners, first = ends - np.arange(len(block)) - 1, np.arange(len(block)) + 1
    else:
        left, right = np.flatnonzero(side == LEFT), np.flatnonzero(side == RIGHT)
        partners, first = np.where(side == LEFT, len(right), 0), np.full(len(block), right[0] if len(right) else 0)
    upto = np.cumsum(partners)
    start = 0
    while start < len(block):
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + PAIRS, side="right")))
        n = partners[start:end]
        left = np.repeat(np.arange(start, end), n)
        yield left, np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + first[left]
        start = end


def _sorted(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """(rows by side, block and copies; their block, side, copies)."""
    table = table.sort_by([("side", "ascending"), ("block", "ascending"), ("copies", "ascending")])
    block = table.column("block").combine_chunks().dictionary_encode().indices.to_numpy()
    return table, block.astype(np.int64), table.column("side").to_numpy(), table.column("copies").to_numpy().astype(float)


def _meetings(block: np.ndarray, side: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(rows that meet rows as a whole, rows of blocks too small for that)."""
    if not (side == BOTH).all():
        return [(np.flatnonzero(side == LEFT), np.flatnonzero(side == RIGHT))], np.zeros(0, dtype=np.int64)
    edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    large = [np.arange(s, e) for s, e in zip(edges[:-1], edges[1:]) if e - s >= WHOLE]
    small = np.ones(len(block), dtype=bool)
    for rows in large:
        small[rows] = False
    return [(rows, rows) for rows in large], np.flatnonzero(small)


def _tables(compared: list[Field], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray | None]]:
    """(rows of `left`, of `right`, patterns, which entries are pairs or None for all), a bounded piece at a time.

    A field's levels are spread over the columns once; a row of patterns is then a sum of rows.
    """
    found = [f.table(left, right) for f in compared]
    within = left is right
    for t in range(0, len(right), COLUMNS):
        columns = slice(t, min(t + COLUMNS, len(right)))
        spread = []
        factor = 1
        for field, (levels, _, y) in zip(reversed(compared), reversed(found)):
            spread.append((levels.astype(np.int32) + 1)[:, y[columns]] * np.int32(factor))
            factor *= TOP_LEVEL[field.name] + 2
        spread.reverse()
        for s in range(0, columns.stop if within else len(left), ROWS):
            rows = slice(s, min(s + ROWS, len(left)))
            pattern = np.zeros((rows.stop - s, columns.stop - t), dtype=np.int32)
            for wide, (_, x, _) in zip(spread, found):
                pattern += wide[x[rows]]
            whole = not within or rows.stop <= t
            yield rows, columns, pattern, None if whole else np.arange(s, rows.stop)[:, None] < np.arange(t, columns.stop)[None, :]


def _levels_of(patterns: np.ndarray, fields: tuple[str, ...]) -> np.ndarray:
    """Levels by pattern and field."""
    out = np.zeros((len(patterns), len(fields)), dtype=np.int64)
    rest = patterns.astype(np.int64)
    for k in range(len(fields) - 1, -1, -1):
        rest, level = np.divmod(rest, TOP_LEVEL[fields[k]] + 2)
        out[:, k] = level - 1
    return out


def pattern_number(fields: tuple[str, ...]) -> int:
    return int(np.prod([TOP_LEVEL[f] + 2 for f in fields]))


def count_patterns(table: pa.Table, fields: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(levels per pattern, weight) of the pairs of a group; captures weigh their copies."""
    total = pattern_weights(table, fields)
    found = np.flatnonzero(total)
    return _levels_of(found, fields), total[found]


def pattern_weights(table: pa.Table, fields: tuple[str, ...]) -> np.ndarray:
    """The weight of every pattern among the pairs of a group; captures weigh their copies."""
    table, block, side, copies = _sorted(table)
    compared = [Field(f, table) for f in fields]
    total = np.zeros(pattern_number(fields))
    whole, few = _meetings(block, side)
    for left, right in whole:
        for rows, columns, pattern, pairs in _tables(compared, left, right):
            a, b = copies[left[rows]], copies[right[columns]]
            pattern = pattern.ravel() if pairs is None else pattern[pairs]
            if (a == a[0]).all() and (b == b[0]).all():
                total += a[0] * b[0] * np.bincount(pattern, minlength=len(total))
            else:
                weights = a[:, None] * b[None, :]
                total += np.bincount(pattern, weights=weights.ravel() if pairs is None else weights[pairs], minlength=len(total))
    for left, right in _pairs(block[few], side[few]):
        left, right = few[left], few[right]
        pattern = np.zeros(len(left), dtype=np.int64)
        for field in compared:
            pattern = pattern * (TOP_LEVEL[field.name] + 2) + field.levels(left, right) + 1
        total += np.bincount(pattern, weights=copies[left] * copies[right], minlength=len(total))
    return total


LIKE = "_like"  # captures with the same phone or e-mail stand together


def _span(sizes: DataFrame, tile: int, few: int) -> int:
    """The shortest span for which rows are moved SPREAD times at most on average, else the longest.

    A capture of a block of t > 1 spans goes to t groups, after it was put in order and written;
    `sizes` are those of large blocks, `few` the captures of all others.
    """
    n = F.col("n")
    spans = [tile << k for k in range(LONGEST + 1)]
    moved = [F.sum(F.when(n > s, n * (F.ceil(n / s) + 2)).otherwise(n)).alias(str(s)) for s in spans]
    found = sizes.agg(F.sum(n).alias("rows"), *moved).first()
    return next((s for s in spans if (found[str(s)] or 0) + few <= SPREAD * ((found["rows"] or 0) + few)), spans[-1])


def dealt(keyed: DataFrame, tile: int, group: int) -> DataFrame:
    """`keyed` (block, rep, ...) with `grp`, `side` and LIKE: captures of a block meet in a group, bounded by `tile` and `_span`.

    Tiles of a large block are cut from an order in which captures with the same phone or e-mail
    stand together, so that most values are compared in one group only.
    """
    spark = keyed.sparkSession
    n = shuffle_partitions(spark)
    sizes = materialize(keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile), "sizes")
    rows = keyed.count()
    few_rows = rows - (sizes.agg(F.sum("n")).first()[0] or 0)
    span = _span(sizes, tile, few_rows)
    large = sizes.select("block", F.ceil(F.col("n") / span).cast("int").alias("tiles"))
    bins = max(1, -(-rows // group))
    like = [F.regexp_replace(c, "[^0-9a-z]", "") if c in keyed.columns else F.lit(None).cast("string") for c in ("phone", "email", "address")]
    none = F.lit(None).cast("string")
    few = keyed.join(large, "block", "left_anti").select(
        F.struct(none.alias("of"), F.pmod(F.xxhash64("block"), F.lit(bins)).cast("int").alias("i"), F.lit(0).alias("j")).alias("grp"),
        F.lit(BOTH).alias("side"), none.alias(LIKE), *keyed.columns,
    )
    own, other = F.col("_own"), F.col("_other")
    hot = keyed.join(large, "block").withColumn(LIKE, F.coalesce(*like, F.lit("")))
    alone = hot.filter("tiles = 1").select(
        F.struct(F.col("block").alias("of"), F.lit(0).alias("i"), F.lit(0).alias("j")).alias("grp"), F.lit(BOTH).alias("side"), LIKE, *keyed.columns
    )
    out = few.unionByName(alone)
    if not sizes.filter(F.col("n") > span).isEmpty():
        tiled = running_total(Scratch(spark, "tiles"), hot.filter("tiles > 1"), ["block"], [LIKE, "rep"], None, "_at")
        tiled = tiled.withColumn("_own", F.floor(F.col("_at") / span).cast("int"))
        tiled = tiled.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        out = out.unionByName(tiled.select(
            F.struct(F.col("block").alias("of"), F.least(own, other).alias("i"), F.greatest(own, other).alias("j")).alias("grp"),
            F.when(own == other, BOTH).when(own < other, LEFT).otherwise(RIGHT).alias("side"), LIKE, *keyed.columns,
        ))
    # A fixed number: the work is in the pairs, so AQE must not merge groups because their rows are few.
    return out.repartition(TASKS * n, "grp")


def by_tiles(table: pa.Table, tile: int) -> Iterator[pa.Table]:
    """The group in parts of two tiles at most, in which every two of its captures that are to meet do so once."""
    if not len(table) or table.column("grp").combine_chunks().field("of")[0].as_py() is None:
        yield table
        return
    table = table.sort_by([("side", "ascending"), (LIKE, "ascending"), ("rep", "ascending")])
    side = table.column("side").to_numpy()
    cut = lambda at: [at[i : i + tile] for i in range(0, len(at), tile)]
    both, left, right = (cut(np.flatnonzero(side == s)) for s in (BOTH, LEFT, RIGHT))
    for at in both:
        yield table.take(pa.array(at))
    across = [(a, b) for i, a in enumerate(both) for b in both[i + 1 :]] + [(a, b) for a in left for b in right]
    place = table.column_names.index("side")
    for a, b in across:
        part = table.take(pa.array(np.concatenate([a, b])))
        sides = np.concatenate([np.full(len(a), LEFT, np.int32), np.full(len(b), RIGHT, np.int32)])
        yield part.set_column(place, "side", pa.array(sides))


def pair_patterns(vectors: DataFrame, rule: Rule, fields: tuple[str, ...], tile: int = TILE, group: int = GROUP) -> DataFrame:
    """(gamma_<field> ..., w): the weighted pairs of different captures in the blocks of `rule`, by pattern, per group."""
    columns = dict.fromkeys(c for f in fields for c in SOURCES[f])
    keyed = vectors.select(block_key(rule).alias("block"), "rep", F.col("copies").cast("long").alias("copies"), *columns).filter(
        F.col("block").isNotNull()
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pattern_number(fields))
        for table in by_tiles(pa.Table.from_batches(batches), tile):
            total += pattern_weights(table, fields)
        found = np.flatnonzero(total)
        patterns = _levels_of(found, fields)
        levels = {f"gamma_{f}": pa.array(patterns[:, k].astype(np.int32)) for k, f in enumerate(fields)}
        yield pa.RecordBatch.from_pydict({**levels, "w": pa.array(total[found])})

    schema = ", ".join([f"gamma_{f} int" for f in fields] + ["w double"])
    return dealt(keyed, tile, group).groupBy("grp").applyInArrow(of, schema)


def _same_rule(table: pa.Table, rules: tuple[Rule, ...], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the rule of a pair's block is the first one that the pair satisfies."""
    own = table.column("rule").to_numpy()[left]
    first = np.ones(len(left), dtype=bool)
    codes = {}
    for c in {c for rule in rules for c in rule}:
        codes[c] = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for i, rule in enumerate(rules[:-1]):
        at = np.flatnonzero(first & (own > i))
        same = np.ones(len(at), dtype=bool)
        for c in rule:
            x, y = codes[c][left[at]], codes[c][right[at]]
            same &= (x == y) & (x >= 0)
        first[at] = ~same
    return first


def pick_pairs(table: pa.Table, fields: tuple[str, ...], wanted: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, left, right, patterns): the pairs of a group whose pattern is wanted."""
    table, block, side, _ = _sorted(table)
    compared = [Field(f, table) for f in fields]
    found = []
    whole, few = _meetings(block, side)
    for left, right in whole:
        for rows, columns, pattern, pairs in _tables(compared, left, right):
            i, j = np.nonzero(wanted[pattern] if pairs is None else wanted[pattern] & pairs)
            found.append((left[rows][i], right[columns][j], pattern[i, j].astype(np.int64)))
    for left, right in _pairs(block[few], side[few]):
        left, right = few[left], few[right]
        pattern = np.zeros(len(left), dtype=np.int64)
        for field in compared:
            pattern = pattern * (TOP_LEVEL[field.name] + 2) + field.levels(left, right) + 1
        at = np.flatnonzero(wanted[pattern])
        found.append((left[at], right[at], pattern[at]))
    none = np.zeros(0, dtype=np.int64)
    return table, *(np.concatenate([none, *part]) for part in (zip(*found) if found else (none,) * 3))


def wanted_pairs(
    vectors: DataFrame, rules: tuple[Rule, ...], fields: tuple[str, ...], wanted: Callable[[pa.Table], np.ndarray],
    most: tuple[str, ...] = (), tile: int = TILE, group: int = GROUP,
) -> DataFrame:
    """(rep_l, rep_r, copies_l, copies_r, gamma_<field> ..., most ...): pairs under any rule, each once, whose pattern is wanted.

    `wanted` says of a group which patterns are; no other pair leaves its task. Of the columns
    `most` a pair has the greater value.
    """
    columns = dict.fromkeys([*(c for f in fields for c in SOURCES[f]), *(c for rule in rules for c in rule), *most])
    keyed = blocks(vectors, rules).select("rule", "block", "rep", F.col("copies").cast("long").alias("copies"), *columns)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_tiles(pa.Table.from_batches(batches), tile):
            yield from scored(part).to_batches()

    def scored(table: pa.Table) -> pa.Table:
        table, left, right, patterns = pick_pairs(table, fields, wanted(table))
        first = _same_rule(table, rules, left, right)
        left, right, patterns = left[first], right[first], patterns[first]
        rep = table.column("rep").combine_chunks()
        order = np.empty(len(rep), dtype=np.int64)
        order[pc.sort_indices(rep).to_numpy()] = np.arange(len(rep))
        swap = order[left] > order[right]
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        out = {"rep_l": rep.take(pa.array(left)), "rep_r": rep.take(pa.array(right))}
        copies = table.column("copies").to_numpy()
        out |= {"copies_l": pa.array(copies[left]), "copies_r": pa.array(copies[right])}
        levels = _levels_of(patterns, fields).astype(np.int32)
        out |= {f"gamma_{f}": pa.array(levels[:, k]) for k, f in enumerate(fields)}
        for c in most:
            value = table.column(c).combine_chunks()
            out[c] = pc.max_element_wise(value.take(pa.array(left)), value.take(pa.array(right)))
        return pa.table(out)

    text = f"rep_l {vectors.schema['rep'].dataType.simpleString()}, rep_r {vectors.schema['rep'].dataType.simpleString()}, copies_l long, copies_r long"
    schema = ", ".join([text, *[f"gamma_{f} int" for f in fields], *[f"{c} {vectors.schema[c].dataType.simpleString()}" for c in most]])
    return dealt(keyed, tile, group).groupBy("grp").applyInArrow(of, schema)


def ring_levels(ring: DataFrame, n: int, steps: int, fields: tuple[str, ...], segment: int = GROUP) -> DataFrame:
    """(field, level, n): levels of the pairs that each of the n captures of a ring makes with its next `steps`, per segment.

    A segment also holds the captures behind its end that its own ones meet.
    """
    columns = dict.fromkeys(c for f in fields for c in SOURCES[f])
    at = F.col("pos") - 1
    of = lambda place: F.floor(place / segment)
    met_by = F.when(at < steps, of(F.lit(n - 1)))  # across the seam, also the last segment, however short
    where = F.array_distinct(F.array_compact(F.array(of(at), of((at + n - steps) % n), met_by)))
    dealt = ring.select("pos", F.explode(where).alias("segment"), of(at).alias("_own"), *columns)
    dealt = dealt.select("segment", "pos", (F.col("_own") == F.col("segment")).alias("own"), *columns)

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        places = table.column("pos").to_numpy()
        own = np.flatnonzero(np.array(table.column("own").to_pylist()))
        left = np.repeat(own, steps)
        right = np.searchsorted(places, (places[left] + np.tile(np.arange(steps), len(own))) % n + 1)
        rows = []
        for f in fields:
            counts = np.bincount(Field(f, table).levels(left, right).astype(np.int64) + 1, minlength=8)
            rows += [(f, level - 1, int(counts[level])) for level in np.flatnonzero(counts)]
        names, levels, sums = zip(*rows) if rows else ((), (), ())
        return pa.table({"field": pa.array(names, pa.string()), "level": pa.array(levels, pa.int32()), "n": pa.array(sums, pa.int64())})

    if n < 2:
        dealt = dealt.limit(0)
    return dealt.groupBy("segment").applyInArrow(count, "field string, level int, n long")
