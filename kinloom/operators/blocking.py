"""Candidate pairs from equality rules, and their counts without the pairs."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.expr import pair_count
from kinloom.operators.compare import with_parts
from kinloom.schemas import COMPARED, RECORD_ID
from kinloom.session import materialize, shuffle_partitions

# The blocking rules and the deterministic rules of the prior.
BLOCKING_RULES = (
    ("first_name", "last_name"),
    ("email",),
    ("phone",),
    ("date_of_birth", "postcode"),
    ("last_name", "postcode"),
    ("initial", "last_name", "date_of_birth"),
)
DETERMINISTIC_RULES = (
    ("email",),
    ("phone", "last_name"),
    ("date_of_birth", "postcode", "last_name"),
)

TILE_ROWS = 4_000
BROADCAST_ROWS = 200_000
HASHES = (1, 2)  # seeds of the halves of a 128-bit key
KEYS_AT_ONCE = 8
LEAST_BUCKETS = 1 << 12  # of keys, in which large blocks are looked for

Rule = tuple[str, ...]


def captures(pool: DataFrame) -> DataFrame:
    """The pool with a fingerprint of its compared values; empty text is missing."""
    clean = {c: F.nullif(F.col(c), F.lit("")) for c in COMPARED}
    marked = [F.coalesce(F.concat(F.lit("="), v), F.lit("0")) for v in clean.values()]
    return pool.select(
        RECORD_ID,
        *[v.alias(c) for c, v in clean.items()],
        F.md5(F.concat_ws("\u0001", *marked)).alias("capture"),
    )


def collapse(captured: DataFrame) -> DataFrame:
    """One row per distinct capture: its smallest record id and its record count.

    Exact copies, however many, would score alike against everything; from here on
    they are one row, and the pairs among them are counted instead of listed.
    """
    return with_parts(
        captured.groupBy("capture").agg(
            F.min(RECORD_ID).alias("rep"),
            F.count(F.lit(1)).alias("copies"),
            *[F.min(c).alias(c) for c in COMPARED],
        )
    )


def block_key(rule: Rule, prefix: str = "") -> Column:
    """NULL as soon as one part is missing, so missing values never meet."""
    parts = [F.col(c) for c in rule]
    out = [F.lit(prefix)]
    for part in parts:
        out += [F.lit("\u0001"), part]
    return F.concat(*out)


def _with_initial(df: DataFrame) -> DataFrame:
    return df if "initial" in df.columns else df.withColumn("initial", F.substring("first_name", 1, 1))


def blocks(df: DataFrame, rules: tuple[Rule, ...] = BLOCKING_RULES) -> DataFrame:
    """Rows in long form: one per rule the row has a key for."""
    keyed = [F.struct(F.lit(i).alias("rule"), block_key(r, str(i)).alias("block")) for i, r in enumerate(rules)]
    named = F.filter(F.array(*keyed), lambda k: k["block"].isNotNull())
    return _with_initial(df).select("*", F.inline(named))


def block_sizes(df: DataFrame, rules: tuple[Rule, ...] = BLOCKING_RULES, weight: str | None = None) -> DataFrame:
    """Records and possible pairs per block, largest first when a reader sorts."""
    size = F.sum(weight) if weight else F.count(F.lit(1))
    return (
        blocks(df, rules)
        .groupBy("rule", "block")
        .agg(size.alias("n"))
        .withColumn("pairs", pair_count(F.col("n")).cast("double"))
    )


def _needed(rules: tuple[Rule, ...]) -> frozenset[str]:
    """All columns that must agree for every rule to fire; a name implies its initial."""
    columns = frozenset(c for r in rules for c in r)
    return columns - {"initial"} if "first_name" in columns else columns


def _signed_sets(rules: tuple[Rule, ...]) -> dict[frozenset[str], int]:
    """Inclusion-exclusion over the rules, equal column sets merged."""
    signs: dict[frozenset[str], int] = {}
    for size in range(1, len(rules) + 1):
        for chosen in combinations(rules, size):
            columns = _needed(chosen)
            signs[columns] = signs.get(columns, 0) + (1 if size % 2 else -1)
    return {c: s for c, s in signs.items() if s}


def _set_key(number: int, columns: list[str]) -> Column:
    """128 bits that tell a set's values from all others, NULL as soon as one is missing."""
    present = F.lit(True)
    for c in columns:
        present = present & F.col(f"{c}_{HASHES[0]}").isNotNull()
    halves = [F.xxhash64(F.lit(seed), *[F.col(f"{c}_{seed}") for c in columns]) for seed in HASHES]
    return F.struct(F.lit(number).alias("columns"), F.when(present, halves[0]).alias("high"), halves[1].alias("low"))


def union_pair_counts(records: DataFrame, rules: tuple[Rule, ...] = BLOCKING_RULES) -> DataFrame:
    """Per rule its pairs, and the pairs no earlier rule has, without listing any.

    A set of rules fires together exactly when all their columns agree, so the size
    of every intersection is a sum of n over 2, and the union follows by
    inclusion-exclusion: one aggregation, however large the blocks are.
    """
    steps = [_signed_sets(rules[: i + 1]) for i in range(len(rules))]
    sets = sorted({s for step in steps for s in step} | {_needed((r,)) for r in rules}, key=sorted)
    used = sorted(set().union(*sets))
    # Each value is hashed once per record; what is dealt out per set are two longs, not the values.
    hashed = [F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(seed), F.col(c))).alias(f"{c}_{seed}") for c in used for seed in HASHES]
    marked = _with_initial(records).select(*hashed)
    marked = materialize(marked.repartition(shuffle_partitions(records.sparkSession)), "marked")
    keys = [_set_key(i, sorted(s)) for i, s in enumerate(sets)]
    # Few keys to a reader of the hashes: the JVM does not compile the one long method of all of them.
    parts = [marked.select(F.inline(F.array(*keys[at : at + KEYS_AT_ONCE]))) for at in range(0, len(keys), KEYS_AT_ONCE)]
    counted = (
        reduce(DataFrame.unionByName, parts)
        .filter("high IS NOT NULL")
        .groupBy("columns", "high", "low")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .groupBy("columns")
        .agg(F.sum(pair_count(F.col("n"))).alias("pairs"))
    )
    place = {s: i for i, s in enumerate(sets)}

    def total(signs: dict[frozenset[str], int]) -> Column:
        terms = F.coalesce(*[F.when(F.col("columns") == place[s], sign) for s, sign in signs.items()], F.lit(0))
        return F.coalesce(F.sum(F.col("pairs") * terms), F.lit(0)).cast("double")

    single = [total({_needed((r,)): 1}).alias(f"own_{i}") for i, r in enumerate(rules)]
    union = [total(step).alias(f"union_{i}") for i, step in enumerate(steps)]
    rows = [
        F.struct(
            F.lit(i).alias("rule"),
            F.lit(" + ".join(r)).alias("columns"),
            F.col(f"own_{i}").alias("pairs"),
            (F.col(f"union_{i}") - (F.col(f"union_{i - 1}") if i else F.lit(0.0))).alias("new_pairs"),
            F.col(f"union_{i}").alias("pairs_so_far"),
        )
        for i, r in enumerate(rules)
    ]
    return counted.agg(*single, *union).select(F.inline(F.array(*rows)))


def _rule_keys(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """Two longs per rule, 128 bits that tell its values from all others; NULL as soon as one is missing."""
    keys = {}
    for i, rule in enumerate(rules):
        present = reduce(Column.__and__, [F.col(c).isNotNull() for c in rule])
        keys |= {f"key{i}_{seed}": F.when(present, F.xxhash64(F.lit(seed), *rule)) for seed in HASHES}
    return keys


def _earlier(rule: int) -> Column:
    """The keys of the rules before this one, halves in turn: all that tells whether a pair in its block is a new one."""
    return F.array(*[F.col(f"key{i}_{seed}") for i in range(rule) for seed in HASHES]).cast("array<long>")


def _met_before(rules: tuple[Rule, ...]) -> Column:
    """Whether a pair agrees on an earlier rule than that of its block; keeps each pair under one rule only."""
    same = lambda at: F.get("l.earlier", F.lit(at)) == F.get("r.earlier", F.lit(at))
    met = [F.coalesce(same(2 * i) & same(2 * i + 1), F.lit(False)) for i in range(len(rules) - 1)]
    return reduce(Column.__or__, met, F.lit(False))


def _hot_blocks(keyed: DataFrame, on: list[str], tile_rows: int, rows: int) -> DataFrame:
    """(on, tiles) of the blocks above `tile_rows`.

    Keys are counted by buckets first, whose counts are few: only in a bucket above `tile_rows` can a block be.
    """
    bucket = F.pmod(on[-1], F.lit(max(LEAST_BUCKETS, 4 * -(-rows // tile_rows)))).alias("bucket")
    crowded = keyed.groupBy("rule", bucket).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile_rows)
    crowded = materialize(crowded.select("rule", "bucket"), "crowded")
    n = crowded.count()
    crowded = F.broadcast(crowded) if n <= BROADCAST_ROWS else crowded
    tiles = F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles")
    keys = keyed.select(*on, bucket).join(crowded, ["rule", "bucket"], "left_semi")
    return materialize(keys.groupBy(*on).agg(tiles).filter("tiles > 1"), "hot")


def candidate_pairs(
    vectors: DataFrame,
    rules: tuple[Rule, ...] = BLOCKING_RULES,
    tile_rows: int = TILE_ROWS,
    carried: tuple[str, ...] | None = None,
) -> DataFrame:
    """Pairs of distinct captures that agree on at least one rule, each pair once.

    The members of a block are listed in the order of `rep`, and each one meets those
    behind it: a pair is looked at once per rule, and only the keys of earlier rules are
    compared, two longs each; a member brings no others. A block above `tile_rows` is cut into tiles whose pairs are listed
    on their own: the work of a hot block is the same, but spread evenly over many
    tasks. Output: structs `l` and `r` of the columns `carried` (all, if not named)
    with l.rep < r.rep, and the `rule` that proposed the pair.
    """
    carried = carried or tuple(vectors.columns)
    keys = _rule_keys(rules)
    named = [
        F.struct(F.lit(i).alias("rule"), *[F.col(f"key{i}_{s}").alias(f"half_{s}") for s in HASHES], _earlier(i).alias("earlier"))
        for i in range(len(rules))
    ]
    on = ["rule", *[f"half_{s}" for s in HASHES]]
    marked = _with_initial(vectors).filter("rep IS NOT NULL").withColumns(keys)
    own = list(dict.fromkeys(["rep", *carried]))
    keyed = marked.select(F.struct(*own).alias("_own"), F.inline(F.array(*named))).filter(F.col(on[-1]).isNotNull())
    keyed = keyed.select(*on, F.struct(*[F.col(f"_own.{c}") for c in own], "earlier").alias("left"))
    hot = _hot_blocks(keyed, on, tile_rows, vectors.count())
    n_hot = hot.count()
    lists = [F.sort_array(F.collect_list("left")).alias("left")]
    behind = F.slice("left", F.col("at") + 2, F.size("left"))
    if n_hot:
        # Few hot keys travel to every task; many are joined like any table.
        hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        tiled = keyed.join(hot, on, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("left.rep"), F.col("tiles")).cast("int"))
        tiled = tiled.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        keyed = tiled.select(
            *on, F.least("tile", "met").alias("ti"), F.greatest("tile", "met").alias("tj"),
            F.when(F.col("tile") <= F.col("met"), F.col("left")).alias("left"),
            F.when(F.col("tile") > F.col("met"), F.col("left")).alias("right"),
        )
        on += ["ti", "tj"]
        lists.append(F.collect_list("right").alias("right"))
        behind = F.when(F.col("ti") == F.col("tj"), behind).otherwise(F.col("right"))
    # A fixed number of partitions: pairs multiply after the lists, so AQE must not
    # merge these because their inputs look small.
    listed = keyed.repartition(shuffle_partitions(vectors.sparkSession), *on).groupBy(*on).agg(*lists)
    # By a lambda, members leave their list one at a time; two plain generators in a row would run as one
    # loop that holds all pairs of a list as rows before the first is handed on.
    placed = F.transform("left", lambda m, at: F.struct(m.alias("l"), at.alias("at")))
    met = listed.select("*", F.inline(placed)).select("rule", "l", F.explode(behind).alias("r"))
    met = met.filter(~_met_before(rules) & (F.col("l.rep") != F.col("r.rep")))
    l, r = (F.struct(*[F.col(f"{side}.{c}") for c in carried]) for side in "lr")
    if n_hot:
        in_order = F.col("l.rep") < F.col("r.rep")
        l, r = F.when(in_order, l).otherwise(r), F.when(in_order, r).otherwise(l)
    return met.select("rule", l.alias("l"), r.alias("r"))
