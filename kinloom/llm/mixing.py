"""Temperature mixing of sources, realised as budgeted block permutations.

A source with share s of all tokens gets the weight s^a / sum(s^a). The exponent a lies
between 1 (natural shares) and 0 (equal shares); the smallest one is bisected at which no
source is repeated more often than a limit, or the largest one at which the weights reach a
target entropy. The budget defaults to the tokens at which the least repeated source is
shown exactly once, so nothing is lost.

A source's budget is its weight times that of the mix. Passes over the source are permuted
by a keyed hash, whole ones first, and the last is cut at the budget. A row's place in its
source's passes, as a share of the source's budget, names its block, so that each block
holds all sources in the mix's proportions; within a block rows are permuted again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import text_key, words
from kinloom.operators.ids import running_total
from kinloom.session import Scratch

MAX_REPEATS = 2.0
BLOCK_TOKENS = 1 << 20
GRID = 64  # exponents looked at in one pass of the bisection
PASSES = 4


def n_tokens(text: Column) -> Column:
    """Words and one end of text; null and empty texts have the end only."""
    return F.size(words(text)).cast("long") + 1


def _readings(totals: DataFrame, exponents: list[float], all_tokens: int, budget: float | None) -> list[tuple[float, float, float]]:
    """(exponent, entropy in nats, most repeats) for each exponent, from one pass over the sources."""
    share = F.col("tokens") / F.lit(float(all_tokens))
    powered = F.pow(share, F.col("a"))
    rows = (
        totals.select("tokens", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        .groupBy("a")
        .agg(
            F.sum(powered).alias("z"),
            F.sum(powered * F.log(share)).alias("l"),
            F.max(powered / share).alias("high"),
            F.min(powered / share).alias("low"),
        )
        .collect()
    )
    readings = []
    for r in sorted(rows, key=lambda r: r.a):
        repeats = r.high / r.low if budget is None else budget / all_tokens * r.high / r.z
        readings.append((r.a, math.log(r.z) - r.a * r.l / r.z, repeats))
    return readings


def temperature(
    totals: DataFrame, all_tokens: int, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: float | None = None
) -> float:
    """The exponent. Repeats and entropy both fall as it grows; 1 if even natural shares break the repetition limit."""
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        grid = [low + (high - low) * k / GRID for k in range(GRID + 1)]
        read = _readings(totals, grid, all_tokens, budget)
        if entropy is not None:
            good = [a for a, h, _ in read if h >= entropy - 1e-12] or [grid[0]]
            low, high = good[-1], min([a for a in grid if a > good[-1]] or [good[-1]])
        else:
            good = [a for a, _, r in read if r <= max_repeats + 1e-12] or [grid[-1]]
            low, high = max([a for a in grid if a < good[0]] or [good[0]]), good[0]
        if low == high:
            break
    return low if entropy is not None else high


def mix(
    docs: DataFrame,
    max_repeats: float | None = MAX_REPEATS,
    entropy: float | None = None,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 9,
) -> DataFrame:
    """(doc_id, key, source, tokens, pass, weight, block, slot): a row for every showing of a row of `docs`.

    `slot` runs from 0 without gaps in each block. A null source is a source of its own.
    Null and empty texts weigh one token. Repeated rows are each shown; null ids pass through.
    A row is shown in the last pass if it starts before the budget is used up.
    """
    twin = F.monotonically_increasing_id()
    return _mix(docs, twin, max_repeats, entropy, budget, block_tokens, seed).drop("_twin")


def _mix(
    docs: DataFrame, twin: Column, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS, seed: int = 9,
) -> DataFrame:
    """`mix` with the column `_twin`, which tells all rows of `docs` apart."""
    scratch = Scratch(docs.sparkSession, "mixing")
    narrow = scratch.put(
        docs.select(
            "doc_id", text_key(F.col("text")).alias("key"), F.col("source"), n_tokens(F.col("text")).alias("tokens"), twin.alias("_twin")
        ),
        "narrow",
    )
    totals = scratch.put(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens")), "totals")
    all_tokens = totals.agg(F.sum("tokens")).first()[0] or 0
    if not all_tokens:
        return narrow.select(
            "doc_id", "key", "source", "tokens", F.lit(0).alias("pass"), F.lit(0.0).alias("weight"),
            F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("slot"), "_twin",
        )
    a = temperature(totals, all_tokens, max_repeats, entropy, budget)
    share = F.col("tokens") / F.lit(float(all_tokens))
    z, least = totals.agg(F.sum(F.pow(share, F.lit(a))), F.min(F.pow(share, F.lit(a)) / share)).first()
    spent = float(budget) if budget is not None else all_tokens * z / least
    plan = scratch.put(
        totals.select(
            F.col("source").alias("_source"),
            (F.pow(share, F.lit(a)) / F.lit(z)).alias("weight"),
            F.col("tokens").alias("_total"),
        ).withColumn("_budget", F.round(F.col("weight") * F.lit(spent), 3)),
        "plan",
    )
    whole = F.floor(F.col("_budget") / F.col("_total")).cast("int")
    rest = F.col("_budget") - whole * F.col("_total")
    passes = narrow.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "pass", F.explode(F.sequence(F.lit(0), whole))
    )
    passes = passes.filter((F.col("pass") < whole) | (rest > 0))
    drawn = passes.withColumns(
        {"_group": F.coalesce("source", F.lit("\0")), "_draw": F.xxhash64("doc_id", "key", "pass", F.lit(seed))}
    )
    placed = running_total(scratch, drawn, ("_group", "pass"), ("_draw", "doc_id", "key", "_twin"), "tokens")
    n_blocks = max(1, math.ceil(spent / block_tokens))
    position = (F.col("pass") * F.col("_total") + F.col("before")) / F.col("_budget")
    shown = placed.filter((F.col("pass") < whole) | (F.col("before") < rest)).select(
        "doc_id", "key", "source", "tokens", "pass", "weight",
        F.least(F.floor(position * n_blocks), F.lit(n_blocks - 1)).cast("long").alias("block"),
        F.xxhash64("_draw", F.lit(seed + 1)).alias("_order"), "_twin",
    )
    return running_total(scratch, shown, ("block",), ("_order", "doc_id", "key", "_twin", "pass"), None, "slot").drop("_order")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` as often as the mix shows them, columns unchanged, stored in the order of blocks and slots."""
    scratch = Scratch(docs.sparkSession, "mixed")
    # Written once, so that a row's id is a fact on disk.
    rows = scratch.put(docs.withColumn("__mix_row", F.monotonically_increasing_id()), "rows", "zstd")
    shown = _mix(rows, F.col("__mix_row"), **options)
    places = scratch.put(shown.select(F.col("_twin").alias("__mix_row"), F.struct("block", "slot").alias("__mix_at")), "places")
    placed = rows.join(places, "__mix_row")
    return placed.repartitionByRange("__mix_at").sortWithinPartitions("__mix_at").select(*docs.columns)
