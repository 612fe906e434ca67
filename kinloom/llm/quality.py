"""Quality rules as a short-circuit cascade, ordered by what a rule rejects for its cost.

Everything is a column expression: no shuffle, no Python. The measures are defined on
words (runs of anything but white space) of the whole text; a null text has none.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import GAPS, words
from kinloom.session import Scratch

UPPER = r"[A-Z\u00C0-\u00D6\u00D8-\u00DE]"  # capitals of the Latin script
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """`rejects` is a condition on the text column; it is null-safe, an empty text is judged as such."""

    name: str
    rejects: Column


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def word_chars(found: Column) -> Column:
    return F.length(F.array_join(found, ""))


def n_symbols(text: Column) -> Column:
    return _count(text, SYMBOLS)


def _lines(text: Column) -> Column:
    """Lines with at least one word."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda line: F.length(F.btrim(line, F.lit(GAPS))) > 0)


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return _let(_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_repeat_words(found: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more among the words `found`.

    Texts whose windows all differ, nearly all, are done after hashing. Else a window's hash and its place share one long: the place fills the low bits, so a sort
    brings equal windows together. Neighbours that agree in the high bits are compared by
    their full hashes.
    """

    def repeated(keys: Column, hashes: Column, place: Column, high: Column) -> Column:
        agree = F.filter(
            F.sequence(F.lit(0), F.size(keys) - 2),
            lambda i: F.get(keys, i).bitwiseXOR(F.get(keys, i + 1)).bitwiseAND(high) == 0,
        )
        pair = F.transform(agree, lambda i: F.transform(F.slice(keys, i + 1, 2), lambda x: x.bitwiseAND(place)))
        equal = F.filter(pair, lambda p: F.get(hashes, F.get(p, 0)) == F.get(hashes, F.get(p, 1)))
        starts = F.array_distinct(F.flatten(equal))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

    def of(w: Column) -> Column:
        hashes = F.transform(
            F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
        )
        low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(w)))) - 1
        packed = lambda h, place: F.sort_array(
            F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(place)).bitwiseOR(i.cast("long")))
        )
        some = lambda h: _let(low, lambda place: _let(packed(h, place), lambda keys: repeated(keys, h, place, F.bitwise_not(place))))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(
            _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(some(h)))
        )

    return _let(found, of)


def base_failed(words_found: Column, repeat_words: Column) -> Column:
    """Fewer than 50 words, or over half of them in repeated windows."""
    return (words_found < 50) | (100 * repeat_words > 50 * words_found)


def standard_rules(text: Column, found: Column) -> list[Rule]:
    """The rules of the base contract, and rules against text that is hardly prose; `found` are the text's words.

    The limits leave room above what labelled good texts reach.
    """
    count = F.size(found)
    per_word, per_char = F.greatest(count, F.lit(1)), F.greatest(word_chars(found), F.lit(1))
    return [
        Rule("few_words", count < 50),
        Rule("repeated_windows", 100 * n_repeat_words(found) > 50 * count),
        Rule("word_length", ~(word_chars(found) / per_word).between(2.5, 12.0) & (count > 0)),
        Rule("symbols", n_symbols(text) / per_word > 0.3),
        Rule("upper_case", _count(text, UPPER) / per_char > 0.3),
        Rule("digits", _count(text, "[0-9]") / per_char > 0.3),
        Rule("exclamations", _count(text, "!") / per_word > 0.5),
        Rule("dup_lines", n_dup_lines(text) > 0.5 * F.greatest(F.size(_lines(text)), F.lit(1))),
    ]


def cascade_order(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected), best rejection per second first, measured on `sample` (columns _text, _words).

    The order only decides what is computed first: a text is rejected by the same set of
    rules in any order.
    """
    read = F.sum(F.length("_text") + F.size("_words"))
    sample.agg(read).first()
    started = time.perf_counter()
    sample.agg(read).first()
    idle = time.perf_counter() - started
    measured = []
    for rule in rules:
        started = time.perf_counter()
        share = sample.agg(read, F.avg(rule.rejects.cast("int"))).first()[1]
        measured.append((rule, max(time.perf_counter() - started - idle, 1e-3), share or 0.0))
    return sorted(measured, key=lambda m: -m[2] / m[1])


def _ordered(docs: DataFrame, names: set[str], sample_rows: int) -> list[str]:
    """The named standard rules in cascade order, estimated on about `sample_rows` rows drawn from all of the table."""
    scratch = Scratch(docs.sparkSession, "cascade")
    share = min(1.0, sample_rows / max(docs.count(), 1))
    drawn = docs.select(F.col("text").alias("_text")).sample(share, seed=4)
    sample = scratch.put(drawn.withColumn("_words", words(F.col("_text"))), "sample")
    rules = [r for r in standard_rules(F.col("_text"), F.col("_words")) if r.name in names]
    order = [m[0].name for m in cascade_order(sample, rules)]
    scratch.clear()
    return order


def first_rejection(rules: list[Rule], order: list[str]) -> Column:
    """The first rule in the given order that rejects a text, else null; later ones are not evaluated."""
    by_name = {r.name: r for r in rules}
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(by_name[name].rejects, F.lit(name)).otherwise(verdict)
    return verdict


def keep_good(docs: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """The rows that no rule rejects, columns unchanged. Null and empty texts are rejected; repeated rows stay."""
    order = _ordered(docs, {r.name for r in standard_rules(F.col("text"), F.array())}, sample_rows)
    text = F.col("text")
    return docs.filter(_let(words(text), lambda found: first_rejection(standard_rules(text, found), order).isNull()))


def quality_report(docs: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """One row per document: the base measures, `base_failed`, and `kept`, the verdict of the cascade.

    A null text counts as empty: all measures 0, base_failed. Ids are passed through, null or repeated.
    The measures are needed for every row here, so the cascade only runs the remaining rules.
    """
    text, found = F.col("text"), F.col("words")
    rest = {r.name for r in standard_rules(text, found)} - {"few_words", "repeated_windows"}
    order = _ordered(docs, rest, sample_rows)
    measured = docs.select("doc_id", "text", words(text).alias("words")).select(
        "doc_id",
        "text",
        "words",
        F.size(found).cast("long").alias("n_words"),
        word_chars(found).cast("long").alias("word_chars"),
        n_symbols(text).cast("long").alias("n_symbols"),
        n_dup_lines(text).cast("long").alias("n_dup_lines"),
        n_repeat_words(found).cast("long").alias("n_repeat_words"),
    )
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(first_rejection(standard_rules(text, found), order).isNull()).alias("kept"),
    )
