"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinloom.schemas import COVERAGE_AGENCIES, ENGAGEMENT_TIERS

# Histogram labels with their lower bounds, lowest first.
PROBABILITY_BUCKETS = {
    "< 0.75": None,
    "0.75 - 0.90": 0.75,
    "0.90 - 0.95": 0.90,
    "0.95 - 0.99": 0.95,
    ">= 0.99": 0.99,
}
SIZE_BUCKETS = ("1", "2", "3", "4+")
SCORE_BUCKETS = ("0-20", "20-40", "40-60", "60-80", "80-100")


def full_name(first: str = "first_name", last: str = "last_name") -> Column:
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def squeezed(column: str) -> Column:
    """A postcode without its blanks."""
    return F.replace(F.col(column), F.lit(" "), F.lit(""))


def ilike_contains(column: Column, text: str) -> Column:
    """Case-blind containment; % and _ of the user stay wildcards, \\ is literal."""
    return column.ilike("%" + text.replace("\\", "\\\\") + "%")


def engagement_tier(agency_count: Column) -> Column:
    branches = [(label, top) for label, (_, top) in ENGAGEMENT_TIERS.items()]
    tier = F.lit(branches[-1][0])
    for label, top in reversed(branches[:-1]):
        tier = F.when(agency_count <= top, label).otherwise(tier)
    return tier


def probability_bucket(p: Column) -> Column:
    bucket = F.lit("< 0.75")
    for label, low in PROBABILITY_BUCKETS.items():
        if low is not None:
            bucket = F.when(p >= low, label).otherwise(bucket)
    return bucket


def size_bucket(n: Column) -> Column:
    return F.when(n >= 4, "4+").otherwise(n.cast("string"))


def score_bucket(score: Column) -> Column:
    slot = F.least(F.floor(score / 20), F.lit(len(SCORE_BUCKETS) - 1)).cast("int")
    return F.get(F.array(*[F.lit(b) for b in SCORE_BUCKETS]), slot)


def confidence_band(p: Column) -> Column:
    return F.when(p >= 0.99, "high").when(p >= 0.90, "medium").otherwise("low")


def coverage_gaps(linked: Column) -> Column:
    return F.array_except(F.array(*[F.lit(a) for a in COVERAGE_AGENCIES]), linked)


def first_gap(linked: Column) -> Column:
    return F.get(coverage_gaps(linked), F.lit(0))


def whole_years(start: Column, end: Column) -> Column:
    """Completed years from `start` to `end`, by birthday."""
    not_yet = F.struct(F.month(end), F.dayofmonth(end)) < F.struct(F.month(start), F.dayofmonth(start))
    return F.year(end) - F.year(start) - not_yet.cast("int")


def age(date_of_birth: Column, as_of: Column | None = None) -> Column:
    born = F.try_to_date(date_of_birth, "yyyy-MM-dd")
    return whole_years(born, F.current_date() if as_of is None else as_of)


def as_date(text: str | None) -> Column:
    return F.current_date() if text is None else F.to_date(F.lit(text))


def humanized(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def attributes_text(attributes: Column) -> Column:
    """`{tax_year: 2024}` as `Tax Year: 2024; ...`, keys in order."""
    lines = F.transform(
        F.array_sort(F.map_entries(attributes)),
        lambda e: F.concat(humanized(e["key"]), F.lit(": "), e["value"]),
    )
    return F.array_join(lines, "; ")


def percent_text(p: Column) -> Column:
    hundredfold = p.cast("decimal(9,6)") * 100
    return F.concat(hundredfold.cast("decimal(5,1)").cast("string"), F.lit("%"))


def or_dash(column: Column) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit("-"))


def pair_count(n: Column) -> Column:
    """n over 2, exact beyond the range of a long."""
    wide = n.cast("decimal(19,0)")
    return wide * (wide - 1) / 2
