"""CSV, JSON and report-table exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions import expr
from kinloom.operators.dossier import dossiers
from kinloom.operators.population import review_queue, search, tier_members
from kinloom.schemas import MASTER_ID, RECORD_ID

# Columns of the directory file.
DIRECTORY_COLUMNS = (
    MASTER_ID, "name", "age", "marital_status", "engagement_tier", "linked_agencies", "agency_count",
    "record_count", "confidence_score", "tax_status", "employment_status", "driving_licence_status",
    "passport_status", "housing_assistance", "veteran_status", "healthcare_registrations", "hospital_visits",
)


def directory_rows(results: DataFrame) -> DataFrame:
    """Search results (tier and age included) in the directory's flat form."""
    return results.withColumns(
        {
            "name": F.col("preferred_name"),
            "linked_agencies": F.array_join("linked_agencies", "|"),
            "confidence_score": F.round("confidence_score", 6),
        }
    ).select(*DIRECTORY_COLUMNS)


def directory(linked: DataFrame, profiles: DataFrame, text: str = "", as_of: str | None = None) -> DataFrame:
    return directory_rows(search(linked, profiles, text, as_of))


def tier_directory(profiles: DataFrame, tier: str, as_of: str | None = None) -> DataFrame:
    return directory_rows(tier_members(profiles, tier, as_of))


def review_rows(profiles: DataFrame, limit: int = 500) -> DataFrame:
    return review_queue(profiles, limit).withColumn("linked_agencies", F.array_join("linked_agencies", "|"))


def report_profiles(profiles_with_tier: DataFrame) -> DataFrame:
    """The heading and status row of the printed report."""
    status = ("tax_status", "employment_status", "driving_licence_status", "passport_status", "housing_assistance", "veteran_status")
    return profiles_with_tier.select(
        MASTER_ID,
        F.concat("preferred_name", F.lit(" ("), MASTER_ID, F.lit(")")).alias("heading"),
        F.coalesce("marital_status", F.lit("Not on file")).alias("marital_status"),
        "engagement_tier",
        "age",
        "agency_count",
        expr.percent_text(F.col("confidence_score")).alias("linkage_confidence"),
        F.col("healthcare_registrations").cast("string").alias("healthcare_registrations"),
        *[expr.or_dash(F.col(c)).alias(c) for c in status],
    )


def report_records(linked: DataFrame) -> DataFrame:
    """The report's record table, attributes flattened to `Key: value; ...`."""
    return linked.select(
        MASTER_ID,
        RECORD_ID,
        "agency",
        expr.humanized(F.lower("record_type")).alias("record_type"),
        "record_date",
        expr.or_dash(F.col("status")).alias("status"),
        expr.percent_text(F.col("match_probability")).alias("confidence"),
        expr.or_dash(expr.attributes_text(F.col("attributes"))).alias("details"),
    )


def report_agreement(agreement: DataFrame, lists: DataFrame) -> DataFrame:
    """The report's field table; a very long value list continues on more pages."""
    return agreement.join(lists, [MASTER_ID, "field"], "left").select(
        MASTER_ID,
        "field",
        F.coalesce("page", F.lit(0)).alias("page"),
        F.when(F.col("is_consistent"), "Yes").otherwise("No").alias("consistent"),
        F.coalesce(F.array_join("distinct_values", ", "), F.lit("")).alias("distinct_values"),
    )


def write_csv(rows: DataFrame, path: str, *order: str) -> None:
    """A header per part file; `order` sorts globally by range partitioning."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").option("header", True).csv(path)


def write_json(linked: DataFrame, profiles: DataFrame, path: str, as_of: str | None = None) -> None:
    """One JSON document per person, or per page of a very large dossier."""
    dossiers(linked, profiles, as_of).write.mode("overwrite").json(path)
