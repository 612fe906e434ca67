"""The full picture behind a profile: records, agreement, tags, case file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import expr
from kinloom.functions.paging import paged_lists, with_page
from kinloom.operators.population import with_tier_and_age
from kinloom.schemas import MASTER_ID, RECORD_ID

# Fields checked for agreement.
AGREEMENT_FIELDS = ("email", "phone", "address", "postcode", "date_of_birth", "last_name")

# Case-file sections with their record types.
CASE_FILE = {
    "Identity & Travel": ("PASSPORT", "DRIVING_LICENCE", "IMMIGRATION_RECORD"),
    "Health": ("HEALTHCARE_REGISTRATION", "HOSPITAL_VISIT", "PRESCRIPTION"),
    "Finance & Employment": ("TAX_RECORD", "EMPLOYMENT_REGISTRATION", "BENEFITS_RECORD", "HOUSING_BENEFIT"),
    "Education, Service & Legal": ("EDUCATION_RECORD", "VETERAN_RECORD", "CRIMINAL_RECORD"),
}
REPEATED_TYPES = ("HOSPITAL_VISIT", "PRESCRIPTION")

# Thresholds of the evidence-cited tags.
FREQUENT_VISITS = 3
SEVERAL_PRESCRIPTIONS = 2
SEVERAL_BENEFITS = 2
SEVERAL_QUALIFICATIONS = 2
LONG_EMPLOYMENT_YEARS = 10

RECORD_FIELDS = (
    RECORD_ID, "agency", "record_type", "agency_reference_id", "first_name", "last_name", "date_of_birth",
    "email", "phone", "address", "city", "postcode", "record_date", "expiry_date", "status", "amount",
    "provider_name", "detail", "attributes", "match_probability",
)


def dossier_records(linked: DataFrame) -> DataFrame:
    """The linked records, one row each; a reader orders them by `record_date`."""
    return linked.select(MASTER_ID, *RECORD_FIELDS)


def field_values(linked: DataFrame) -> DataFrame:
    """Distinct non-empty values per cluster and field, in long form."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in AGREEMENT_FIELDS])
    return (
        linked.select(MASTER_ID, F.inline(pairs))
        .filter((F.col("value").isNotNull()) & (F.col("value") != ""))
        .distinct()
    )


def field_agreement(linked: DataFrame) -> DataFrame:
    """Per cluster and field: how many values, and whether they agree.

    Fields nobody filled in appear too, as consistent with zero values.
    """
    fields = F.explode(F.array(*[F.lit(f) for f in AGREEMENT_FIELDS])).alias("field")
    everyone = linked.select(MASTER_ID).distinct().select(MASTER_ID, fields)
    counted = field_values(linked).groupBy(MASTER_ID, "field").agg(F.count(F.lit(1)).alias("n"))
    return everyone.join(counted, [MASTER_ID, "field"], "left").select(
        MASTER_ID,
        "field",
        F.coalesce("n", F.lit(0)).alias("value_count"),
        (F.coalesce("n", F.lit(0)) <= 1).alias("is_consistent"),
    )


def agreement_lists(linked: DataFrame) -> DataFrame:
    """The distinct values as sorted lists, in pages where a cluster has very many."""
    return paged_lists(field_values(linked), [MASTER_ID, "field"], F.col("value"), "distinct_values")


def _tag(condition: Column, name: str, basis: Column) -> Column:
    return F.when(condition, F.struct(F.lit(name).alias("tag"), basis.alias("basis")))


def _several(column: str, least: int, name: str, what: str) -> Column:
    values = F.col(column)
    basis = F.concat(
        F.size(values).cast("string"), F.lit(f" {what} on record: "), F.array_join(F.array_sort(values), ", "), F.lit(".")
    )
    return _tag(F.size(values) >= least, name, basis)


def fact_tags(linked: DataFrame, profiles: DataFrame, as_of: str | None = None) -> DataFrame:
    """Plain restatements of facts on file, each citing its evidence."""
    employed = linked.filter(F.col("record_type") == "EMPLOYMENT_REGISTRATION")
    since = employed.groupBy(MASTER_ID).agg(F.min("record_date").alias("employed_since"))
    years = expr.whole_years(F.try_to_date("employed_since", "yyyy-MM-dd"), expr.as_date(as_of))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    # The texts of the tags.
    tags = F.array_compact(
        F.array(
            _tag(
                F.col("hospital_visits") >= FREQUENT_VISITS,
                "Frequent healthcare service user",
                text(F.col("hospital_visits").cast("string"), " hospital visits on record."),
            ),
            _several("current_prescriptions", SEVERAL_PRESCRIPTIONS, "Multiple active prescriptions", "prescriptions"),
            _several(
                "benefits_received", SEVERAL_BENEFITS, "Multiple benefit types on record", "distinct benefit types"
            ),
            _several(
                "education_history",
                SEVERAL_QUALIFICATIONS,
                "Multiple education qualifications on record",
                "qualifications",
            ),
            _tag(
                years >= LONG_EMPLOYMENT_YEARS,
                "Long-standing employment record",
                text(
                    "Employment record on file since ", F.col("employed_since"), " (", years.cast("string"), " years)."
                ),
            ),
            _tag(
                F.col("housing_assistance").isNotNull(),
                "Registered for housing assistance",
                text("Housing assistance record on file, status '", F.col("housing_assistance"), "'."),
            ),
            _tag(
                F.col("veteran_status").isNotNull(),
                "Veteran of the armed forces",
                text("Veterans Affairs record on file, status '", F.col("veteran_status"), "'."),
            ),
        )
    )
    return profiles.join(since, MASTER_ID, "left").select(MASTER_ID, F.inline(tags))


def case_file(linked: DataFrame) -> DataFrame:
    """Cards per section: every instance of a repeated type, one of the others.

    Records of a type come in date order and the single card shows the first.
    """
    rows = [
        F.struct(F.lit(t).alias("record_type"), F.lit(i).alias("section_order"), F.lit(s).alias("section"))
        for i, (s, types) in enumerate(CASE_FILE.items())
        for t in types
    ]
    section = F.get(F.filter(F.array(*rows), lambda r: r["record_type"] == F.col("record_type")), F.lit(0))
    shown = ("record_date", RECORD_ID, "agency", "provider_name", "status", "detail", "match_probability", "attributes")
    cards = linked.select(MASTER_ID, "record_type", F.struct(*shown).alias("card"))
    repeated = F.col("record_type").isin(*REPEATED_TYPES)
    order = F.struct("card.record_date", f"card.{RECORD_ID}")
    single = (
        cards.filter(~repeated)
        .groupBy(MASTER_ID, "record_type")
        .agg(F.min_by("card", order).alias("card"))
    )
    return (
        cards.filter(repeated)
        .unionByName(single)
        .withColumn("place", section)
        .select(MASTER_ID, "place.section_order", "place.section", "record_type", "card.*")
        .withColumn("confidence_band", expr.confidence_band(F.col("match_probability")))
    )


def dossiers(linked: DataFrame, profiles: DataFrame, as_of: str | None = None) -> DataFrame:
    """Nested form: the profile with its records by date, agreement and tags.

    A cluster of ordinary size is one row. A hot cluster continues in further
    pages, each with the same profile columns, so no row grows without bound; the
    pages in sequence are the person's records by date.
    """
    paged = with_page(dossier_records(linked), [MASTER_ID], ("record_date", RECORD_ID))
    ordered = ("record_date", *[c for c in RECORD_FIELDS if c not in ("record_date", "attributes")])
    item = F.struct(*ordered, F.map_entries("attributes").alias("attributes"))
    records = paged.groupBy(MASTER_ID, "page").agg(F.array_sort(F.collect_list(item)).alias("records"))
    agreement = (
        field_agreement(linked)
        .groupBy(MASTER_ID)
        .agg(F.array_sort(F.collect_list(F.struct("field", "is_consistent", "value_count"))).alias("field_agreement"))
    )
    tags = (
        fact_tags(linked, profiles, as_of)
        .groupBy(MASTER_ID)
        .agg(F.array_sort(F.collect_list(F.struct("tag", "basis"))).alias("summary"))
    )
    empty = F.array().cast("array<struct<tag:string,basis:string>>")
    return (
        with_tier_and_age(profiles, as_of)
        .join(records, MASTER_ID)
        .join(agreement, MASTER_ID)
        .join(tags, MASTER_ID, "left")
        .withColumn("summary", F.coalesce("summary", empty))
    )
