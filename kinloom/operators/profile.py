"""One unified profile per cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.schemas import MASTER_ID, RECORD_ID

# Record type whose latest status fills a profile column.
STATUS_COLUMNS = {
    "tax_status": "TAX_RECORD",
    "driving_licence_status": "DRIVING_LICENCE",
    "passport_status": "PASSPORT",
    "employment_status": "EMPLOYMENT_REGISTRATION",
    "housing_assistance": "HOUSING_BENEFIT",
    "veteran_status": "VETERAN_RECORD",
}
DETAIL_LISTS = {
    "benefits_received": "BENEFITS_RECORD",
    "current_prescriptions": "PRESCRIPTION",
    "education_history": "EDUCATION_RECORD",
}

PROFILE_COLUMNS = (
    MASTER_ID, "preferred_name", "date_of_birth", "marital_status", "current_address", "current_city",
    "current_postcode", "confidence_score", "record_count", "agency_count", "linked_agencies", "tax_status",
    "benefits_received", "healthcare_registrations", "hospital_visits", "current_prescriptions",
    "education_history", "driving_licence_status", "passport_status", "employment_status",
    "housing_assistance", "veteran_status",
)


def linked_records(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """Records with their cluster and confidence: the input of everything below."""
    return records.drop("match_probability").join(
        clusters.select(RECORD_ID, MASTER_ID, "match_probability"), RECORD_ID
    )


def _mixed_case(name: str) -> Column:
    c = F.col(name)
    return (c != F.upper(c)) & (c != F.lower(c))


def survivors(linked: DataFrame) -> DataFrame:
    """Best name, birth date and address from one pass over the records.

    Each record casts one vote per attribute; votes are counted, then every
    attribute's winner is taken in a single aggregation per cluster. Both steps
    combine map-side, where a window would sort a whole cluster in one task.

    Name: fullest, best-cased, most frequent. Birth date: most frequent.
    Address: most frequent, most complete, most recent.
    """
    null = F.lit(None).cast("string")
    vote = lambda kind, *cols: F.struct(
        F.lit(kind).alias("kind"), *[c.alias(n) for c, n in zip(cols, "abc")]
    )
    c = F.col
    votes = linked.select(
        MASTER_ID,
        "record_date",
        F.inline(
            F.array(
                vote("name", c("first_name"), c("last_name"), null),
                vote("born", c("date_of_birth"), null, null),
                vote("place", c("address"), c("city"), c("postcode")),
            )
        ),
    )
    counted = votes.groupBy(MASTER_ID, "kind", "a", "b", "c").agg(
        F.count(F.lit(1)).alias("n"), F.max("record_date").alias("latest")
    )
    is_name, is_born = c("kind") == "name", c("kind") == "born"
    is_place = (c("kind") == "place") & F.coalesce("a", "b", "c").isNotNull()
    name_order = F.struct(F.length("a"), _mixed_case("a"), _mixed_case("b"), "n", "a", "b")
    filled = sum((c(x).isNotNull().cast("int") for x in "abc"), F.lit(0))
    place_order = F.struct("n", filled, "latest", *[F.coalesce(x, F.lit("")) for x in "abc"])
    return counted.groupBy(MASTER_ID).agg(
        F.max_by(F.concat("a", F.lit(" "), "b"), F.when(is_name, name_order)).alias("preferred_name"),
        F.max_by("a", F.when(is_born, F.struct("n", "a"))).alias("date_of_birth"),
        F.max_by(F.struct("a", "b", "c"), F.when(is_place, place_order)).alias("place"),
    )


def latest(value: str, *record_types: str) -> Column:
    """The value on the latest record of these types that has one."""
    wanted = F.col("record_type").isin(*record_types) & F.col(value).isNotNull()
    return F.max_by(value, F.when(wanted, F.struct("record_date", RECORD_ID)))


def distinct_list(value: str, *record_types: str) -> Column:
    """Sorted distinct values; the value domains are small code lists."""
    wanted = F.col(value)
    if record_types:
        wanted = F.when(F.col("record_type").isin(*record_types), wanted)
    return F.array_sort(F.collect_set(wanted))


def cluster_aggregates(linked: DataFrame) -> DataFrame:
    agencies = distinct_list("agency")
    return linked.groupBy(MASTER_ID).agg(
        F.avg("match_probability").alias("confidence_score"),
        F.count(F.lit(1)).alias("record_count"),
        F.size(agencies).cast("long").alias("agency_count"),
        agencies.alias("linked_agencies"),
        latest("marital_status", "TAX_RECORD", "BENEFITS_RECORD").alias("marital_status"),
        F.count_if(F.col("record_type") == "HEALTHCARE_REGISTRATION").alias("healthcare_registrations"),
        F.count_if(F.col("record_type") == "HOSPITAL_VISIT").alias("hospital_visits"),
        *[latest("status", rt).alias(c) for c, rt in STATUS_COLUMNS.items()],
        *[distinct_list("detail", rt).alias(c) for c, rt in DETAIL_LISTS.items()],
    )


def build_profiles(linked: DataFrame) -> DataFrame:
    """The 22-column profile table, one row per cluster."""
    place = F.col("place")
    return (
        survivors(linked)
        .join(cluster_aggregates(linked), MASTER_ID)
        .withColumns(
            {
                "current_address": place["a"],
                "current_city": place["b"],
                "current_postcode": place["c"],
            }
        )
        .select(*PROFILE_COLUMNS)
    )
