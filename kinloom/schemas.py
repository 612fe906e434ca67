"""Enumerations and table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The agencies, in their published order.
AGENCIES = (
    "Revenue & Tax",
    "Social Security",
    "Healthcare",
    "Education",
    "Immigration",
    "Driver Licensing",
    "Passport Office",
    "Employment",
    "Housing",
    "Veterans Affairs",
    "Criminal Justice",
)

# Record type -> issuing agency.
RECORD_TYPES = {
    "TAX_RECORD": "Revenue & Tax",
    "BENEFITS_RECORD": "Social Security",
    "HEALTHCARE_REGISTRATION": "Healthcare",
    "HOSPITAL_VISIT": "Healthcare",
    "PRESCRIPTION": "Healthcare",
    "EDUCATION_RECORD": "Education",
    "IMMIGRATION_RECORD": "Immigration",
    "DRIVING_LICENCE": "Driver Licensing",
    "PASSPORT": "Passport Office",
    "EMPLOYMENT_REGISTRATION": "Employment",
    "HOUSING_BENEFIT": "Housing",
    "VETERAN_RECORD": "Veterans Affairs",
    "CRIMINAL_RECORD": "Criminal Justice",
}

# Agencies that can be a coverage gap, in priority order.
COVERAGE_AGENCIES = (
    "Healthcare",
    "Revenue & Tax",
    "Employment",
    "Driver Licensing",
    "Passport Office",
    "Social Security",
    "Education",
    "Housing",
)

# Engagement tier -> (lowest, highest) number of agencies.
ENGAGEMENT_TIERS = {
    "Minimal Engagement": (1, 1),
    "Limited Engagement": (2, 2),
    "Moderate Engagement": (3, 4),
    "High Engagement": (5, 5),
    "Full Engagement": (6, None),
}

RECORD_ID = "source_record_id"
MASTER_ID = "master_citizen_id"
TRUTH = "person_index"
COMPARED = ("first_name", "last_name", "date_of_birth", "email", "phone", "address", "postcode")


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


CITIZENS = T.StructType(
    [T.StructField(TRUTH, T.LongType())]
    + _strings("first_name", "last_name", "date_of_birth", "email", "phone", "address", "city", "postcode", "marital_status")
)

RECORDS = T.StructType(
    _strings(RECORD_ID)
    + [T.StructField(TRUTH, T.LongType())]
    + _strings(
        "agency", "record_type", "agency_reference_id", "first_name", "last_name", "date_of_birth", "email",
        "phone", "address", "city", "postcode", "record_date", "expiry_date", "status",
    )
    + [T.StructField("amount", T.DoubleType())]
    + _strings("provider_name", "detail", "marital_status")
    + [T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))]
)

CLUSTERS = T.StructType(_strings(RECORD_ID, MASTER_ID) + [T.StructField("match_probability", T.DoubleType())])

EDGES = T.StructType(
    _strings(f"{RECORD_ID}_l", f"{RECORD_ID}_r")
    + [T.StructField("match_probability", T.DoubleType())]
    + [T.StructField(f"gamma_{c}", T.IntegerType()) for c in COMPARED]
)


def require(df: DataFrame, columns: tuple[str, ...] | list[str], stage: str) -> DataFrame:
    """Fail early, naming the stage whose output is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks {', '.join(missing)}: run the {stage} stage first")
    return df
