"""Multi-agency `records` derived from the order table.

One order is one noisy capture and its customer is the person. The layers hold
plain SQL expressions, so another engine can evaluate the very same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinloom.session import shuffle_partitions
from kinloom.sources.tables import read_table


def _pick(selector: str, values: tuple[str, ...]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {selector} {arms} END"


_AGENCY = _pick(
    "agency_ix",
    (
        "Revenue & Tax", "Social Security", "Healthcare", "Education", "Immigration", "Driver Licensing",
        "Passport Office", "Employment", "Housing", "Veterans Affairs", "Criminal Justice",
    ),
)
_RECORD_TYPE = (
    "CASE agency_ix WHEN 0 THEN 'TAX_RECORD' WHEN 1 THEN 'BENEFITS_RECORD' "
    "WHEN 2 THEN CASE k%3 WHEN 0 THEN 'HEALTHCARE_REGISTRATION' WHEN 1 THEN 'HOSPITAL_VISIT' ELSE 'PRESCRIPTION' END "
    "WHEN 3 THEN 'EDUCATION_RECORD' WHEN 4 THEN 'IMMIGRATION_RECORD' WHEN 5 THEN 'DRIVING_LICENCE' "
    "WHEN 6 THEN 'PASSPORT' WHEN 7 THEN 'EMPLOYMENT_REGISTRATION' WHEN 8 THEN 'HOUSING_BENEFIT' "
    "WHEN 9 THEN 'VETERAN_RECORD' ELSE 'CRIMINAL_RECORD' END"
)

LAYERS: tuple[dict[str, str], ...] = (
    {
        "k": "o_orderkey",
        "p": "o_custkey",
        "q8": "CAST(FLOOR(o_custkey/8.0) AS INT)",
        "q64": "CAST(FLOOR(o_custkey/64.0) AS INT)",
        "q384": "CAST(FLOOR(o_custkey/384.0) AS INT)",
        "order_day": "substr(CAST(o_orderdate AS VARCHAR(30)),1,10)",
        "status": "o_orderstatus",
        "amount": "o_totalprice",
    },
    {
        "k": "k", "p": "p", "order_day": "order_day", "status": "status", "amount": "amount",
        "fn": _pick("p%8", ("James", "Robert", "William", "Elizabeth", "Margaret", "Thomas", "Joseph", "Edward")),
        "nick": _pick("p%8", ("Jim", "Bob", "Billy", "Liz", "Maggie", "Tom", "Joe", "Ted")),
        "ln": "concat("
        + _pick("q8%8", ("Ash", "Brad", "Car", "Dun", "Elm", "Fern", "Har", "Kings")) + ","
        + _pick("q64%6", ("ton", "ford", "ley", "wood", "bury", "field")) + ","
        + _pick("q384%12", ("", "er", "man", "s", "by", "more", "ham", "well", "ing", "dale", "ster", "wick")) + ")",
        "dob": "concat(CAST(1960+(p*7)%40 AS VARCHAR(4)),'-',lpad(CAST(1+(p*5)%12 AS VARCHAR(2)),2,'0'),'-',"
        "lpad(CAST(1+(p*11)%28 AS VARCHAR(2)),2,'0'))",
        "pc": "concat('ZZ',CAST(p%90 AS VARCHAR(4)),' ',CAST((p*3)%10 AS VARCHAR(4)),'AB')",
        "agency_ix": "CAST((p%11 + k%(1+p%6))%11 AS INT)",
    },
    {
        "source_record_id": "concat('REC',lpad(CAST(k AS VARCHAR(12)),9,'0'))",
        "person_index": "p",
        "agency": _AGENCY,
        "record_type": _RECORD_TYPE,
        "agency_reference_id": "concat('REF',lpad(CAST((k*7919)%1000000 AS VARCHAR(6)),6,'0'))",
        "first_name": "CASE WHEN k%20<11 THEN fn WHEN k%20<16 THEN nick WHEN k%20<18 THEN substr(fn,1,1) "
        "WHEN k%20=18 THEN upper(fn) ELSE lower(fn) END",
        "last_name": "CASE WHEN k%7=3 THEN upper(ln) "
        "WHEN k%13=5 THEN concat(substr(ln,1,1),substr(ln,3,1),substr(ln,2,1),substr(ln,4)) ELSE ln END",
        "date_of_birth": "CASE WHEN k%19=7 AND substr(dob,9,2)<='12' "
        "THEN concat(substr(dob,1,5),substr(dob,9,2),'-',substr(dob,6,2)) ELSE dob END",
        "email": "CASE WHEN k%8=1 THEN NULL WHEN k%5<3 "
        "THEN concat(lower(fn),'.',lower(ln),CAST(p AS VARCHAR(12)),'@mail.test') "
        "ELSE concat(lower(fn),'_',lower(ln),'@post.test') END",
        "phone": "CASE WHEN k%9=2 THEN NULL WHEN k%2=0 "
        "THEN concat('(0',CAST(1000+p%9000 AS VARCHAR(6)),') ',lpad(CAST((p*37)%1000000 AS VARCHAR(6)),6,'0')) "
        "ELSE concat('0',CAST(1000+p%9000 AS VARCHAR(6)),lpad(CAST((p*37)%1000000 AS VARCHAR(6)),6,'0')) END",
        "address": "CASE WHEN k%10=4 THEN NULL WHEN k%3=1 THEN concat(CAST(1+p%200 AS VARCHAR(4)),' ',ln,' St') "
        "ELSE concat(CAST(1+p%200 AS VARCHAR(4)),' ',ln,' Street') END",
        "city": _pick("p%7", ("Ashford", "Bellmoor", "Cranswick", "Dunholme", "Elmsgate", "Ferngate", "Kingsmere")),
        "postcode": "CASE WHEN k%10<3 THEN replace(pc,' ','') ELSE pc END",
        "record_date": "order_day",
        "expiry_date": f"CASE WHEN ({_RECORD_TYPE}) IN ('DRIVING_LICENCE','PASSPORT') "
        "THEN concat(CAST(CAST(substr(order_day,1,4) AS INT)+10 AS VARCHAR(4)),substr(order_day,5)) ELSE NULL END",
        "status": "status",
        "amount": f"CASE WHEN ({_RECORD_TYPE}) IN ('TAX_RECORD','BENEFITS_RECORD','EMPLOYMENT_REGISTRATION','HOUSING_BENEFIT') "
        "THEN amount ELSE NULL END",
        "provider_name": f"concat(({_AGENCY}),' Office ',CAST(k%5 AS VARCHAR(2)))",
        "detail": f"CASE WHEN ({_RECORD_TYPE}) IN ('TAX_RECORD','HEALTHCARE_REGISTRATION','PASSPORT') THEN NULL "
        "ELSE concat('Kind ',CAST(agency_ix AS VARCHAR(2)),'-',CAST(k%6 AS VARCHAR(2))) END",
        "marital_status": "CASE WHEN agency_ix IN (0,1) THEN "
        + _pick("p%5", ("Single", "Married", "Divorced", "Widowed", "Separated")) + " ELSE NULL END",
        "capture_channel": _pick("k%3", ("Online", "Paper", "Phone")),
        "case_year": "substr(order_day,1,4)",
        "match_probability": "CAST(100 - k%40 AS DOUBLE)/CAST(100 AS DOUBLE)",
    },
)

RECORDS_SQL = "orders"
for _layer in LAYERS:
    _select = ", ".join(f"{expr} AS {name}" for name, expr in _layer.items())
    RECORDS_SQL = f"SELECT {_select} FROM {RECORDS_SQL if RECORDS_SQL == 'orders' else f'({RECORDS_SQL}) AS layer'}"


def derived_records(spark: SparkSession, folder: str) -> DataFrame:
    """`records` with the full column set; one row per order.

    Orders are few bytes and much to derive from: they are dealt to tasks, between layers, so that the
    last one is not expanded into expressions of orders that are too long for the JVM to compile.
    """
    df = read_table(spark, folder, "orders")
    for i, layer in enumerate(LAYERS):
        df = df.repartition(shuffle_partitions(spark)) if i == len(LAYERS) - 1 else df
        df = df.selectExpr(*[f"{expr} AS {name}" for name, expr in layer.items()])
    return df.selectExpr(
        "* EXCEPT (capture_channel, case_year)",
        "map('capture_channel', capture_channel, 'case_year', case_year) AS attributes",
    )


def true_clusters(records: DataFrame) -> DataFrame:
    """A clustering that equals the ground truth: a fixed input for profile queries."""
    return records.selectExpr(
        "source_record_id", "format_string('MC%05d', person_index) AS master_citizen_id", "match_probability"
    )
