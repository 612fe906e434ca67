import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kinloom.session import build_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def partition_fixture(spark):
    """Eight records of four people: one exact, one over-split, one over-merged cluster."""
    person = {"R1": 0, "R2": 0, "R3": 0, "R4": 1, "R5": 1, "R6": 2, "R7": 2, "R8": 3}
    cluster = {"R1": "C1", "R2": "C1", "R3": "C1", "R4": "C2", "R5": "C3", "R6": "C4", "R7": "C4", "R8": "C4"}
    rows = []
    for i, (r, p) in enumerate(person.items()):
        odd = i % 2 == 1
        rows.append(
            (r, p, "Healthcare" if odd else "Revenue & Tax", "HOSPITAL_VISIT" if odd else "TAX_RECORD", f"Person{p}", "Test",
             f"199{p}-01-01", f"person{p}@example.test", f"0700000000{p}", f"{p} Test Street", f"TE{p} 1ST", "2024-01-01")
        )
    records = spark.createDataFrame(
        rows,
        "source_record_id string, person_index long, agency string, record_type string, first_name string, last_name string, "
        "date_of_birth string, email string, phone string, address string, postcode string, record_date string",
    )
    clusters = spark.createDataFrame(
        [(r, c, 0.99) for r, c in cluster.items()], "source_record_id string, master_citizen_id string, match_probability double"
    )
    return records, clusters
