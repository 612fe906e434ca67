"""Every registered query with SQL, compared on DuckDB at the smallest scale."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tools.check_oracles import TABLES, compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
LONG = {"noise_rises", "pristine_capture"}  # several populations; run by tools/check_oracles.py


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - LONG))
def test_query_matches_sql(spark, con, name):
    verdict = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_oracles_name_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
