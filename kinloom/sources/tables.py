"""Reading the shared tables and persisting derived ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinloom.schemas import COMPARED, RECORD_ID, require


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def persist(df: DataFrame, path: str) -> DataFrame:
    """Replace a derived table and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def linkage_pool(records: DataFrame) -> DataFrame:
    """What the matcher may see: the id and the compared columns, never the truth."""
    require(records, (RECORD_ID, *COMPARED), "generation")
    return records.select(RECORD_ID, *COMPARED)
