"""What several of the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words are runs of anything but these six characters: space, tab, line feed,
# vertical tab, form feed, carriage return.
GAPS = " \t\n\x0b\f\r"
GAP_PATTERN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAPS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, GAP_PATTERN)).otherwise(F.array().cast("array<string>"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not use."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def text_key(text: Column) -> Column:
    """Tells the rows of a repeated id apart by their text; a null text is not an empty one."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text, F.lit(1)))
