"""A small table with everything that may go wrong in it."""

from pyspark.sql import functions as F

CLASHES = (
    "key fp fingerprint component component_id first words node shard slot size before row kind start end hash tokens weight block "
    "passage score ids tail base digest payload label count entity surrogate entities blocked"
).split()
LONG = " ".join(f"wort{i}" for i in range(40_000))
PROSE = " ".join(f"sailor{i} carried{i % 5} lantern{i % 7} beyond{i % 3}" for i in range(30))


def odd_documents(spark):
    rows = [
        (1, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),  # a repeated row
        (3, None, "en", None),
        (4, "", None, "b"),
        (5, " \t\n\x0b\f\r", "de", "b"),
        (None, PROSE.replace("lantern3", "torch"), "en", "a"),
        (None, None, None, None),
        (6, LONG, "en", "c"),
        (7, "zwei Wörter", "de", "c"),
        (8, "é€😀 " * 60, "fr", "c"),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(f"extra {c}") for c in CLASHES})


def empty_documents(spark):
    return odd_documents(spark).filter("doc_id < 0")
