"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinloom.llm import collocations, decontam, flatgraph, infill, kdtree, lm, mixing, pii, quality, secrets, simhash, urls, warc
from kinloom.sources.tables import read_table

SURROGATE_KEY = "registered query"  # a job passes its own secret
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op1_simhash(spark, sf):
    found = simhash.near_duplicates(read_table(spark, sf, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query
def op2_kd_shards(spark, sf):
    return kdtree.shard_rows(read_table(spark, sf, "documents"), shards=8)


@query
def op3_decontamination(spark, sf):
    return decontam.contaminated(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


@query
def op4_quality_cascade(spark, sf):
    return quality.quality_report(read_table(spark, sf, "documents"))


@query
def op9_temperature_mix(spark, sf):
    return mixing.mix(read_table(spark, sf, "documents")).drop("key")


@query
def op7_secret_ownership(spark, sf):
    return secrets.secret_spans(read_table(spark, sf, "documents"))


@query
def op5_surrogates(spark, sf):
    return pii.surrogate_report(read_table(spark, sf, "documents"), key=SURROGATE_KEY)


@query
def op6_recurrent_lm(spark, sf):
    return lm.score_documents(read_table(spark, sf, "documents"))


@query
def op8_seekable_warc(spark, sf):
    return warc.round_trip(read_table(spark, sf, "pages"))


@query
def op10_url_trees(spark, sf):
    return urls.filter_urls(read_table(spark, sf, "pages"))


@query
def op11_collocations(spark, sf):
    return collocations.collocations(read_table(spark, sf, "documents"))


@query
def op12_infill(spark, sf):
    return infill.digests(read_table(spark, sf, "documents"))


@query
def op13_flat_graph(spark, sf):
    return flatgraph.near_duplicates(read_table(spark, sf, "embeddings"))
