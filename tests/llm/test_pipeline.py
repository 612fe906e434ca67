"""The pipeline's stages on the smallest tables, each judged on its own input."""

import collections

import pytest

import corpus_pipeline
from kinloom.llm import quality
from kinloom.llm.queries import QUERIES
from tests.llm.helpers import empty_documents, odd_documents
from tests.llm.test_jaccard import stand

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns_and_every_clean_document(spark, outputs):
    docs, good, single, clean, mixed, sharded = outputs
    for df in outputs[:-1]:
        assert df.columns == docs.columns
    assert set(sharded.columns) == {*docs.columns, "shard"}
    assert ids(good) == ids(quality.quality_report(docs).filter("kept"))
    assert set(ids(single)) == stand({r.doc_id: r.text for r in good.collect()})
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert ids(clean) == collections.Counter(r.doc_id for r in single.collect() if not any(t in r.text for t in items))
    assert set(ids(mixed)) == set(ids(clean)) and max(ids(mixed).values()) <= 2
    assert ids(sharded) == ids(mixed) and {r.shard for r in sharded.select("shard").distinct().collect()} == set(range(8))


def test_run_equals_the_stages(spark, outputs):
    assert ids(corpus_pipeline.run(spark, FOLDER)) == ids(outputs[-1])


@pytest.mark.parametrize("docs", [odd_documents, empty_documents])
def test_stages_take_odd_tables(spark, docs):
    state = docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, FOLDER)
    state.collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_tables(spark, name):
    rows = QUERIES[name](spark, FOLDER)
    table = "pages" if name.startswith(("op8", "op10_")) else "embeddings" if name.startswith("op13") else "documents"
    if not name.startswith(("op3", "op9", "op11")):
        assert rows.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
