from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import database, differences
from mapengine.llm import line_dedup, mixing, quality, simhash
from mapengine.llm.queries import oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no given tables here")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_sql(spark, name):
    assert differences(queries()[name](spark, SF_DIR), database(SF_DIR), oracle_sql()[name]) == []


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("extra", F.lit(1))
    columns = docs.columns
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SF_DIR))
    for step in steps[:-1]:
        assert step.columns == columns
    _, good, deduped, single, mixed, packed = steps
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    verdicts = {r.doc_id: r.kept for r in quality.quality(docs, labels).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, k in verdicts.items() if k}
    assert deduped.count() == good.count()
    assert line_dedup.dedup_lines(deduped).agg(F.sum("n_dropped")).first()[0] == 0
    assert deduped.where("n_chars <> char_length(text)").isEmpty()
    classes = simhash.near_duplicates(deduped).select("component_id").distinct().count()
    assert single.count() == classes
    taken = {r.doc_id: r.copies for r in mixing.mix(single).collect() if r.copies}
    assert {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == taken
    whole = packed.agg(F.sum("length")).first()[0]
    lengths = [r.n for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert whole == sum(lengths) and all(n == 2048 or n & (n - 1) == 0 for n in lengths)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0


def test_awkward_documents(spark, documents, awkward):
    steps = documents(*awkward).select("doc_id", "text", "lang", "source", "n_chars", "size")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, steps.where("doc_id < 0") if "text" in steps.columns else steps, SF_DIR)
        assert empty.count() == 0
        steps = stage(spark, steps, SF_DIR)
