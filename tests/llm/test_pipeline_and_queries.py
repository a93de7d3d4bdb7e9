import pytest

import corpus_pipeline
from tests.compare import check_engine, check_rows, spark_rows, spark_types
from tests.llm.samples import documents, rows
from visitlens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_against_its_check(spark, sample_dir, name):
    got = spark_rows(queries.QUERIES[name](spark, sample_dir))
    assert got == check_rows(check_engine(sample_dir), queries.CHECKS[name])


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}


def test_stages_on_awkward_rows(spark):
    docs = documents(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        last = i == len(corpus_pipeline.STAGES) - 1
        assert last or out.columns == docs.columns
        assert out.count() >= (0 if last else 1)
        assert stage(spark, docs.limit(0), "").count() == 0
    assert len(rows()) == docs.count()


def test_run_is_the_stages_in_turn(spark, sample_dir):
    out = corpus_pipeline.run(spark, sample_dir)
    assert set(spark_types(out)) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert out.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0
