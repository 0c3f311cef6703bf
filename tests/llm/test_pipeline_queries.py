import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import queries as registered
from graphloom.llm.common import stored, table


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_queries_run_and_equal_sql(spark, sf_dir, duck, same, name):
    df = registered.queries()[name](spark, sf_dir)
    sql = registered.oracle_sql().get(name)
    if sql:
        assert same(df, duck, sql) > 0
    else:
        assert df.count() > 0
    if "doc_id" in df.columns and name != "op5_packing":
        assert df.count() == table(spark, sf_dir, "documents").count()


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stored(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns
        sizes.append(docs.count())
        assert docs.select("doc_id").distinct().count() == sizes[-1]
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 0.4 * sizes[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == sizes[-1]
    assert corpus_pipeline.run(spark, sf_dir).agg(F.sum("length")).first()[0] == pieces.agg(F.sum("length")).first()[0]


def test_stages_take_empty_tables_and_nulls(spark, sf_dir):
    """Nulls and blanks go with the first stage; without it they are equal texts, of which one stays, and are kept otherwise."""
    docs = table(spark, sf_dir, "documents")
    rows = spark.createDataFrame([(None, None, None, None, None), (-1, None, None, None, None), (-1, "", "en", None, 0)], docs.schema)
    for given, n in ((docs.limit(0), 0), (rows, 3)):
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, stored(given, "given"), sf_dir)
            if at < 4:
                assert out.columns == docs.columns
            assert out.count() == (0 if at == 0 else min(n, 1) if at == 1 else n), (at, n)


def test_columns_with_clashing_names_are_carried(spark, sf_dir, make, words):
    text = lambda i: " ".join(words[(i * 37 + j * 7) % 800] for j in range(60)) + "."
    docs = make([(i, text(i)) for i in range(12)] + [(50, text(3))]).withColumn("file", F.col("doc_id")).withColumn("at", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        assert "uid" in docs.columns and docs.filter("at = 'x' and file = doc_id").count() == docs.count() == 12, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == 12


def test_the_session_and_the_shared_folder_are_left_as_they_were(spark, sf_dir):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    corpus_pipeline.run(spark, sf_dir).count()
    assert spark.conf.get(name) == before


def test_a_task_has_one_python_worker(spark, sf_dir):
    """Repeated passages cut a text once, and mixing takes its counts to the executors without a worker of another kind."""
    docs = table(spark, sf_dir, "documents")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(corpus_pipeline.repeats(spark, docs, sf_dir)).count("ArrowEvalPython") == 1
    mixed = plan(corpus_pipeline.mixing(spark, docs, sf_dir))
    assert "ExistingRDD" not in mixed and mixed.count("MapInPandas") > 0
