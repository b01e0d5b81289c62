import corpus_pipeline
from tests.llm.cases import frame, texts, words


def test_stages_on_odd_documents(spark, tmp_path):
    item = words(900, 30) + ". " + words(901, 12)
    rows = [*texts(), (90, words(902, 70) + " " + item), (91, words(903, 200))]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0), (11, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    left = {r.doc_id for r in kept.collect()}
    assert {1, 9, 10, 11, 12, 13, 14, 91} <= left and not {3, 90} & left
    packed = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed == left


def test_line_stage_drops_whole_runs(spark):
    run = "\n".join([words(1, 60), words(2, 10), words(3, 20)])
    docs = frame(spark, [(k, f"{words(10 + k, 70)}\n{run}\n{words(20 + k, 70)}") for k in (1, 2)])
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert left[2] == f"{words(12, 70)}\n{words(22, 70)}" and run in left[1]


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
