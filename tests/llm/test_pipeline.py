from tokenizers import Tokenizer  # noqa: F401

import corpus_pipeline


def test_stages(spark, sf, tmp_path, messy):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_stages_take_messy_and_empty_tables(spark, sf, messy):
    for rows in (messy, messy.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, sf).count() <= 2 * rows.count() + 40


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 10
