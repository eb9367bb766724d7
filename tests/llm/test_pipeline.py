import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "encoding" or out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        assert docs.count() > 0
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
