from tabq.streaming.live import each_batch


def test_each_batch_is_queried(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "a long, b long").repartition(3)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/{n}"))
    q = each_batch(stream, "SELECT b, count(*) AS n FROM t GROUP BY b", sink, str(tmp_path / "ck"))
    assert q.awaitTermination(60)
    out = spark.read.parquet(*[str(p) for p in (tmp_path / "out").iterdir()])
    assert out.groupBy("b").sum("n").count() == 3 and out.selectExpr("sum(n)").first()[0] == 30
