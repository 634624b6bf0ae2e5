from quern.sources import files


def test_formats(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b", 2.5), (2, "c", None)], "k int, name string, v double")
    rows.coalesce(1).write.parquet(str(tmp_path / "p"))
    rows.coalesce(1).write.option("header", True).csv(str(tmp_path / "c.csv"))
    rows.coalesce(1).write.option("sep", "|").csv(str(tmp_path / "t.tbl"))
    for name, schema in (("p", None), ("c.csv", None), ("t.tbl", rows.schema)):
        got = files.read(spark, str(tmp_path / name), schema=schema)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
