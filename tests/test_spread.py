from pyspark.sql import functions as F

from pairlab.sources import tables


def test_large_partitions_are_spread_over_more_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(4000, numPartitions=8).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    df = tables.read_table(spark, str(tmp_path), "documents")
    scan = df.rdd.getNumPartitions()
    assert tables.spread(df, "id").rdd.getNumPartitions() >= scan
    monkeypatch.setattr(tables, "TASK_BYTES", 2000)
    wide = tables.spread(df, "id")
    assert wide.rdd.getNumPartitions() >= 50
    assert sorted(wide.collect()) == sorted(df.collect())
