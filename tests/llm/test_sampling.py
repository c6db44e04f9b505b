from pyspark.sql import functions as F

from millrace.llm.sampling import least_hashes, sample_files


def test_the_same_rows_whatever_their_order(spark):
    df = spark.range(20_000).withColumn("text", F.col("id").cast("string"))
    a = least_hashes(df, F.col("id"), 300)
    b = least_hashes(df.orderBy(F.desc("id")).repartition(7), F.col("id"), 300)
    assert [r["id"] for r in a] == [r["id"] for r in b]
    assert len(a) == 300
    assert max(r["id"] for r in a) > 15_000  # from all over the table


def test_condition_and_small_tables(spark):
    df = spark.range(5000)
    even = least_hashes(df, F.col("id"), 100, F.col("id") % 2 == 0, 0.5)
    assert len(even) == 100
    assert all(r["id"] % 2 == 0 for r in even)
    assert len(least_hashes(df.limit(7), F.col("id"), 100)) == 7
    assert least_hashes(df.limit(0), F.col("id"), 100) == []
    assert least_hashes(df, F.col("id"), 100, F.lit(False)) == []


def test_files(spark, tmp_path):
    spark.range(100).repartition(10).write.parquet(str(tmp_path / "t.parquet"))
    part = sample_files(spark, str(tmp_path), "t", "id", files=3)
    assert len(part.inputFiles()) == 3
    assert part.inputFiles() == sample_files(spark, str(tmp_path), "t", "id", files=3).inputFiles()
    assert sample_files(spark, str(tmp_path), "t", "id", files=50).count() == 100
