"""Lineage cuts, measured broadcasts, joins on hot keys, and how tables are dealt out."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import runtime
from tessera.sources import tables


def test_stage_and_forget(spark):
    kept = runtime.stage(spark.range(5), "five")
    assert kept.count() == 5 and kept._staged_at.startswith("file:")
    runtime.forget(kept, None, spark.range(1))
    with pytest.raises(Exception):
        spark.read.parquet(kept._staged_at).count()


def test_broadcast_measures_texts(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    short, long = spark.range(10).select(F.lit("x").alias("t")), spark.range(10).select(F.repeat(F.lit("x"), 2000).alias("t"))
    assert hinted(runtime.broadcast_if_small(short, 8, limit=10_000))
    assert not hinted(runtime.broadcast_if_small(long, 8, limit=10_000))
    assert not hinted(runtime.broadcast_if_small(spark.range(2000), 8, limit=10_000))


def test_join_on_a_hot_key(spark):
    big = spark.range(0, 60_000, 1, 4).select(F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") % 1000 > 1, F.col("id")).alias("k"), F.col("id").alias("v"))
    small = spark.range(0, 500).select(F.col("id").alias("k"), (2 * F.col("id")).alias("w"))
    joined = runtime.spread_join(big, small, "k", most=2_000)
    plain = big.join(small, "k")
    assert joined.columns == plain.columns and joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()
    left, plain = runtime.spread_join(big, small, ["k"], "left", most=2_000), big.join(small, ["k"], "left")
    assert left.exceptAll(plain).isEmpty() and left.count() == plain.count() == 60_000
    assert runtime.spread_join(big, small, "k", row_bytes=8).count() == joined.count()
    # half of the rows have one key; no task gets much more of them than others
    sizes = [r["n"] for r in joined.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert joined.count() > 30_000 and (len(sizes) == 1 or max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2])


def test_tables_are_dealt_out_by_row_groups(spark, sf, tmp_path):
    spark.range(0, 4000, 1, 1).write.option("parquet.block.size", 1024).parquet(f"{tmp_path}/many.parquet")
    spark.range(0, 10, 1, 1).write.parquet(f"{tmp_path}/one.parquet")
    assert tables._row_groups(spark, f"{tmp_path}/one.parquet", 4) == 1
    dealt = tables.spread_table(spark, str(tmp_path), "one", "id")
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and dealt.count() == 10


def test_heavy_keys(spark):
    rows = spark.range(0, 3000, 1, 4).select(F.when(F.col("id") % 3 == 0, F.lit("a")).when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"))
    assert [tuple(r) for r in runtime.heavy_keys(rows, ["k"], most=900).collect()] == [("a", 1000)]
    assert runtime.heavy_keys(rows, ["k"], most=1000).isEmpty()


def test_ranks_of_a_hot_key(spark):
    rows = spark.range(0, 20_000, 1, 4).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), (F.col("id") * 7919 % 20_000).alias("o"))
    ranked = runtime.spread_rank(rows, "k", ["o"], "place")
    plain = rows.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("bigint") - 1)
    assert ranked.exceptAll(plain).isEmpty() and ranked.count() == 20_000
    assert runtime.spread_rank(rows.limit(0), "k", ["o"], "place").isEmpty()
