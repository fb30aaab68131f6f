"""Sinks (S8-S12): checked inserts, merges by key, and the atomic publication of several tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators.dml import upsert


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def insert_checked(df: DataFrame, path: str) -> int:
    """Append and check that as many rows lie there as were to be written; returns the count."""
    spark = df.sparkSession
    part = f"{path}/batch={uuid.uuid4().hex[:12]}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(part)
    written, wanted = spark.read.parquet(part).count(), seen.get["rows"]
    if written != wanted:
        raise OSError(f"{written} of {wanted} rows were written")
    return written


def discard(df: DataFrame) -> None:
    """Run the plan and write nothing."""
    df.write.format("noop").mode("overwrite").save()


def merge(rows: DataFrame, path: str, key: str = "id", order: str = "updated_at", buckets: int = 64) -> None:
    """Upsert into the Parquet table at ``path``, whose rows lie in one folder per hash of the key (column ``key_bucket``).

    Only the folders that ``rows`` touch are read, merged, written beside the table and renamed into place; a batch that is
    merged again gives the same table.
    """
    spark = rows.sparkSession
    fs, target = _fs(spark, path)
    placed = rows.withColumn("key_bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))
    touched = [r["key_bucket"] for r in placed.select("key_bucket").distinct().collect()]  # at most ``buckets`` numbers
    folder = lambda root, n: f"{root}/key_bucket={n}"
    held = [folder(path, n) for n in touched if fs.exists(_fs(spark, folder(path, n))[1])]
    before = spark.read.option("basePath", path).parquet(*held) if held else placed.limit(0)
    fresh, old = (f"{path}.{uuid.uuid4().hex[:12]}.{kind}" for kind in ("new", "old"))
    upsert(before, placed, key, order).repartition("key_bucket").write.partitionBy("key_bucket").parquet(fresh)
    fs.mkdirs(target)
    fs.mkdirs(_fs(spark, old)[1])
    for n in touched:
        if folder(path, n) in held:
            fs.rename(_fs(spark, folder(path, n))[1], _fs(spark, folder(old, n))[1])
        fs.rename(_fs(spark, folder(fresh, n))[1], _fs(spark, folder(path, n))[1])
    for left in (fresh, old):
        fs.delete(_fs(spark, left)[1], True)


def publish(tables: dict[str, DataFrame], spark: SparkSession) -> None:
    """Write all tables beside their places, then rename each: a failed write leaves every old table as it was.

    Renames follow each other, so a reader may meet some new and some old tables for a moment; Spark has no
    transaction over several tables.
    """
    tag = uuid.uuid4().hex[:12]
    for path, df in tables.items():
        df.write.parquet(f"{path}.{tag}.new")
    for path in tables:
        fs, target = _fs(spark, path)
        _, fresh = _fs(spark, f"{path}.{tag}.new")
        _, old = _fs(spark, f"{path}.{tag}.old")
        if fs.exists(target):
            fs.rename(target, old)
        fs.rename(fresh, target)
        fs.delete(old, True)
