"""Scans of the Parquet tables (S1) with only the columns a query needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; ``columns`` prunes the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _row_groups(spark: SparkSession, path: str, enough: int) -> int:
    """Row groups of a table, which bound the tasks that can read it; counting stops at ``enough`` files, and only footers are read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    found, groups, seen = root.getFileSystem(conf).listFiles(root, True), 0, 0
    while found.hasNext() and groups < enough and seen < enough:
        at = found.next().getPath()
        if at.getName().endswith(".parquet"):
            seen += 1
            footer = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, conf))
            groups += footer.getRowGroups().size()
            footer.close()
    return groups


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table for work that is heavy per row: where its row groups cannot give every core a task (one small file),
    the rows are dealt out once. A table of enough row groups, in however few files, is read as it lies."""
    df = table(spark, sf_dir, name, *columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if _row_groups(spark, f"{sf_dir}/{name}.parquet", cores) < cores else df
