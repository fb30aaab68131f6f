"""Neighbour expansion (W5, J3, E1): merged index ranges around hits, fetched by an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged_ranges(hits: DataFrame, offset: int = 2, by: tuple[str, ...] = ("parsed_book_id",)) -> DataFrame:
    """(by..., low, high): the ranges [index - offset, index + offset] clamped at 0, overlapping and adjacent ones merged."""
    spans = hits.select(*by, F.greatest(F.col("chunk_index") - offset, F.lit(0)).alias("low"), (F.col("chunk_index") + offset).alias("high")).distinct()
    before = Window.partitionBy(*by).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.withColumn("reach", F.max("high").over(before)).withColumn("new", F.when(F.col("reach").isNull() | (F.col("low") > F.col("reach") + 1), 1).otherwise(0))
    upto = Window.partitionBy(*by).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, 0)
    islands = starts.withColumn("island", F.sum("new").over(upto))
    return islands.groupBy(*by, "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island")


def expand(hits: DataFrame, chunks: DataFrame, offset: int = 2, by: tuple[str, ...] = ("parsed_book_id",)) -> DataFrame:
    """(by..., chunk columns): the hits and their neighbours, each once; an order is for the caller to give.

    The ranges are written out as indexes, so the fetch is an equi-join on (book, index) and not a range join. ``by`` must
    hold ``parsed_book_id``; further columns (a query id) keep their ranges apart.
    """
    wanted = merged_ranges(hits, offset, by).select(*by, F.explode(F.transform(F.sequence("low", "high"), lambda i: i.cast("int"))).alias("chunk_index"))
    return wanted.join(chunks, ["parsed_book_id", "chunk_index"])
