"""Candidates for manual selection (A6-A9, J8-J10, W11): results grouped by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.textops import preview


def group_by_document(results: DataFrame, rank: str = "rank") -> DataFrame:
    """(query_id, document, position, chunk_ids): groups and their members in order of first appearance.

    A document is the source reference of a result, or its own id where it has none. A group holds the
    results of one query, which the query's size bounds.
    """
    keyed = results.withColumn("document", F.coalesce(F.col("source_ref").cast("string"), F.col("id").cast("string")))
    grouped = keyed.groupBy("query_id", "document").agg(F.min(rank).alias("first_rank"), F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), "id"))).alias("members"))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank", "document"))
    return grouped.select("query_id", "document", position.alias("position"), F.transform("members", lambda m: m["id"]).alias("chunk_ids"))


def document_metadata(results: DataFrame, rank: str = "rank") -> DataFrame:
    """(query_id, document, title, preview, page_label): title and preview of the first result; the label counts
    results that have a page, so two on page 7 read ``PDF pages 7-7``."""
    keyed = results.withColumn("document", F.coalesce(F.col("source_ref").cast("string"), F.col("id").cast("string")))
    pages, low, high = F.count("page_number"), F.min("page_number"), F.max("page_number")
    label = F.when(pages == 1, F.concat(F.lit("PDF page "), low)).when(pages > 1, F.concat(F.lit("PDF pages "), low, F.lit("-"), high))
    return keyed.groupBy("query_id", "document").agg(
        F.min_by(F.coalesce("book_title", "label"), F.struct(rank, "id")).alias("title"), F.min_by(preview(F.col("text"), 100), F.struct(rank, "id")).alias("preview"), label.alias("page_label")
    )


def expand_selection(selection: DataFrame, results: DataFrame, rank: str = "rank") -> DataFrame:
    """(query_id, ordinal, id): the chunks of the selected documents, in the order of selection and then of rank.

    ``selection`` has (query_id, selected_pos, document); documents that are unknown add nothing.
    """
    keyed = results.select("query_id", F.coalesce(F.col("source_ref").cast("string"), F.col("id").cast("string")).alias("document"), "id", F.col(rank).alias("rank"))
    order = Window.partitionBy("query_id").orderBy("selected_pos", "rank", "id")
    return selection.join(keyed, ["query_id", "document"]).select("query_id", F.row_number().over(order).alias("ordinal"), "id")


def all_chunk_ids(grouped: DataFrame) -> DataFrame:
    """(query_id, ordinal, id): the chunks of all documents of :func:`group_by_document`, group by group."""
    rows = grouped.select("query_id", "position", F.posexplode("chunk_ids").alias("__at", "id"))
    order = Window.partitionBy("query_id").orderBy("position", "__at")
    return rows.select("query_id", F.row_number().over(order).alias("ordinal"), "id")


def unknown_selection(requested: DataFrame, available: DataFrame, key: str = "id") -> DataFrame:
    """What was requested but is not available: not empty means that the selection is refused."""
    return requested.join(available.select("query_id", key).distinct(), ["query_id", key], "left_anti")


def selected(candidates: DataFrame, wanted: DataFrame, rank: str = "rank") -> DataFrame:
    """The wanted candidates in candidate order with an index from 1; neither floor nor ceiling applies."""
    kept = candidates.join(wanted.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")
    return kept.withColumn("selection_index", F.row_number().over(Window.partitionBy("query_id").orderBy(rank, "id")))
