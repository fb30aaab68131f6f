"""Corpora derived from the tables: chunks of pages, documents, chunks of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.textops import char_count, word_count
from tessera.operators.dml import first_of
from tessera.operators.predicates import has_text
from tessera.runtime import spread_rank


def page_chunks(pages: DataFrame) -> DataFrame:
    """One chunk per page with text: of a page extracted twice the latest; indexes are dense per book.

    Blank pages get no index. Pages are ranked in ranges of (book, page), so that no task gets the whole of a large book.
    """
    latest = first_of(pages, ["parsed_book_id", "page_number"], F.desc("extracted_at"), F.desc("page_id")).where(has_text())
    ranked = spread_rank(latest.select("parsed_book_id", "page_number", "page_id", "text"), "parsed_book_id", ["page_number", "page_id"], "rank")
    return ranked.select(
        F.col("page_id").alias("id"),
        "parsed_book_id",
        "page_number",
        F.col("rank").cast("int").alias("chunk_index"),
        F.lit(None).cast("string").alias("section_title"),
        "text",
        word_count(F.col("text")).alias("word_count"),
        char_count(F.col("text")).alias("char_count"),
    )


def vector_chunks(embeddings: DataFrame) -> DataFrame:
    """The vectors as chunks of one book per label, in the order of their ids."""
    ranked = spread_rank(embeddings.select("vec_id", "label", "embedding"), "label", ["vec_id"], "rank")
    return ranked.select(F.col("vec_id").alias("id"), F.col("label").alias("parsed_book_id"), F.col("rank").cast("int").alias("chunk_index"), "embedding")


def book_totals(pages: DataFrame) -> DataFrame:
    """Pages (blank ones included) and words of every book."""
    latest = first_of(pages, ["parsed_book_id", "page_number"], F.desc("extracted_at"), F.desc("page_id"))
    return latest.groupBy("parsed_book_id").agg(F.count(F.lit(1)).alias("total_pages"), F.sum(word_count(F.col("text"))).alias("word_count"))
