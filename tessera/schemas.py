"""Declared schemas (as DDL, for ``spark.read.schema``) and row validation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.textops import is_blank, strip_nul


PARSED_BOOKS = (
    "id string, title string, metadata map<string,string>, language string, file_size int, source_file_path string, authors array<string>, source_format string, "
    "file_hash string, isbn string, publisher string, publication_date date, total_pages int, word_count int, table_of_contents map<string,string>, parsed_at timestamp, "
    "embedding_status string, inserted_at timestamp, updated_at timestamp"
)
CHUNKS = ("id string, text string, page_number int, chunk_index int, section_title string, word_count int, char_count int, embedding array<float>, parsed_book_id string")
PARSED_DOCUMENTS = (
    "id string, source string, version string, package string, language string, title string, url string, embedding array<float>, text string, core boolean, "
    "inserted_at timestamp, updated_at timestamp"
)
RAW_DOCUMENTS = ("module string, version string, core boolean, url string, content string, source string, language string")
FAILED_INGESTS = (
    "id string, pipeline_behaviour string, pipeline_implementation string, step string, version string, error_text string, input_identifier string, pipeline_fatal boolean, "
    "retry_count int, last_retried_at timestamp, inserted_at timestamp, updated_at timestamp"
)

# The columns a row must have, and the states of an embedding.
REQUIRED = {
    "parsed_books": ("title", "file_size", "source_file_path", "source_format", "file_hash", "word_count", "parsed_at", "embedding_status"),
    "chunks": ("text", "chunk_index", "word_count", "char_count", "parsed_book_id"),
    "parsed_documents": ("source", "version", "package", "title", "url", "text"),
    "failed_ingests": ("pipeline_behaviour", "pipeline_implementation", "step", "error_text"),
    "raw_documents": ("module", "version", "core", "url", "content"),
}
EMBEDDING_STATES = ("pending", "processing", "completed", "failed")


def sanitise(df: DataFrame) -> DataFrame:
    """Every string column without NUL characters."""
    return df.select(*[strip_nul(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def missing(df: DataFrame, required: Iterable[str]) -> Column:
    """Array of ``<column> can't be blank`` for required columns that are null or blank."""
    kinds = dict(df.dtypes)
    bad = lambda c: is_blank(F.col(f"`{c}`")) if kinds[c] == "string" else F.col(f"`{c}`").isNull()
    return F.filter(F.array(*[F.when(bad(c), F.lit(f"{c} can't be blank")) for c in required]), lambda e: e.isNotNull())


def too_long(column: str, most: int) -> Column:
    return F.when(F.length(column) > most, F.lit(f"{column} is longer than {most}"))


def not_one_of(column: str, allowed: Iterable[str]) -> Column:
    return F.when(F.col(column).isNotNull() & ~F.col(column).isin(list(allowed)), F.lit(f"{column} is invalid"))


def validated(df: DataFrame, required: Iterable[str], rules: Iterable[Column] = (), unique: str | None = None, name: str = "errors") -> DataFrame:
    """``df`` with an array of its rows' errors; ``unique`` adds a check by a window over that column's values."""
    rules = list(rules)
    if unique:
        again = F.row_number().over(Window.partitionBy(unique).orderBy(*[F.col(f"`{c}`") for c, t in df.dtypes if t in ("string", "int", "bigint", "timestamp")])) > 1
        df = df.withColumn("__again", again & F.col(unique).isNotNull())
        rules.append(F.when(F.col("__again"), F.lit(f"{unique} has already been taken")))
    errors = missing(df, required)
    if rules:
        errors = F.concat(errors, F.filter(F.array(*rules), lambda e: e.isNotNull()))
    return df.withColumn(name, errors).drop("__again")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose foreign key has no parent (a left anti join)."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
