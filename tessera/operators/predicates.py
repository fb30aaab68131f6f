"""Composable row predicates (F1-F18): each is a function of columns for ``df.where`` or ``df.transform``."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.textops import is_blank


def by_book(book_id: str) -> Column:
    return F.col("parsed_book_id") == book_id


def on_page(page: int) -> Column:
    return F.col("page_number") == page


def within_pages(center: int, span: int) -> Column:
    return F.col("page_number").isNotNull() & F.col("page_number").between(center - span, center + span)


def by_section(title: str) -> Column:
    return F.col("section_title") == title


def by(column: str, value) -> Column:
    """Equality on one column: title, language, file path, format, isbn, publisher, source, version."""
    return F.col(column) == value


def by_author(name: str) -> Column:
    return F.array_contains("authors", name)


def published_on(day: datetime.date) -> Column:
    return F.col("publication_date") == F.lit(day)


def published_before(day: datetime.date) -> Column:
    return F.col("publication_date") < F.lit(day)


def published_after(day: datetime.date) -> Column:
    return F.col("publication_date") > F.lit(day)


def parsed_on(at: datetime.datetime) -> Column:
    return F.col("parsed_at") == F.lit(at)


def parsed_before(at: datetime.datetime) -> Column:
    return F.col("parsed_at") < F.lit(at)


def parsed_after(at: datetime.datetime) -> Column:
    return F.col("parsed_at") > F.lit(at)


def failures_of(behaviour: str, implementation: str, version: str) -> Column:
    """Failures of one pipeline that did not end it."""
    return (F.col("pipeline_behaviour") == behaviour) & (F.col("pipeline_implementation") == implementation) & (F.col("version") == version) & ~F.col("pipeline_fatal")


def above_floor(score: str = "relevance_score", floor: float = 0.3) -> Column:
    """At least the relevance floor; a row without a score passes."""
    return F.col(score).isNull() | (F.col(score) >= floor)


def has_text(column: str = "text") -> Column:
    return ~is_blank(F.col(column))


def without_blanks(items: Column) -> Column:
    """An array without its empty strings."""
    return F.filter(items, lambda x: x != "")


def reaches(score: str, least: float | None) -> Column:
    """At least ``least``; no bound when that is None."""
    return F.lit(True) if least is None else F.col(score) >= least


def language_and_version(df: DataFrame, language: str, version: str) -> DataFrame:
    return df.where(by("language", language)).where(by("version", version))


def source_and_version(df: DataFrame, source: str, version: str) -> DataFrame:
    return df.where(by("source", source)).where(by("version", version))
