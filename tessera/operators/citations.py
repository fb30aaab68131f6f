"""Citation post-processing (M1-M11, W9, W10, W14, J6): all column expressions over a text and its chunk map.

A chunk map is an array of structs with at least ``idx``; ``valid`` is its array of indexes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.textops import marker_number, preview, trim
from tessera.runtime import broadcast_if_small

MARKER = r"\[(\d+)\]"


def markers(text: Column) -> Column:
    """The distinct marker numbers of a text in order of first appearance (``[007]`` is 7)."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MARKER), F.lit(1))
    return F.array_distinct(F.transform(found, marker_number))


def resolved(text: Column, valid: Column) -> Column:
    """Markers that the chunk map knows."""
    return F.filter(markers(text), lambda m: m.isNotNull() & F.array_contains(valid, m))


def hallucinated(text: Column, valid: Column) -> Column:
    """Markers that it does not know."""
    return F.filter(markers(text), lambda m: m.isNull() | ~F.array_contains(valid, m))


def renumbered(text: Column, valid: Column) -> Column:
    """(old_index, new_index) of the known markers: the new index is the place among all markers, so an
    unknown one leaves a gap."""
    every = markers(text)
    return F.transform(resolved(text, valid), lambda m: F.struct(m.alias("old_index"), F.array_position(every, m).cast("int").alias("new_index")))


def rewritten(text: Column, valid: Column) -> Column:
    """The text with known markers renumbered and unknown ones dropped; runs of blanks collapse."""
    plain = F.coalesce(text, F.lit(""))
    every = markers(text)
    parts = F.split(plain, MARKER.replace("(", "").replace(")", ""), -1)
    numbers = F.transform(F.regexp_extract_all(plain, F.lit(MARKER), F.lit(1)), marker_number)
    shown = F.transform(numbers, lambda m: F.when(m.isNotNull() & F.array_contains(valid, m), F.concat(F.lit("["), F.array_position(every, m).cast("string"), F.lit("]"))).otherwise(F.lit("")))
    joined = F.array_join(F.zip_with(parts, shown, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    return F.regexp_replace(joined, " +", " ")


def finalised(text: Column) -> Column:
    """At most one empty line in a row, no outer white space."""
    return trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def warnings(text: Column, valid: Column) -> Column:
    return F.transform(hallucinated(text, valid), lambda m: F.concat(F.lit("unknown citation ["), F.coalesce(m.cast("string"), F.lit("?")), F.lit("]")))


def response(df: DataFrame, text: str = "text", valid: str = "valid") -> DataFrame:
    """Adds ``citations``, ``hallucinated``, ``warnings``, ``final_text`` and an empty ``media``."""
    t, v = F.col(text), F.col(valid)
    return df.withColumns(
        {"citations": renumbered(t, v), "hallucinated": hallucinated(t, v), "warnings": warnings(t, v), "final_text": finalised(rewritten(t, v)), "media": F.array().cast("array<string>")}
    )


def citation_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, position, idx): one row per distinct marker."""
    return df.select(F.col(key), F.posexplode(markers(F.col(text))).alias("position", "idx"))


def hits_and_misses(cited: DataFrame, chunk_map: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Citations joined with their chunks, and those without one."""
    return cited.join(chunk_map, [key, "idx"]), cited.join(chunk_map.select(key, "idx").distinct(), [key, "idx"], "left_anti")


def resolve(cited: DataFrame, chunk_map: DataFrame, key: str | None = None) -> DataFrame:
    """(old_index, new_index, id, label, preview, source_ref, extras, ...) of the citations that the chunk map knows, metadata attached.

    ``cited`` has ``old_index``, ``new_index`` and what identifies the answer; ``chunk_map`` has ``idx`` and a struct ``metadata``, one map
    for all answers or, with ``key``, one per answer.
    """
    known = chunk_map.select(*([key] if key else []), F.col("idx").cast("decimal(38,0)").alias("old_index"), "metadata")
    joined = cited.withColumn("old_index", F.col("old_index").cast("decimal(38,0)")).join(broadcast_if_small(known, 64), [*([key] if key else []), "old_index"])
    return joined.select(*cited.columns, "metadata.*")


def download_actions(cited: DataFrame, key: str) -> DataFrame:
    """(key, kind, label, source_ref, new_index): one per source, labelled as its first citation; citations without a source give none."""
    first = Window.partitionBy(key, "source_ref").orderBy("new_index")
    rows = cited.where(F.col("source_ref").isNotNull()).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return rows.select(key, F.lit("download").alias("kind"), "label", "source_ref", "new_index")


def chunk_label(title: Column, page: Column, section: Column) -> Column:
    """``title, p. N — section`` with what is missing left out."""
    page_part = F.when(page.isNotNull(), F.concat(F.lit(", p. "), page.cast("string"))).otherwise(F.lit(""))
    section_part = F.when(section.isNotNull(), F.concat(F.lit(" — "), section)).otherwise(F.lit(""))
    return F.concat(F.coalesce(title, F.lit("")), page_part, section_part)


def citable_chunk(title: str = "book_title", path: str = "source_file_path") -> Column:
    """The citation metadata of a book chunk: its source is the book's file."""
    page, section = F.col("page_number"), F.col("section_title")
    extras = F.struct(F.col(title).alias("book_title"), "page_number", "section_title", "chunk_index")
    return F.struct(
        F.col("id").cast("string").alias("id"), chunk_label(F.col(title), page, section).alias("label"), preview(F.col("text")).alias("preview"), F.col(path).alias("source_ref"), extras.alias("extras")
    )


def citable_document() -> Column:
    """The citation metadata of a document: its source is its URL."""
    label = F.concat(F.coalesce("package", F.lit("")), F.lit(" — "), F.coalesce("title", F.lit("")))
    extras = F.struct("package", "title", "version", "language", "source")
    return F.struct(F.col("id").cast("string").alias("id"), label.alias("label"), preview(F.col("text")).alias("preview"), F.col("url").alias("source_ref"), extras.alias("extras"))
