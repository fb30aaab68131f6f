"""Prompt assembly (P1-P5, W8): context blocks, messages and the history window."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WITH_CONTEXT = (
    "Answer from the numbered excerpts below. Cite each statement with the number of its excerpt in square brackets, several where "
    "several support it, and name pages where they are given. Say so when the excerpts hold no answer; never cite what is not there."
)
WITHOUT_CONTEXT = "No excerpt was found for this question. Say so, and do not cite anything."


# The layouts in which chunks and documents are shown to a model.
CHUNK_LAYOUT = "Book: {title} | Page: {page}\nSection: {section}\n\n{text}"
DOCUMENT_LAYOUT = "Package: {package} | Function: {title}\nURL: {url}\n\n{text}"


def laid_out(layout: str, **values: Column) -> Column:
    """A layout with its ``{names}`` filled in; null prints empty."""
    parts = re.split(r"\{(\w+)\}", layout)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if n % 2 else F.lit(p) for n, p in enumerate(parts) if p])


def chunk_context(title: Column, page: Column, section: Column, text: Column) -> Column:
    """A book chunk as prompt text; a missing page prints empty, a missing section as ``(none)``."""
    return laid_out(CHUNK_LAYOUT, title=title, page=page, section=F.coalesce(section, F.lit("(none)")), text=text)


def document_context(package: Column, title: Column, url: Column, text: Column) -> Column:
    return laid_out(DOCUMENT_LAYOUT, package=package, title=title, url=url, text=text)


def numbered(index: Column, context: Column) -> Column:
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), context)


def context_block(context: DataFrame, by: str = "query_id") -> DataFrame:
    """(query_id, block): a query's excerpts in the order of their index; a context is at most a few chunks."""
    lines = F.array_sort(F.collect_list(F.struct("prompt_index", "prompt_text")))
    return context.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: numbered(x["prompt_index"], x["prompt_text"])), "\n---\n").alias("block"))


def history_pairs(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", most: int = 5) -> DataFrame:
    """(conv_id, pair, ordinal, role, text): consecutive turns in pairs, an odd last one dropped, the last ``most`` pairs."""
    order = Window.partitionBy(conversation).orderBy(turn)
    placed = turns.withColumn("__n", F.row_number().over(order) - 1).withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy(conversation)))
    pairs = F.floor(F.col("__all") / 2)
    kept = placed.withColumn("pair", F.floor(F.col("__n") / 2)).where((F.col("pair") < pairs) & (F.col("pair") >= pairs - most))
    first = F.greatest(pairs - most, F.lit(0))
    return kept.select(conversation, (F.col("pair") - first).cast("int").alias("pair"), (F.col("__n") - 2 * first).cast("int").alias("ordinal"), F.when(F.col("__n") % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), "text")


def messages(question: Column, block: Column, history: Column) -> Column:
    """system ++ history ++ user, as an array of (role, content); a null block is a question without context."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    system = F.when(block.isNull(), F.lit(WITHOUT_CONTEXT)).otherwise(F.concat(F.lit(WITH_CONTEXT + "\n\n"), block))
    return F.concat(F.array(message("system", system)), F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), F.array(message("user", question)))
