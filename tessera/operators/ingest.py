"""Ingestion (I1-I18, A1-A3, A12, A15, S7, J12): item results, dead letters, retries, summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.corpus import page_chunks
from tessera.operators.dml import first_of
from tessera.runtime import spread_join, stage

# What a retry of each failed step works on. Steps of the raw documents have no retry.
RETRIES = {
    "books.load_binary": "file",
    "books.parse": "file",
    "books.persist": "file",
    "books.embed": "chunk",
    "books.index": "chunk",
    "docs.persist": "raw",
    "docs.embed": "document",
    "docs.embed_persist": "document",
    "docs.index": "document",
}


def ok(results: DataFrame, order: str = "ordinal") -> DataFrame:
    """The values of the items that went well, in input order."""
    return results.where(F.col("ok")).orderBy(order)


def dead_letters(results: DataFrame, behaviour: str, implementation: str, version: str, step: str, fatal: bool = False) -> DataFrame:
    """One failure row per item that did not go well; a malformed result (null ``ok``) is a failure as well."""
    failed = results.where(~F.coalesce("ok", F.lit(False)))
    return failed.select(
        F.lit(behaviour).alias("pipeline_behaviour"),
        F.lit(implementation).alias("pipeline_implementation"),
        F.lit(version).alias("version"),
        F.lit(step).alias("step"),
        F.coalesce("error", F.lit("malformed result")).alias("error_text"),
        F.col("identifier").cast("string").alias("input_identifier"),
        F.lit(fatal).alias("pipeline_fatal"),
        F.lit(0).alias("retry_count"),
    )


def version_of(*parts: int) -> str:
    return ".".join(str(p) for p in parts)


def embed_input(title: Column, text: Column) -> Column:
    """What is embedded: title, empty line, text; a missing title leaves the empty line."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit("")))


def raw_attributes(path: Column, version: Column, content: Column, base: str = "https://docs.example/") -> dict[str, Column]:
    """module, version, url and content of a source file: its name without ``.html`` is the module, its name under ``base`` the URL."""
    name = F.element_at(F.split(path, "/"), -1)
    return {"module": F.replace(name, F.lit(".html"), F.lit("")), "version": version, "url": F.concat(F.lit(base), name), "content": content}


def retry_from_raw(failures: DataFrame, raw: DataFrame) -> DataFrame:
    """(id, module, version, found) of failures that name their raw document as ``module@...``: how many raw documents of that module
    and of the failure's version there are (0: not found)."""
    asked = failures.select("id", F.substring_index("input_identifier", "@", 1).alias("module"), "version")
    held = raw.groupBy("module", "version").agg(F.count(F.lit(1)).alias("found"))
    return spread_join(asked, held, ["module", "version"], "left", row_bytes=48).select("id", "module", "version", F.coalesce("found", F.lit(0)).alias("found"))


def retry_from_chunk(failures: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, chunk, found) of failures that name a chunk by its id."""
    held = chunks.select(F.col("id").cast("string").alias("chunk"), F.lit(True).alias("found")).distinct()
    asked = failures.select("id", F.col("input_identifier").alias("chunk"))
    return asked.join(held, "chunk", "left").select("id", "chunk", F.coalesce("found", F.lit(False)).alias("found"))


def failures_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per pipeline and version how many failures came to be between two states of the table (what one run added)."""
    added = after.join(before.select("id").distinct(), "id", "left_anti")
    return failure_counts(added)


def retry_target(step: Column) -> Column:
    """file, chunk, raw or document; ``none`` for steps without a retry."""
    table = F.create_map(*[F.lit(x) for pair in RETRIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, step), F.lit("none"))


def failure_counts(failures: DataFrame) -> DataFrame:
    """Failures that did not end their run, per pipeline and version."""
    return failures.where(~F.col("pipeline_fatal")).groupBy("pipeline_behaviour", "pipeline_implementation", "version").agg(F.count(F.lit(1)).alias("failures"))


def summary(indexed: Column, failed: Column) -> Column:
    """``error`` if nothing was indexed and something failed; an empty run is a success."""
    return F.when((indexed == 0) & (failed > 0), F.lit("error")).otherwise(F.lit("ok"))


def skipped_warning(skipped: DataFrame, by: str = "parsed_book_id") -> DataFrame:
    """(book, warning): the skipped pages of a file in order, as text."""
    pages = F.array_sort(F.collect_list("page_number"))
    return skipped.groupBy(by).agg(F.concat(F.lit("skipped pages: "), F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")).alias("warning"))


def until_first_failure(results: DataFrame, by: str | None = None, order: str = "ordinal") -> DataFrame:
    """The rows before the first failure, per ``by`` (a re-run halts at its first error)."""
    if by is None:
        results, by = results.withColumn("__all", F.lit(1)), "__all"
    stop = results.groupBy(by).agg(F.min(F.when(~F.coalesce("ok", F.lit(False)), F.col(order))).alias("__stop"))
    kept = results.join(stop, by).where(F.col("__stop").isNull() | (F.col(order) < F.col("__stop")))
    return kept.drop("__stop", "__all")


def sweep(failures: DataFrame, attempt: Callable[[DataFrame], DataFrame], most: int = 2) -> tuple[DataFrame, list[dict]]:
    """Retries failures pass by pass: stops when none is left, when a pass resolves none, or after ``most`` passes.

    ``attempt`` maps failures to (id, resolved). Returns what is left (with its retry count raised) and a tally per pass.
    """
    left, tally = stage(failures, "failures"), []
    for n in range(most):
        if left.isEmpty():
            break
        outcome = stage(attempt(left).select("id", "resolved"), "outcome")
        tried = left.join(outcome, "id", "left")
        counts = tried.agg(F.count_if(F.coalesce("resolved", F.lit(False))).alias("resolved"), F.count(F.lit(1)).alias("all")).first()
        left = stage(tried.where(~F.coalesce("resolved", F.lit(False))).drop("resolved").withColumn("retry_count", F.col("retry_count") + 1), "failures")
        tally.append({"pass": n + 1, "resolved": counts["resolved"], "remaining": counts["all"] - counts["resolved"]})
        if counts["resolved"] == 0:
            break
    return left, tally


def densify(chunks: DataFrame, by: str = "parsed_book_id", order: tuple[str, ...] = ("page_number", "id")) -> DataFrame:
    """Chunk indexes 0..N-1 per book, whatever they were before."""
    return chunks.withColumn("chunk_index", (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("int"))


def error_info(error: Column, identifier: Column) -> Column:
    """(identifier, text): of an error that names its item, or of a bare one."""
    return F.struct(identifier.cast("string").alias("input_identifier"), F.coalesce(error, F.lit("unknown error")).alias("error_text"))


@dataclass(frozen=True)
class BookRun:
    """What a run over books gave (I6): the books kept, their chunks with vectors, failures, and warnings of skipped pages."""

    kept: DataFrame
    chunks: DataFrame
    failures: DataFrame
    warnings: DataFrame

    def report(self) -> DataFrame:
        """(id, n_chunks, warning, failed, outcome) of every book kept."""
        counts = self.chunks.where(F.col("embedding").isNotNull()).groupBy(F.col("parsed_book_id").alias("id")).agg(F.count(F.lit(1)).alias("n_chunks"))
        failed = self.failures.select(F.col("input_identifier").alias("id"), F.lit(True).alias("failed"))
        rows = self.kept.select("id").join(counts, "id", "left").join(self.warnings.withColumnRenamed("parsed_book_id", "id"), "id", "left").join(failed, "id", "left")
        n, bad = F.coalesce("n_chunks", F.lit(0)), F.coalesce("failed", F.lit(False))
        return rows.select("id", n.alias("n_chunks"), "warning", bad.alias("failed"), summary(n, bad.cast("int")).alias("outcome"))


def book_run(books: DataFrame, pages: DataFrame, skipped: DataFrame, embed: Callable[[Column], Column]) -> BookRun:
    """Load, drop known files, cut into chunks, embed, and collect what failed; every step is a table, and the first failure of a book is its only one."""
    kept = first_of(books, "file_hash", F.col("inserted_at"), F.col("id"))
    titles = kept.select(F.col("id").alias("parsed_book_id"), F.col("title").alias("book_title"))
    cut = spread_join(page_chunks(pages), titles, "parsed_book_id", row_bytes=48)
    chunks = stage(cut.withColumn("embedding", embed(embed_input(F.col("book_title"), F.col("text")))), "chunks")
    some = chunks.select(F.col("parsed_book_id").alias("id")).distinct().withColumn("ok", F.lit(True))
    results = kept.select("id").join(some, "id", "left").select(F.col("id").alias("identifier"), F.coalesce("ok", F.lit(False)).alias("ok"), F.lit("no page has text").alias("error"))
    return BookRun(kept, chunks, dead_letters(results, "Books.Pipeline", "PDF", "", "books.parse"), skipped_warning(skipped))
