"""Queries over ingestion: failures, dead letters, retries, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import providers
from tessera.functions.textops import is_blank
from tessera.operators import ingest, predicates
from tessera.plans.library import CHUNKS_SQL, documents
from tessera.plans.register import query
from tessera.providers import HashedEmbedder
from tessera.sources.tables import table


def _failures(spark, sf_dir):
    return table(spark, sf_dir, "failed_ingests")


@query("SELECT id, step FROM failed_ingests WHERE pipeline_behaviour = 'Books.Pipeline' AND pipeline_implementation = 'PDF' AND version = '' AND NOT pipeline_fatal")
def failures_of_pipeline(spark, sf_dir):
    return _failures(spark, sf_dir).where(predicates.failures_of("Books.Pipeline", "PDF", "")).select("id", "step")


@query("SELECT pipeline_behaviour, pipeline_implementation, version, count(*) AS failures FROM failed_ingests WHERE NOT pipeline_fatal GROUP BY ALL")
def count_failures(spark, sf_dir):
    return ingest.failure_counts(_failures(spark, sf_dir))


@query(
    """SELECT id, CASE WHEN step IN ('books.load_binary', 'books.parse', 'books.persist') THEN 'file' WHEN step IN ('books.embed', 'books.index') THEN 'chunk' WHEN step = 'docs.persist' THEN 'raw'
    WHEN step IN ('docs.embed', 'docs.embed_persist', 'docs.index') THEN 'document' ELSE 'none' END AS retry_target FROM failed_ingests"""
)
def retry_dispatch(spark, sf_dir):
    return _failures(spark, sf_dir).select("id", ingest.retry_target(F.col("step")).alias("retry_target"))


@query(
    """SELECT f.id, 'book' AS found_in FROM failed_ingests f JOIN parsed_books b ON b.id = f.input_identifier UNION ALL
    SELECT f.id, 'document' FROM failed_ingests f JOIN parsed_documents d ON d.id = f.input_identifier"""
)
def retry_lookup(spark, sf_dir):
    """The failed items that are still there to be tried again."""
    failures = _failures(spark, sf_dir).where(F.col("input_identifier").isNotNull()).select("id", "input_identifier")
    found = lambda df, kind: failures.join(df.select(F.col("id").alias("input_identifier")), "input_identifier").select("id", F.lit(kind).alias("found_in"))
    return found(table(spark, sf_dir, "parsed_books", "id"), "book").unionByName(found(documents(spark, sf_dir, "id"), "document"))


_ITEMS_SQL = """items AS (SELECT id AS identifier, source, text IS NOT NULL AND NOT regexp_full_match(text, '\\s*') AND len(embedding) = 64 AS ok,
    CASE WHEN text IS NULL OR regexp_full_match(text, '\\s*') THEN 'text is blank' ELSE 'embedding is missing or of another length' END AS error FROM parsed_documents)"""


def _items(spark, sf_dir):
    """The documents as items of a run: those without text or a full vector have failed."""
    docs = documents(spark, sf_dir, "id", "source", "text", "embedding")
    blank = is_blank(F.col("text"))
    sound = ~blank & F.coalesce(F.size("embedding") == 64, F.lit(False))
    error = F.when(blank, F.lit("text is blank")).otherwise(F.lit("embedding is missing or of another length"))
    return docs.select(F.col("id").alias("identifier"), "source", sound.alias("ok"), error.alias("error"))


@query(f"WITH {_ITEMS_SQL} SELECT identifier AS input_identifier, error AS error_text, 'docs.embed' AS step, false AS pipeline_fatal FROM items WHERE NOT coalesce(ok, false)")
def dead_letter_route(spark, sf_dir):
    rows = ingest.dead_letters(_items(spark, sf_dir), "Documents.Pipeline", "Hexdocs", ingest.version_of(1, 9, 1), "docs.embed")
    return rows.select("input_identifier", "error_text", "step", "pipeline_fatal")


@query(
    f"""WITH {_ITEMS_SQL}, s AS (SELECT source, count(*) FILTER (WHERE coalesce(ok, false)) AS indexed, count(*) FILTER (WHERE NOT coalesce(ok, false)) AS failed FROM items GROUP BY source)
    SELECT source, indexed, failed, CASE WHEN indexed = 0 AND failed > 0 THEN 'error' ELSE 'ok' END AS outcome FROM s"""
)
def ingest_summary(spark, sf_dir):
    ok = F.coalesce("ok", F.lit(False))
    counted = _items(spark, sf_dir).groupBy("source").agg(F.count_if(ok).alias("indexed"), F.count_if(~ok).alias("failed"))
    return counted.withColumn("outcome", ingest.summary(F.col("indexed"), F.col("failed")))


@query(
    """WITH p1 AS (SELECT *, input_identifier IS NOT NULL AND retry_count > 0 AS resolved FROM failed_ingests WHERE NOT pipeline_fatal)
    SELECT id, CAST(retry_count + 2 AS INTEGER) AS retry_count FROM p1 WHERE NOT resolved AND NOT (input_identifier IS NOT NULL AND retry_count + 1 > 0)"""
)
def sweep_passes(spark, sf_dir):
    """Two passes over the failures: an item is resolved once it is known and has been tried before."""
    attempt = lambda left: left.select("id", (F.col("input_identifier").isNotNull() & (F.col("retry_count") > 0)).alias("resolved"))
    left, _ = ingest.sweep(_failures(spark, sf_dir).where(~F.col("pipeline_fatal")), attempt)
    return left.select("id", "retry_count")


@query("SELECT parsed_book_id, 'skipped pages: ' || string_agg(CAST(page_number AS VARCHAR), ', ' ORDER BY page_number) AS warning FROM skipped_pages GROUP BY parsed_book_id")
def skipped_page_warnings(spark, sf_dir):
    return ingest.skipped_warning(table(spark, sf_dir, "skipped_pages", "parsed_book_id", "page_number"))


@query("SELECT id, md5(coalesce(title, '') || chr(10) || chr(10) || coalesce(text, '')) AS input_hash FROM parsed_documents")
def embed_input(spark, sf_dir):
    return documents(spark, sf_dir, "id", "title", "text").select("id", F.md5(ingest.embed_input(F.col("title"), F.col("text"))).alias("input_hash"))


@query("SELECT id, replace(list_extract(string_split(url, '/'), -1), '.html', '') AS module, 'https://docs.example/' || list_extract(string_split(url, '/'), -1) AS doc_url, length(coalesce(text, '')) AS n_chars FROM parsed_documents")
def raw_attributes(spark, sf_dir):
    rows = documents(spark, sf_dir, "id", "url", "version", "text")
    made = ingest.raw_attributes(F.col("url"), F.col("version"), F.col("text"))
    return rows.select("id", made["module"].alias("module"), made["url"].alias("doc_url"), F.length(F.coalesce(made["content"], F.lit(""))).alias("n_chars"))


@query(
    """SELECT f.id, d.package AS module, d.version, (SELECT count(*) FROM parsed_documents r WHERE r.package = d.package AND r.version = d.version) AS found
    FROM failed_ingests f JOIN parsed_documents d ON d.id = f.input_identifier"""
)
def retry_raw_lookup(spark, sf_dir):
    """Failures that name their document as module@id: how many documents of that module and version there are."""
    docs = documents(spark, sf_dir, "id", "package", "version")
    named = docs.select(F.col("id").alias("input_identifier"), F.concat_ws("@", "package", "id").alias("named"), "version")
    failures = _failures(spark, sf_dir).select("id", "input_identifier").join(named, "input_identifier")
    raw = docs.select(F.col("package").alias("module"), "version")
    return ingest.retry_from_raw(failures.select("id", F.col("named").alias("input_identifier"), "version"), raw)


@query(
    """SELECT pipeline_behaviour, pipeline_implementation, version, count(*) AS failures FROM failed_ingests WHERE NOT pipeline_fatal AND inserted_at >= TIMESTAMPTZ '2025-05-01 00:00:00+00' GROUP BY ALL"""
)
def failures_since(spark, sf_dir):
    """What was added to the failures after a point in time."""
    every = _failures(spark, sf_dir)
    before = every.where(F.col("inserted_at") < F.lit("2025-05-01 00:00:00").cast("timestamp"))
    return ingest.failures_between(before, every)


@query(
    """WITH o AS (SELECT id, source, coalesce(len(embedding) = 64, false) AS ok FROM parsed_documents), stop AS (SELECT source, min(CASE WHEN NOT ok THEN id END) AS stop FROM o GROUP BY source)
    SELECT o.id, o.source FROM o JOIN stop USING (source) WHERE stop IS NULL OR o.id < stop"""
)
def until_first_failure(spark, sf_dir):
    """The documents of each source, in the order of their ids, before the first one without a full vector."""
    rows = documents(spark, sf_dir, "id", "source", "embedding").select("id", "source", (F.size("embedding") == 64).alias("ok"))
    return ingest.until_first_failure(rows, "source", "id").select("id", "source")


@query(
    f"""WITH {CHUNKS_SQL}, kept AS (SELECT * FROM parsed_books QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY inserted_at, id) = 1),
    n AS (SELECT parsed_book_id, count(*) AS n_chunks FROM chunks GROUP BY parsed_book_id),
    w AS (SELECT parsed_book_id, 'skipped pages: ' || string_agg(CAST(page_number AS VARCHAR), ', ' ORDER BY page_number) AS warning FROM skipped_pages GROUP BY parsed_book_id)
    SELECT kept.id, coalesce(n_chunks, 0) AS n_chunks, warning, n_chunks IS NULL AS failed, CASE WHEN n_chunks IS NULL THEN 'error' ELSE 'ok' END AS outcome
    FROM kept LEFT JOIN n ON n.parsed_book_id = kept.id LEFT JOIN w ON w.parsed_book_id = kept.id"""
)
def book_ingest(spark, sf_dir):
    """The whole run over all books: known files dropped, pages cut into chunks and embedded, books without a chunk as failures."""
    run = ingest.book_run(table(spark, sf_dir, "parsed_books"), table(spark, sf_dir, "page_contents"), table(spark, sf_dir, "skipped_pages"), HashedEmbedder().embed)
    return run.report()


@query(
    f"""WITH {_ITEMS_SQL} SELECT source, count(*) FILTER (WHERE coalesce(ok, false)) AS indexed, count(*) FILTER (WHERE NOT coalesce(ok, false) AND error <> 'text is blank') AS swept,
    count(*) FILTER (WHERE NOT coalesce(ok, false) AND error = 'text is blank') AS remaining FROM items GROUP BY source"""
)
def document_ingest(spark, sf_dir):
    """A run with its sweep: what failed for its vector is embedded again from its text, what has no text stays a failure."""
    items = _items(spark, sf_dir)
    failed = items.where(~F.coalesce("ok", F.lit(False))).select(F.col("identifier").alias("id"), "source", F.lit(0).alias("retry_count"))
    texts = documents(spark, sf_dir, "id", "title", "text")

    def embed_again(left):
        vector = HashedEmbedder().embed(ingest.embed_input(F.col("title"), F.col("text")))
        return left.join(texts, "id").select("id", (~is_blank(F.col("text")) & (F.size(vector) == 64)).alias("resolved"))

    left, _ = ingest.sweep(failed, embed_again)
    counted = items.groupBy("source").agg(F.count_if(F.coalesce("ok", F.lit(False))).alias("indexed"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"))
    remaining = left.groupBy("source").agg(F.count(F.lit(1)).alias("remaining"))
    joined = counted.join(remaining, "source", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)))
    return joined.select("source", "indexed", (F.col("failed") - F.col("remaining")).alias("swept"), "remaining")


_SHAPE_SQL = "CAST(ascii(left(id, 1)) % 5 AS INTEGER)"


@query(
    f"""WITH s AS (SELECT id, coalesce(title, '') AS title, CAST(length(coalesce(text, '')) AS BIGINT) AS n, {_SHAPE_SQL} AS shape FROM parsed_documents)
    SELECT id, CASE WHEN shape = 3 THEN 'rate_limited' WHEN shape = 4 THEN 'malformed_response' WHEN title = '' THEN 'empty_response' ELSE 'ok' END AS kind,
      CASE WHEN shape < 3 THEN title END AS answer, CASE WHEN shape < 2 THEN n ELSE 0 END AS tokens_in, CASE WHEN shape < 2 THEN n + 7 ELSE 0 END AS tokens_total, CASE WHEN shape = 3 THEN '30' END AS retry_after FROM s"""
)
def response_normalise(spark, sf_dir):
    """Responses of a generation service, made of the documents: two shapes of usage and an unknown one, a rate limit, a body without usage."""
    n, title = F.length(F.coalesce("text", F.lit(""))).cast("bigint"), F.coalesce("title", F.lit(""))
    shape = F.ascii(F.substring("id", 1, 1)) % 5
    output = F.array(F.struct(F.array(F.struct(title.alias("text"))).alias("content"), F.lit("completed").alias("status")))
    body = lambda usage: F.to_json(F.struct(output.alias("output"), *([usage.alias("usage")] if usage is not None else [])))
    counts = lambda i, o: F.struct(n.alias(i), F.lit(7).alias(o), (n + 7).alias("total_tokens"))
    made = (
        F.when(shape == 0, body(counts("input_tokens", "output_tokens"))).when(shape == 1, body(counts("prompt_tokens", "completion_tokens")))
        .when(shape == 2, body(F.struct(n.alias("input_tokens")))).when(shape == 4, body(None))
    )
    rows = documents(spark, sf_dir, "id", "title", "text").select("id", made.alias("body"), F.when(shape == 3, 429).otherwise(200).alias("status"), F.when(shape == 3, F.lit("30 s")).alias("wait"))
    used = providers.usage(F.col("body"))
    kind = providers.response_kind(F.col("status"), F.col("body"), F.lit(None).cast("string"))
    answered = F.col("status").eqNullSafe(200) & F.get_json_object("body", "$.usage").isNotNull()
    return rows.select(
        "id", kind.alias("kind"), F.when(answered, providers.answer_text(F.col("body"))).alias("answer"), used["input"].alias("tokens_in"), used["total"].alias("tokens_total"), providers.retry_after(F.col("wait")).cast("string").alias("retry_after")
    )
