"""Queries over books, pages, documents: predicates, lookups, totals, table changes."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import textops
from tessera.operators import corpus, dml, predicates
from tessera.plans.register import query
from tessera.sources.tables import table

#: The page chunks in SQL, shared by several queries.
CHUNKS_SQL = """
    latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parsed_book_id, page_number ORDER BY extracted_at DESC, page_id DESC) AS rn FROM page_contents) WHERE rn = 1),
    chunks AS (
        SELECT page_id AS id, parsed_book_id, page_number, CAST(row_number() OVER (PARTITION BY parsed_book_id ORDER BY page_number, page_id) - 1 AS INTEGER) AS chunk_index, text,
               len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word_count, length(text) AS char_count
        FROM latest WHERE text IS NOT NULL AND NOT regexp_full_match(text, '[\\s\\v\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]*'))
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.page_chunks(table(spark, sf_dir, "page_contents"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_books")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_documents", *columns)


@query("SELECT id, source, version, title FROM parsed_documents WHERE source = 'hexdocs' AND version = '3.6.9'")
def docs_by_source_and_version(spark, sf_dir):
    return predicates.source_and_version(documents(spark, sf_dir, "id", "source", "version", "title"), "hexdocs", "3.6.9")


@query("SELECT id, language, version, package FROM parsed_documents WHERE language = 'elixir' AND version = '3.6.9'")
def docs_by_language_and_version(spark, sf_dir):
    return predicates.language_and_version(documents(spark, sf_dir, "id", "language", "version", "package"), "elixir", "3.6.9")


@query(
    """SELECT id, title, CAST(publication_date AS VARCHAR) AS published FROM parsed_books
    WHERE language = 'en' AND source_format = 'pdf' AND publication_date > DATE '2010-01-01' AND publication_date < DATE '2020-01-01'
      AND parsed_at > TIMESTAMPTZ '2025-01-10 00:00:00+00' AND publisher = 'Ninth Gate Books'"""
)
def books_by_predicates(spark, sf_dir):
    utc = datetime.timezone.utc
    rows = books(spark, sf_dir).where(predicates.by("language", "en")).where(predicates.by("source_format", "pdf"))
    rows = rows.where(predicates.published_after(datetime.date(2010, 1, 1)) & predicates.published_before(datetime.date(2020, 1, 1)))
    rows = rows.where(predicates.parsed_after(datetime.datetime(2025, 1, 10, tzinfo=utc))).where(predicates.by("publisher", "Ninth Gate Books"))
    return rows.select("id", "title", F.col("publication_date").cast("string").alias("published"))


@query("SELECT id, title FROM parsed_books WHERE list_contains(authors, 'Orrin Zintel')")
def books_by_author(spark, sf_dir):
    return books(spark, sf_dir).where(predicates.by_author("Orrin Zintel")).select("id", "title")


@query(f"WITH {CHUNKS_SQL} SELECT id, parsed_book_id, page_number, chunk_index FROM chunks WHERE page_number BETWEEN 8 AND 12")
def chunks_within_pages(spark, sf_dir):
    return chunks(spark, sf_dir).where(predicates.within_pages(10, 2)).select("id", "parsed_book_id", "page_number", "chunk_index")


@query(f"WITH {CHUNKS_SQL} SELECT id, parsed_book_id, page_number, chunk_index, word_count, char_count FROM chunks")
def page_split_densify(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", "parsed_book_id", "page_number", "chunk_index", "word_count", "char_count")


@query(
    f"""WITH {CHUNKS_SQL} SELECT parsed_book_id, count(*) AS total_pages,
    CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> ''))) AS BIGINT) AS word_count FROM latest GROUP BY parsed_book_id"""
)
def book_totals(spark, sf_dir):
    return corpus.book_totals(table(spark, sf_dir, "page_contents"))


@query(
    """SELECT id, source_file_path FROM (SELECT *, row_number() OVER (PARTITION BY source_file_path ORDER BY inserted_at, id) AS rn FROM parsed_books
    WHERE starts_with(source_file_path, 'library/') AND NOT regexp_matches(source_file_path, '(^|/)\\.\\.(/|$)')) WHERE rn = 1"""
)
def books_by_path(spark, sf_dir):
    held = books(spark, sf_dir).where(textops.under_root(F.col("source_file_path"), "library"))
    return dml.by_path(held, held).select("id", "source_file_path")


@query(
    """SELECT id, coalesce(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '[\\x{FFFD}\\x00-\\x1F]+', '', 'g'), '^Microsoft Word - ', ''), ', p\\. (\\d+)', ', PDF page \\1', 'g'),
    '^[\\s\\v\\x{85}\\p{Z}]+|[\\s\\v\\x{85}\\p{Z}]+$', '', 'g'), 'Untitled') AS display_title FROM parsed_books"""
)
def display_titles(spark, sf_dir):
    return books(spark, sf_dir).select("id", textops.display_title(F.col("title")).alias("display_title"))


@query(
    """WITH ranked AS (SELECT id, file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY inserted_at, id) AS rn, first_value(id) OVER (PARTITION BY file_hash ORDER BY inserted_at, id) AS kept_id FROM parsed_books)
    SELECT id, file_hash, kept_id, rn = 1 AS is_new FROM ranked"""
)
def hash_dedup(spark, sf_dir):
    rows = books(spark, sf_dir).select("id", "file_hash", "inserted_at")
    kept = dml.first_of(rows, "file_hash", F.col("inserted_at"), F.col("id")).select("file_hash", F.col("id").alias("kept_id"))
    return rows.join(kept, "file_hash").select("id", "file_hash", "kept_id", (F.col("id") == F.col("kept_id")).alias("is_new"))


@query(
    """SELECT id, len(e) AS n_errors, array_to_string(e, '; ') AS errors FROM (SELECT id, list_filter([
      CASE WHEN source IS NULL OR trim(source) = '' THEN 'source can''t be blank' END, CASE WHEN version IS NULL OR trim(version) = '' THEN 'version can''t be blank' END,
      CASE WHEN package IS NULL OR trim(package) = '' THEN 'package can''t be blank' END, CASE WHEN title IS NULL OR trim(title) = '' THEN 'title can''t be blank' END,
      CASE WHEN url IS NULL OR trim(url) = '' THEN 'url can''t be blank' END, CASE WHEN text IS NULL OR regexp_full_match(text, '\\s*') THEN 'text can''t be blank' END,
      CASE WHEN length(title) > 20 THEN 'title is longer than 20' END], lambda x: x IS NOT NULL) AS e FROM parsed_documents) WHERE len(e) > 0"""
)
def validate_required(spark, sf_dir):
    rows = documents(spark, sf_dir, "id", *schemas.REQUIRED["parsed_documents"])
    checked = schemas.validated(rows, schemas.REQUIRED["parsed_documents"], [schemas.too_long("title", 20)])
    return checked.where(F.size("errors") > 0).select("id", F.size("errors").alias("n_errors"), F.array_join("errors", "; ").alias("errors"))


@query("SELECT p.page_id, p.parsed_book_id FROM page_contents p WHERE NOT EXISTS (SELECT 1 FROM parsed_books b WHERE b.id = p.parsed_book_id AND b.embedding_status = 'completed')")
def orphan_pages(spark, sf_dir):
    done = books(spark, sf_dir).where(predicates.by("embedding_status", "completed"))
    return schemas.orphans(table(spark, sf_dir, "page_contents", "page_id", "parsed_book_id"), done, "parsed_book_id")


@query("SELECT id, replace(title, chr(0), '') AS title, length(replace(title, chr(0), '')) AS n_chars FROM parsed_books")
def nul_sanitise(spark, sf_dir):
    return schemas.sanitise(books(spark, sf_dir).select("id", "title")).withColumn("n_chars", F.length("title"))


@query(
    """SELECT 'books' AS kind, count(*) AS n FROM parsed_books WHERE embedding_status <> 'failed'
    UNION ALL SELECT 'pages', count(*) FROM page_contents WHERE parsed_book_id NOT IN (SELECT id FROM parsed_books WHERE embedding_status = 'failed')"""
)
def delete_cascade(spark, sf_dir):
    gone = books(spark, sf_dir).where(predicates.by("embedding_status", "failed"))
    left, pages = dml.delete_cascade(books(spark, sf_dir), table(spark, sf_dir, "page_contents", "page_id", "parsed_book_id"), gone)
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(left, "books").unionByName(count(pages, "pages"))


@query("SELECT id, CASE WHEN embedding_status = 'processing' THEN 'pending' ELSE embedding_status END AS embedding_status FROM parsed_books")
def update_where(spark, sf_dir):
    rows = books(spark, sf_dir).select("id", "embedding_status")
    return dml.update(rows, F.col("embedding_status") == "processing", embedding_status=F.lit("pending"))


@query(
    """SELECT id, package, version, title FROM (SELECT *, row_number() OVER (PARTITION BY source, package, version, title ORDER BY updated_at DESC NULLS LAST, id) AS rn FROM parsed_documents) WHERE rn = 1"""
)
def upsert_latest(spark, sf_dir):
    rows = documents(spark, sf_dir, "id", "source", "package", "version", "title", "updated_at")
    return dml.first_of(rows, ["source", "package", "version", "title"], F.desc_nulls_last("updated_at"), F.col("id")).select("id", "package", "version", "title")


@query(
    """SELECT e.event_id, c.c_custkey FROM events e JOIN customer c ON e.user_id = c.c_custkey AND e.event_type = 'login' WHERE e.ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY
    UNION ALL SELECT e.event_id, c.c_custkey FROM events e JOIN customer c ON e.user_id = c.c_custkey AND e.event_type <> 'login' WHERE e.ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY"""
)
def token_validity_join(spark, sf_dir):
    """Events as tokens of customers: each kind is valid for its own number of days before the latest event."""
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    now = events.agg(F.max("ts").alias("now"))
    days = F.when(F.col("event_type") == "login", 7).otherwise(1)
    valid = events.join(F.broadcast(now)).where(F.col("ts") > F.col("now") - F.make_dt_interval(days))
    customers = table(spark, sf_dir, "customer", "c_custkey")
    return valid.join(customers, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_custkey")


@query(
    """SELECT b.id, coalesce(NULLIF(regexp_replace(b.title, '^[\\s\\v]+|[\\s\\v]+$', '', 'g'), ''), list_extract(string_split(b.source_file_path, '/'), -1)) AS title, sha256(b.source_file_path) AS path_hash, coalesce(TRY_CAST(NULLIF(regexp_extract(b.isbn, '^([+-]?\\d+)', 1), '') AS BIGINT), -1) AS isbn_prefix
    FROM parsed_books b"""
)
def book_fields(spark, sf_dir):
    rows = books(spark, sf_dir)
    title = textops.title_or_fallback(F.col("title"), F.lit(None).cast("string"), F.col("source_file_path"))
    return rows.select("id", title.alias("title"), textops.file_hash(F.col("source_file_path")).alias("path_hash"), F.coalesce(textops.leading_int(F.col("isbn")), F.lit(-1)).alias("isbn_prefix"))


@query(
    """SELECT id, md5(concat_ws('|', id, source, version, package, language, title, url, text, CAST(core AS VARCHAR), CAST(len(embedding) AS VARCHAR))) AS fields_hash FROM parsed_documents"""
)
def document_json(spark, sf_dir):
    """Every document written as JSON and read back with the declared schema."""
    rows = documents(spark, sf_dir)
    back = rows.select(F.from_json(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), schemas.PARSED_DOCUMENTS).alias("d")).select("d.*")
    fields = ["id", "source", "version", "package", "language", "title", "url", "text", F.col("core").cast("string"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("string")]
    return back.select("id", F.md5(F.concat_ws("|", *fields)).alias("fields_hash"))
