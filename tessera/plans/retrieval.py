"""Queries that search: nearest units, keywords, hybrids, neighbours, fusion, candidates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine
from tessera.operators import candidates, corpus, expand, index, lexical, rank, search, vector
from tessera.plans.library import CHUNKS_SQL, chunks, documents
from tessera.plans.register import query
from tessera.runtime import shared_dir, spread_join
from tessera.sources.tables import spread_table, table
from tessera.spec import CorpusSpec

DOCS = CorpusSpec("docs", {"title": 3.0, "text": 1.0})
BOOKS = CorpusSpec("chunks_of_books", {"section_title": 2.0, "text": 1.0}, expand=expand.expand)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.vector_chunks(table(spark, sf_dir, "embeddings"))


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 asks."""
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question of every evaluation item whose id is divisible by 20."""
    items = table(spark, sf_dir, "eval_items", "item_id", "text").where(F.col("item_id") % 20 == 0)
    return items.select(F.col("item_id").alias("query_id"), F.trim(F.substring_index("text", "Question:", -1)).alias("text"))


_KNN_SQL = """
    units AS (SELECT vec_id AS id, label AS parsed_book_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS chunk_index, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    asked AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0),
    hits AS (SELECT * FROM (SELECT query_id, id, score AS backend_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
        SELECT query_id, id, round((1 + list_cosine_similarity(q, v)) / 2, 6) AS score FROM asked, units)) WHERE rank <= 30)
"""
_EXPAND_SQL = """
    spans AS (SELECT DISTINCT h.query_id, u.parsed_book_id, unnest(generate_series(greatest(u.chunk_index - 2, 0), u.chunk_index + 2)) AS chunk_index FROM hits h JOIN units u USING (id)),
    expanded AS (SELECT s.query_id, u.id, u.parsed_book_id, u.chunk_index, u.v FROM spans s JOIN units u ON s.parsed_book_id = u.parsed_book_id AND s.chunk_index = u.chunk_index),
    scored AS (SELECT e.query_id, e.id, e.parsed_book_id, e.chunk_index, h.backend_score, CASE WHEN h.id IS NULL THEN 'expansion' ELSE 'search' END AS hit_source, round(list_cosine_similarity(a.q, e.v), 6) AS cosine_score
        FROM expanded e JOIN asked a USING (query_id) LEFT JOIN hits h ON h.query_id = e.query_id AND h.id = e.id),
    bounds AS (SELECT query_id, min(cosine_score) AS cl, max(cosine_score) AS ch, min(backend_score) AS bl, max(backend_score) AS bh FROM scored GROUP BY query_id),
    shares AS (SELECT s.*, CASE WHEN ch > cl THEN (cosine_score - cl) / (ch - cl) ELSE 1.0 END AS nc, CASE WHEN bh > bl THEN (backend_score - bl) / (bh - bl) ELSE 1.0 END AS nb FROM scored s JOIN bounds USING (query_id)),
    fused AS (SELECT query_id, id, parsed_book_id, chunk_index, hit_source, cosine_score, round(CASE WHEN backend_score IS NULL THEN nc ELSE 0.5 * nb + 0.5 * nc END, 6) AS relevance_score FROM shares)
"""
_CONTEXT_SQL = """
    context AS (SELECT query_id, id, parsed_book_id, chunk_index, hit_source, relevance_score, prompt_index FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, parsed_book_id, chunk_index, id) AS prompt_index FROM fused WHERE relevance_score IS NULL OR relevance_score >= 0.3) WHERE prompt_index <= 10)
"""


@query(f"WITH {_KNN_SQL} SELECT query_id, id, backend_score, rank FROM hits")
def knn_batch_topk(spark, sf_dir):
    return vector.knn(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir))


@query(
    """WITH units AS (SELECT id, CAST(embedding AS DOUBLE[64]) AS v FROM parsed_documents WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x))) AND source = 'hexdocs'),
    asked AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[64]) AS q FROM embeddings WHERE vec_id % 20 = 0)
    SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
        SELECT query_id, id, CASE WHEN isnan(array_cosine_similarity(q, v)) THEN 0.5 ELSE round((1 + array_cosine_similarity(q, v)) / 2, 6) END AS score FROM asked, units)) WHERE rank <= 30 AND score >= 0.6"""
)
def filter_term_knn(spark, sf_dir):
    """Nearest documents of one source, above a least score."""
    return search.search(documents(spark, sf_dir, "id", "source", "embedding"), _vector_queries(spark, sf_dir), "vector", DOCS, filters={"source": "hexdocs"}, min_score=0.6)


@query(
    """SELECT a.vec_id AS id, b.vec_id AS next_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def cosine_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("following"))
    return rows.join(following, "vec_id").select(F.col("vec_id").alias("id"), "next_id", F.round(cosine(F.col("embedding"), F.col("following")), 6).alias("cosine"))


def _expanded(spark, sf_dir):
    units = _vectors(spark, sf_dir)
    return search.with_context(units, vector.knn(units, _vector_queries(spark, sf_dir)), spec=BOOKS)


@query(f"WITH {_KNN_SQL}, {_EXPAND_SQL} SELECT query_id, id, parsed_book_id, chunk_index, hit_source FROM fused")
def search_with_context(spark, sf_dir):
    return _expanded(spark, sf_dir).select("query_id", "id", "parsed_book_id", "chunk_index", "hit_source")


@query(f"WITH {_KNN_SQL}, {_EXPAND_SQL} SELECT query_id, id, hit_source, cosine_score, relevance_score FROM fused")
def minmax_fuse(spark, sf_dir):
    fused = rank.fuse(rank.with_cosine(_expanded(spark, sf_dir), _vector_queries(spark, sf_dir)))
    return fused.select("query_id", "id", "hit_source", "cosine_score", "relevance_score")


@query(f"WITH {_KNN_SQL}, {_EXPAND_SQL}, {_CONTEXT_SQL} SELECT * FROM context")
def prepare_context(spark, sf_dir):
    """The flagship: search, expand, score, fuse, select the context of every query."""
    out = search.ranked_search(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir))
    return out.select("query_id", "id", "parsed_book_id", "chunk_index", "hit_source", "relevance_score", "prompt_index")


@query(f"WITH {_KNN_SQL}, {_EXPAND_SQL} SELECT query_id, min(relevance_score) AS lowest, max(relevance_score) AS highest FROM fused GROUP BY query_id")
def score_range(spark, sf_dir):
    return rank.score_range(rank.fuse(rank.with_cosine(_expanded(spark, sf_dir), _vector_queries(spark, sf_dir))))


@query(
    f"""WITH {_KNN_SQL}, s AS (SELECT h.query_id, u.parsed_book_id, greatest(u.chunk_index - 2, 0) AS low, u.chunk_index + 2 AS high FROM hits h JOIN units u USING (id)),
    d AS (SELECT DISTINCT * FROM s), r AS (SELECT *, max(high) OVER (PARTITION BY query_id, parsed_book_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR low > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, parsed_book_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT query_id, parsed_book_id, min(low) AS low, max(high) AS high FROM i GROUP BY query_id, parsed_book_id, island"""
)
def neighbor_interval_merge(spark, sf_dir):
    units = _vectors(spark, sf_dir)
    hits = vector.knn(units, _vector_queries(spark, sf_dir)).join(units.select("id", "parsed_book_id", "chunk_index"), "id")
    return expand.merged_ranges(hits, 2, ("query_id", "parsed_book_id"))


@query(
    f"""WITH {CHUNKS_SQL}, hits AS (SELECT * FROM chunks WHERE id % 20 = 0), spans AS (SELECT DISTINCT parsed_book_id, unnest(generate_series(greatest(chunk_index - 2, 0), chunk_index + 2)) AS chunk_index FROM hits)
    SELECT c.id, c.parsed_book_id, c.chunk_index, c.page_number FROM spans s JOIN chunks c ON s.parsed_book_id = c.parsed_book_id AND s.chunk_index = c.chunk_index"""
)
def neighbor_expand(spark, sf_dir):
    """Every page whose id is divisible by 20, with its neighbours in its book."""
    units = chunks(spark, sf_dir)
    return expand.expand(units.where(F.col("id") % 20 == 0), units).select("id", "parsed_book_id", "chunk_index", "page_number")


_BM25_SQL = """
    asked AS (SELECT item_id AS query_id, trim(regexp_replace(text, '(?s)^.*Question:', ''), ' ') AS text FROM eval_items WHERE item_id % 20 = 0),
    qt AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM asked),
    cut AS (SELECT id, title, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS terms FROM parsed_documents),
    whole AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM cut),
    exploded AS (SELECT id, len(terms) AS length, unnest(terms) AS term FROM cut),
    postings AS (SELECT id, term, count(*) AS tf, max(length) AS length FROM exploded WHERE term IN (SELECT term FROM qt) GROUP BY id, term),
    weights AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(mean) AS mean FROM postings, whole GROUP BY term),
    bm25 AS (SELECT query_id, id, round(sum(idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM qt JOIN weights USING (term) JOIN postings USING (term) GROUP BY query_id, id)
"""


@query(
    f"WITH {_BM25_SQL} SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm25) WHERE rank <= 30"
)
def bm25_topk(spark, sf_dir):
    return search.keyword(spread_table(spark, sf_dir, "parsed_documents", "id", "title", "text"), _text_queries(spark, sf_dir), DOCS.fields).select("query_id", "id", "score", "rank")


@query(
    f"WITH {_BM25_SQL} SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm25) WHERE rank <= 30"
)
def indexed_bm25_topk(spark, sf_dir):
    """The same ranking from an index that is derived from the schema, written, and read by its terms."""
    docs = spread_table(spark, sf_dir, "parsed_documents", "id", "title", "text", "source", "embedding")
    made = index.build(docs, f"{shared_dir(spark)}/index-{uuid.uuid4().hex[:12]}")
    return lexical.top(lexical.bm25(made.units(spark), _text_queries(spark, sf_dir), index=made.postings(spark)), 30)


@query("SELECT title AS query_id, id, 3.0::DOUBLE AS score FROM parsed_documents WHERE title IS NOT NULL")
def title_exact_boost(spark, sf_dir):
    """Titles are keywords: all distinct titles, asked against all documents."""
    docs = documents(spark, sf_dir, "id", "title")
    titles = docs.where("title is not null").select(F.col("title").alias("query_id"), F.col("title").alias("text")).distinct()
    return lexical.title_boost(docs, titles, 3.0)


@query(
    f"""WITH {_BM25_SQL}, questions AS (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS n FROM asked),
    q AS (SELECT questions.query_id, CAST(e.embedding AS DOUBLE[64]) AS q FROM questions JOIN embeddings e ON e.vec_id = questions.n),
    units AS (SELECT id, CAST(embedding AS DOUBLE[64]) AS v FROM parsed_documents WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x)))),
    near AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, CASE WHEN isnan(array_cosine_similarity(q, v)) THEN 0.5 ELSE round((1 + array_cosine_similarity(q, v)) / 2, 6) END AS score FROM q, units)) WHERE rank <= 30),
    mixed AS (SELECT n.query_id, n.id, round(n.score + coalesce(round(0.8 * b.score, 6), 0), 6) AS score FROM near n LEFT JOIN bm25 b ON b.query_id = n.query_id AND b.id = n.id)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM mixed"""
)
def hybrid_topk(spark, sf_dir):
    """Questions with the first vectors as their embeddings, nearest documents re-scored by text."""
    asked = _text_queries(spark, sf_dir)
    numbered = asked.select("query_id", "text", (F.expr("row_number() over (order by query_id)") - 1).cast("bigint").alias("vec_id"))
    queries = numbered.join(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id").select("query_id", "text", F.col("embedding").alias("vector"))
    return search.hybrid(spread_table(spark, sf_dir, "parsed_documents", "id", "title", "text", "embedding"), queries, DOCS.fields)


_HITS_SQL = "hits AS (SELECT query_id, CAST(id AS BIGINT) AS id, rank FROM (SELECT l_orderkey AS query_id, l_partkey AS id, l_linenumber AS rank FROM lineitem))"


@query(f"WITH {CHUNKS_SQL}, {_HITS_SQL} SELECT h.query_id, h.rank AS hit_rank, c.id, c.parsed_book_id, c.page_number FROM hits h JOIN chunks c ON c.id = h.id")
def hydrate_in_hit_order(spark, sf_dir):
    """Order lines as hits: the part's number is the page, the line's number the place."""
    hits = _hits(spark, sf_dir)
    return search.hydrate(hits, chunks(spark, sf_dir).select("id", "parsed_book_id", "page_number"))


def _hits(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("rank"))


def _results(spark, sf_dir):
    """Hydrated hits as results with their book as source, and no source for pages that are divisible by 7."""
    pages = chunks(spark, sf_dir).select("id", "parsed_book_id", "page_number", "text")
    rows = search.hydrate(_hits(spark, sf_dir), pages).withColumnRenamed("hit_rank", "rank")
    source = F.when(F.col("id") % 7 != 0, F.col("parsed_book_id"))
    page = F.when(F.col("id") % 5 != 0, F.col("page_number"))
    return rows.select(
        "query_id", "id", "rank", "text", "parsed_book_id", page.alias("page_number"), source.alias("source_ref"), F.lit(None).cast("string").alias("book_title"), F.lit(None).cast("string").alias("section_title"), F.concat(F.lit("page "), "id").alias("label")
    )


_RESULTS_SQL = f"""{CHUNKS_SQL}, {_HITS_SQL}, results AS (SELECT h.query_id, c.id, h.rank, c.text, c.parsed_book_id, CASE WHEN c.id % 5 <> 0 THEN c.page_number END AS page_number,
    CASE WHEN c.id % 7 <> 0 THEN c.parsed_book_id END AS source_ref, coalesce(CASE WHEN c.id % 7 <> 0 THEN c.parsed_book_id END, CAST(c.id AS VARCHAR)) AS document FROM hits h JOIN chunks c ON c.id = h.id)"""


@query(
    f"""WITH {_RESULTS_SQL} SELECT query_id, document, row_number() OVER (PARTITION BY query_id ORDER BY first_rank, document) AS position, ids AS chunk_ids FROM (
    SELECT query_id, document, min(rank) AS first_rank, array_to_string(list(id ORDER BY rank, id), ',') AS ids FROM results GROUP BY query_id, document)"""
)
def group_by_document(spark, sf_dir):
    grouped = candidates.group_by_document(_results(spark, sf_dir))
    return grouped.withColumn("chunk_ids", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ","))


@query(
    f"""WITH {_RESULTS_SQL} SELECT query_id, document, arg_min('page ' || id, rank * 1000000000000 + id) AS title, arg_min(left(text, 100), rank * 1000000000000 + id) AS preview,
    CASE WHEN count(page_number) = 1 THEN 'PDF page ' || min(page_number) WHEN count(page_number) > 1 THEN 'PDF pages ' || min(page_number) || '-' || max(page_number) END AS page_label FROM results GROUP BY query_id, document"""
)
def document_page_label(spark, sf_dir):
    return candidates.document_metadata(_results(spark, sf_dir))


@query(
    f"""WITH {_RESULTS_SQL}, sel AS (SELECT query_id, document, row_number() OVER (PARTITION BY query_id ORDER BY document DESC) AS selected_pos FROM (SELECT DISTINCT query_id, document FROM results))
    SELECT s.query_id, row_number() OVER (PARTITION BY s.query_id ORDER BY selected_pos, rank, id) AS ordinal, id FROM sel s JOIN results r ON r.query_id = s.query_id AND r.document = s.document WHERE selected_pos <= 2"""
)
def expand_selection(spark, sf_dir):
    results = _results(spark, sf_dir)
    documents_ = results.select("query_id", F.coalesce("source_ref", F.col("id").cast("string")).alias("document")).distinct()
    selection = documents_.withColumn("selected_pos", F.expr("row_number() over (partition by query_id order by document desc)")).where("selected_pos <= 2")
    return candidates.expand_selection(selection, results)


@query(f"WITH {_RESULTS_SQL} SELECT DISTINCT h.query_id, h.id FROM hits h WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.query_id = h.query_id AND r.id = h.id)")
def unknown_selection(spark, sf_dir):
    requested = _hits(spark, sf_dir).select("query_id", "id").distinct()
    return candidates.unknown_selection(requested, _results(spark, sf_dir))


@query(f"WITH {_RESULTS_SQL} SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS selection_index FROM results WHERE id % 3 = 0")
def manual_selection(spark, sf_dir):
    results = _results(spark, sf_dir)
    return candidates.selected(results, results.where(F.col("id") % 3 == 0)).select("query_id", "id", "rank", "selection_index")


@query(
    f"""WITH {_RESULTS_SQL}, g AS (SELECT query_id, document, min(rank) AS first_rank FROM results GROUP BY query_id, document), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank, document) AS position FROM g)
    SELECT r.query_id, row_number() OVER (PARTITION BY r.query_id ORDER BY position, r.rank, r.id) AS ordinal, r.id FROM results r JOIN p ON p.query_id = r.query_id AND p.document = r.document"""
)
def all_chunk_ids(spark, sf_dir):
    return candidates.all_chunk_ids(candidates.group_by_document(_results(spark, sf_dir)))


@query(
    f"""WITH {_RESULTS_SQL}, firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, parsed_book_id, page_number ORDER BY rank, id) AS nth FROM results),
    grouped AS (SELECT query_id, parsed_book_id, count(*) AS hit_count,
        array_to_string(list(coalesce(CAST(page_number AS VARCHAR), '-') || ':' || left(text, 200) ORDER BY page_number NULLS LAST) FILTER (WHERE nth = 1), '|') AS pages FROM firsts GROUP BY query_id, parsed_book_id)
    SELECT query_id, b.title AS book_title, b.source_file_path, CAST(b.total_pages AS VARCHAR) AS total_pages, hit_count, row_number() OVER (PARTITION BY query_id ORDER BY hit_count DESC, parsed_book_id) AS position, md5(pages) AS pages_hash
    FROM grouped JOIN parsed_books b ON b.id = parsed_book_id"""
)
def search_page_groups(spark, sf_dir):
    """The books of a search by their hits, with title, path, length, and the pages that were hit with their first 200 characters."""
    of = table(spark, sf_dir, "parsed_books", "id", "title", "source_file_path", "total_pages").withColumnsRenamed({"id": "parsed_book_id", "title": "book_title"})
    results = spread_join(_results(spark, sf_dir).drop("book_title"), of, "parsed_book_id", row_bytes=64)
    shown = F.transform("pages", lambda p: F.concat(F.coalesce(p["page_number"].cast("string"), F.lit("-")), F.lit(":"), p["chunk_preview"]))
    return search.page_groups(results).select("query_id", "book_title", "source_file_path", F.col("total_pages").cast("string").alias("total_pages"), "hit_count", "position", F.md5(F.array_join(shown, "|")).alias("pages_hash"))


@query(
    """WITH units AS (SELECT id, package, CAST(embedding AS DOUBLE[64]) AS v FROM parsed_documents WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x)))),
    asked AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[64]) AS q FROM embeddings WHERE vec_id % 20 = 0)
    SELECT query_id, id, package, backend_score, 'search' AS hit_source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY backend_score DESC, id) AS rank FROM (
        SELECT query_id, id, package, CASE WHEN isnan(array_cosine_similarity(q, v)) THEN 0.5 ELSE round((1 + array_cosine_similarity(q, v)) / 2, 6) END AS backend_score FROM asked, units)) WHERE rank <= 30"""
)
def search_without_order(spark, sf_dir):
    """Documents have no order: a search with context gives the hits as they are."""
    docs = documents(spark, sf_dir, "id", "package", "embedding")
    hits = vector.knn(docs, _vector_queries(spark, sf_dir))
    return search.with_context(docs, hits, spec=DOCS).select("query_id", "id", "package", "backend_score", "hit_source")


@query(f"WITH {_KNN_SQL}, {_EXPAND_SQL}, {_CONTEXT_SQL} SELECT a.query_id, CASE WHEN count(c.id) > 0 THEN 'good' ELSE 'none' END AS quality FROM asked a LEFT JOIN context c USING (query_id) GROUP BY a.query_id")
def context_quality(spark, sf_dir):
    queries = _vector_queries(spark, sf_dir)
    return rank.context_quality(queries, search.ranked_search(_vectors(spark, sf_dir), queries))


