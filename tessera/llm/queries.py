"""Registered queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import encoding, leakage, mixing, neardup, reading, splitting, tokens, vectors
from tessera.runtime import spread_join
from tessera.sources.tables import spread_table, table

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Problem 4: pieces of long pages, runs of long books


def _page_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(table(spark, sf_dir, "page_contents", "page_id", "parsed_book_id", "page_number", "text"))


def _book_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_runs(table(spark, sf_dir, "page_contents", "parsed_book_id", "page_number", "text"))


@query(
    """
    SELECT 'page' AS item_kind, CAST(page_id AS VARCHAR) AS item_key FROM page_contents WHERE length(text) > 3000
    UNION ALL
    SELECT 'book', parsed_book_id FROM page_contents GROUP BY parsed_book_id HAVING count(DISTINCT page_number) > 60
    """
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and book that the splitters cut."""
    pages = _page_pieces(spark, sf_dir).where(F.col("piece_no") == 0).select(F.lit("page").alias("item_kind"), F.col("page_id").cast("string").alias("item_key"))
    books = _book_runs(spark, sf_dir).where(F.col("run_no") == 0).select(F.lit("book").alias("item_kind"), F.col("parsed_book_id").alias("item_key"))
    return pages.unionByName(books)


@query()
def p4_page_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every page of more than 3,000 code points."""
    return _page_pieces(spark, sf_dir)


@query()
def p4_book_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every book of more than 60 pages, with what its record claims beside what was counted."""
    books = table(spark, sf_dir, "parsed_books", "id", "total_pages").withColumnRenamed("id", "parsed_book_id")
    runs = _book_runs(spark, sf_dir).join(books, "parsed_book_id", "left")
    return runs.withColumn("total_pages_agrees", F.coalesce(F.col("total_pages") == F.col("n_pages"), F.lit(False)))


@query(
    """
    SELECT page_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_hash, true AS within_limit, true AS overlaps_fit, true AS ends_fit
    FROM page_contents WHERE length(text) > 3000
    """
)
def p4_page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every page that was cut: the text that its pieces give when laid over each other, and whether they keep to the limits."""
    pieces = _page_pieces(spark, sf_dir)
    before = Window.partitionBy("page_id").orderBy("piece_no")
    placed = pieces.withColumn("reached", F.coalesce(F.lag("piece_end").over(before), F.lit(0)))
    size = F.col("piece_end") - F.col("piece_start")
    shared = F.col("reached") - F.col("piece_start")
    new = F.substring("piece_text", shared + 1, size)
    return placed.groupBy("page_id").agg(
        F.max("piece_end").alias("n_chars"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("piece_no"), new.alias("new")))), lambda x: x["new"]), "")).alias("text_hash"),
        F.bool_and((size <= 3000) & (F.length("piece_text") == size)).alias("within_limit"),
        F.bool_and(shared.between(0, 200)).alias("overlaps_fit"),
        (F.max_by("cut_at", "piece_no") == "end").alias("ends_fit"),
    )


@query(
    """
    SELECT parsed_book_id, CAST(count(DISTINCT page_number) AS INTEGER) AS n_pages, min(page_number) AS first_page, max(page_number) AS last_page, true AS within_limit, true AS covers
    FROM page_contents GROUP BY parsed_book_id HAVING count(DISTINCT page_number) > 60
    """
)
def p4_run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every book that was cut: what its runs cover, and whether they keep to the limit and overlap by two pages."""
    return _book_runs(spark, sf_dir).groupBy("parsed_book_id").agg(
        F.max("n_pages").alias("n_pages"),
        F.min("first_page").alias("first_page"),
        F.max("last_page").alias("last_page"),
        F.bool_and(F.col("run_pages") <= 60).alias("within_limit"),
        (F.sum("run_pages") - 2 * (F.count(F.lit(1)) - 1) == F.max("n_pages")).alias("covers"),
    )


# Problem 6: test items in the corpus


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = leakage.excerpts(table(spark, sf_dir, "eval_items", "item_id", "text"))
    return leakage.find_leaks(spread_table(spark, sf_dir, "documents", "doc_id", "text"), items)


@query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least ten consecutive words of an item's excerpt."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


@query()
def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks with the number and the longest of the shared runs."""
    return _leaks(spark, sf_dir)


# Problem 1: near-duplicate records


def _near_duplicates(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(spread_table(spark, sf_dir, "parsed_documents", "id", "text"), threshold=0.6, shingle=3, min_words=20)


_P1_SQL = """
    cut AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM parsed_documents WHERE text IS NOT NULL),
    shingles AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM cut WHERE len(w) >= 20)),
    sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
    common AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id)
"""


@query(f"WITH {_P1_SQL} SELECT x AS id_a, y AS id_b FROM common JOIN sizes p ON p.id = x JOIN sizes q ON q.id = y WHERE c >= 0.6 * (p.n + q.n - c)")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that share at least 0.6 of their runs of three words."""
    return _near_duplicates(spark, sf_dir).record_pairs()


@query()
def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its class, its copies and its links."""
    return _near_duplicates(spark, sf_dir).groups()


# Problem 5: most similar vectors


def _vector_search(spark: SparkSession, sf_dir: str) -> vectors.VectorSearch:
    return vectors.VectorSearch(spread_table(spark, sf_dir, "parsed_documents", "id", "embedding"))


@query(
    """
    WITH units AS (SELECT id, CAST(embedding AS DOUBLE[64]) AS v FROM parsed_documents
        WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))) AND list_min(embedding) < list_max(embedding)),
    near AS (SELECT a.id AS x, b.id AS y, round(array_cosine_similarity(a.v, b.v), 7) AS c FROM units a JOIN units b ON a.id <> b.id WHERE array_cosine_similarity(a.v, b.v) >= 0.9),
    ranked AS (SELECT x, y, c FROM near QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 10)
    SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM ranked WHERE c >= 0.92
    """
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a cosine of at least 0.92 of which one is among the ten most similar rows of the other."""
    near = _vector_search(spark, sf_dir).neighbours(at_least=0.92)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


@query()
def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar rows of every row with a usable vector."""
    return _vector_search(spark, sf_dir).neighbours()


# Problem 2: token budget

# Pieces are cut by the tokenizer's pattern; each distinct one starts as single bytes, and in each step the first of the adjacent pairs
# of the least rank is joined, until no rule applies.
_P2_SQL = """
    rules AS (SELECT min(merge_rank) AS rank, left_hex || '|' || right_hex AS pair, any_value(left_hex || right_hex) AS joined FROM tokenizer_merges GROUP BY left_hex || '|' || right_hex),
    cut AS (SELECT row_number() OVER () AS r, id, source, language, url, text, regexp_extract_all(coalesce(text, ''), ' ?\\p{L}+| ?\\p{N}{1,3}| ?[^\\s\\v\\x{85}\\p{Z}\\p{L}\\p{N}]+|[\\s\\v\\x{85}\\p{Z}]+') AS pieces FROM parsed_documents),
    used AS (SELECT r, unnest(pieces) AS piece FROM cut),
    steps AS (
        SELECT piece, regexp_extract_all(lower(hex(encode(piece))), '..') AS parts, false AS done FROM (SELECT DISTINCT piece FROM used)
        UNION ALL
        SELECT piece, CASE WHEN spot IS NULL THEN parts ELSE list_concat(list_concat(parts[:spot - 1], [parts[spot] || parts[spot + 1]]), parts[spot + 2:]) END, spot IS NULL
        FROM (SELECT s.piece, any_value(s.parts) AS parts, arg_min(s.i, rules.rank * 1000000 + s.i) AS spot
              FROM (SELECT piece, parts, unnest(range(1, greatest(len(parts), 2))) AS i FROM steps WHERE NOT done) s
              LEFT JOIN rules ON rules.pair = s.parts[s.i] || '|' || s.parts[s.i + 1] GROUP BY s.piece)
    ),
    lengths AS (SELECT piece, len(parts) AS tokens FROM steps WHERE done),
    counted AS (SELECT r, sum(tokens) AS tokens FROM used JOIN lengths USING (piece) GROUP BY r),
    docs AS (SELECT cut.*, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens FROM cut LEFT JOIN counted USING (r))
"""
_BLANKS = "\\s\\v\\x{85}\\p{Z}"
_LANGUAGES_SQL = " ".join(f"WHEN '{short}' THEN '{name}'" for short, name in tokens.LANGUAGE_ALIASES.items())
_P2_TOTALS_SQL = f"""
    trimmed AS (SELECT *, regexp_replace(source, '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g') AS s, lower(regexp_replace(language, '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g')) AS l,
        lower(regexp_replace(url, '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g')) AS u FROM docs),
    facts AS (SELECT coalesce(nullif(replace(lower(s), '-', '_'), ''), 'unknown') AS source, coalesce(nullif(CASE l {_LANGUAGES_SQL} ELSE l END, ''), 'unknown') AS language,
        coalesce(nullif(regexp_replace(coalesce(nullif(regexp_extract(u, '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)', 1), ''), regexp_extract(u, '^((?:[a-z0-9-]+\\.)+[a-z0-9-]+)(?::\\d+)?(?:[/?#]|$)', 1)), '^www\\.', ''), ''), 'unknown') AS host,
        tokens, coalesce(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) >= 20, false) AS usable FROM trimmed)
"""


def _merge_tokenizer(spark: SparkSession, sf_dir: str) -> tokens.MergeTokenizer:
    return tokens.MergeTokenizer.from_table(table(spark, sf_dir, "tokenizer_merges"))


@query(
    f"""WITH RECURSIVE {_P2_SQL}, {_P2_TOTALS_SQL}
    SELECT CASE grouping(source, language, host) WHEN 0 THEN 'slice' WHEN 3 THEN 'source' WHEN 5 THEN 'language' WHEN 6 THEN 'host' ELSE 'all' END AS level, source, language, host, count(*) AS documents,
        CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, count(*) FILTER (WHERE usable) AS usable_documents, CAST(coalesce(sum(tokens) FILTER (WHERE usable), 0) AS BIGINT) AS usable_tokens
    FROM facts GROUP BY GROUPING SETS ((source, language, host), (source), (language), (host), ())"""
)
def p2_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all and of usable texts by source, language and host."""
    docs = spread_table(spark, sf_dir, "parsed_documents", "id", "text", "source", "language", "url")
    return tokens.token_totals(docs, _merge_tokenizer(spark, sf_dir))


@query(f"WITH RECURSIVE {_P2_SQL} SELECT id, tokens FROM docs")
def p2_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every record's text."""
    return tokens.row_tokens(spread_table(spark, sf_dir, "parsed_documents", "id", "text"), _merge_tokenizer(spark, sf_dir), "text", "id")


@query()
def p2_public_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals under a public vocabulary of 50 k tokens."""
    docs = spread_table(spark, sf_dir, "parsed_documents", "id", "text", "source", "language", "url")
    return tokens.token_totals(docs, tokens.RankTokenizer(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"))


# Problem 7: a mix of sources


def _mix(spark: SparkSession, sf_dir: str) -> mixing.SourceMix:
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    counted = tokens.row_tokens(docs, tokens.RankTokenizer(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), "text", "doc_id", "source")
    return mixing.SourceMix(counted, table(spark, sf_dir, "mix_targets"))


@query()
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of which the mix holds less than their share although it holds every copy that it may."""
    return _mix(spark, sf_dir).shares().where("missed").select("source")


@query()
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and their copies."""
    return _mix(spark, sf_dir).mix().withColumnRenamed("key", "doc_id")


@query()
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mix(spark, sf_dir).shares()


# Problem 8: reading level


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    return reading.reading_levels(docs, reading.fit_on_ratings(docs, table(spark, sf_dir, "reading_ratings", "doc_id", "school_years")))


@query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents of at least 60 words of prose that ask for more than 14 years of schooling."""
    return _levels(spark, sf_dir).where("english and prose_words >= 60 and school_years > 14").select("doc_id")


@query()
def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document."""
    return _levels(spark, sf_dir)


# Problem 3: wrong character encodings


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and titles in one table; a group is a field of the books of one folder."""
    folder = F.regexp_extract("source_file_path", r"^(.*)/", 1)
    books = table(spark, sf_dir, "parsed_books", "id", "title", "source_file_path").withColumn("folder", folder)
    pages = spread_table(spark, sf_dir, "page_contents", "page_id", "parsed_book_id", "text")
    of = books.select(F.col("id").alias("parsed_book_id"), "folder")
    pages = spread_join(pages, of, "parsed_book_id", "left", row_bytes=48)
    return pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("key"), F.concat(F.lit("page:"), "folder").alias("group"), "text").unionByName(
        books.select(F.lit("book").alias("kind"), F.col("id").alias("key"), F.concat(F.lit("book:"), "folder").alias("group"), F.col("title").alias("text"))
    )


@query()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and titles that a wrong decoding damaged."""
    damaged = encoding.find_damage(_texts(spark, sf_dir)).damaged
    return damaged.select(F.col("kind").alias("record_kind"), F.col("key").alias("record_key"))


@query()
def p3_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged records, how they were damaged, and their text restored as far as it can be."""
    texts = _texts(spark, sf_dir)
    return encoding.repaired(texts, encoding.find_damage(texts))
