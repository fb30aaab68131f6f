"""Search modes and hydration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import expand as expansion
from tessera.operators import lexical, rank, vector
from tessera.functions.textops import preview
from tessera.operators.predicates import reaches
from tessera.runtime import broadcast_if_small, stage
from tessera.spec import DEFAULTS, CorpusSpec, RetrievalQuery


def keyword(units: DataFrame, queries: DataFrame, fields: dict[str, float], size: int = DEFAULTS.size) -> DataFrame:
    """Units that match a term at least; ``queries`` has (query_id, text)."""
    return lexical.top(lexical.match(units, queries, fields), size)


def dense(units: DataFrame, queries: DataFrame, k: int = DEFAULTS.k, size: int = DEFAULTS.size) -> DataFrame:
    """The nearest units; ``queries`` has (query_id, vector)."""
    return vector.knn(units, queries, min(k, size)).withColumnRenamed("backend_score", "score")


def hybrid(units: DataFrame, queries: DataFrame, fields: dict[str, float], k: int = DEFAULTS.k, size: int = DEFAULTS.size, keyword_weight: float = DEFAULTS.keyword_weight) -> DataFrame:
    """The k nearest units, re-scored by their text: a text match adds to the score, never a row."""
    near = vector.knn(units, queries, k).select("query_id", "id", "backend_score")
    near = stage(near, "nearest")
    # only the candidates' texts are scored, but against the statistics of the whole corpus
    text = lexical.match(units, queries, fields, keyword_weight, among=near.select("query_id", "id"))
    both = near.join(text, ["query_id", "id"], "left").select("query_id", "id", F.round(F.col("backend_score") + F.coalesce("score", F.lit(0.0)), 6).alias("score"))
    return lexical.top(both, size)


def search(units: DataFrame, queries: DataFrame, mode: str, spec: CorpusSpec, size: int = DEFAULTS.size, k: int = DEFAULTS.k, min_score: float | None = None, filters: dict | None = None) -> DataFrame:
    """(query_id, id, score, rank) by ``keyword``, ``vector`` or ``hybrid``; filters cut before scoring, ``min_score`` after."""
    for column, value in (filters or {}).items():
        units = units.where(F.col(column) == value)
    if mode == "keyword":
        found = keyword(units, queries, spec.fields, size)
    elif mode == "vector":
        found = dense(units, queries, k, size)
    elif mode == "hybrid":
        found = hybrid(units, queries, spec.fields, k, size)
    else:
        raise ValueError(f"unknown search mode {mode!r}")
    return found.where(reaches("score", min_score))


def execute(units: DataFrame, query: RetrievalQuery, query_id: int = 0) -> DataFrame:
    """One builder query: k-NN clauses intersect and add up, text clauses add up (and select where there is no
    k-NN clause), filters cut first."""
    spark = units.sparkSession
    for clause in query.filters:
        for column, value in clause["term"].items():
            units = units.where(F.col(column) == value)
    scores: DataFrame | None = None
    for clause in query.must:
        for column, body in clause["knn"].items():
            asked = spark.createDataFrame([(query_id, body["vector"])], "query_id int, vector array<double>")
            near = vector.knn(units, asked, body["k"], vector=column).select("query_id", "id", F.col("backend_score").alias("score"))
            scores = near if scores is None else scores.join(near.withColumnRenamed("score", "more"), ["query_id", "id"]).select("query_id", "id", (F.col("score") + F.col("more")).alias("score"))
    texts: DataFrame | None = None
    for clause in query.should:
        body = clause["multi_match"]
        fields = {f.partition("^")[0]: float(f.partition("^")[2] or 1) for f in body["fields"]}
        asked = spark.createDataFrame([(query_id, body["query"])], "query_id int, text string")
        part = lexical.match(units, asked, fields, body["boost"])
        texts = part if texts is None else texts.unionByName(part)
    if texts is not None:
        texts = texts.groupBy("query_id", "id").agg(F.sum("score").alias("more"))
        if scores is None:
            scores = texts.withColumnRenamed("more", "score")
        else:
            scores = scores.join(texts, ["query_id", "id"], "left").select("query_id", "id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    if scores is None:
        scores = units.select(F.lit(query_id).alias("query_id"), "id", F.lit(0.0).alias("score"))
    return lexical.top(scores.withColumn("score", F.round("score", 6)).where(reaches("score", query.min_score)), query.size)


def hydrate(hits: DataFrame, units: DataFrame, order: str = "rank") -> DataFrame:
    """Hits with their units in hit order: missing units drop out, hits that repeat an id stay."""
    return broadcast_if_small(hits, 256).join(units, "id").withColumnRenamed(order, "hit_rank")


def with_context(chunks: DataFrame, hits: DataFrame, offset: int = DEFAULTS.neighbor_offset, spec: CorpusSpec | None = None) -> DataFrame:
    """Hits and their neighbours per query, tagged ``search`` or ``expansion``; expansions have no backend score.

    A corpus whose ``spec`` says that its units have no order is not expanded: the hits come out as they are.
    """
    scores = hits.groupBy("query_id", "id").agg(F.max("backend_score").alias("backend_score"), F.lit("search").alias("hit_source"))
    if spec is not None and spec.expand is None:
        return broadcast_if_small(scores, 64).join(chunks, "id")
    placed = hits.join(chunks.select("id", "parsed_book_id", "chunk_index"), "id")
    expand = spec.expand if spec is not None else expansion.expand
    expanded = expand(placed, chunks, offset, ("query_id", "parsed_book_id"))
    tagged = expanded.join(broadcast_if_small(scores, 64), ["query_id", "id"], "left")
    return tagged.withColumn("hit_source", F.coalesce("hit_source", F.lit("expansion")))


def ranked_search(chunks: DataFrame, queries: DataFrame, k: int = DEFAULTS.k, offset: int = DEFAULTS.neighbor_offset) -> DataFrame:
    """The whole front half of a question: nearest chunks, neighbours, cosine, fusion, context with prompt index."""
    hits = vector.knn(chunks, queries, k)
    results = rank.fuse(rank.with_cosine(with_context(chunks, hits, offset), queries))
    return rank.prepare_context(results, DEFAULTS.max_context_chunks, DEFAULTS.relevance_floor)


def page_groups(results: DataFrame, rank: str = "rank") -> DataFrame:
    """(query_id, parsed_book_id, book_title, source_file_path, total_pages, hit_count, position, pages): the books of a query by their hits
    (expansions count), each with its distinct pages in order: number, section and the start of the first result's text.

    A query's results are few: its size bounds them.
    """
    first = Window.partitionBy("query_id", "parsed_book_id", "page_number").orderBy(rank, "id")
    ranked = results.withColumn("__first", F.row_number().over(first) == 1)
    page = F.when(F.col("__first"), F.struct(F.col("page_number").isNull().alias("last"), "page_number", "section_title", preview(F.col("text")).alias("chunk_preview")))
    whole = ["book_title", "source_file_path", "total_pages"]
    grouped = ranked.groupBy("query_id", "parsed_book_id").agg(
        *[F.first(c).alias(c) for c in whole], F.count(F.lit(1)).alias("hit_count"), F.transform(F.array_sort(F.collect_list(page)), lambda p: p.dropFields("last")).alias("pages")
    )
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hit_count"), "parsed_book_id"))
    return grouped.select("query_id", "parsed_book_id", *whole, "hit_count", position.alias("position"), "pages")
