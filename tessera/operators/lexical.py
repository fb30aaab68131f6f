"""Lexical retrieval (Q3, Q7): BM25 over an inverted index that holds only the terms asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.textops import terms
from tessera.runtime import broadcast_if_small, spread_join, stage

# The usual constants of the published formula.
K1, B = 1.2, 0.75


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct terms of every query's text."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def postings(units: DataFrame, wanted: DataFrame | None = None, unit: str = "id", text: str = "text") -> DataFrame:
    """(id, term, tf, length): the inverted index of ``units``, of the ``wanted`` terms or of all.

    Every unit is cut once and has, besides its terms, a row with a null term: it carries the unit's length in terms, so that the
    index by itself tells how many units there are and how long they are.
    """
    cut = units.select(F.col(unit).alias("id"), terms(F.col(text)).alias("terms"))
    each = cut.select("id", F.size("terms").alias("length"), F.explode(F.array_append("terms", F.lit(None).cast("string"))).alias("term"))
    if wanted is not None:
        held = broadcast_if_small(wanted.select("term", F.col("term").alias("__known")).distinct(), 32)
        each = each.join(held, "term", "left").drop("term").withColumnRenamed("__known", "term")
    counted = each.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"))
    return counted.select("id", "term", "tf", "length")


def bm25(units: DataFrame, queries: DataFrame, unit: str = "id", text: str = "text", index: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) of every unit that holds a term of the query; scores rounded to six digits.

    ``index`` is a persisted index of the units (see :mod:`tessera.operators.index`); without it the wanted postings are made here. ``among``
    (query_id, id) limits what is scored, not what is counted.
    """
    asked = stage(query_terms(queries), "query-terms")
    if index is None:
        # the wanted postings are a small part of the texts: written once, they serve the frequencies and the scores
        index = stage(postings(units, asked, unit, text), "postings")
    whole = index.where(F.col("term").isNull()).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    n, mean = whole["n"] or 0, whole["mean"] or 1.0
    held = broadcast_if_small(asked.select("term").distinct(), 32)
    wanted = index.where(F.col("term").isNotNull()).join(held, "term")
    frequency = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = asked.join(frequency, "term").select("query_id", "term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    if among is not None:
        # few units per query: their postings, then their terms
        mine = broadcast_if_small(among, 24)
        placed = wanted.join(mine, "id").join(broadcast_if_small(weighted, 48), ["query_id", "term"])
    else:
        placed = spread_join(wanted, weighted, "term", row_bytes=48)
    tf, length = F.col("tf"), F.col("length")
    part = F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / mean))
    return placed.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def title_boost(units: DataFrame, queries: DataFrame, boost: float, title: str = "title", unit: str = "id") -> DataFrame:
    """(query_id, id, score) of units whose whole title is the query's text: titles are keywords."""
    asked = broadcast_if_small(queries.select("query_id", F.col("text").alias("wanted")), 512)
    return units.select(F.col(unit).alias("id"), F.col(title).alias("title")).join(asked, F.col("title") == F.col("wanted")).select("query_id", "id", F.lit(float(boost)).alias("score"))


def match(units: DataFrame, queries: DataFrame, fields: dict[str, float], boost: float = 1.0, unit: str = "id", index: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): the best field counts; ``text`` is scored by BM25, all other fields by equality."""
    scored = bm25(units, queries, unit, index=index, among=among).withColumn("score", F.col("score") * fields.get("text", 1.0))
    for column, weight in fields.items():
        if column != "text":
            scored = scored.unionByName(title_boost(units, queries, weight, column, unit))
    return scored.groupBy("query_id", "id").agg(F.round(F.max("score") * boost, 6).alias("score"))


def top(scored: DataFrame, size: int, score: str = "score") -> DataFrame:
    """The ``size`` best per query with their rank; ties go to the lesser id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= size)
