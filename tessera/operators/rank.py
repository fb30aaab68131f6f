"""Scoring and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine
from tessera.operators.predicates import above_floor
from tessera.runtime import broadcast_if_small


def with_cosine(results: DataFrame, queries: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``cosine_score`` to the query's vector, 0.0 for units without a vector, rounded to six digits."""
    asked = queries.select("query_id", F.col("vector").alias("__asked"))
    joined = results.join(broadcast_if_small(asked, 1024), "query_id")
    return joined.withColumn("cosine_score", F.round(cosine(F.col("__asked"), F.col(vector)), 6)).drop("__asked")


def _normal(value: str, whole) -> F.Column:
    low, high = F.coalesce(F.min(value).over(whole), F.lit(0.0)), F.coalesce(F.max(value).over(whole), F.lit(0.0))
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(1.0))


def fuse(results: DataFrame, by: str = "query_id") -> DataFrame:
    """Adds ``relevance_score``: half the min-max of the backend's score and half that of the cosine, or the latter alone
    for rows without a backend score (expansions). Bounds are those of the whole result set of a query; if they are equal
    the share is 1."""
    whole = Window.partitionBy(by)
    shares = results.withColumn("__cosine", _normal("cosine_score", whole)).withColumn("__backend", _normal("backend_score", whole))
    fused = F.when(F.col("backend_score").isNull(), F.col("__cosine")).otherwise(0.5 * F.col("__backend") + 0.5 * F.col("__cosine"))
    return shares.withColumn("relevance_score", F.round(fused, 6)).drop("__cosine", "__backend")


def by_relevance() -> list:
    """A total order: relevance first (unscored rows lead), then book, index and id."""
    return [F.desc_nulls_first("relevance_score"), F.col("parsed_book_id"), F.col("chunk_index"), F.col("id")]


def prepare_context(results: DataFrame, most: int = 10, floor: float = 0.3, order: list | None = None, by: str = "query_id") -> DataFrame:
    """The first ``most`` results at or above the floor, with ``prompt_index`` from 1 (floor first, then ceiling)."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*(order or by_relevance())))
    return results.where(above_floor("relevance_score", floor)).withColumn("prompt_index", rank).where(F.col("prompt_index") <= most)


def context_quality(queries: DataFrame, context: DataFrame, by: str = "query_id") -> DataFrame:
    """(query_id, quality): ``good`` if any context was selected, else ``none``."""
    some = context.select(by).distinct().withColumn("quality", F.lit("good"))
    return queries.select(by).join(some, by, "left").withColumn("quality", F.coalesce("quality", F.lit("none")))


def score_range(results: DataFrame, score: str = "relevance_score", by: str = "query_id") -> DataFrame:
    return results.groupBy(by).agg(F.min(score).alias("lowest"), F.max(score).alias("highest"))
