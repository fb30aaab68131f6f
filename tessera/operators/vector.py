"""Dense retrieval (Q2, Q8, W13): exact k nearest neighbours of a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are sent to every task as they are; more of them meet the units in a grid of blocks.
QUERY_BLOCK = 4096
#: Units in one cell of that grid.
UNIT_BLOCK = 50_000


def knn(units: DataFrame, queries: DataFrame, k: int = 30, unit: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, backend_score, rank): per query the k units of the highest cosine, scored (1 + cosine) / 2.

    ``queries`` has (query_id, vector). Few queries, as a count that stops at ``QUERY_BLOCK`` shows, are broadcast and
    each task keeps the k best of its rows; many are cut into blocks, and so are the units, and every pair
    of blocks is one task, so that neither side is ever whole in one place. Units whose vector is missing, of another
    length, or holds NaN take no part. Scores are rounded to six digits before ranking; ties go to the lesser id.
    """
    id_type, query_type = units.schema[unit].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, id {id_type}, score double"
    asked = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    held = units.select(F.col(unit).alias("id"), F.col(vector).alias("vector")).where((F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    few = asked.limit(QUERY_BLOCK + 1).toPandas()
    found = _broadcast(held, few, k, schema) if len(few) <= QUERY_BLOCK else _grid(held, asked, k, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", F.col("score").alias("backend_score"), "rank")


def _broadcast(held: DataFrame, asked: pd.DataFrame, k: int, schema: str) -> DataFrame:
    block = held.sparkSession.sparkContext.broadcast(asked)  # at most QUERY_BLOCK vectors

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for batch in batches:
            new = _scores(block.value, batch, k)
            best = new if best is None else pd.concat([best, new])
            if len(best) > 4 * k * max(1, len(block.value)):
                best = _top(best, k)
        if best is not None:
            yield _top(best, k)

    return held.mapInPandas(nearest, schema)


def _grid(held: DataFrame, asked: DataFrame, k: int, schema: str) -> DataFrame:
    blocks, parts = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-held.count() // UNIT_BLOCK))
    left = asked.select("query_id", F.col("vector").alias("wanted"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"))
    right = held.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))

    def cell(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return _top(_scores(queries.rename(columns={"wanted": "vector"}), rows, k), k)

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(cell, schema)


def _scores(asked: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, id, score) of the k best rows of every query, with all that tie with the k-th."""
    out = [pd.DataFrame({"query_id": asked["query_id"].iloc[:0], "id": rows["id"].iloc[:0], "score": np.empty(0)})]
    sizes = rows["vector"].map(len).to_numpy()
    wanted = asked["vector"].map(len).to_numpy()
    for size in np.intersect1d(sizes, wanted):
        q, r = asked[wanted == size], rows[sizes == size]
        a, b = np.stack(q["vector"].to_numpy()).astype(np.float64), np.stack(r["vector"].to_numpy()).astype(np.float64)
        norms = [np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b)]
        a, b = (x / np.where(n > 0, n, 1.0) for x, n in zip((a, b), norms))
        names, ids = q["query_id"].to_numpy(), r["id"].to_numpy()
        for at in range(0, len(names), 256):
            score = np.round((1 + a[at : at + 256] @ b.T) / 2, 6)
            score[~np.isfinite(score)] = -1
            if score.shape[1] > k:
                x, y = np.nonzero(score >= np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None])
            else:
                x, y = np.indices(score.shape).reshape(2, -1)
            found = pd.DataFrame({"query_id": names[at + x], "id": ids[y], "score": score[x, y]})
            out.append(found[found["score"] >= 0])
    return pd.concat(out)


def _top(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    return rows.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)
