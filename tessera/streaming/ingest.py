"""Incremental ingestion: a stream of items into an upserted table and a dead-letter table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.dml import first_of
from tessera.sources.sinks import merge
from pyspark.sql import functions as F


def ingest_stream(items: DataFrame, valid: Column, table: str, failures: str, checkpoint: str, key: str = "id", order: str = "updated_at") -> StreamingQuery:
    """Starts a query over what is there (``availableNow``): valid items are merged by key, others appended as failures.

    A batch that is run again after a failure gives the same table, as the merge is by key; its failures are
    written under the number of the batch and so replace themselves.
    """

    def batch(df: DataFrame, number: int) -> None:
        good = F.coalesce(valid, F.lit(False))
        df = df.persist()
        latest = first_of(df.where(good), key, F.desc_nulls_last(order))
        if not latest.isEmpty():
            merge(latest, table, key, order)
        df.where(~good).write.mode("overwrite").parquet(f"{failures}/batch={number}")
        df.unpersist()

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
