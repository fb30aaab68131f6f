"""Functional table changes (S2, S8, S11, S16, S17, J11, W6): each returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import broadcast_if_small


def get(df: DataFrame, key, column: str = "id") -> DataFrame:
    """The row with that key; an error where there is none."""
    row = df.where(F.col(column) == key).limit(1)
    if row.isEmpty():
        raise LookupError(f"no row with {column} = {key!r}")
    return row


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, condition: Column, **changes: Column) -> DataFrame:
    """``changes`` where the condition holds; a null condition changes nothing."""
    where = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in changes.items()})


def delete(table: DataFrame, keys: DataFrame, column: str = "id") -> DataFrame:
    """The table without the rows whose key is among ``keys``."""
    return table.join(keys.select(column).distinct(), column, "left_anti")


def delete_cascade(parents: DataFrame, children: DataFrame, keys: DataFrame, parent_key: str = "id", child_key: str = "parsed_book_id") -> tuple[DataFrame, DataFrame]:
    """Parents without the deleted ones, and children without theirs."""
    gone = keys.select(parent_key).distinct()
    return delete(parents, gone, parent_key), children.join(gone.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def first_of(df: DataFrame, by: str | list[str], *order: Column) -> DataFrame:
    """One row per value of ``by``: the first in ``order``, which should be a total order."""
    by = [by] if isinstance(by, str) else by
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(table: DataFrame, rows: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """The table with ``rows`` merged in by key: the latest wins, of equally late ones the incoming."""
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return first_of(both, key, F.desc_nulls_last(order), F.desc("__new")).drop("__new")


def split_known(rows: DataFrame, existing: DataFrame, column: str = "file_hash") -> tuple[DataFrame, DataFrame]:
    """(new rows, existing rows that are returned instead): the probe before an insert."""
    probe = existing.select(column).distinct()
    new = rows.join(probe, column, "left_anti")
    return first_of(new, column, F.col("inserted_at"), F.col("id")), existing.join(rows.select(column).distinct(), column, "left_semi")


def by_path(books: DataFrame, paths: DataFrame) -> DataFrame:
    """The first book of each wanted path, in insertion order."""
    wanted = broadcast_if_small(paths.select("source_file_path").distinct(), 256)
    return first_of(books.join(wanted, "source_file_path", "left_semi"), "source_file_path", F.col("inserted_at"), F.col("id"))
