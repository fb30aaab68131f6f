"""Search indexes derived from a schema (S10): which column is searched how, and the tables that serve it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import lexical

#: Buckets of the inverted index; a term's postings lie in the files of one bucket.
BUCKETS = 64


def mapping(schema: T.StructType, texts: tuple[str, ...] = ("text",), vectors: tuple[str, ...] = ("embedding",)) -> dict[str, str]:
    """Column -> ``text`` (cut into terms), ``vector``, ``keyword``, ``number``, ``date`` or ``flag``; columns of other types are not indexed."""
    out = {}
    for field in schema.fields:
        kind = field.dataType
        if field.name in vectors and isinstance(kind, T.ArrayType):
            out[field.name] = "vector"
        elif isinstance(kind, T.StringType):
            out[field.name] = "text" if field.name in texts else "keyword"
        elif isinstance(kind, T.BooleanType):
            out[field.name] = "flag"
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[field.name] = "date"
        elif isinstance(kind, T.NumericType):
            out[field.name] = "number"
    return out


@dataclass(frozen=True)
class Index:
    """The tables of an index: postings of each text column, and the units with their other columns."""

    path: str
    kinds: dict[str, str]

    def postings(self, spark: SparkSession, column: str = "text") -> DataFrame:
        return spark.read.parquet(f"{self.path}/terms-{column}").drop("bucket")

    def units(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/units")


def build(units: DataFrame, path: str, unit: str = "id") -> Index:
    """Write the index of ``units`` under ``path``: one pass per text column, one for the rest.

    Postings are clustered by term (units without a term by their id), so a query for a few terms skips the other row groups.
    """
    kinds = mapping(units.schema)
    for column in (c for c, k in kinds.items() if k == "text"):
        made = lexical.postings(units, unit=unit, text=column).withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("term", F.col("id").cast("string"))), F.lit(BUCKETS)).cast("int"))
        made.repartition("bucket").sortWithinPartitions("bucket", "term").write.parquet(f"{path}/terms-{column}")
    units.select(*[c for c, k in kinds.items() if k != "text"]).write.parquet(f"{path}/units")
    return Index(path, kinds)
