"""Session-level helpers: lineage cuts in shared storage and size-checked broadcasts.

Iterative operators must not grow their lineage without end, and must survive the loss of an
executor. Both needs are met by writing the intermediate table as Parquet into the folder that the
cluster names in ``spark.checkpoint.dir`` (shared by all executors) and reading it back.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if its rows and their measured bytes stay below this.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024

_own_dir: str | None = None
_run = uuid.uuid4().hex[:12]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Taken from ``spark.checkpoint.dir``; only where that is unset and all runs on this machine (tests, a laptop) a temporary
    folder of this process is used. On a cluster an unset folder is an error: executors would write to disks of their own.
    """
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-tessera-")
    return f"file://{_own_dir}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{_run}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    if not getattr(stage, "_hooked", False):
        atexit.register(release, spark)
        stage._hooked = True
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def forget(*staged: DataFrame | None) -> None:
    """Delete tables that :func:`stage` returned and that nothing will read again (those of a loop's earlier rounds)."""
    for df in staged:
        if df is not None and getattr(df, "_staged_at", None):
            _delete(df.sparkSession, df._staged_at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete what :func:`stage` wrote in this process."""
    try:
        _delete(spark, f"{shared_dir(spark)}/tessera-{_run}")
    except Exception:  # the session may be gone already
        pass


def _width(df: DataFrame) -> Column:
    """The bytes of a row: those of texts and arrays as they are, those of other types by their kind."""
    parts = F.lit(0)
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            parts = parts + 16 + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
            parts = parts + 24 + 8 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts = parts + 24 + 2 * F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            parts = parts + 16
    return parts


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``F.broadcast(df)`` if it is measured to fit ``limit``; otherwise ``df`` for a shuffled join.

    ``row_bytes`` is what a row takes at least; the texts and arrays of the rows are summed. The measurement stops after as many rows
    as could fit, so the check costs no more than reading those.
    """
    most = limit // row_bytes
    seen = df.limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_width(df)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if seen["n"] <= most and seen["bytes"] <= limit else df


#: Rows of one key that a task of :func:`spread_join` gets before the key is split, and classes of keys that are counted first.
KEY_ROWS, KEY_CLASSES = 20_000, 1 << 16


def heavy_keys(df: DataFrame, on: list[str], most: int = KEY_ROWS) -> DataFrame:
    """(on..., __rows): the keys that hold more than ``most`` rows of ``df``, at most one in ``most`` rows.

    Rows are counted by a hash of the key first, with few classes and so with little to shuffle; only keys of classes over the limit
    are counted each. Null keys are left out.
    """
    keys = df.dropna(subset=on).select(*on, F.pmod(F.xxhash64(*on), F.lit(KEY_CLASSES)).cast("int").alias("__class"))
    full = stage(keys.groupBy("__class").agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > most).select("__class"), "full-classes")
    each = keys.join(F.broadcast(full), "__class", "left_semi")  # at most KEY_CLASSES numbers
    return stage(each.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > most), "heavy-keys")


def spread_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", row_bytes: int | None = None, most: int = KEY_ROWS, heavy: DataFrame | None = None) -> DataFrame:
    """``big.join(small, on, how)``, inner or left, in which a key that holds more than ``most`` rows of ``big`` is split over several tasks.

    The rows of such a key are dealt to parts by a hash of the row, and the rows of ``small`` are repeated for each part. Null keys match
    nothing. With ``row_bytes`` (what a row of ``small`` takes at least) ``small`` is measured first and broadcast if it fits. ``heavy`` are the
    :func:`heavy_keys` of ``big`` where they are known.
    """
    on = [on] if isinstance(on, str) else on
    if row_bytes is not None:
        held = broadcast_if_small(small, row_bytes)
        if held is not small:
            return big.join(held, on, how)
    heavy = heavy_keys(big, on, most) if heavy is None else heavy
    parts = broadcast_if_small(heavy.select(*on, F.ceil(F.col("__rows") / most).cast("int").alias("__parts")), 24)
    count = F.coalesce("__parts", F.lit(1))
    # the part follows from the row, so that a task that runs again deals its rows out alike
    rest = [F.col(f"`{c}`") for c in big.columns if c not in on] or [F.lit(0)]
    dealt = big.join(parts, on, "left").withColumn("__part", F.pmod(F.xxhash64(*rest), count).cast("int")).drop("__parts")
    repeated = small.join(parts, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), count - 1))).drop("__parts")
    return dealt.join(repeated, [*on, "__part"], how).drop("__part")


def spread_rank(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row, from 0, among those of equal ``by`` in the order of the columns ``order``, none of them null.

    Rows are cut into ranges of (by, order), so a key that holds many rows lies in many tasks; the rows before a range come from
    one count per range and key. ``order`` should be total. What is ranked is written once.
    """
    ranges = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("__at", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id())
    placed = stage(ranges, "ranges")
    starts = placed.groupBy("__at", by).agg(F.min("__n").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy(by).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("__at", by, (before - F.col("__first")).alias("__shift"))
    # a range holds a key's rows in one task's share at most
    small = broadcast_if_small(starts, 40)
    return placed.join(small, ["__at", by]).withColumn(name, F.col("__n") + F.col("__shift")).drop("__at", "__n", "__shift")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or ``wanted_2`` and so on if ``df`` already has a column of that name (any case)."""
    taken = {c.lower() for c in df.columns}
    name, n = wanted, 2
    while name.lower() in taken:
        name, n = f"{wanted}_{n}", n + 1
    return name
