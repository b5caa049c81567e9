"""How a wide table meets a lookup side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest lookup side, in bytes of row data, that is copied to every executor.
BROADCAST_LIMIT = 64 * 1024 * 1024
# Allowance per row for the hash table entry and the row header.
ROW_OVERHEAD = 64


def data_bytes(df: DataFrame) -> int:
    """Measured size of a frame: one aggregation over its columns."""
    size = F.lit(ROW_OVERHEAD)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            raise TypeError(f"cannot bound the size of nested column {field.name}")
    return df.agg(F.sum(size.cast("bigint"))).first()[0] or 0


def broadcast_if_bounded(
    df: DataFrame, measured: DataFrame | None = None, copies: int = 1, limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Mark ``df`` for broadcast only when its measured size stays under the limit.

    ``measured`` may be a cheaper frame that bounds ``df``: ``df`` holds at most
    ``copies`` rows for each of its rows. Beyond the limit the frame is returned
    as it is, the join shuffles on its key, and adaptive execution splits the
    partitions of hot keys.
    """
    if limit <= 0:
        return df
    size = data_bytes(df if measured is None else measured) * copies
    return F.broadcast(df) if size <= limit else df


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join to a side with one row per key, which is the outcome of an aggregation on it.

    Adaptive execution splits a hot key only where both inputs of the join are
    fresh shuffles, and an aggregation on the key would be joined as it lies.
    The hash of the key as a second join column asks for that shuffle; the
    unique side is the small price for a left side that may be hot.

    Rows without a key meet nothing: an inner join drops them before the shuffle,
    a left join deals them out by a hash of their other plain columns.
    """
    spread = F.xxhash64(key)
    dealt = spread
    if how == "left":
        plain = [f"`{f.name}`" for f in left.schema.fields if f.name != key and isinstance(f.dataType, T.AtomicType)]
        dealt = F.when(F.col(key).isNull(), F.xxhash64(*plain)).otherwise(spread) if plain else spread
    keys = ["__spread", key]
    return left.withColumn("__spread", dealt).join(right.withColumn("__spread", spread), keys, how).drop("__spread")


def join_unique_by(left: DataFrame, right: DataFrame, value: Column, key: str) -> DataFrame:
    """Left join to a side with one row per ``key``, which the left side's rows name by ``value``.

    As ``join_unique``, but what the rows are dealt by is worked out on both ends of the shuffle and never written: a wide
    left side is shuffled with its own columns only.
    """
    plain = [f"`{f.name}`" for f in left.schema.fields if isinstance(f.dataType, T.AtomicType)]
    dealt = F.when(value.isNull(), F.xxhash64(*plain)).otherwise(F.xxhash64(value))
    right = right.withColumnRenamed(key, "__named")
    return left.join(right, (dealt == F.xxhash64("__named")) & (value == F.col("__named")), "left").drop("__named")
