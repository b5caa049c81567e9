"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one, which only a local session may have."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="docketframe-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet into the shared folder and read again.

    It cuts the lineage as a checkpoint does, survives lost executors, and gives the optimizer real sizes.
    """
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


FILTER_BITS = 1 << 24


def may_match(rows: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """The rows whose ``columns`` may be those of a row of ``wanted``, so that few others are shuffled in the join that follows.

    The filter is a bitmap of 2^24 bits in at most 2^18 rows, whatever the number of wanted ones, which bounds its broadcast. The
    fuller it is the more rows pass; none of the wanted is lost.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    bits = wanted.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("_bits")
    )
    tested = rows.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(bits), "_word")
    return tested.where("shiftrightunsigned(_bits, CAST(_place & 63 AS INT)) & 1 = 1").drop("_place", "_word", "_bits")


def column_or_null(frame: DataFrame, name: str, kind: str) -> Column:
    """A column of the frame, or NULLs of the kind where it is missing."""
    return F.col(f"`{name}`") if name in frame.columns else F.lit(None).cast(kind)
