"""Rows stored by key, so that a few keys are read without the rest."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketframe.functions.citations import citation_key
from docketframe.operators.cases import parse_cases
from docketframe.operators.reports import named_case

# Bytes of a row group: what one key costs to read.
ROW_GROUP = 8 * 1024 * 1024


def new_store(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which driver and executors share; a local session without one gets a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='docketframe-')}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_keyed(df: DataFrame, path: str, key: str, mode: str = "errorifexists", row_group: int = ROW_GROUP) -> None:
    """Parquet in ``path/rows``, in ranges of ``key``, and ``path/manifest``: ``key, file, first_row, n_rows``.

    Ranges are cut inside a hot key too, by a hash of the other plain columns.
    Dealing out ranges samples the frame first, so it is worked out twice: give
    a stored one where that is dear. Rows without a key are kept; no key finds them.
    """
    spark = df.sparkSession
    plain = [f"`{f.name}`" for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    # Sorted inside a range, so that row groups cover few keys each.
    ranges = df.repartitionByRange(F.col(f"`{key}`"), F.xxhash64(*plain)).sortWithinPartitions(F.col(f"`{key}`"))
    ranges.write.mode(mode).option("parquet.block.size", row_group).parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    places = rows.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`"), F.col("_metadata.file_name").alias("file")).agg(
        F.min("_metadata.row_index").alias("first_row"), F.count(F.lit(1)).alias("n_rows")
    )
    # The manifest is in order of the key as well: finding a key opens few row groups of it.
    places.repartitionByRange(f"`{key}`", "file").sortWithinPartitions(f"`{key}`").write.mode(mode).parquet(f"{path}/manifest")


def read_keyed(spark: SparkSession, path: str, key: str, values: list) -> DataFrame:
    """The stored rows whose key is one of ``values``.

    The manifest names the files, and only these are opened; the condition on
    the key skips their other row groups. The names of those files come to the
    driver, no rows do.
    """
    wanted = F.col(f"`{key}`").isin(list(values))
    rows = spark.read.parquet(f"{path}/manifest").where(wanted).select("file").distinct()
    files = sorted(row.file for row in rows.collect())
    if not files:
        return spark.read.parquet(f"{path}/rows").limit(0)
    return spark.read.parquet(*[f"{path}/rows/{file}" for file in files]).where(wanted)


def write_pages(pages: DataFrame, path: str, markdown: str = "markdown", mode: str = "errorifexists") -> None:
    """Markdown pages stored by the decision their header names, in a column ``decision``.

    Headers alone are parsed. Pages without a citation have no decision and
    are kept.
    """
    header = parse_cases(pages.withColumn("_page", F.col(f"`{markdown}`")), markdown)
    named = header.select(
        *[F.col("_page").alias(c) if c == markdown else F.col(f"`{c}`") for c in pages.columns],
        F.when(F.col("citation") != "", citation_key(F.col("citation"))).alias("decision"),
    )
    write_keyed(named, path, "decision", mode)


def chosen_pages(spark: SparkSession, path: str, citations: list[str]) -> DataFrame:
    """The stored pages of the decisions that citations (or case ids) name; all others stay unread and unparsed."""
    asked = spark.createDataFrame([(c,) for c in citations], "citation string")
    keys = [row.decision for row in asked.select(citation_key(F.col("citation")).alias("decision")).collect()]
    return read_keyed(spark, path, "decision", [k for k in keys if k]).drop("decision")


def store_reports(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Reports stored by ``case_id`` (``unknown`` without one) in large files with a manifest."""
    write_keyed(reports.withColumn("case_id", named_case(F.col("case_id"))), path, "case_id", mode)


def stored_reports(spark: SparkSession, path: str, *case_ids: str) -> DataFrame:
    """The stored reports of the cases named, or all of them."""
    return read_keyed(spark, path, "case_id", list(case_ids)) if case_ids else spark.read.parquet(f"{path}/rows")
