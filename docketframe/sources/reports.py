"""Case reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketframe.operators.citations import METADATA_LIST_FIELDS, METADATA_TEXT_FIELDS
from docketframe.operators.legislation import ordered_legislation
from docketframe.operators.reports import named_case

_METADATA = "struct<{}>".format(
    ",".join(
        [f"{f}:string" for f in ["citation", "case_id", *METADATA_TEXT_FIELDS]]
        + [f"{f}:array<string>" for f in METADATA_LIST_FIELDS]
    )
)
_RELATED = f"array<struct<citation:string,metadata:{_METADATA}>>"
REPORT_SCHEMA = (
    f"citation string, metadata {_METADATA}, references struct<"
    f"cited_cases_metadata:{_RELATED},citing_cases_metadata:{_RELATED},"
    "cited_legislation:array<struct<name:string,section:string,para_nos:array<int>>>>, "
    "header string, body_paragraphs array<string>"
)
REPORT_FIELDS = ["citation", "metadata", "references", "header", "body_paragraphs"]


def write_reports(reports: DataFrame, path: str, per_case: bool = False, mode: str = "errorifexists") -> None:
    """Reports as JSON documents.

    Large files of one document per line, ``case_id`` (``unknown`` without one)
    included. ``per_case`` puts each report in a folder named by its case
    (``case_id=2024abcj264/``) instead, for a corpus whose cases a person
    browses; a folder per case does not suit millions of them.
    """
    fields = [F.col(f) for f in REPORT_FIELDS]
    case = named_case(F.col("case_id")).alias("case_id")
    writer = reports.select(case, *fields).write.mode(mode).option("ignoreNullFields", False)
    (writer.partitionBy("case_id") if per_case else writer).json(path)


def read_reports(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Stored reports; ``multi_line`` for documents spread over several lines.

    Missing paragraphs become an empty list. A report whose paragraphs are
    anything but a list is an error.
    """
    raw = "_unreadable"
    stored = (
        spark.read.schema(f"case_id string, {REPORT_SCHEMA}, {raw} string")
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", raw)
        .json(path)
    )
    bad = F.raise_error(F.lit("invalid report: not a JSON document, or its paragraphs are not a list"))
    paragraphs = F.when(F.col(raw).isNotNull() & F.col("body_paragraphs").isNull(), bad.cast("array<string>")).otherwise(
        F.coalesce("body_paragraphs", F.array().cast("array<string>"))
    )
    return stored.withColumn("body_paragraphs", paragraphs).drop(raw)


def report_legislation(reports: DataFrame, key: str = "case_id") -> DataFrame:
    """Cited legislation found again in the paragraphs of stored reports, each report for itself."""
    return ordered_legislation(reports, key, "body_paragraphs")
