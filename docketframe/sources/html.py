"""HTML files, one decision each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """``case_name, html`` for every HTML file under ``path``, or for the named ones.

    Names may come with or without the ``.html`` ending. UTF-8 is assumed.
    """
    files = [n.strip() if n.strip().lower().endswith(".html") else f"{n.strip()}.html" for n in names]
    source = [f"{path.rstrip('/')}/{f}" for f in files] or path
    pages = spark.read.option("pathGlobFilter", "*.[hH][tT][mM][lL]").text(source, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"(?i)\.html$", "")
    return pages.select(name.alias("case_name"), F.col("value").alias("html"))
