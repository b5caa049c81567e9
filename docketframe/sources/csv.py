"""CSV tables as they are found in practice: ragged rows, missing-value tokens."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketframe.functions.sentences import SENTENCE_COLUMNS
from docketframe.functions.text import strip
from docketframe.operators.joins import BROADCAST_LIMIT, ROW_OVERHEAD
from docketframe.operators.tables import append_tables
from docketframe.sources.quoted import split_records

# Cell texts read as a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
RAW = "_raw_line"


def na_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing-value tokens become NULL; other cells stay as they are."""
    columns = columns or df.columns
    return df.select(
        *[
            F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def _reader(spark: SparkSession, multi_line: bool):
    return (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("multiLine", multi_line)
        .option("inferSchema", False)
    )


def _fields(line: Column) -> Column:
    """Number of fields in a raw line; separators inside quotes, closed or not, do not count."""
    bare = F.regexp_replace(line, '"[^"]*("|$)', "")
    return F.length(bare) - F.length(F.translate(bare, ",", "")) + 1


def header_catalogue(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, header`` of every file under the paths, in one job: the first line that is not blank.

    The lines are read once, unparsed, and reduced to one per file before the
    shuffle. A file without text has no row.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    first = F.min_by("value", F.struct("block", "row")).alias("header")
    return lines.where(strip(F.col("value")) != "").groupBy("file").agg(first)


def read_table(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str] | None = None,
    with_order: bool = False,
    multi_line: bool | str = False,
    file_number: int = 0,
    strict_quotes: bool = True,
) -> DataFrame:
    """CSV files, or directories of them, with the same header, all text.

    A file whose header differs from the first one's is an error. Rows with too many fields are skipped, rows with too few are filled with
    NULL, blank lines are skipped. Column names come from the header unless
    given. ``with_order`` adds ``ord``, the position of the row: a comparable
    struct that needs no sort and no shuffle to make.

    Files are split, so a line break inside quotes needs ``multi_line``: ``True``
    reads a file in one task, ``"split"`` in as many as it has splits, for one
    shuffle of its lines (``split_records``). Meeting one without it is an error, or with
    ``strict_quotes=False`` that line is skipped. A line that has too many
    fields even before its open quote is skipped like other broken rows.
    """
    columns = columns or _reader(spark, bool(multi_line)).csv(path).columns
    if multi_line == "split":
        return _read_split(spark, path, columns, with_order, file_number)
    schema = ", ".join(f"`{c}` string" for c in [*columns, RAW])
    lines = (
        _reader(spark, multi_line)
        .schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RAW)
        # A pruned parser sees only the asked-for fields and cannot tell a ragged row.
        .option("columnPruning", False)
        # Columns are taken by place, so every header must name them in this order.
        .option("enforceSchema", False)
        .csv(path)
    )
    if with_order:
        lines = lines.withColumn(
            "ord",
            F.struct(
                F.lit(file_number).alias("file"),
                F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ),
        )
    raw, first = F.col(RAW), F.col(f"`{columns[0]}`")
    blank = (strip(raw) == "") & (F.coalesce(strip(first), F.lit("")) == "")
    cut_off = (F.length(raw) - F.length(F.translate(raw, '"', ""))) % 2 == 1
    fits = _fields(raw) <= len(columns)
    if not multi_line:
        broken = F.raise_error(F.lit("line break inside quotes: read this table with multi_line=True")) if strict_quotes else F.lit(False)
        fits = F.when(fits & cut_off, broken.cast("boolean")).otherwise(fits)
    keep = raw.isNull() | (~blank & fits)
    return lines.where(keep).drop(RAW)


def _read_split(spark: SparkSession, path: str | list[str], columns: list[str], with_order: bool, file_number: int) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in [*columns, RAW])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW, "columnPruning": "false"}
    records = split_records(spark, path).where(_fields(F.col("record")) <= len(columns))
    place = F.struct(F.lit(file_number).alias("file"), F.col("file").alias("path"), "block", F.col("nth").alias("row"))
    parsed = records.select(F.from_csv("record", schema, options).alias("cells"), place.alias("ord"))
    return parsed.select(*[F.col(f"cells.`{c}`") for c in columns], *(["ord"] if with_order else []))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; NULL and empty cells are both written empty."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def _places(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """Every file under the paths, with the place of the first path that leads to it. Files are listed, not read."""
    places: dict[str, int] = {}
    with ThreadPoolExecutor(16) as pool:
        for number, files in enumerate(pool.map(lambda path: spark.read.text(path).inputFiles(), paths)):
            for file in files:
                # A row tells its local file with one slash.
                places.setdefault(re.sub("^file:/+", "file:/", file), number)
    return places


def _numbered(spark: SparkSession, table: DataFrame, places: dict[str, int]) -> DataFrame:
    """``ord.file`` filled in: the place in the list of paths that a row's file has."""
    numbers = sorted(set(places.values()))
    if len(numbers) == 1:
        return table.withColumn("ord", F.col("ord").withField("file", F.lit(numbers[0])))
    lookup = spark.createDataFrame(list(places.items()), "_path string, _place int")
    if sum(len(file.encode()) + ROW_OVERHEAD for file in places) <= BROADCAST_LIMIT:
        lookup = F.broadcast(lookup)
    found = table.join(lookup, F.col("ord.path") == F.col("_path"))
    return found.withColumn("ord", F.col("ord").withField("file", F.col("_place"))).drop("_path", "_place")


def append_files(
    spark: SparkSession, paths: list[str], with_order: bool = False, multi_line: bool | str = False
) -> DataFrame:
    """Rows of several tables, columns matched by name, absent ones NULL.

    The headers of all files are read in one job, and files with the same
    header in one scan: as many scans as there are headers, however many files.
    Files of a directory may differ in their headers. A header whose quotes go
    over its line is read with its own file. Columns come in the order in which
    the files bring them; the order of rows is in ``ord`` alone. A file that
    several paths lead to is read once; files without text give no column and
    no row.
    """
    if not paths:
        raise ValueError("no tables to append")
    places = _places(spark, paths)
    headers = {}
    if len(places) > 1:
        headers = {row.file: row.header for row in header_catalogue(spark, paths).collect()}
    groups: dict[str, list[str]] = {}
    for file in sorted(headers, key=lambda f: (places[f], f)):
        header = headers[file]
        groups.setdefault(header if header.count('"') % 2 == 0 else file, []).append(file)
    tables = []
    for files in groups.values() or [list(places)]:
        listed = [unquote(file) for file in files]
        columns = _reader(spark, bool(multi_line)).csv(listed[0]).columns
        if not columns:
            continue
        table = read_table(spark, listed, columns, with_order, multi_line)
        if with_order:
            table = _numbered(spark, table, {file: places[file] for file in files})
        tables.append(na_to_null(table, columns))
    return append_tables(tables) if tables else spark.createDataFrame([], "struct<>")


def read_sentences(spark: SparkSession, *paths: str, with_order: bool = False, multi_line: bool | str = False) -> DataFrame:
    """A sentence table; ``ord`` on request for access by position."""
    return append_files(spark, list(paths), with_order, multi_line)


def read_offences(spark: SparkSession, *paths: str, multi_line: bool | str = False) -> DataFrame:
    """The offence table with ``ord``, so that the first of repeated sections can be told."""
    return append_files(spark, list(paths), with_order=True, multi_line=multi_line)


__all__ = ["NA_TOKENS", "SENTENCE_COLUMNS", "append_files", "header_catalogue", "na_to_null", "read_offences", "read_sentences", "read_table", "write_table"]
