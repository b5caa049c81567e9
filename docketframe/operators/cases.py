"""Jobs over tables of court decisions in Markdown. All of them are narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketframe.functions import cases as C
from docketframe.functions.html import markdown_of
from docketframe.functions.text import evaluate_once, let, strip


def pages_to_markdown(df: DataFrame, html: str = "html", output: str = "markdown") -> DataFrame:
    """Replace the HTML column by its Markdown."""
    return df.withColumn(output, markdown_of(F.col(html))).drop(html)


def split_cases(df: DataFrame, markdown: str = "markdown", separator: str = C.CHUNK_SEPARATOR) -> DataFrame:
    """Replace the Markdown by ``header, body, section_heading, header_found``.

    Texts with fewer than four non-blank chunks (or an empty separator) have no
    header and are all body. With four or more chunks the body starts at the
    fifth, whether or not a header chunk was found.
    """
    keep = [c for c in df.columns if c != markdown]
    text = F.col(f"`{markdown}`")
    if not separator:
        return df.select(
            *keep,
            F.lit("").alias("header"),
            strip(text).alias("body"),
            F.lit("").alias("section_heading"),
            F.lit(False).alias("header_found"),
        )
    def parts(chunks: Column) -> Column:
        enough = F.size(chunks) >= C.MIN_CHUNKS
        rest = F.slice(chunks, C.MIN_CHUNKS + 1, F.greatest(F.size(chunks) - C.MIN_CHUNKS, F.lit(0)))
        return F.struct(
            F.when(enough, C.heading_split(C.clean_header(C.header_chunk(chunks)))).alias("top"),
            F.when(enough, F.array_join(rest, separator)).alias("body"),
        )

    split = evaluate_once(df, __parts=let(C.chunks(text, separator), parts), __text=text)
    return split.select(
        *keep,
        F.coalesce("__parts.top.header", F.lit("")).alias("header"),
        F.coalesce(F.col("__parts.body"), strip(F.col("__text"))).alias("body"),
        F.coalesce("__parts.top.heading", F.lit("")).alias("section_heading"),
        F.col("__parts.top.header").isNotNull().alias("header_found"),
    )


def parse_cases(df: DataFrame, markdown: str = "markdown", separator: str = C.CHUNK_SEPARATOR) -> DataFrame:
    """Markdown to ``header`` (cleaned), ``section_heading``, ``citation``, ``paragraphs``."""
    parts = split_cases(df, markdown, separator)
    keep = [c for c in df.columns if c != markdown]
    return parts.withColumn("header", C.clean_text(F.col("header"))).select(
        *keep,
        "header",
        "section_heading",
        C.extract_citation(F.col("header")).alias("citation"),
        C.body_paragraphs(F.col("body"), F.col("section_heading")).alias("paragraphs"),
    )


def paragraph_rows(cases: DataFrame, *keys: str) -> DataFrame:
    """One row per paragraph, numbered from 1."""
    # The outer form keeps the optimizer from testing the array's size first,
    # which would work it out twice; it adds one empty row to empty arrays.
    rows = cases.select(*keys, F.posexplode_outer("paragraphs").alias("pos", "text"))
    return rows.where(F.col("text").isNotNull()).select(*keys, (F.col("pos") + 1).alias("para_no"), "text")


def case_texts(cases: DataFrame, metadata: DataFrame, include_header: bool = False) -> DataFrame:
    """Header (on request), paragraphs and metadata of every parsed case.

    Cases without known metadata stay, with NULL metadata.
    """
    from docketframe.operators.citations import join_metadata

    joined = join_metadata(cases, metadata, F.col("citation"), how="left")
    header = F.col("header") if include_header else F.lit(None).cast("string")
    return joined.withColumn("header", header)
