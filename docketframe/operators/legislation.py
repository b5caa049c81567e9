"""Statutes cited in the paragraphs of decisions. All of the jobs are narrow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketframe.functions.citations import citation_key
from docketframe.functions.legislation import legislation_entries, statute_name, statute_section, statute_urls


def legislation_links(cases: DataFrame, key: str = "doc_id", paragraphs: str = "paragraphs") -> DataFrame:
    """One row per statute link: ``key, para_no, link_pos, name, section``. Narrow."""
    # The outer form: for the inner one the optimizer adds a filter on the
    # array's size, which would work the paragraphs out a second time.
    para = cases.select(key, F.posexplode_outer(paragraphs).alias("p", "text"))
    links = para.select(
        key,
        (F.col("p") + 1).alias("para_no"),
        F.posexplode(statute_urls(F.col("text"))).alias("link_pos", "url"),
    )
    return links.select(
        key,
        "para_no",
        "link_pos",
        statute_name(F.col("url")).alias("name"),
        statute_section(F.col("url")).alias("section"),
    )


def legislation_lists(cases: DataFrame, key: str = "doc_id", paragraphs: str = "paragraphs") -> DataFrame:
    """``key, cited_legislation``: one array per row, in order of first appearance, empty where nothing is cited."""
    entries = legislation_entries(F.col(paragraphs))
    return cases.select(key, F.coalesce(entries, F.array()).alias("cited_legislation"))


def ordered_legislation(cases: DataFrame, key: str = "doc_id", paragraphs: str = "paragraphs") -> DataFrame:
    """``key, rank, name, section, para_nos``: the entries of each row with their rank by first appearance, from 1.

    A citation of a statute as a whole (NULL section) does not count in a paragraph that also cites one of its
    sections. Nothing is shuffled; rows that share a key keep lists of their own.
    """
    # The outer form, as in ``legislation_links``.
    rows = cases.select(key, F.posexplode_outer(legislation_entries(F.col(paragraphs))).alias("pos", "entry"))
    found = rows.where(F.col("entry").isNotNull())
    return found.select(key, (F.col("pos") + 1).alias("rank"), "entry.name", "entry.section", "entry.para_nos")


def cited_legislation(cases: DataFrame, key: str = "doc_id", paragraphs: str = "paragraphs") -> DataFrame:
    """``key, name, section, para_nos``: ``ordered_legislation`` without the rank."""
    return ordered_legislation(cases, key, paragraphs).drop("rank")


def statute_edges(cases: DataFrame, citation: str = "citation", paragraphs: str = "paragraphs") -> DataFrame:
    """Decisions and the sections they cite, each edge once: ``citing, name, section, n_paragraphs``.

    Cases without a citation have no place in the graph; several texts of one decision add their paragraphs up.
    """
    named = cases.select(citation_key(F.col(citation)).alias("citing"), paragraphs).where(F.col("citing").isNotNull())
    found = cited_legislation(named, "citing", paragraphs)
    return found.groupBy("citing", "name", "section").agg(F.sum(F.size("para_nos")).alias("n_paragraphs"))
