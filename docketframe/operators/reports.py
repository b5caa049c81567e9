"""One nested report per case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketframe.functions.cases import report_header
from docketframe.functions.citations import citation_key
from docketframe.functions.legislation import legislation_entries
from docketframe.operators.citations import keyed_metadata, latest_answers, related_cases, relation_items
from docketframe.operators.joins import join_unique


def named_case(case_id: Column) -> Column:
    """The id a report is stored under; ``unknown`` for none and for an empty one."""
    return F.coalesce(F.nullif(case_id, F.lit("")), F.lit("unknown"))


def related_lists(responses: DataFrame, metadata: DataFrame, order: str = "request_id") -> DataFrame:
    """``decision, cited_cases_metadata, citing_cases_metadata`` per case that has answers.

    An array is bounded by the body of one answer.
    """
    answers = relation_items(latest_answers(responses, order)).select(
        F.col("decision").alias("decision_asked"), "caseref_type", "items"
    )
    rows = related_cases(answers, metadata, "decision_asked", "caseref_type")

    def listed(relation: str):
        entry = F.when(F.col("caseref_type") == relation, F.struct("pos", "citation", "metadata"))
        # Sorted by position alone: metadata holds arrays but no maps or variants.
        return F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("pos"))

    return rows.groupBy(F.col("decision_asked").alias("decision")).agg(
        listed("citedCases").alias("cited_cases_metadata"),
        listed("citingCases").alias("citing_cases_metadata"),
    )


def build_reports(
    cases: DataFrame, metadata: DataFrame, responses: DataFrame, key: str = "doc_id", order: str = "request_id"
) -> DataFrame:
    """Parsed cases, citation metadata and landed answers to
    ``key, case_id, citation, metadata, references, header, body_paragraphs``.

    Cases without a citation, or with one no metadata is known for, give no report; one whose metadata has no uid has the
    case id ``unknown``. Each case is read and parsed once, its legislation is found in its row, and it is shuffled once,
    to meet metadata and related cases on its decision.
    """
    read = cases.where(F.col("citation") != "").select(
        key,
        "citation",
        citation_key(F.col("citation")).alias("decision"),
        report_header(F.col("header")).alias("header"),
        F.col("paragraphs").alias("body_paragraphs"),
        legislation_entries(F.col("paragraphs")).alias("cited_legislation"),
    )
    # Both sides of this join are grouped by decision already.
    known = keyed_metadata(metadata).join(related_lists(responses, metadata, order), "decision", "left")

    def or_empty(column: str):
        return F.coalesce(F.col(column), F.array()).alias(column)

    return join_unique(read, known, "decision").select(
        key,
        named_case(F.col("metadata.case_id")).alias("case_id"),
        "citation",
        "metadata",
        F.struct(or_empty("cited_cases_metadata"), or_empty("citing_cases_metadata"), or_empty("cited_legislation")).alias("references"),
        "header",
        "body_paragraphs",
    )
