"""Column functions for citations and relation items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketframe.functions.text import text_or_null

# Fixed values.
CITATION_LABEL = " (CanLII)"
NEUTRAL_CITATION_PATTERN = "[0-9]{4} [A-Za-z]+ [0-9]+"


def formatted_citation(style_of_cause: Column, atomic_citation: Column, original: Column) -> Column:
    """``style, atomic (CanLII)`` from what is known, else the citation as given."""
    style = F.nullif(style_of_cause, F.lit(""))
    atomic = F.nullif(atomic_citation, F.lit(""))
    known = F.nullif(F.concat_ws(", ", style, atomic), F.lit(""))
    return F.coalesce(F.concat(known, F.lit(CITATION_LABEL)), original)


def decision_code(uid: Column) -> Column:
    """Key of a decision: its uid in lower case without hyphens."""
    return F.replace(F.lower(uid), F.lit("-"), F.lit(""))


def citation_key(citation: Column) -> Column:
    """Decision key held in a free citation: its neutral citation, else the text itself."""
    neutral = F.regexp_extract(citation, NEUTRAL_CITATION_PATTERN, 0)
    text = F.coalesce(F.nullif(neutral, F.lit("")), text_or_null(citation))
    return decision_code(F.replace(text, F.lit(" "), F.lit("")))


def title_key(title: Column) -> Column:
    """Key of a case title: lower case, one space for each run of white space; it never equals a citation's key, which has none."""
    return F.concat(F.lit("title: "), F.lower(F.regexp_replace(text_or_null(title), "\\s+", " ")))


def text_field(item: Column, key: str) -> Column:
    """A JSON field of a relation item, kept only when it is a non-blank string."""
    value = F.try_variant_get(item, f"$.{key}", "variant")
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(is_text, text_or_null(F.try_variant_get(value, "$", "string")))


def item_citation(item: Column) -> Column:
    """Citation of a related case: ``title, citation``, else the first usable field."""
    title, citation = text_field(item, "title"), text_field(item, "citation")
    return F.coalesce(
        F.concat(title, F.lit(", "), citation),
        citation,
        text_field(item, "caseId"),
        text_field(item, "case_id"),
        title,
    )
