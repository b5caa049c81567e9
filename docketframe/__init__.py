"""Legal sentencing data on Spark: sentence tables, case texts, citation graph."""

from docketframe.operators.cases import (
    case_texts,
    pages_to_markdown,
    paragraph_rows,
    parse_cases,
    split_cases,
)
from docketframe.operators.citations import (
    citation_aliases,
    citation_edges,
    citation_metadata,
    join_metadata,
    latest_answers,
    related_cases,
    related_cases_by_name,
    related_items,
    relation_counts,
    relation_edges,
    relation_items,
    request_keys,
)
from docketframe.operators.legislation import (
    cited_legislation,
    legislation_links,
    legislation_lists,
    ordered_legislation,
    statute_edges,
)
from docketframe.operators.offences import code_table, first_per_section, resolve_offences
from docketframe.operators.reports import build_reports, related_lists
from docketframe.operators.sentences import (
    canonical_sentences,
    case_sentences,
    cases_with_many_sentences,
    column_report,
    parse_sentences,
    row_at,
    sentence_counts,
    sentences_as_json,
    sentences_for_case,
    total_days,
)
from docketframe.operators.tables import append_tables
from docketframe.session import build_session
from docketframe.sources.csv import append_files, header_catalogue, na_to_null, read_offences, read_sentences, read_table, write_table
from docketframe.sources.html import read_pages
from docketframe.sources.reports import read_reports, report_legislation, write_reports
from docketframe.sources.store import chosen_pages, new_store, read_keyed, store_reports, stored_reports, write_keyed, write_pages

__all__ = [name for name in dir() if not name.startswith("_")]
