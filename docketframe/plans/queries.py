"""One query per operator over the driver's tables, flattened to scalar columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import docketframe as df_
from docketframe.functions import cases as C
from docketframe.functions import citations as Q
from docketframe.functions import sentences as S
from docketframe.functions.offences import offence_variants
from docketframe.functions.text import text_after, text_before
from docketframe.plans import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SENTENCE_KEYS = ["l_orderkey", "l_linenumber"]
SEP = " | "
CASE = "2024ord77"
ROW_INDEX = 1234
CHOSEN = [f"R v D{n}, 2024 ABCJ {n}" for n in range(1, 60)]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(array: str | Column, part: Callable[[Column], Column] | None = None, sep: str = SEP) -> Column:
    """Array to text, for comparing."""
    array = F.col(array) if isinstance(array, str) else array
    return F.array_join(F.transform(array, part) if part else array, sep)


def components_text(array: str) -> Column:
    return joined(
        array,
        lambda c: F.concat(F.floor(c["quantity"] * 10).cast("bigint").cast("string"), F.lit("/10"), c["unit"]),
    )


def sentence_fields(prefix: str = "") -> list[Column]:
    """Scalar columns of a parsed sentence."""
    c = lambda name: F.col(f"{prefix}{name}")
    return [
        c("uid.case_id").alias("case_id"), c("uid.docket").alias("docket"),
        c("uid.count").alias("count_no"), c("uid.defendant").alias("defendant"),
        c("offence.offence_code").alias("offence_code"), c("offence.offence_name").alias("offence_name"),
        c("date.offence_date").alias("offence_date"), c("date.offence_start_date").alias("offence_start_date"),
        c("date.offence_end_date").alias("offence_end_date"),
        components_text(f"{prefix}jail.components").alias("jail_components"),
        c("jail.total_days").alias("total_days"), c("jail.is_indeterminate").alias("is_indeterminate"),
        c("jail.is_unrecognized").alias("is_unrecognized"),
        c("mode.jail_type").alias("jail_type"), c("mode.sentence_mode").alias("sentence_mode"),
        c("conditions.time").alias("cond_time"), c("conditions.unit").alias("cond_unit"),
        c("conditions.unit_display").alias("unit_display"), c("conditions.type").alias("cond_type"),
        c("conditions.type_display").alias("type_display"),
        c("fine").alias("fine"),
        c("appeal.court").alias("appeal_court"), c("appeal.result").alias("appeal_result"),
    ]


# sentence tables ---------------------------------------------------------

@query
def parse_sentences(spark, sf):
    parsed = df_.parse_sentences(fx.sentences(spark, sf), fx.offences(spark, sf), keep=SENTENCE_KEYS)
    return parsed.select(*SENTENCE_KEYS, *sentence_fields())


@query
def sentence_json(spark, sf):
    parsed = df_.parse_sentences(fx.sentences(spark, sf), fx.offences(spark, sf), keep=SENTENCE_KEYS)
    return df_.sentences_as_json(parsed, keep=SENTENCE_KEYS)


def _one_column(spark, sf, column: str, parsed: Column, *fields: str) -> DataFrame:
    rows = fx.sentences(spark, sf).select(*SENTENCE_KEYS, column, parsed.alias("p"))
    return rows.select(*SENTENCE_KEYS, column, *[F.col(f"p.{f}").alias(f) for f in fields])


@query
def uid_parts(spark, sf):
    rows = fx.sentences(spark, sf).select(*SENTENCE_KEYS, "uid", S.uid_parts(F.col("uid")).alias("p"))
    return rows.select(*SENTENCE_KEYS, "uid", "p.case_id", "p.docket", F.col("p.count").alias("count_no"), "p.defendant")


@query
def date_parts(spark, sf):
    return _one_column(
        spark, sf, "date", S.date_parts(F.col("date")), "offence_date", "offence_start_date", "offence_end_date"
    )


@query
def jail_components(spark, sf):
    rows = fx.sentences(spark, sf).select(*SENTENCE_KEYS, "jail", S.jail_components(F.col("jail")).alias("c"))
    return rows.select(
        *SENTENCE_KEYS, "jail", F.size("c").cast("bigint").alias("n_components"), components_text("c").alias("components")
    )


@query
def jail_total_days(spark, sf):
    return _one_column(
        spark, sf, "jail", S.jail_summary(F.col("jail")), "total_days", "is_indeterminate", "is_unrecognized"
    )


@query
def mode_parts(spark, sf):
    return _one_column(spark, sf, "mode", S.mode_parts(F.col("mode")), "jail_type", "sentence_mode")


@query
def conditions_parts(spark, sf):
    return _one_column(spark, sf, "conditions", S.conditions_parts(F.col("conditions")), "time", "unit", "type")


@query
def conditions_display(spark, sf):
    return _one_column(
        spark, sf, "conditions", S.conditions_parts(F.col("conditions")), "unit_display", "type_display"
    )


@query
def fine_format(spark, sf):
    return fx.sentences(spark, sf).select(
        *SENTENCE_KEYS, F.col("fine").alias("fine_text"), S.fine_amount(F.col("fine")).alias("fine")
    )


@query
def appeal_parts(spark, sf):
    return _one_column(spark, sf, "appeal", S.appeal_parts(F.col("appeal")), "court", "result")


@query
def na_tokens(spark, sf):
    rows = fx.sentences(spark, sf).select(*SENTENCE_KEYS, *S.SENTENCE_COLUMNS)
    return df_.na_to_null(rows, S.SENTENCE_COLUMNS)


@query
def canonical_projection(spark, sf):
    rows = fx.sentences(spark, sf).drop("fine", "appeal")
    return df_.canonical_sentences(rows, keep=SENTENCE_KEYS)


@query
def schema_diff(spark, sf):
    return df_.column_report(fx.sentences(spark, sf).drop("fine", "appeal"))


@query
def row_at(spark, sf):
    rows = fx.sentences(spark, sf).select(*SENTENCE_KEYS, *S.SENTENCE_COLUMNS)
    return df_.row_at(rows, ROW_INDEX, [*SENTENCE_KEYS, *S.SENTENCE_COLUMNS])


@query
def sentences_for_case(spark, sf):
    rows = df_.sentences_for_case(fx.sentences(spark, sf), CASE)
    return rows.select(*SENTENCE_KEYS, *S.SENTENCE_COLUMNS)


@query
def cases_with_many_counts(spark, sf):
    return df_.cases_with_many_sentences(fx.sentences(spark, sf))


@query
def case_sentences(spark, sf):
    rows = df_.case_sentences(fx.sentences(spark, sf), fx.offences(spark, sf))
    return rows.select(F.col("key").alias("sentence_uid"), *sentence_fields())


@query
def append_tables(spark, sf):
    return df_.append_tables([fx.sentences(spark, sf), fx.citations(spark, sf)])


# offences ----------------------------------------------------------------

@query
def first_per_section(spark, sf):
    return df_.first_per_section(fx.offences(spark, sf))


@query
def offence_variants_(spark, sf):
    rows = fx.sentences(spark, sf)
    return rows.select(*SENTENCE_KEYS, "offence", joined(offence_variants(F.col("offence"))).alias("variants"))


@query
def offence_lookup(spark, sf):
    rows = fx.sentences(spark, sf).select(*SENTENCE_KEYS, "offence")
    found = df_.resolve_offences(rows, fx.offences(spark, sf), output="found")
    return found.select(*SENTENCE_KEYS, "offence", "found.offence_code", "found.offence_name")


@query
def offence_lookup_plain_variants(spark, sf):
    rows = fx.sentences(spark, sf).select(*SENTENCE_KEYS, "offence")
    found = df_.resolve_offences(rows, fx.offences(spark, sf), output="found", match_plain_variants=True)
    return found.select(*SENTENCE_KEYS, "offence", "found.offence_code", "found.offence_name")


# case texts --------------------------------------------------------------

@query
def pages_markdown(spark, sf):
    return df_.pages_to_markdown(fx.load(spark, sf, "pages")).select("page_id", "markdown")


@query
def case_split(spark, sf):
    return df_.split_cases(fx.case_markdown(spark, sf))


@query
def case_citation(spark, sf):
    return df_.parse_cases(fx.case_markdown(spark, sf)).select("doc_id", "citation")


@query
def case_paragraphs(spark, sf):
    return df_.paragraph_rows(df_.parse_cases(fx.case_markdown(spark, sf)), "doc_id")


@query
def clean_text(spark, sf):
    return fx.case_markdown(spark, sf).select("doc_id", C.clean_text(F.col("markdown")).alias("clean"))


@query
def text_before_(spark, sf):
    return fx.case_markdown(spark, sf).select(
        "doc_id", text_before(F.col("markdown"), C.BODY_END_MARKER).alias("kept")
    )


@query
def text_after_(spark, sf):
    return fx.case_markdown(spark, sf).select(
        "doc_id", text_after(F.col("markdown"), C.HEADER_NOISE_MARKER).alias("kept")
    )


@query
def report_header(spark, sf):
    cases = df_.parse_cases(fx.case_markdown(spark, sf))
    return cases.select("doc_id", C.report_header(F.col("header")).alias("header"))


@query
def case_summary(spark, sf):
    cases = df_.parse_cases(fx.case_markdown(spark, sf))
    texts = df_.case_texts(cases, df_.citation_metadata(fx.citations(spark, sf)), include_header=True)
    return texts.select(
        "doc_id",
        "header",
        joined("paragraphs").alias("body"),
        F.col("metadata.citation").alias("citation"),
        F.col("metadata.court").alias("court"),
    )


# legislation -------------------------------------------------------------

def _numbers(array: str) -> Column:
    return joined(array, lambda n: n.cast("string"), ",")


@query
def legislation_links(spark, sf):
    links = df_.legislation_links(df_.parse_cases(fx.case_markdown(spark, sf)))
    return links.select("doc_id", "para_no", "name", "section")


@query
def cited_legislation(spark, sf):
    found = df_.cited_legislation(df_.parse_cases(fx.case_markdown(spark, sf)))
    return found.select("doc_id", "name", "section", _numbers("para_nos").alias("para_nos"))


@query
def legislation_ordered(spark, sf):
    found = df_.ordered_legislation(df_.parse_cases(fx.case_markdown(spark, sf)))
    return found.select(
        "doc_id", F.col("rank").cast("bigint").alias("rank"), "name", "section", _numbers("para_nos").alias("para_nos")
    )


# citations and relations -------------------------------------------------

@query
def citation_metadata(spark, sf):
    metadata = df_.citation_metadata(fx.citations(spark, sf))
    lists = [joined(f).alias(f) for f in ("keywords", "categories")]
    return metadata.select(*[c for c in metadata.columns if c not in ("keywords", "categories")], *lists)


@query
def citation_format(spark, sf):
    return fx.citations(spark, sf).select(
        "case_key",
        Q.formatted_citation(F.col("style_of_cause"), F.col("atomic_citation"), F.col("raw_citation")).alias("citation"),
    )


@query
def relation_status(spark, sf):
    return df_.relation_counts(fx.relation_responses(spark, sf))


@query
def relation_items(spark, sf):
    rows = df_.relation_items(fx.relation_responses(spark, sf)).select("request_id", F.posexplode("items").alias("pos", "i"))
    return rows.select(
        "request_id", (F.col("pos") + 1).cast("bigint").alias("pos"),
        *[Q.text_field(F.col("i"), k).alias(k) for k in ("title", "citation", "caseId")],
    )


@query
def relation_counts(spark, sf):
    counts = df_.relation_counts(df_.latest_answers(fx.relation_responses(spark, sf)))
    return counts.select("decision", "caseref_type", "status", "error", "n_items")


@query
def relation_edges(spark, sf):
    edges = df_.relation_edges(fx.citations(spark, sf), fx.relation_responses(spark, sf))
    return edges.select(
        "case_key", "court_key", "decision", "caseref_type", "error", F.size("items").cast("bigint").alias("n_items")
    )


@query
def related_citation(spark, sf):
    answers = df_.relation_items(fx.relation_responses(spark, sf))
    return df_.related_items(answers, "request_id").select(
        "request_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "citation"
    )


@query
def related_cases(spark, sf):
    answers = df_.relation_items(fx.relation_responses(spark, sf))
    related = df_.related_cases(answers, df_.citation_metadata(fx.citations(spark, sf)), "request_id")
    return related.select(
        "request_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "citation",
        F.col("metadata.citation").alias("metadata_citation"), F.col("metadata.case_id").alias("case_id"),
    )


@query
def related_cases_by_name(spark, sf):
    answers = df_.relation_items(fx.named_responses(spark, sf))
    related = df_.related_cases_by_name(answers, df_.citation_metadata(fx.citations(spark, sf)), "request_id")
    return related.select(
        "request_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "citation",
        F.col("metadata.citation").alias("metadata_citation"), F.col("metadata.case_id").alias("case_id"),
    )


@query
def citation_edges(spark, sf):
    cases = df_.citation_edges(fx.relation_responses(spark, sf)).withColumnRenamed("cited", "name")
    statutes = df_.statute_edges(df_.parse_cases(fx.case_markdown(spark, sf)))
    return cases.withColumn("kind", F.lit("case")).unionByName(statutes.withColumn("kind", F.lit("statute")), allowMissingColumns=True)


def report_rows(spark: SparkSession, sf: str, cases: DataFrame) -> DataFrame:
    reports = df_.build_reports(cases, df_.citation_metadata(fx.citations(spark, sf)), fx.relation_responses(spark, sf))

    def related(column: str) -> Column:
        return joined(f"references.{column}", lambda e: F.concat(e["citation"], F.lit("="), e["metadata"]["case_id"]))

    legislation = joined(
        "references.cited_legislation",
        lambda e: F.concat(
            e["name"], F.lit("#"), F.coalesce(e["section"], F.lit("-")), F.lit("@"),
            F.array_join(F.transform(e["para_nos"], lambda n: n.cast("string")), ","),
        ),
    )
    return reports.select(
        "doc_id", "case_id", "citation", F.col("metadata.citation").alias("metadata_citation"),
        related("cited_cases_metadata").alias("cited"), related("citing_cases_metadata").alias("citing"),
        legislation.alias("legislation"), "header", joined("body_paragraphs").alias("body"),
    )


@query
def case_report(spark, sf):
    return report_rows(spark, sf, df_.parse_cases(fx.case_markdown(spark, sf)))


@query
def page_report(spark, sf):
    return report_rows(spark, sf, df_.parse_cases(df_.pages_to_markdown(fx.case_html(spark, sf))))


@query
def chosen_case_report(spark, sf):
    store = df_.new_store(spark, "pages")
    df_.write_pages(fx.case_markdown(spark, sf), store)
    return report_rows(spark, sf, df_.parse_cases(df_.chosen_pages(spark, store, CHOSEN)))


for _name in [n for n in QUERIES if n.endswith("_")]:
    QUERIES[_name.rstrip("_")] = QUERIES.pop(_name)
