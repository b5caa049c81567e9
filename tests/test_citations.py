import json

import pytest
from pyspark.sql import functions as F

import docketframe as d
from docketframe.functions.citations import citation_key, formatted_citation

RESPONSE_TYPE = "request_id bigint, case_id string, caseref_type string, status int, body string"
CITATION_TYPE = "case_key int, raw_citation string, uid string, style_of_cause string, atomic_citation string, court string"


@pytest.mark.parametrize(
    "style, atomic, expected",
    [
        ("R v Example", "2024 SKCA 79", "R v Example, 2024 SKCA 79 (CanLII)"),
        ("R v Example", "", "R v Example (CanLII)"),
        (None, "2024 SKCA 79", "2024 SKCA 79 (CanLII)"),
        ("", None, "as given"),
    ],
)
def test_formatted_citation(spark, style, atomic, expected):
    row = spark.createDataFrame([(style, atomic, "as given")], "s string, a string, o string")
    assert row.select(formatted_citation(F.col("s"), F.col("a"), F.col("o"))).first()[0] == expected


def test_metadata_fields(spark):
    rows = spark.createDataFrame(
        [("2024skca79", "R v Example", "2024 SKCA 79", "SKCA", ["sentencing"], "x")],
        "uid string, style_of_cause string, atomic_citation string, court string, keywords array<string>, raw_citation string",
    )
    got = d.citation_metadata(rows).first().asDict()
    assert got["citation"] == "R v Example, 2024 SKCA 79 (CanLII)"
    assert (got["case_id"], got["court"], got["keywords"], got["categories"]) == ("2024skca79", "SKCA", ["sentencing"], [])
    assert got["docket_number"] is None and len(got) == 19


def response(i, case, kind, status, body):
    return (i, case, kind, status, body if isinstance(body, str) else json.dumps(body))


def test_answers(spark):
    rows = spark.createDataFrame(
        [
            response(1, "c", "citingCases", 429, ""),
            response(2, "c", "citingCases", 500, ""),
            response(3, "c", "citingCases", 200, {"citingCases": [{"caseId": "1", "more": [1]}]}),
            response(4, "c", "citingCases", 200, {"citedCases": [{"caseId": "1"}]}),
            response(5, "c", "citedCases", 200, "{not json"),
            response(6, "c", "citedCases", 200, "[1]"),
        ],
        RESPONSE_TYPE,
    )
    got = {r.request_id: (r.error, json.loads(r.j)) for r in d.relation_items(rows).select("request_id", "error", F.to_json("items").alias("j")).collect()}
    assert got[1] == ("Rate limit reached", [])
    assert got[2] == ("API error: 500", [])
    assert got[3] == (None, [{"caseId": "1", "more": [1]}])
    assert got[4] == (None, [])
    assert got[5] == got[6] == ("Invalid response body", [])
    assert {r.request_id: r.n_items for r in d.relation_counts(rows).collect()}[3] == 1


def test_citation_of_an_item(spark):
    items = [
        ({"title": " R v A ", "citation": "2024 X 1 (CanLII)"}, "R v A, 2024 X 1 (CanLII)"),
        ({"title": "", "citation": " c "}, "c"),
        ({"title": "t", "citation": 5, "caseId": {"en": "z"}, "case_id": "k"}, "k"),
        ({"title": "t", "caseId": "id"}, "id"),
        ({"title": "t"}, "t"),
        ({"title": " ", "citation": None}, None),
        ({}, None),
    ]
    rows = spark.createDataFrame([response(1, "c", "citedCases", 200, {"citedCases": [i for i, _ in items]})], RESPONSE_TYPE)
    got = {r.pos: r.citation for r in d.related_items(d.relation_items(rows), "case_id").collect()}
    assert got == {i: c for i, (_, c) in enumerate(items) if c}


def test_keys(spark):
    texts = ["R. v. Bandesha, 2013 ABCA 255 (CanLII)", " 2013abca255 ", "2013-ABCA-255"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(citation_key(F.col("t")))
    assert {r[0] for r in rows.collect()} == {"2013abca255"}


@pytest.fixture(scope="module")
def graph(spark):
    citations = spark.createDataFrame(
        [
            (1, "one", "2024-ABCJ-1", "R v A", "2024 ABCJ 1", "ABCJ"),
            (2, "two", "2024ABCJ2", "R v B", "2024 ABCJ 2", "abcj"),
            (3, "three", None, None, None, "ABCJ"),
            (4, "four", "2024abcj4", None, None, None),
        ],
        CITATION_TYPE,
    )
    responses = spark.createDataFrame(
        [
            response(1, "2024abcj1", "citedCases", 200, {"citedCases": [{"title": "old", "citation": "2024 ABCJ 1"}]}),
            response(2, "2024abcj1", "citedCases", 200, {"citedCases": [
                {"title": "R v B", "citation": "2024 ABCJ 2 (CanLII)"}, {"title": "R v Q", "citation": "2099 ABCJ 9 (CanLII)"}, {}, {"caseId": "2024abcj1"}]}),
            response(3, "2024abcj1", "citingCases", 429, ""),
        ],
        RESPONSE_TYPE,
    )
    return citations, responses


def test_edges(spark, graph):
    rows = d.relation_edges(*graph).select("case_key", "court_key", "decision", "caseref_type", "error", F.size("items")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [
            (1, "abcj", "2024abcj1", "citedCases", None, 4),
            (1, "abcj", "2024abcj1", "citingCases", "Rate limit reached", 0),
            (3, None, None, None, "Could not parse citation: three", 0),
            (4, None, None, None, "Could not parse citation: four", 0),
        ],
        key=str,
    )


def test_a_good_answer_outlives_a_late_refusal(spark, graph):
    citations, responses = graph
    late = spark.createDataFrame([response(9, "2024-ABCJ-1", "citedCases", 429, "")], RESPONSE_TYPE)
    answers = d.latest_answers(responses.unionByName(late))
    assert sorted((r.decision, r.caseref_type, r.status) for r in answers.collect()) == [("2024abcj1", "citedCases", 200), ("2024abcj1", "citingCases", 429)]
    assert {r.caseref_type: r.n_items for r in d.relation_counts(answers).collect()} == {"citedCases": 4, "citingCases": 0}


def test_related_cases_drop_unknown_ones(graph):
    citations, responses = graph
    rows = d.related_cases(d.relation_items(responses), d.citation_metadata(citations), "request_id").collect()
    assert sorted((r.request_id, r.pos, r.metadata.case_id) for r in rows) == [(1, 0, "2024-ABCJ-1"), (2, 0, "2024ABCJ2"), (2, 3, "2024-ABCJ-1")]


def test_report(spark, graph):
    citations, responses = graph
    link = "[s 1](/en/ca/laws/stat/sc-1996-c-19/latest/sc-1996-c-19.html#s1)"
    cases = spark.createDataFrame(
        [
            (10, "# x Most recent unfavourable mention  *H*", "", "R v A, 2024 ABCJ 1", [f"p {link}", "q"]),
            (11, "h", "", "R v B, 2024 ABCJ 2", ["r"]),
            (12, "h", "", "", ["no citation"]),
            (13, "h", "", "R v Z, 2099 ABCJ 9", ["no metadata"]),
        ],
        "doc_id int, header string, section_heading string, citation string, paragraphs array<string>",
    )
    got = {r.doc_id: r.asDict(recursive=True) for r in d.build_reports(cases, d.citation_metadata(citations), responses).collect()}
    assert set(got) == {10, 11}
    references = got[10]["references"]
    assert [(c["citation"], c["metadata"]["case_id"]) for c in references["cited_cases_metadata"]] == [
        ("R v B, 2024 ABCJ 2 (CanLII)", "2024ABCJ2"), ("2024abcj1", "2024-ABCJ-1"),
    ]
    assert references["citing_cases_metadata"] == []
    assert references["cited_legislation"] == [{"name": "Controlled Drugs and Substances Act", "section": "s1", "para_nos": [1]}]
    assert got[10]["header"] == " H" and got[10]["body_paragraphs"] == [f"p {link}", "q"]
    assert got[11]["references"] == {"cited_cases_metadata": [], "citing_cases_metadata": [], "cited_legislation": []}


def test_report_without_uid(spark):
    citations = spark.createDataFrame(
        [
            (1, "one", None, "R v A", "2024 ABCJ 1", "ABCJ"),
            (2, "two", "", "R v B", "2024 ABCJ 2", "ABCJ"),
            (3, "three", None, "R v Other", "2024 ABCJ 3", "ABCJ"),
            (4, "four", "2024-ABCJ-3", "R v Z", "2024 ABCJ 3", "ABCJ"),
        ],
        CITATION_TYPE,
    )
    cases = spark.createDataFrame(
        [(i, "h", f"R v A, 2024 ABCJ {i}", ["p"]) for i in (1, 2, 3)], "doc_id int, header string, citation string, paragraphs array<string>"
    )
    responses = spark.createDataFrame([], RESPONSE_TYPE)
    reports = d.build_reports(cases, d.citation_metadata(citations), responses).collect()
    assert sorted((r.doc_id, r.case_id, r.metadata.citation) for r in reports) == [
        (1, "unknown", "R v A, 2024 ABCJ 1 (CanLII)"), (2, "unknown", "R v B, 2024 ABCJ 2 (CanLII)"), (3, "2024-ABCJ-3", "R v Z, 2024 ABCJ 3 (CanLII)"),
    ]


def test_case_texts(spark, graph):
    citations, _ = graph
    cases = spark.createDataFrame(
        [(1, "h1", "R v A, 2024 ABCJ 1", ["p"]), (2, "h2", "", ["q"])], "doc_id int, header string, citation string, paragraphs array<string>"
    )
    metadata = d.citation_metadata(citations)
    shown = {r.doc_id: r for r in d.case_texts(cases, metadata, include_header=True).collect()}
    assert shown[1].header == "h1" and shown[1].metadata.case_id == "2024-ABCJ-1" and shown[2].metadata is None
    assert {r.header for r in d.case_texts(cases, metadata).collect()} == {None}


def test_mirrored_edges_are_one(spark):
    body = {
        "2024abcj1": ("citedCases", '{"citedCases":[{"citation":"R v B, 2024 ABCJ 2 (CanLII)"},{"caseId":"2024-ABCJ-3"},{"title":"R v Nobody"},{"citation":"2024 ABCJ 1"}]}'),
        "2024-ABCJ-2": ("citingCases", '{"citingCases":[{"citation":"2024 ABCJ 1"},{"case_id":"2024abcj9"},{"citation":"2024 ABCJ 1 (CanLII)"}]}'),
        "2024abcj4": ("citedLegislations", '{"citedLegislations":[{"citation":"2024 ABCJ 1"}]}'),
    }
    rows = [(i, case, kind, 200, text) for i, (case, (kind, text)) in enumerate(body.items())]
    rows += [(9, "2024abcj5", "citedCases", 500, None), (10, None, "citedCases", 200, '{"citedCases":[{"citation":"2024 ABCJ 1"}]}')]
    frame = spark.createDataFrame(rows, "request_id int, case_id string, caseref_type string, status int, body string")
    got = {tuple(r) for r in d.citation_edges(frame).collect()}
    assert got == {("2024abcj1", "2024abcj2", True, True), ("2024abcj1", "2024abcj3", True, False), ("2024abcj9", "2024abcj2", False, True)}
    assert d.citation_edges(frame.where("false")).count() == 0


def test_statute_edges_add_up(spark):
    link = "[s](/en/ca/laws/stat/rsc-1985-c-c-46/latest/rsc-1985-c-c-46.html#sec7)"
    rows = spark.createDataFrame([("2024 ABCJ 1", [link, "x", link]), ("R v A, 2024 ABCJ 1", [link]), ("", [link]), (None, [link]), ("2024 ABCJ 2", None)], "citation string, paragraphs array<string>")
    (edge,) = d.statute_edges(rows).collect()
    assert (edge.citing, edge.section, edge.n_paragraphs) == ("2024abcj1", "sec7", 3)


def test_related_cases_by_name(spark):
    citations = spark.createDataFrame(
        [
            ("2024-ABCJ-1", "R v A", "2024 ABCJ 1", "[2024] 1 SCR 10", "raw"), ("2024-ABCJ-2", "R v  B", "2024 ABCJ 2", None, "raw"),
            ("2023-ABCJ-3", "R v Twin", "2023 ABCJ 3", "[2023] 2 SCR 5", "raw"), ("2023-ABCJ-4", "R v Twin", "2023 ABCJ 4", "[2023] 2 SCR 5", "raw"),
            ("2024-ABCJ-1", "R v A", "2024 ABCJ 1", "[2024] 1 SCR 10", "again"),
        ],
        "uid string, style_of_cause string, atomic_citation string, official_reporter_citation string, raw_citation string",
    )
    items = """{"citedCases": [
      {"title": "Other name", "citation": "2024 ABCJ 1 (CanLII)"}, {"caseId": "2024abcj2"}, {"title": "r V b"}, {"title": "R v Twin"},
      {"title": "R v Nobody"}, {"citation": "[2024] 1 SCR 10"}, {"citation": "[2023] 2 SCR 5"}, {"title": "R v A", "citation": "1900 XX 1"}, {"case_id": "2023-abcj-4", "title": "R v A"}, {"x": 1}]}"""
    answers = spark.createDataFrame([(n, "c", "citedCases", 200, items) for n in (1, 1, 2)], "request_id int, case_id string, caseref_type string, status int, body string")
    rows = d.related_cases_by_name(d.relation_items(answers), d.citation_metadata(citations), "request_id").collect()
    one = {0: "2024-ABCJ-1", 1: "2024-ABCJ-2", 2: "2024-ABCJ-2", 5: "2024-ABCJ-1", 7: "2024-ABCJ-1", 8: "2023-ABCJ-4"}
    assert sorted((r.request_id, r.pos, r.metadata.case_id) for r in rows) == sorted((n, pos, uid) for n in (1, 1, 2) for pos, uid in one.items())
    none = d.related_cases_by_name(d.relation_items(answers), d.citation_metadata(citations).where("false"), "request_id")
    assert none.count() == 0


def test_aliases_name_one_decision(spark):
    rows = [("2024-A-1", "T", "2024 B 2", None), ("2024-B-2", "t ", None, "2024 A 1"), ("2024-C-3", "  ", "", "9 R 9")]
    metadata = d.citation_metadata(spark.createDataFrame(rows, "uid string, style_of_cause string, atomic_citation string, official_reporter_citation string").withColumn("raw_citation", F.lit("x")))
    assert {r.alias: r.decision for r in d.citation_aliases(metadata).collect()} == {"2024a1": "2024a1", "2024b2": "2024b2", "2024c3": "2024c3", "9r9": "2024c3"}
