"""Citation metadata and the relations between cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketframe.functions.citations import citation_key, decision_code, formatted_citation, item_citation, text_field, title_key
from docketframe.functions.text import evaluate_once
from docketframe.operators.joins import join_unique

# Fields of the citation metadata, in output order.
METADATA_TEXT_FIELDS = [
    "style_of_cause", "atomic_citation", "citation_type", "official_reporter_citation",
    "year", "court", "decision_number", "jurisdiction", "court_name", "court_level",
    "long_url", "short_url", "language", "docket_number", "decision_date",
]
METADATA_LIST_FIELDS = ["keywords", "categories"]
# Relation types and error texts.
RELATION_TYPES = ["citedCases", "citingCases", "citedLegislations"]
RATE_LIMIT_STATUS, RATE_LIMIT_ERROR = 429, "Rate limit reached"
STATUS_ERROR = "API error: "
BODY_ERROR = "Invalid response body"
CITATION_ERROR = "Could not parse citation: "

EMPTY_ITEMS = "array<variant>"


# metadata ----------------------------------------------------------------

def citation_metadata(citations: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Parsed citations to metadata rows: ``citation, case_id``, 15 text fields, two lists.

    ``citations`` holds ``uid``, ``raw_citation`` and any of the other fields;
    text fields it lacks are NULL and lists it lacks are empty.
    """

    def text(field: str) -> Column:
        return F.col(field).cast("string") if field in citations.columns else F.lit(None).cast("string")

    def items(field: str) -> Column:
        return F.col(field) if field in citations.columns else F.array().cast("array<string>")

    return citations.select(
        *(keep or []),
        formatted_citation(text("style_of_cause"), text("atomic_citation"), text("raw_citation")).alias("citation"),
        text("uid").alias("case_id"),
        *[text(f).alias(f) for f in METADATA_TEXT_FIELDS],
        *[items(f).alias(f) for f in METADATA_LIST_FIELDS],
    )


def keyed_metadata(metadata: DataFrame) -> DataFrame:
    """``decision, metadata`` with one row per decision key.

    The key is that of the uid, or of the citation where there is no uid; a row with a uid goes before one without.
    """
    uid = F.nullif(decision_code(F.col("case_id")), F.lit(""))
    row = F.struct(uid.isNull().alias("unnamed"), F.struct(*metadata.columns).alias("metadata"))
    keyed = metadata.select(F.coalesce(uid, citation_key(F.col("citation"))).alias("decision"), row.alias("row"))
    first = keyed.where(F.col("decision").isNotNull()).groupBy("decision").agg(F.min("row").alias("row"))
    return first.select("decision", "row.metadata")


def join_metadata(cases: DataFrame, metadata: DataFrame, citation: Column, how: str = "inner") -> DataFrame:
    """Add the ``metadata`` struct of the decision a citation names.

    Both sides may be large: they meet on the decision key. A much-cited
    decision makes that key hot on the left only, where adaptive execution
    splits its partition; the right side has one row per key.
    """
    left = cases.withColumn("decision", citation_key(citation))
    return join_unique(left, keyed_metadata(metadata), "decision", how).drop("decision")


# relation responses ------------------------------------------------------

def relation_items(responses: DataFrame) -> DataFrame:
    """Replace ``body`` by ``error`` and ``items``.

    ``responses`` are landed answers: ``case_id, caseref_type, status, body``.
    A good answer gives the items under its type's key (none when the key is
    absent) and a NULL error; any other answer gives no items and an error.
    The body is parsed once, items stay VARIANT so no field is lost.
    """
    schema = ", ".join(f"{t} array<variant>" for t in RELATION_TYPES) + ", _malformed string"
    body = F.from_json("body", schema, {"columnNameOfCorruptRecord": "_malformed"})
    parsed = evaluate_once(responses, __body=F.when(F.col("status") == 200, body))
    malformed = F.col("__body").isNull() | F.col("__body._malformed").isNotNull()
    error = (
        F.when(F.col("status") == RATE_LIMIT_STATUS, F.lit(RATE_LIMIT_ERROR))
        .when(F.col("status") != 200, F.concat(F.lit(STATUS_ERROR), F.col("status").cast("string")))
        .when(malformed, F.lit(BODY_ERROR))
    )
    items = F.lit(None).cast(EMPTY_ITEMS)
    for relation in RELATION_TYPES:
        items = F.when(F.col("caseref_type") == relation, F.col(f"__body.{relation}")).otherwise(items)
    none = F.array().cast(EMPTY_ITEMS)
    keep = [c for c in responses.columns if c != "body"]
    return parsed.select(
        *keep,
        error.alias("error"),
        F.when(F.col("status") == 200, F.coalesce(items, none)).otherwise(none).alias("items"),
    )


def relation_counts(responses: DataFrame) -> DataFrame:
    """Number of related cases per answer; the error instead when there is one."""
    rows = relation_items(responses)
    return rows.select(
        *[c for c in rows.columns if c != "items"], F.size("items").cast("bigint").alias("n_items")
    )


def request_keys(citations: DataFrame) -> DataFrame:
    """Add ``court_key, decision, error``: how each citation's relations are asked for.

    Citations without court or uid cannot be asked for and get an error.
    """
    known = F.col("court").isNotNull() & F.col("uid").isNotNull()
    return citations.select(
        "*",
        F.when(known, F.lower("court")).alias("court_key"),
        F.when(known, decision_code(F.col("uid"))).alias("decision"),
        F.when(~known, F.concat(F.lit(CITATION_ERROR), F.col("raw_citation"))).alias("error"),
    )


def relation_edges(citations: DataFrame, responses: DataFrame, key: str = "case_key", order: str = "request_id") -> DataFrame:
    """Each citation with the answers landed for it: ``key, court_key, decision,
    caseref_type, error, items``; a citation that cannot be asked for gives one
    row with its error.

    A decision has one answer per relation type (``latest_answers``), however
    often it was asked for. The join is inner, with the error rows added beside it: adaptive execution
    can then split a hot decision on whichever side it is hot.
    """
    asked = request_keys(citations).select(key, "court_key", "decision", "error")
    answers = relation_items(latest_answers(responses, order)).select("decision", "caseref_type", "error", "items")
    answered = asked.where(F.col("error").isNull()).drop("error").join(answers, "decision")
    failed = asked.where(F.col("error").isNotNull()).withColumn("items", F.array().cast(EMPTY_ITEMS))
    columns = [key, "court_key", "decision", "caseref_type", "error", "items"]
    return answered.select(columns).unionByName(
        failed.withColumn("caseref_type", F.lit(None).cast("string")).select(columns)
    )


def related_items(answers: DataFrame, *keys: str) -> DataFrame:
    """Items of relation answers, one row each: ``keys, pos, citation``; unusable ones go."""
    cited = F.transform(
        "items", lambda item, pos: F.struct(pos.alias("pos"), item_citation(item).alias("citation"))
    )
    return answers.select(*keys, F.inline(F.filter(cited, lambda c: c["citation"].isNotNull())))


def related_cases(answers: DataFrame, metadata: DataFrame, *keys: str) -> DataFrame:
    """Related cases with metadata: ``keys, pos, citation, metadata``; unknown ones go."""
    return join_metadata(related_items(answers, *keys), metadata, F.col("citation"))


def citation_aliases(metadata: DataFrame) -> DataFrame:
    """Every name of a decision that no other decision has: ``alias, decision``, one row per alias.

    Names are the decision key itself, the keys of its atomic and reporter citations, and its title. A decision key goes
    before a citation of the same spelling. A name that two decisions share is left out. One aggregation, reduced in each task.
    """
    keyed = keyed_metadata(metadata)
    name = lambda rank, alias: F.struct(F.lit(rank).alias("rank"), alias.alias("alias"))
    names = F.array(
        name(0, F.col("decision")), name(1, citation_key(F.col("metadata.atomic_citation"))),
        name(1, citation_key(F.col("metadata.official_reporter_citation"))), name(1, title_key(F.col("metadata.style_of_cause"))),
    )
    rows = keyed.select("decision", F.inline(names)).where(F.col("alias").isNotNull())
    first, last = F.min(F.struct("rank", "decision")), F.max(F.struct(-F.col("rank"), F.col("decision").alias("decision")))
    ends = rows.groupBy("alias").agg(first["decision"].alias("decision"), last["decision"].alias("other"))
    return ends.where(F.col("decision") == F.col("other")).drop("other")


def related_cases_by_name(answers: DataFrame, metadata: DataFrame, *keys: str) -> DataFrame:
    """Related cases with metadata, whatever they are named by: ``keys, pos, citation, metadata``; unknown and ambiguous ones go.

    An item is looked up by its citation, else its case id; where that names no decision, by its title. Items meet the
    aliases twice and the metadata once, each time on a side with one row per key; a much-cited decision is split by
    adaptive execution, and items without a name of the kind asked for are dealt out.
    """
    named = F.transform("items", lambda item, pos: F.struct(
        pos.alias("pos"), item_citation(item).alias("citation"),
        citation_key(F.coalesce(*(text_field(item, k) for k in ("citation", "caseId", "case_id")))).alias("__name"),
        title_key(text_field(item, "title")).alias("__title"),
    ))
    items = answers.select(*keys, F.inline(F.filter(named, lambda x: x["citation"].isNotNull())))
    aliases = citation_aliases(metadata)
    cited = join_unique(items, aliases.select(F.col("alias").alias("__name"), F.col("decision").alias("__cited")), "__name", "left")
    cited = cited.withColumn("__title", F.when(F.col("__cited").isNull(), F.col("__title")))
    titled = join_unique(cited, aliases.select(F.col("alias").alias("__title"), F.col("decision").alias("__titled")), "__title", "left")
    found = titled.withColumn("decision", F.coalesce("__cited", "__titled")).where(F.col("decision").isNotNull())
    return join_unique(found, keyed_metadata(metadata), "decision").select(*keys, "pos", "citation", "metadata")


def citation_edges(responses: DataFrame, order: str = "request_id") -> DataFrame:
    """The citation graph of the landed answers, each edge once: ``citing, cited, told_by_citing, told_by_cited``.

    "A cites B" among the cited cases of A and "B is cited by A" among the citing cases of B are one edge, and the flags say
    who told of it. A related case is known by its citation, else by its case id; one with a title only is no decision. An
    edge to itself is left out. Edges are reduced in each task before their shuffle, so a decision of any number of them is
    spread over the graph.
    """
    answers = relation_items(latest_answers(responses, order))
    named = F.transform("items", lambda item: citation_key(F.coalesce(*(text_field(item, k) for k in ("citation", "caseId", "case_id")))))
    pairs = answers.where(F.col("caseref_type").isin(RELATION_TYPES[:2])).select("decision", (F.col("caseref_type") == RELATION_TYPES[0]).alias("cites"), F.explode(named).alias("other"))
    edges = pairs.select(
        F.when(F.col("cites"), F.col("decision")).otherwise(F.col("other")).alias("citing"),
        F.when(F.col("cites"), F.col("other")).otherwise(F.col("decision")).alias("cited"), "cites",
    ).where(F.col("citing") != F.col("cited"))
    return edges.groupBy("citing", "cited").agg(F.bool_or("cites").alias("told_by_citing"), F.bool_or(~F.col("cites")).alias("told_by_cited"))


def latest_answers(responses: DataFrame, order: str = "request_id") -> DataFrame:
    """One answer per decision and relation type: ``decision, caseref_type, status, body``.

    It is the last one with status 200, or the last one of all where none has. The spellings of a case id are one
    decision. Answers are reduced in each task before the shuffle.
    """
    keys = [decision_code(F.col("case_id")).alias("decision"), "caseref_type"]
    good = F.coalesce(F.col("status") == 200, F.lit(False))
    best = F.max_by(F.struct("status", "body"), F.struct(good, F.col(order)))
    return responses.groupBy(*keys).agg(best.alias("answer")).select("decision", "caseref_type", "answer.status", "answer.body")
