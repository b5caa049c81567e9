"""Sentence, offence, case and relation tables derived from the driver's tables.

Each text is valid in Spark SQL and in the checking engine alike, so both sides
of a check start from the same rows. All of them cover their whole tables and
whole texts and grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketframe.session import tune

SENTENCES = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  concat('2024ord', cast(l_orderkey % 500 AS string),
    CASE WHEN l_partkey % 11 = 0 THEN ''
         ELSE concat('_', cast(l_suppkey AS string), '_', cast(l_linenumber AS string)) END,
    CASE WHEN l_partkey % 7 = 0 THEN '_b' ELSE '' END,
    CASE WHEN l_partkey % 77 = 1 THEN '_b_extra' ELSE '' END) AS uid,
  CASE l_linenumber % 8
    WHEN 0 THEN NULL
    WHEN 1 THEN concat('cc_', cast(l_partkey AS string))
    WHEN 2 THEN concat('cc', cast(l_partkey AS string))
    WHEN 3 THEN cast(l_partkey AS string)
    WHEN 4 THEN concat('cc_', cast(l_partkey AS string), '_ycja')
    WHEN 5 THEN concat('cc', cast(l_partkey AS string), '_ycja')
    WHEN 6 THEN ' '
    ELSE concat(' cdsa_', cast(l_partkey AS string)) END AS offence,
  CASE l_orderkey % 5
    WHEN 0 THEN concat(cast(cast(l_shipdate AS date) AS string), '&', cast(cast(l_shipdate AS date) AS string))
    WHEN 1 THEN concat(cast(cast(l_shipdate AS date) AS string), ' &')
    WHEN 2 THEN ''
    ELSE cast(cast(l_shipdate AS date) AS string) END AS date,
  CASE l_partkey % 10
    WHEN 0 THEN NULL WHEN 1 THEN 'Indeterminate' WHEN 2 THEN 'life' WHEN 3 THEN '12m'
    WHEN 4 THEN concat(cast(cast(floor(l_quantity) AS bigint) AS string), 'm')
    WHEN 5 THEN concat(cast(cast(floor(l_quantity) AS bigint) AS string), 'y&6m&3d')
    WHEN 6 THEN concat(cast(cast(floor(l_quantity) AS bigint) AS string), 'y6m3d')
    WHEN 7 THEN '3.5y' WHEN 8 THEN '255y_7y'
    ELSE concat(cast(cast(floor(l_quantity) AS bigint) AS string), ' D') END AS jail,
  CASE l_suppkey % 6
    WHEN 0 THEN NULL WHEN 1 THEN 'jail-consecutive' WHEN 2 THEN 'jail-consecutive-intermittent'
    WHEN 3 THEN 'fine' WHEN 4 THEN '-concurrent' ELSE 'cso-' END AS mode,
  CASE l_orderkey % 9
    WHEN 0 THEN NULL WHEN 1 THEN '0d-discharge' WHEN 2 THEN '12m-Discharge' WHEN 3 THEN '1y-probation'
    WHEN 4 THEN '10y-LTSO' WHEN 5 THEN 'ltso-10y' WHEN 6 THEN '18m' WHEN 7 THEN ' 1.5 y -parole '
    ELSE '18m-probation' END AS conditions,
  CASE l_linenumber % 5
    WHEN 0 THEN NULL
    WHEN 1 THEN concat('$', cast(cast(floor(l_extendedprice) AS bigint) AS string))
    WHEN 2 THEN '1,234.5' WHEN 3 THEN 'n/a'
    ELSE cast(cast(floor(l_quantity) AS bigint) AS string) END AS fine,
  CASE l_suppkey % 4
    WHEN 0 THEN '2024skca79_upheld' WHEN 1 THEN '2024skca79-upheld' WHEN 2 THEN '' ELSE NULL END AS appeal
FROM lineitem
"""

OFFENCES = """
SELECT cast(p_partkey AS bigint) AS ord,
  concat(CASE WHEN p_partkey % 2 = 0 THEN 'cc_' ELSE 'cc' END, cast(p_partkey AS string)) AS section,
  p_name AS offence_name
FROM part WHERE p_partkey % 3 <> 0
UNION ALL
SELECT cast(p_partkey + 1000000000 AS bigint), concat('cc_', cast(p_partkey AS string)), concat(p_name, ' (dup)')
FROM part WHERE p_partkey % 4 = 0
"""

# Whole document texts, every line a numbered paragraph, inside the page layout
# of a decision; French pages lack the English marker, some pages lack it all.
CASE_MARKDOWN = """
SELECT doc_id, CASE WHEN doc_id % 13 = 12 THEN text ELSE concat(
  'Home', sep, 'Menu', sep, 'Search', sep,
  CASE WHEN lang = 'fr' THEN '' ELSE concat('Loading paragraph markers __', nl) END,
  CASE WHEN lang IN ('fr', 'es') THEN concat('Chargement des marqueurs de paragraphe __', nl) ELSE '' END,
  'Share! widget PDF # R v D', cast(doc_id AS string), ', 2024 ABCJ ', cast(doc_id AS string),
  ' (CanLII) Most recent unfavourable mention **Court** _of_ Justice', nl, '**_ _**', nl,
  CASE WHEN doc_id % 3 = 0 THEN concat('Facts', nl, '**_ _**') ELSE 'Overview' END, sep,
  '[1] ', replace(text, nl, concat(sep, '[', cast(doc_id % 90 AS string), '] ')),
  ' [s 718](/en/ca/laws/stat/rsc-1985-c-c-46/latest/rsc-1985-c-c-46.html#sec718_smooth)', sep,
  '[2] [Code](/en/ca/laws/stat/rsc-1985-c-c-46/latest/rsc-1985-c-c-46.html) ', text, sep,
  '[3] * * *  [Code](/en/ca/laws/stat/rsc-1985-c-c-46/latest/ rsc-1985-c-c-46.html) [s ', cast(doc_id % 5 AS string),
  '](/en/ca/laws/stat/rsc-1985-c-c-46/latest/rsc-1985-c-c-46.html#sec', cast(doc_id % 5 AS string),
  ') [other](/en/ab/laws/stat/x.html#) [case](/en/ab/abca/doc/1.html) [again](/en/ab/laws/stat/x.html)', sep,
  '[4] ', CASE WHEN doc_id % 2 = 0
    THEN '[Code](/en/ca/laws/stat/rsc-1985-c-c-46/latest/rsc-1985-c-c-46.html) ' ELSE '' END,
  'Back to top', nl, 'footer') END AS markdown
FROM (SELECT *, chr(10) AS nl, concat(chr(10), chr(10), '__', chr(10)) AS sep FROM documents) d
"""

CITATIONS = """
SELECT o_orderkey AS case_key,
  concat('raw ', cast(o_orderkey AS string)) AS raw_citation,
  CASE WHEN o_orderkey % 4 < 2 THEN concat('R v C', cast(o_custkey AS string))
       WHEN o_orderkey % 4 = 2 THEN '' END AS style_of_cause,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('2024 ABCJ ', cast(o_orderkey AS string)) END AS atomic_citation,
  CASE o_orderkey % 12 WHEN 4 THEN NULL WHEN 8 THEN ''
       ELSE concat('2024-ABCJ-', cast(o_orderkey AS string)) END AS uid,
  CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE 'ABCJ' END AS court
FROM orders
"""

RELATION_RESPONSES = """
SELECT event_id AS request_id, concat('2024abcj', cast(user_id AS string)) AS case_id, caseref_type,
  CASE WHEN event_id % 10 = 7 THEN 429 WHEN event_id % 10 = 8 THEN 500 ELSE 200 END AS status,
  CASE WHEN event_id % 50 = 3 THEN 'busy' ELSE
  concat('{"', CASE WHEN event_id % 11 = 0 THEN 'other' ELSE caseref_type END,
    '":[{"title":"R v X","citation":"2024 ABCJ ', cast(event_id * 7 AS string), ' (CanLII)","caseId":"a"},',
    '{"title":" ","citation":"","caseId":"2024abcj', cast(event_id AS string), '"},',
    '{"title":5,"citation":null,"caseId":{"en":"2024abcj1"}}]}') END AS body
FROM (SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN 'citingCases' WHEN 1 THEN 'citedCases'
        ELSE 'citedLegislations' END AS caseref_type FROM events) e
"""

# Related cases named by title, by a citation that nobody has beside a title, and by case id.
NAMED_RESPONSES = """
SELECT event_id AS request_id, concat('2024abcj', cast(user_id AS string)) AS case_id, 'citedCases' AS caseref_type, 200 AS status,
  concat('{"citedCases":[{"title":"r V  C', cast(user_id AS string), '"},',
    '{"title":"R v C', cast(user_id AS string), '","citation":"1900 XX ', cast(event_id AS string), '"},',
    '{"title":"R v C1","caseId":"2024-abcj-', cast(event_id AS string), '"}]}') AS body
FROM events
"""

_SOURCES = {
    "lineitem": SENTENCES,
    "part": OFFENCES,
    "documents": CASE_MARKDOWN,
    "orders": CITATIONS,
    "events": RELATION_RESPONSES,
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table, read as it lies."""
    return tune(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def _derived(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    load(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(_SOURCES[table])


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "lineitem")


def offences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "part")


def case_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "documents")


def case_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of ``case_markdown`` as HTML: links as anchors, marks and white space as references, a head with a script."""
    text = F.col("markdown")
    for mark, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(reference))
    text = F.regexp_replace(text, r"\[([^\[\]]*)\]\(([^()]*)\)", '<a href="$2">$1</a>')
    text = F.replace(F.replace(text, F.lit("\n"), F.lit("&#10;")), F.lit("  "), F.lit(" &#32;"))
    head = '<html><head><title>Decision</title><script>var a = "<p>";</script></head><body><div>'
    html = F.concat(F.lit(head), text, F.lit("</div></body></html>"))
    return case_markdown(spark, sf_dir).select("doc_id", html.alias("html"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "orders")


def named_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(NAMED_RESPONSES)


def relation_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "events")
