"""The queries restated as SQL for an independent engine.

Dialect notes: its regexes know no lookaround, ``cast(double AS int)`` rounds,
``concat`` skips NULLs and ``'\\n'`` is two characters, hence ``chr(10)``.
"""

from __future__ import annotations

from docketframe.plans import fixtures as fx
from docketframe.plans.queries import CASE, ROW_INDEX

# Fixed values, written out again: a wrong one in the library does not go unnoticed here.
SENTENCE_COLUMNS = ["uid", "offence", "date", "jail", "mode", "conditions", "fine", "appeal"]
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
WHITESPACE = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
WS = f"[{WHITESPACE}]"
DURATION_PATTERN = rf"([0-9]+(?:\.[0-9]+)?){WS}*([ymdYMD])"
CONDITION_PATTERN = rf"(?i)^{WS}*([0-9]+(?:\.[0-9]+)?){WS}*(y|m|d){WS}*-(parole|ircs|ltso|discharge|probation){WS}*$"
NUMBER_PATTERN = r"^[-+]?([0-9](_?[0-9])*(\.([0-9](_?[0-9])*)?)?|\.[0-9](_?[0-9])*)([eE][-+]?[0-9](_?[0-9])*)?$"
HEADING_MARKER_PATTERN = rf"[*]{{2}}{WS}*_{WS}*_{WS}*[*]{{2}}"
LINK_PATTERN = r"\[([^\]]+)\]\(([^)]+)\)"
STATUTE_NAMES = {
    "/en/ca/laws/stat/rsc-1985-c-c-46/latest/rsc-1985-c-c-46.html": "Criminal Code",
    "/en/ca/laws/stat/sc-1996-c-19/latest/sc-1996-c-19.html": "Controlled Drugs and Substances Act",
    "/en/ca/laws/stat/schedule-b-to-the-canada-act-1982-uk-1982-c-11/latest/schedule-b-to-the-canada-act-1982-uk-1982-c-11.html": "Charter",
    "/en/ca/laws/stat/rsc-1985-c-c-47/latest/rsc-1985-c-c-47.html": "Criminal Records Act",
    "/en/ca/laws/stat/sc-2001-c-27/latest/sc-2001-c-27.html": "Immigration and Refugee Protection Act",
}

NL = "chr(10)"
KEYS = "l_orderkey, l_linenumber"
SEPARATOR = f"{NL} || {NL} || '__' || {NL}"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {text(WHITESPACE)})"


def cell(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def left_of(x: str, mark: str) -> str:
    return cell(f"left({x}, strpos({x}, '{mark}') - 1)")


def right_of(x: str, mark: str) -> str:
    return cell(f"substr({x}, strpos({x}, '{mark}') + 1)")


def with_(*ctes: tuple[str, str], select: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes) + "\n" + select


SENT = ("fx_sentences", fx.SENTENCES)
OFF = ("fx_offences", fx.OFFENCES)
CASES = ("fx_case_markdown", fx.CASE_MARKDOWN)
CITE = ("fx_citations", fx.CITATIONS)
RESP = ("fx_responses", fx.RELATION_RESPONSES)
CELLS = (
    "cells",
    f"SELECT {KEYS}, l_suppkey, " + ", ".join(f"{cell(c)} AS {c}, {c} AS raw_{c}" for c in SENTENCE_COLUMNS) + " FROM fx_sentences",
)

# sentence columns, over "cells" -----------------------------------------------

UID = {
    "case_id": "string_split(uid, '_')[1]",
    "docket": "string_split(uid, '_')[2]",
    "count_no": "string_split(uid, '_')[3]",
    "defendant": "coalesce(string_split(uid, '_')[4], 'a')",
}
DATE = {
    "offence_date": "CASE WHEN strpos(date, '&') = 0 THEN date END",
    "offence_start_date": f"CASE WHEN strpos(date, '&') > 0 THEN {left_of('date', '&')} END",
    "offence_end_date": f"CASE WHEN strpos(date, '&') > 0 THEN {right_of('date', '&')} END",
}
QUANTITIES = f"CAST(regexp_extract_all(jail, {text(DURATION_PATTERN)}, 1) AS DOUBLE[])"
UNITS = f"[lower(u) FOR u IN regexp_extract_all(jail, {text(DURATION_PATTERN)}, 2)]"
KNOWN_JAIL = f"lower(jail) <> 'indeterminate' AND len({QUANTITIES}) > 0"
COMPONENTS = f"list_zip({QUANTITIES}, {UNITS})"
DAYS_EACH = (
    f"[CASE WHEN c[2] = 'm' AND c[1] = 12 THEN 365.0 WHEN c[2] = 'y' THEN c[1] * 365.0 "
    f"WHEN c[2] = 'm' THEN c[1] * 30.0 ELSE c[1] END FOR c IN {COMPONENTS}]"
)
JAIL = {
    "total_days": f"CASE WHEN jail IS NULL THEN 0 WHEN {KNOWN_JAIL} THEN CAST(trunc(list_sum({DAYS_EACH})) AS BIGINT) END",
    "is_indeterminate": "coalesce(lower(jail) = 'indeterminate', false)",
    "is_unrecognized": f"coalesce(lower(jail) <> 'indeterminate' AND len({QUANTITIES}) = 0, false)",
}
JAIL_TEXT = (
    f"CASE WHEN jail IS NULL THEN '' WHEN {KNOWN_JAIL} THEN "
    f"array_to_string([CAST(CAST(floor(c[1] * 10) AS BIGINT) AS VARCHAR) || '/10' || c[2] FOR c IN {COMPONENTS}], ' | ') END"
)
MODE = {
    "jail_type": f"CASE WHEN strpos(mode, '-') > 0 THEN {left_of('mode', '-')} ELSE mode END",
    "sentence_mode": f"CASE WHEN strpos(mode, '-') > 0 THEN {right_of('mode', '-')} END",
}


def _condition(group: int) -> str:
    return f"CASE WHEN regexp_matches(conditions, {text(CONDITION_PATTERN)}) THEN lower(regexp_extract(conditions, {text(CONDITION_PATTERN)}, {group})) END"


COND = {
    "time": f"CAST({_condition(1)} AS DOUBLE)",
    "unit": _condition(2),
    "type": _condition(3),
}
COND_SHOWN = {
    "unit_display": f"coalesce(CASE {COND['unit']} WHEN 'y' THEN 'year' WHEN 'm' THEN 'month' WHEN 'd' THEN 'day' END, 'unknown')"
    f" || CASE WHEN {COND['time']} <> 1 THEN 's' ELSE '' END",
    "type_display": f"CASE WHEN {COND['type']} = 'discharge' THEN CASE WHEN {COND['time']} = 0 THEN 'absolute discharge'"
    f" ELSE 'conditional discharge' END ELSE {COND['type']} END",
}
DIGITS = cell("replace(replace(fine, '$', ''), ',', '')")
FINE = (
    f"CASE WHEN regexp_matches({DIGITS}, {text(NUMBER_PATTERN)}) "
    f"THEN printf('$%.2f', CAST(replace({DIGITS}, '_', '') AS DOUBLE)) END"
)
APPEAL = {
    "court": f"CASE WHEN strpos(appeal, '_') > 0 THEN {left_of('appeal', '_')} ELSE appeal END",
    "result": f"CASE WHEN strpos(appeal, '_') > 0 THEN {right_of('appeal', '_')} END",
}


def fields(columns: dict[str, str], prefix: str = "") -> str:
    return ", ".join(f"{sql} AS {prefix}{name}" for name, sql in columns.items())


def sentence_query(select: str) -> str:
    return with_(SENT, CELLS, select=f"SELECT {KEYS}, {select} FROM cells")


# offence lookup -----------------------------------------------------------------

FIRST = ("firsts", "SELECT section, arg_min(offence_name, ord) AS offence_name FROM fx_offences GROUP BY section")
CODES = (
    "codes",
    "SELECT *, replace(offence, '_ycja', '') AS k0, contains(offence, '_ycja') AS youth FROM cells",
)
VARIANTS = (
    "variants",
    "SELECT *, CASE WHEN NOT starts_with(k0, 'cc') THEN 'cc_' || k0 WHEN starts_with(k0, 'cc_') THEN 'cc' || substr(k0, 4)"
    " ELSE 'cc_' || substr(k0, 3) END AS k1 FROM codes",
)


def lookup(plain: bool) -> tuple[str, str]:
    may = "true" if plain else "youth"
    label = "CASE WHEN youth THEN ' (YCJA)' ELSE '' END"
    return (
        "found",
        f"""SELECT v.*,
  CASE WHEN e.section IS NOT NULL THEN k0 WHEN {may} AND o.section IS NOT NULL THEN k1 ELSE offence END AS offence_code,
  CASE WHEN e.section IS NOT NULL THEN e.offence_name || {label}
       WHEN {may} AND o.section IS NOT NULL THEN o.offence_name || {label} END AS offence_name
FROM variants v LEFT JOIN firsts e ON e.section = k0 LEFT JOIN firsts o ON o.section = k1""",
    )


LOOKUP = [SENT, OFF, CELLS, FIRST, CODES, VARIANTS]
PARSED_FIELDS = ", ".join(
    [
        fields(UID), "offence_code, offence_name", fields(DATE), f"{JAIL_TEXT} AS jail_components", fields(JAIL), fields(MODE),
        f"{COND['time']} AS cond_time, {COND['unit']} AS cond_unit, {COND['type']} AS cond_type", fields(COND_SHOWN),
        f"{FINE} AS fine", fields(APPEAL, "appeal_"),
    ]
)


def _json_sentence() -> str:
    components = (
        "CASE WHEN jail IS NULL THEN [] WHEN " + KNOWN_JAIL + " THEN "
        f"[{{'quantity': c[1], 'unit': c[2]}} FOR c IN {COMPONENTS}] END"
    )

    def obj(columns: dict[str, str]) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in columns.items()) + "}"

    uid = dict(UID)
    uid["count"] = uid.pop("count_no")
    uid = {k: uid[k] for k in ("case_id", "docket", "count", "defendant")}
    cond = {
        "time": COND["time"], "unit": COND["unit"], "unit_display": COND_SHOWN["unit_display"],
        "type": COND["type"], "type_display": COND_SHOWN["type_display"],
    }
    whole = obj(
        {
            "uid": obj(uid), "offence": "{'offence_code': offence_code, 'offence_name': offence_name}", "date": obj(DATE),
            "jail": obj({"components": components, **JAIL}), "mode": obj(MODE), "conditions": obj(cond), "fine": FINE,
            "appeal": obj(APPEAL),
        }
    )
    return f"CAST(to_json({whole}) AS VARCHAR)"


# case texts ---------------------------------------------------------------------

ENG, FR = (f"'{m}' || {NL}" for m in ("Loading paragraph markers __", "Chargement des marqueurs de paragraphe __"))


def clean(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)^([^!]*)!.*?PDF', '\\1')"
    x = f"replace(replace({x}, '__' || {NL}, '__' || chr(1)), {NL} || '__', chr(1) || '__')"
    x = f"replace(replace({x}, {NL}, ' '), chr(1), {NL})"
    x = f"regexp_replace({x}, {text(chr(10) + WS + '+')}, {NL}, 'g')"
    x = f"regexp_replace({x}, '  +', ' ', 'g')"
    x = f"regexp_replace({x}, {text(f'{chr(10)}{WS}*{chr(10)}')}, {NL}, 'g')"
    x = f"regexp_replace({x}, {text(rf'(?:\*{WS}+){{2,}}\*')}, '', 'g')"
    return strip(x)


SPLIT = [
    CASES,
    (
        "pieces",
        f"SELECT doc_id, markdown, [{strip('c')} FOR c IN string_split(markdown, {SEPARATOR}) IF {strip('c')} <> ''] AS chunks"
        " FROM fx_case_markdown",
    ),
    (
        "tops",
        "SELECT *, CASE WHEN len(chunks) >= 4 THEN [c FOR c IN chunks IF contains(c, 'Loading paragraph markers')][1] END AS top FROM pieces",
    ),
    (
        "heads",
        f"""SELECT *, {strip(f'''CASE WHEN length(string_split(top, {ENG})[-1]) <= length(string_split(top, {FR})[-1])
  THEN string_split(top, {ENG})[-1] ELSE string_split(top, {FR})[-1] END''')} AS head FROM tops""",
    ),
    (
        "marked",
        f"SELECT *, regexp_extract_all(head, {text(HEADING_MARKER_PATTERN)})[-1] AS mark,"
        f" regexp_split_to_array(head, {text(HEADING_MARKER_PATTERN)})[-1] AS tail FROM heads",
    ),
    (
        "split_cases",
        f"""SELECT doc_id,
  CASE WHEN head IS NULL THEN '' WHEN mark IS NOT NULL AND {strip('tail')} <> ''
       THEN rtrim(left(head, length(head) - length(tail) - length(mark)), {text(WHITESPACE)}) ELSE head END AS header,
  CASE WHEN len(chunks) >= 4 THEN array_to_string(chunks[5:], {SEPARATOR}) ELSE {strip('markdown')} END AS body,
  CASE WHEN head IS NOT NULL AND mark IS NOT NULL THEN {strip('tail')} ELSE '' END AS section_heading,
  head IS NOT NULL AS header_found
FROM marked""",
    ),
]
PARAGRAPHS = (
    f"[{strip('p')} FOR p IN regexp_split_to_array(string_split(body, 'Back to top')[1], {text(chr(10) + '+__' + chr(10) + '+')})]"
)
PARSED = [
    *SPLIT,
    (
        "numbered",
        f"""SELECT doc_id, {clean('header')} AS header, section_heading,
  [q FOR q IN [CASE WHEN strpos(left(p, 10), '] ') > 0 THEN ltrim(substr(p, strpos(left(p, 10), '] ') + 2), {text(WHITESPACE)}) ELSE p END
   FOR p IN {PARAGRAPHS}] IF q <> ''] AS raw_paragraphs FROM split_cases""",
    ),
    (
        "cases",
        f"""SELECT doc_id, header, section_heading,
  {strip("regexp_extract(header, '(?s)# (.*?) \\(CanLII\\) ', 1)")} AS citation,
  list_transform(raw_paragraphs, lambda p, i: CASE WHEN i = 1 AND section_heading <> '' THEN section_heading || {NL} || {NL} ELSE '' END
    || {clean('p')}) AS paragraphs FROM numbered""",
    ),
]
HEADER_TEXT = (
    "regexp_replace(replace(replace(CASE WHEN strpos(header, 'Most recent unfavourable mention') > 0"
    " THEN substr(header, strpos(header, 'Most recent unfavourable mention') + 32) ELSE header END, '*', ''), '_', ''),"
    f" {text(WS + '+')}, ' ', 'g')"
)


# Its own rules, for the markup that the pages table has; none of them is the library's.
PAGE_STEPS = [
    ("(?s)<!--.*?-->", ""), ("(?s)<head>.*?</head>", ""), ("(?s)<script>.*?</script>", ""), ("(?s)<style>.*?</style>", ""),
    (r"\s+", " "), ('<a href="([^"]*)">(.*?)</a>', r"[\2](\1)"), ("</?b>", "**"), ("</li>|</?(?:html|body)(?: [^>]*)?>|<!DOCTYPE [^>]*>", ""),
    (" ?<li> ?", "\n  * "), (" ?<h1> ?", "\n\n# "), (" ?<br> ?", "  \n"), (r' ?</?(?:ul|nav|p|div|article|footer|h1)(?: class="\w+")?> ?', "\n\n"),
    ("\n\n\n+", "\n\n"),
]


def _markdown() -> str:
    x = "html"
    for pattern, new in PAGE_STEPS:
        x = f"regexp_replace({x}, {text(pattern)}, {text(new)}, 'g')"
    for name, character in (("&copy;", "(C)"), ("&middot;", "*"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, {text(name)}, {text(character)})"
    return strip(x)


# legislation --------------------------------------------------------------------

NAME = "CASE page " + " ".join(f"WHEN {text(u)} THEN {text(n)}" for u, n in STATUTE_NAMES.items()) + " ELSE page END"
LINKS = [
    *PARSED,
    ("paras", "SELECT doc_id, unnest(paragraphs) AS para, generate_subscripts(paragraphs, 1) AS para_no FROM cases"),
    ("found_urls", f"SELECT doc_id, para_no, regexp_extract_all(para, {text(LINK_PATTERN)}, 2) AS urls FROM paras"),
    (
        "urls",
        "SELECT doc_id, para_no, replace(unnest(urls), ' ', '') AS url, generate_subscripts(urls, 1) AS link_pos FROM found_urls",
    ),
    (
        "pages_cited",
        "SELECT doc_id, para_no, link_pos, string_split(url, '#')[1] AS page,"
        " CASE WHEN strpos(url, '#') > 0 THEN replace(substr(url, strpos(url, '#') + 1), '_smooth', '') END AS section"
        " FROM urls WHERE contains(url, 'laws')",
    ),
    ("links", f"SELECT doc_id, para_no, link_pos, {NAME} AS name, section FROM pages_cited"),
    (
        "kept",
        """SELECT * FROM links l WHERE section IS NOT NULL OR NOT EXISTS (SELECT 1 FROM links s
  WHERE s.doc_id = l.doc_id AND s.name = l.name AND s.para_no = l.para_no AND s.section <> '')""",
    ),
    (
        "grouped",
        "SELECT doc_id, name, section, list_sort(list_distinct(list(para_no))) AS paras FROM kept GROUP BY doc_id, name, section",
    ),
    (
        "ranked",
        """SELECT g.doc_id, g.name, g.section, array_to_string(g.paras, ',') AS para_nos,
  row_number() OVER (PARTITION BY g.doc_id ORDER BY f.first_at) AS rank
FROM grouped g JOIN (SELECT doc_id, name, section, min(para_no * 1000000 + link_pos) AS first_at FROM links GROUP BY ALL) f
  ON f.doc_id = g.doc_id AND f.name = g.name AND f.section IS NOT DISTINCT FROM g.section""",
    ),
]

# citations and relations ----------------------------------------------------------

FORMATTED = (
    "CASE WHEN style_of_cause <> '' AND atomic_citation <> '' THEN style_of_cause || ', ' || atomic_citation || ' (CanLII)'"
    " WHEN style_of_cause <> '' THEN style_of_cause || ' (CanLII)' WHEN atomic_citation <> '' THEN atomic_citation || ' (CanLII)'"
    " ELSE raw_citation END"
)
def json_text(item: str, key: str) -> str:
    return f"CASE WHEN json_type({item}, '$.{key}') = 'VARCHAR' THEN {cell(f'''json_extract_string({item}, '$.{key}')''')} END"


def decision_in(x: str) -> str:
    found = f"nullif(regexp_extract({x}, '[0-9]{{4}} [A-Za-z]+ [0-9]+'), '')"
    return f"lower(replace(replace(coalesce({found}, {cell(x)}), ' ', ''), '-', ''))"


META = (
    "metadata",
    f"SELECT citation, uid AS case_id, court, coalesce(nullif(replace(lower(uid), '-', ''), ''), {decision_in('citation')}) AS decision"
    f" FROM (SELECT *, {FORMATTED} AS citation FROM fx_citations) x",
)
ANSWERS = [
    RESP,
    (
        "answers",
        """SELECT request_id, case_id, caseref_type, status,
  CASE WHEN status = 429 THEN 'Rate limit reached' WHEN status <> 200 THEN 'API error: ' || status
       WHEN NOT json_valid(body) THEN 'Invalid response body' END AS error,
  CASE WHEN status = 200 AND json_valid(body)
       THEN coalesce(CAST(json_extract(body, '$.' || caseref_type) AS JSON[]), []) ELSE [] END AS items FROM fx_responses""",
    ),
]
ITEMS = [
    *ANSWERS,
    ("items", "SELECT request_id, case_id, caseref_type, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM answers"),
    ("item_texts", f"SELECT request_id, case_id, caseref_type, pos, {json_text('item', 'title')} AS title, {json_text('item', 'citation')} AS citation, {json_text('item', 'caseId')} AS caseId FROM items"),
]
RELATED = [
    *ITEMS,
    (
        "related",
        "SELECT request_id, case_id AS asked, caseref_type, pos, coalesce(title || ', ' || citation, citation, caseId, title) AS citation"
        " FROM item_texts WHERE coalesce(citation, caseId, title) IS NOT NULL",
    ),
    CITE,
    META,
    (
        "related_known",
        f"SELECT r.*, m.citation AS metadata_citation, m.case_id FROM related r JOIN metadata m ON m.decision = {decision_in('r.citation')}",
    ),
]
# The items are written out instead of read from JSON.
NAMED = [
    CITE,
    META,
    (
        "aliases",
        f"""SELECT alias, min(decision) AS decision FROM (
  SELECT alias, rank, decision, min(rank) OVER (PARTITION BY alias) AS best FROM (
    SELECT decision AS alias, 0 AS rank, decision FROM metadata
    UNION ALL SELECT {decision_in('atomic_citation')}, 1, m.decision FROM fx_citations c JOIN metadata m ON m.decision = {decision_in(f'coalesce(nullif(c.uid, {text("")}), c.atomic_citation)')}
    UNION ALL SELECT 'title: ' || lower(c.style_of_cause), 1, m.decision FROM fx_citations c
      JOIN metadata m ON m.decision = {decision_in(f'coalesce(nullif(c.uid, {text("")}), c.atomic_citation)')} WHERE c.style_of_cause <> '') x
  WHERE alias IS NOT NULL) y WHERE rank = best GROUP BY alias HAVING count(DISTINCT decision) = 1""",
    ),
    (
        "named",
        """SELECT event_id AS request_id, 1 AS pos, 'r V  C' || user_id AS citation, NULL AS name, 'title: r v c' || user_id AS title FROM events
UNION ALL SELECT event_id, 2, 'R v C' || user_id || ', 1900 XX ' || event_id, '1900xx' || event_id, 'title: r v c' || user_id FROM events
UNION ALL SELECT event_id, 3, '2024-abcj-' || event_id, '2024abcj' || event_id, 'title: r v c1' FROM events""",
    ),
]
LATEST = (
    "latest",
    "SELECT arg_max(request_id, CASE WHEN status = 200 THEN 1000000000000 ELSE 0 END + request_id) AS request_id"
    " FROM fx_responses GROUP BY replace(lower(case_id), '-', ''), caseref_type",
)
METADATA_NULLS = [
    "citation_type", "official_reporter_citation", "year", "decision_number", "jurisdiction", "court_name", "court_level",
    "long_url", "short_url", "language", "docket_number", "decision_date",
]


def _reports() -> str:
    related = []
    for ctes in (RELATED, LINKS):
        related += [c for c in ctes if c[0] not in [n for n, _ in related]]
    lists = "string_agg(citation || '=' || case_id, ' | ' ORDER BY pos) FILTER (caseref_type = '{}')"
    return with_(
        *related,
        LATEST,
        (
            "lists",
            f"""SELECT replace(lower(asked), '-', '') AS decision, {lists.format('citedCases')} AS cited, {lists.format('citingCases')} AS citing
FROM related_known WHERE request_id IN (SELECT request_id FROM latest) GROUP BY 1""",
        ),
        (
            "statutes",
            "SELECT doc_id, string_agg(name || '#' || coalesce(section, '-') || '@' || para_nos, ' | ' ORDER BY rank) AS legislation FROM ranked GROUP BY doc_id",
        ),
        select=f"""SELECT c.doc_id, coalesce(nullif(m.case_id, ''), 'unknown') AS case_id, c.citation, m.citation AS metadata_citation, coalesce(l.cited, '') AS cited,
  coalesce(l.citing, '') AS citing, coalesce(s.legislation, '') AS legislation, {HEADER_TEXT.replace('header', 'c.header')} AS header,
  array_to_string(c.paragraphs, ' | ') AS body
FROM cases c JOIN metadata m ON c.citation <> '' AND m.decision = {decision_in('c.citation')}
LEFT JOIN lists l ON l.decision = m.decision LEFT JOIN statutes s ON s.doc_id = c.doc_id""",
    )


def oracle_sql() -> dict[str, str]:
    raw = ", ".join(SENTENCE_COLUMNS)
    order = ", ".join(f"{c} NULLS FIRST" for c in ["l_orderkey", "l_linenumber", *SENTENCE_COLUMNS])
    nulls = ", ".join(f"CASE WHEN {c} NOT IN ({', '.join(text(t) for t in NA_TOKENS)}) THEN {c} END AS {c}" for c in SENTENCE_COLUMNS)
    keys = "l_orderkey l_linenumber l_partkey l_suppkey".split()
    kept_columns = [c for c in SENTENCE_COLUMNS if c not in ("fine", "appeal")]
    report = [f"SELECT '{c}' AS column_name, 'extra' AS status, count({c}) AS filled FROM fx_sentences" for c in keys]
    report += [f"SELECT '{c}', 'present', count({c}) FROM fx_sentences" for c in kept_columns]
    report += [f"SELECT '{c}', 'missing', 0" for c in ("fine", "appeal")]
    return {
        "parse_sentences": with_(*LOOKUP, lookup(False), select=f"SELECT {KEYS}, {PARSED_FIELDS} FROM found"),
        "sentence_json": with_(*LOOKUP, lookup(False), select=f"SELECT {KEYS}, {_json_sentence()} AS json FROM found"),
        "uid_parts": sentence_query(f"raw_uid AS uid, {fields(UID)}"),
        "date_parts": sentence_query(f"raw_date AS date, {fields(DATE)}"),
        "jail_components": sentence_query(
            f"raw_jail AS jail, CASE WHEN jail IS NULL THEN 0 WHEN {KNOWN_JAIL} THEN len({QUANTITIES}) END AS n_components, {JAIL_TEXT} AS components"
        ),
        "jail_total_days": sentence_query(f"raw_jail AS jail, {fields(JAIL)}"),
        "mode_parts": sentence_query(f"raw_mode AS mode, {fields(MODE)}"),
        "conditions_parts": sentence_query(f"raw_conditions AS conditions, {fields(COND)}"),
        "conditions_display": sentence_query(f"raw_conditions AS conditions, {fields(COND_SHOWN)}"),
        "fine_format": sentence_query(f"raw_fine AS fine_text, {FINE} AS fine"),
        "appeal_parts": sentence_query(f"raw_appeal AS appeal, {fields(APPEAL)}"),
        "na_tokens": with_(SENT, select=f"SELECT {KEYS}, {nulls} FROM fx_sentences"),
        "canonical_projection": with_(
            SENT, select=f"SELECT {KEYS}, {', '.join(kept_columns)}, '' AS fine, '' AS appeal FROM fx_sentences"
        ),
        "schema_diff": with_(SENT, select="\nUNION ALL ".join(report)),
        "row_at": with_(
            SENT,
            select=f"""SELECT {KEYS}, {raw} FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i, count(*) OVER () AS n FROM fx_sentences)
WHERE i = greatest(0, least({ROW_INDEX}, n - 1))""",
        ),
        "sentences_for_case": with_(
            SENT, CELLS, select=f"SELECT {KEYS}, {', '.join(f'raw_{c} AS {c}' for c in SENTENCE_COLUMNS)} FROM cells WHERE {UID['case_id']} = '{CASE}'"
        ),
        "cases_with_many_counts": with_(
            SENT, CELLS,
            select=f"SELECT {UID['case_id']} AS case_id, count(*) AS n_sentences FROM cells WHERE {UID['case_id']} <> '' GROUP BY 1 HAVING count(*) > 1",
        ),
        "case_sentences": with_(
            *LOOKUP, lookup(False),
            select=f"SELECT uid AS sentence_uid, {PARSED_FIELDS} FROM found WHERE {UID['case_id']} <> ''",
        ),
        "append_tables": with_(
            SENT, CITE,
            select="SELECT * FROM fx_sentences UNION ALL BY NAME SELECT * FROM fx_citations",
        ),
        "first_per_section": with_(OFF, FIRST, select="SELECT * FROM firsts"),
        "offence_variants": with_(
            SENT, CELLS, ("codes", "SELECT *, coalesce(offence, '') AS k0 FROM cells"), VARIANTS,
            select=f"SELECT {KEYS}, raw_offence AS offence, k0 || ' | ' || k1 AS variants FROM variants",
        ),
        "offence_lookup": with_(
            *LOOKUP, lookup(False), select=f"SELECT {KEYS}, raw_offence AS offence, offence_code, offence_name FROM found"
        ),
        "offence_lookup_plain_variants": with_(
            *LOOKUP, lookup(True), select=f"SELECT {KEYS}, raw_offence AS offence, offence_code, offence_name FROM found"
        ),
        "pages_markdown": f"SELECT page_id, {_markdown()} AS markdown FROM pages",
        "case_split": with_(*SPLIT, select="SELECT * FROM split_cases"),
        "case_citation": with_(*PARSED, select="SELECT doc_id, citation FROM cases"),
        "case_paragraphs": with_(
            *PARSED, select="SELECT doc_id, CAST(generate_subscripts(paragraphs, 1) AS INTEGER) AS para_no, unnest(paragraphs) AS text FROM cases"
        ),
        "clean_text": with_(CASES, select=f"SELECT doc_id, {clean('markdown')} AS clean FROM fx_case_markdown"),
        "text_before": with_(CASES, select="SELECT doc_id, string_split(markdown, 'Back to top')[1] AS kept FROM fx_case_markdown"),
        "text_after": with_(
            CASES,
            select="SELECT doc_id, CASE WHEN strpos(markdown, 'Most recent unfavourable mention') > 0 THEN"
            " substr(markdown, strpos(markdown, 'Most recent unfavourable mention') + 32) ELSE markdown END AS kept FROM fx_case_markdown",
        ),
        "report_header": with_(*PARSED, select=f"SELECT doc_id, {HEADER_TEXT} AS header FROM cases"),
        "case_summary": with_(
            *PARSED, CITE, META,
            select=f"""SELECT doc_id, header, array_to_string(paragraphs, ' | ') AS body, m.citation, m.court
FROM cases c LEFT JOIN metadata m ON m.decision = {decision_in('c.citation')}""",
        ),
        "legislation_links": with_(*LINKS, select="SELECT doc_id, CAST(para_no AS INTEGER) AS para_no, name, section FROM links"),
        "cited_legislation": with_(*LINKS, select="SELECT doc_id, name, section, array_to_string(paras, ',') AS para_nos FROM grouped"),
        "legislation_ordered": with_(*LINKS, select="SELECT doc_id, rank, name, section, para_nos FROM ranked"),
        "citation_metadata": with_(
            CITE,
            select=f"SELECT {FORMATTED} AS citation, uid AS case_id, style_of_cause, atomic_citation, court, "
            + ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in METADATA_NULLS)
            + ", '' AS keywords, '' AS categories FROM fx_citations",
        ),
        "citation_format": with_(CITE, select=f"SELECT case_key, {FORMATTED} AS citation FROM fx_citations"),
        "relation_status": with_(
            *ANSWERS, select="SELECT request_id, case_id, caseref_type, status, error, len(items) AS n_items FROM answers"
        ),
        "relation_items": with_(*ITEMS, select="SELECT request_id, pos, title, citation, caseId FROM item_texts"),
        "relation_counts": with_(
            *ANSWERS, LATEST,
            select="SELECT replace(lower(case_id), '-', '') AS decision, caseref_type, status, error, len(items) AS n_items"
            " FROM answers WHERE request_id IN (SELECT request_id FROM latest)",
        ),
        "relation_edges": with_(
            *ANSWERS, LATEST, CITE,
            select="""SELECT case_key, lower(court) AS court_key, replace(lower(uid), '-', '') AS decision, caseref_type, error, len(items) AS n_items
FROM fx_citations JOIN answers ON replace(lower(uid), '-', '') = replace(lower(case_id), '-', '')
WHERE court IS NOT NULL AND uid IS NOT NULL AND request_id IN (SELECT request_id FROM latest)
UNION ALL SELECT case_key, NULL, NULL, NULL, 'Could not parse citation: ' || raw_citation, 0 FROM fx_citations WHERE court IS NULL OR uid IS NULL""",
        ),
        "related_citation": with_(*RELATED[:-3], select="SELECT request_id, pos, citation FROM related"),
        "related_cases": with_(*RELATED, select="SELECT request_id, pos, citation, metadata_citation, case_id FROM related_known"),
        "related_cases_by_name": with_(
            *NAMED,
            select="""SELECT n.request_id, CAST(n.pos AS BIGINT) AS pos, n.citation, m.citation AS metadata_citation, m.case_id
FROM named n LEFT JOIN aliases a ON a.alias = n.name LEFT JOIN aliases t ON t.alias = n.title JOIN metadata m ON m.decision = coalesce(a.decision, t.decision)""",
        ),
        "citation_edges": with_(
            *ITEMS, LATEST, *LINKS,
            (
                "told",
                f"""SELECT replace(lower(case_id), '-', '') AS decision, caseref_type, {decision_in('coalesce(citation, caseId)')} AS other
FROM item_texts WHERE request_id IN (SELECT request_id FROM latest) AND caseref_type IN ('citedCases', 'citingCases') AND coalesce(citation, caseId) IS NOT NULL""",
            ),
            (
                "both_ways",
                """SELECT decision AS citing, other AS name, 'citing' AS teller FROM told WHERE caseref_type = 'citedCases'
UNION ALL SELECT other, decision, 'cited' FROM told WHERE caseref_type = 'citingCases'""",
            ),
            select=f"""SELECT 'case' AS kind, citing, name, NULL AS section, max(teller) = 'citing' AS told_by_citing, min(teller) = 'cited' AS told_by_cited,
  CAST(NULL AS BIGINT) AS n_paragraphs FROM both_ways WHERE citing <> name GROUP BY citing, name
UNION ALL SELECT 'statute', {decision_in('c.citation')} AS citing, name, section, NULL, NULL, CAST(sum(len(paras)) AS BIGINT)
FROM grouped JOIN cases c USING (doc_id) WHERE c.citation <> '' GROUP BY ALL""",
        ),
        "case_report": _reports(),
        # The page a report comes from, as HTML or stored, makes no difference to it.
        "page_report": _reports(),
        "chosen_case_report": f"SELECT * FROM ({_reports()}) r WHERE doc_id BETWEEN 1 AND 59",
    }
