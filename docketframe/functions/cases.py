"""Column functions over the Markdown text of court decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketframe.functions.text import WS, let, lstrip, literal_pattern, rstrip, strip, text_after, text_before

# Markers of the page layout.
CHUNK_SEPARATOR = "\n\n__\n"
MIN_CHUNKS = 4
HEADER_CHUNK_MARKER = "Loading paragraph markers"
HEADER_START_MARKERS = [
    "Loading paragraph markers __\n",
    "Chargement des marqueurs de paragraphe __\n",
]
HEADING_MARKER_PATTERN = rf"\*\*{WS}*_{WS}*_{WS}*\*\*"
CITATION_PATTERN = r"(?s)# (.*?) \(CanLII\) "
BANNER_PATTERN = r"(?s)^([^!]*+)!.*?PDF"
BODY_END_MARKER = "Back to top"
HEADER_NOISE_MARKER = "Most recent unfavourable mention"
PARAGRAPH_SEPARATOR_PATTERN = r"\n+__\n+"
NUMBER_END = "] "
NUMBER_WINDOW = 10


def chunks(markdown: Column, separator: str) -> Column:
    """Non-blank stripped pieces between separators."""
    pieces = F.transform(F.split(markdown, literal_pattern(separator)), strip)
    return F.filter(pieces, lambda piece: piece != "")


def header_chunk(pieces: Column) -> Column:
    """First chunk holding the loading marker, NULL when no chunk does."""
    return F.get(F.filter(pieces, lambda piece: F.contains(piece, F.lit(HEADER_CHUNK_MARKER))), F.lit(0))


def clean_header(header: Column) -> Column:
    """Text after the last loading-marker line of either language, stripped."""

    def after_markers(text: Column) -> Column:
        # Each tail is a suffix of the text: the shorter one starts after the later marker.
        tails = [F.substring_index(text, marker, -1) for marker in HEADER_START_MARKERS]
        return F.when(F.length(tails[0]) <= F.length(tails[1]), tails[0]).otherwise(tails[1])

    return strip(let(header, after_markers))


def heading_split(header: Column) -> Column:
    """Struct of ``header`` and the ``heading`` after its last heading marker.

    Without a marker, or with nothing after it, the header stays whole and the
    heading is empty.
    """

    def parts(text: Column) -> Column:
        marker = F.try_element_at(F.regexp_extract_all(text, F.lit(HEADING_MARKER_PATTERN), F.lit(0)), F.lit(-1))
        tail = F.element_at(F.split(text, HEADING_MARKER_PATTERN), -1)
        kept = F.substr(text, F.lit(1), F.length(text) - F.length(tail) - F.length(marker))
        return F.when(
            marker.isNotNull() & (strip(tail) != ""),
            F.struct(rstrip(kept).alias("header"), strip(tail).alias("heading")),
        ).otherwise(F.struct(text.alias("header"), F.lit("").alias("heading")))

    return let(header, parts)


def extract_citation(header: Column) -> Column:
    """Text between ``# `` and the next `` (CanLII) ``; empty when either is missing."""
    return strip(F.regexp_extract(header, CITATION_PATTERN, 1))


def clean_text(text: Column) -> Column:
    """Normalise whitespace of a section, keeping breaks next to ``__`` marks."""
    # Each rule is tried only where the texts it needs are found.
    steps = [
        ("PDF", BANNER_PATTERN, "$1"),
        # Line breaks that touch no "__" are soft. The break comes first in the
        # pattern, so that the look behind runs at breaks only.
        ("\n", r"\n(?<!__\n)(?!__)", " "),
        # After this no break is followed by whitespace, so blank lines are gone too.
        ("\n", rf"\n{WS}+", "\n"),
        ("  ", "  +", " "),
        # Separator runs: three or more spaced stars. Possessive, so that a very
        # long run neither backtracks nor recurses.
        ("*", rf"\*(?:{WS}++\*){{2,}}+", ""),
    ]
    for part, pattern, replacement in steps:
        text = let(text, lambda x: F.when(F.contains(x, F.lit(part)), F.regexp_replace(x, pattern, replacement)).otherwise(x))
    return strip(text)


def paragraphs(body: Column) -> Column:
    """Non-blank paragraphs without their leading ``[n] `` number."""

    def unnumbered(part: Column) -> Column:
        at = F.instr(F.substr(part, F.lit(1), F.lit(NUMBER_WINDOW)), NUMBER_END)
        return F.when(at > 0, lstrip(F.substr(part, at + len(NUMBER_END)))).otherwise(part)

    parts = F.transform(F.transform(F.split(body, PARAGRAPH_SEPARATOR_PATTERN), strip), unnumbered)
    return F.filter(parts, lambda part: part != "")


def body_paragraphs(body: Column, section_heading: Column) -> Column:
    """Cleaned paragraphs of a body up to its end marker; the section heading opens the first."""
    raw = paragraphs(text_before(body, BODY_END_MARKER))
    lead = F.when(section_heading != "", F.concat(section_heading, F.lit("\n\n"))).otherwise(F.lit(""))
    return F.transform(
        raw,
        lambda part, i: F.when(i == 0, F.concat(lead, clean_text(part))).otherwise(clean_text(part)),
    )


def report_header(header: Column) -> Column:
    """Header as shown in a report: no tracking lines, no emphasis marks, single spaces."""
    text = F.translate(text_after(header, HEADER_NOISE_MARKER), "*_", "")
    return F.regexp_replace(text, f"{WS}+", " ")
