"""HTML pages to Markdown as native string and array expressions.

Covers headings, links, emphasis, nested and numbered lists, definition lists, table cells, quotes, preformatted text, rules, line
breaks, block elements and character references; scripts, styles, comments and the document head are dropped. A page is cut
at its links, list tags, quotes, preformatted parts and references, and what a piece becomes depends on its place among
the pieces, so an element that is never closed costs no more than one that is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketframe.functions.text import let, strip

# Lists nested deeper are indented and marked like those at this depth, so that a page of opening tags stays small.
DEEPEST = 12
# Tags that are folded in one go.
RUN = 256
# Stand-ins for characters of preformatted text, and for the borders of quotes, until the rest is done.
NEW_LINE, SPACE, QUOTE, END_OF_QUOTE = "\x01", "\x02", "\x03", "\x04"

# Rules: a pattern, its replacement, and texts of which every match holds one; a page without any of them is not searched.
HIDDEN = [
    (f"[{NEW_LINE}{SPACE}{QUOTE}{END_OF_QUOTE}]", "", [NEW_LINE, SPACE, QUOTE, END_OF_QUOTE]),
    (r"(?s)<!--.*?(?:-->|\z)", "", ["<!--"]),
    (r"(?is)\A((?>.*?<head\b)).*?</head\s*>", "", ["</h", "</H"]),
    (r"(?is)<script\b.*?(?:</script\s*>|\z)", "", ["<s", "<S"]),
    (r"(?is)<style\b.*?(?:</style\s*>|\z)", "", ["<s", "<S"]),
]
INLINE = [
    (r"(?i)</?(?:b|strong)(?: [^<>]*)?>", "**", ["<b>", "<B>", "<b ", "<B ", "</b", "</B", "<s", "<S", "</s", "</S"]),
    (r"(?i)</?(?:i|em)(?: [^<>]*)?>", "_", ["<i", "<I", "</i", "</I", "<e", "<E", "</e", "</E"]),
    *((rf"(?i) ?<h{n}(?: [^<>]*)?> ?", "\n\n" + "#" * n + " ", [f"<h{n}", f"<H{n}"]) for n in range(1, 7)),
]
LIST_TAG = r"(?i) ?</?(?:ol|ul|li)(?: [^<>]*)?> ?"
LIST_STARTS = [f"<{slash}{letter}" for slash in ("", "/") for letter in "oOuUlL"]
CELL_STARTS = [f"<{slash}{letter}" for slash in ("", "/") for letter in "tT"]
ENTRY_STARTS = ["<dt", "<dT", "<Dt", "<DT", "<dd", "<dD", "<Dd", "<DD"]
BLOCKS = [
    (r"(?i) ?<hr ?(?: [^<>]*)?/?> ?", "\n\n* * *\n\n", ["<h", "<H"]),
    (r"(?i) ?<br ?/?> ?", "  \n", ["<br", "<bR", "<Br", "<BR"]),
    # The first cell of a row needs no border.
    (r"(?i) ?<tr(?: [^<>]*)?> ?(?:<t[dh](?: [^<>]*)?> ?)?", "\n", CELL_STARTS[:2]),
    (r"(?i) ?(?:</t[dh] ?> ?)?<t[dh](?: [^<>]*)?> ?", "| ", CELL_STARTS[:2]),
    (r"(?i) ?</(?:tr|t[dh]) ?> ?", "", CELL_STARTS[2:]),
    (r"(?i) ?(?:</d[td] ?> ?)?<dt(?: [^<>]*)?> ?", "\n", ENTRY_STARTS[:4]),
    (r"(?i) ?(?:</d[td] ?> ?)?<dd(?: [^<>]*)?> ?", "\n    ", ENTRY_STARTS[4:]),
    (r"(?i) ?<blockquote(?: [^<>]*)?> ?", f"\n\n{QUOTE}", ["<bl", "<bL", "<Bl", "<BL"]),
    (r"(?i) ?</blockquote ?> ?", f"{END_OF_QUOTE}\n\n", ["</bl", "</bL", "</Bl", "</BL"]),
    (r"(?i) ?</?(?:p|div|dl|article|section|header|nav|footer|table|h[1-6])(?: [^<>]*)?> ?", "\n\n", ["<"]),
    (r"</?[a-zA-Z!?][^<>]*>", "", ["<"]),
    (r"\n{3,}", "\n\n", ["\n\n\n"]),
]
# Named character references: all of HTML 4, of which these have a plainer spelling (fixed values).
PLAIN = {
    "nbsp": " ", "copy": "(C)", "middot": "*", "mdash": "--", "ndash": "-", "lsquo": "'", "rsquo": "'", "ldquo": '"', "rdquo": '"',
    "apos": "'",
}
REFERENCES = {**{name: chr(code) for name, code in name2codepoint.items()}, **PLAIN}


def holds(text: Column, parts: list[str]) -> Column:
    """Whether the text has any of the parts; bytes are compared, which takes a fraction of a pattern's time."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(part)) for part in parts))


def replaced(text: Column, rules: list[tuple[str, str, list[str]]]) -> Column:
    for pattern, replacement, parts in rules:
        text = let(text, lambda x: F.when(holds(x, parts), F.regexp_replace(x, pattern, replacement)).otherwise(x))
    return text


def pieces(text: Column, border: str, body: Callable[[Column, Column], Column]) -> Column:
    """The text cut at each border, every piece but the first replaced by ``body(piece)``, put together again."""
    return F.array_join(F.transform(F.split(text, border), lambda piece, i: F.when(i == 0, piece).otherwise(body(piece))), "")


def preformatted(text: Column) -> Column:
    """Preformatted parts as blocks of indented lines, their white space kept from later rules."""

    def block(piece: Column) -> Column:
        sides = F.split(piece, r"(?i)</pre ?>", 2)
        lines = F.regexp_replace(F.get(sides, F.lit(0)), r"\A\r?\n|\r?\n\z", "")
        kept = F.translate(F.regexp_replace(lines, r"\r\n?|\n", "\n    "), "\n ", NEW_LINE + SPACE)
        border = NEW_LINE * 2
        return F.concat(F.lit(border + SPACE * 4), kept, F.lit(border), F.coalesce(F.get(sides, F.lit(1)), F.lit("")))

    return let(text, lambda x: F.when(holds(x, ["<p", "<P"]), pieces(x, r"(?i) ?<pre(?: [^<>]*)?>", block)).otherwise(x))


def links(text: Column) -> Column:
    def link(piece: Column) -> Column:
        attributes = F.substring_index(piece, ">", 1)
        rest = F.split(F.substr(piece, F.length(attributes) + 2), r"(?i)</a ?>", 2)
        address = F.regexp_extract(attributes, r"(?i)\bhref ?= ?([\"'])([^\"']*)\1", 2)
        quoted = F.rlike(attributes, F.lit(r"(?i)\bhref ?= ?([\"'])[^\"']*\1"))
        closed = (F.size(rest) == 2) & (F.length(attributes) < F.length(piece)) & quoted
        return F.when(
            closed, F.concat(F.lit("["), F.get(rest, F.lit(0)), F.lit("]("), address, F.lit(")"), F.get(rest, F.lit(1)))
        ).otherwise(F.concat(F.lit("<a"), piece))

    return let(text, lambda x: F.when(holds(x, ["<a ", "<A "]), pieces(x, r"(?i)<a(?= )", link)).otherwise(x))


def single_spaces(text: Column) -> Column:
    """White space as single spaces; a text that has it so already is not searched."""
    return F.when(holds(text, ["\t", "\r", "\n", "  "]), F.regexp_replace(text, r"[ \t\r\n]+", " ")).otherwise(text)


def lists(text: Column) -> Column:
    """Items of lists behind a mark, indented by the depth of their list, numbered in numbered ones.

    The tags are folded with the open lists as state: each is -1, or the number of the last item. An item outside of any
    list is one of a plain list, and a closing tag without an opening one does nothing.
    """

    def step(state: Column, tag: Column) -> Column:
        open_, name = state["open"], F.lower(F.regexp_extract(tag, "</?([a-zA-Z]+)", 1))
        depth, closing = F.size(open_), F.contains(tag, F.lit("</"))
        outer = F.slice(open_, 1, F.greatest(depth - 1, F.lit(0)))
        last = F.coalesce(F.get(open_, depth - 1), F.lit(-1))
        first = F.regexp_extract(tag, r"(?i)\bstart ?= ?[\"']?([0-9]{1,9})", 1)
        before = F.when(first == "", 0).otherwise(first.cast("int") - 1)
        number = F.when(last >= 0, last + 1).otherwise(-1)
        mark = F.when(last >= 0, F.concat(number.cast("string"), F.lit(". "))).otherwise("* ")
        opened = F.concat(open_, F.array(F.when(name == "ol", before).otherwise(-1)))
        now = (
            F.when(name != "li", F.when(closing, outer).when(depth == DEEPEST, open_).otherwise(opened))
            .when(closing | (depth == 0), open_).otherwise(F.concat(outer, F.array(number)))
        )
        outermost = F.when(closing, depth == 1).otherwise(depth == 0)
        shown = (
            F.when(name != "li", F.when(outermost, "\n\n").otherwise(""))
            .when(closing, "").otherwise(F.concat(F.lit("\n"), F.repeat(F.lit("  "), F.greatest(depth, F.lit(1))), mark))
        )
        return F.struct(now.alias("open"), F.concat(state["marks"], F.array(shown)).alias("marks"))

    # In runs, so that the marks made so far are not copied for every tag.
    def run(tags: Column, state: Column, at: Column) -> Column:
        begin = F.struct(state["open"].alias("open"), F.array().cast("array<string>").alias("marks"))
        folded = F.aggregate(F.slice(tags, at, RUN), begin, step)
        return let(folded, lambda end: F.struct(end["open"].alias("open"), F.concat(state["runs"], F.array(end["marks"])).alias("runs")))

    def in_runs(tags: Column) -> Column:
        none = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<array<string>>").alias("runs"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(tags), F.lit(1)), F.lit(RUN)), none, lambda state, at: run(tags, state, at), lambda state: F.flatten(state["runs"]))

    marks = let(F.regexp_extract_all(text, F.lit(LIST_TAG), F.lit(0)), in_runs)
    joined = F.zip_with(F.split(text, LIST_TAG), marks, lambda piece, mark: F.concat(piece, F.coalesce(mark, F.lit(""))))
    return F.when(holds(text, LIST_STARTS) & F.rlike(text, F.lit(LIST_TAG)), F.array_join(joined, "")).otherwise(text)


def quotes(text: Column) -> Column:
    """Lines of a quote behind ``>``; a quote that is never closed goes to the end."""

    def quote(piece: Column) -> Column:
        inside = strip(F.substring_index(piece, END_OF_QUOTE, 1))
        rest = F.substr(piece, F.length(F.substring_index(piece, END_OF_QUOTE, 1)) + 1)
        return F.concat(F.when(inside != "", F.concat(F.lit("> "), F.replace(inside, F.lit("\n"), F.lit("\n> ")))).otherwise(""), rest)

    return F.when(F.contains(text, F.lit(QUOTE)), F.replace(pieces(text, QUOTE, quote), F.lit(END_OF_QUOTE), F.lit(""))).otherwise(text)


def decode_references(text: Column) -> Column:
    """``&#233;``, ``&#xE9;`` and ``&eacute;`` to their characters, once; anything else stays as it is."""
    names = F.create_map(*(F.lit(x) for pair in REFERENCES.items() for x in pair))

    def numbered(name: Column) -> Column:
        digits = F.substr(name, F.lit(2))
        hex_digits = F.ltrim(F.lower(digits), F.lit("x"))
        code = F.when(digits.rlike("^[xX]"), F.conv(hex_digits, 16, 10)).otherwise(digits).try_cast("bigint")
        usable = lambda c: ((c > 0) & (c < 0xD800)) | ((c > 0xDFFF) & (c <= 0x10FFFF))
        return let(code, lambda c: F.when((c >= 0x20) & (c < 0x7F) | (c == 10), F.char(c)).when(usable(c), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")))

    def decoded(piece: Column) -> Column:
        def shown(reference: Column) -> Column:
            name = F.rtrim(reference, F.lit(";"))
            character = F.when(reference == "", None).when(F.startswith(name, F.lit("#")), numbered(name)).otherwise(F.try_element_at(names, name))
            return F.coalesce(F.concat(character, F.substr(piece, F.length(reference) + 1)), F.concat(F.lit("&"), piece))

        return let(F.regexp_extract(piece, r"^(?:#(?:[xX]0*[0-9a-fA-F]{1,6}|0*[0-9]{1,7})|[a-zA-Z][a-zA-Z0-9]{1,9});", 0), shown)

    return F.when(F.contains(text, F.lit("&")), pieces(text, "&", decoded)).otherwise(text)


def markdown_of(html: Column) -> Column:
    steps = [
        lambda text: preformatted(replaced(text, HIDDEN)),
        lambda text: links(single_spaces(text)),
        lambda text: replaced(text, INLINE),
        lists,
        lambda text: replaced(text, BLOCKS),
        quotes,
        decode_references,
        lambda text: strip(F.when(holds(text, [NEW_LINE, SPACE]), F.translate(text, NEW_LINE + SPACE, "\n ")).otherwise(text)),
    ]
    # Each step's text is worked out once, however often the next one uses it.
    text = html
    for step in steps:
        text = let(text, step)
    return text
