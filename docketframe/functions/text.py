"""Text helpers shared by every parser. All are native Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex class. Java's \s is ASCII only and (?U)\s leaves out
# the four ASCII separators, so the class is spelled out.
WS = "[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(text: Column) -> Column:
    """Drop whitespace of any kind at both ends (``trim`` alone drops spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def text_or_null(text: Column) -> Column:
    """Stripped text, NULL when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def cell(text: Column) -> Column:
    """``text_or_null`` for table cells, nearly all of which need no stripping.

    A text that begins and ends with a visible ASCII character is passed on
    after two comparisons. Uses ``text`` several times: give it a column, or an
    expression generated code can share.
    """
    text = text.cast("string")
    visible = (text >= "!") & (text < "\x7f") & F.right(text, F.lit(1)).between("!", "~")
    return F.when(visible, text).otherwise(text_or_null(text))


def cut(text: Column, separator: str) -> tuple[Column, Column]:
    """Cell sides of the first separator, blank ones NULL; without it all is left.

    Written without branches, so that generated code shares the common parts.
    """
    left = F.substring_index(text, separator, 1)
    return cell(left), cell(F.substr(text, F.length(left) + len(separator) + 1))


def text_before(text: Column, target: str) -> Column:
    """Everything before the first occurrence of target; all of it when absent."""
    return F.substring_index(text, target, 1)


def text_after(text: Column, target: str) -> Column:
    """Everything after the first occurrence of target; all of it when absent."""
    at = F.instr(text, target)
    return F.when(at > 0, F.substr(text, at + len(target))).otherwise(text)


def literal_pattern(text: str) -> str:
    """A regex matching ``text`` as it stands."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind an inline of a one-element array.

    The optimizer neither merges expressions across it nor moves filters below
    it, so costly columns that later steps filter by or use several times are
    worked out once per row.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def free_name(wanted: str, taken: list[str]) -> str:
    """The name, with underscores in front if a column of that name is taken already (in any case of letters)."""
    lower = {name.lower() for name in taken}
    while wanted.lower() in lower:
        wanted = "_" + wanted
    return wanted
