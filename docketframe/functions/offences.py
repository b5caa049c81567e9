"""Offence-code helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketframe.functions.text import strip

# Fixed values.
CODE_PREFIX = "cc"
YCJA_SUFFIX = "_ycja"
YCJA_LABEL = " (YCJA)"


def offence_variant(code: Column) -> Column:
    """The other common spelling of a stripped code: ``cc_1`` <-> ``cc1``, ``1`` -> ``cc_1``."""
    rest = F.substr(code, F.lit(len(CODE_PREFIX) + 1))
    return (
        F.when(~code.startswith(CODE_PREFIX), F.concat(F.lit(f"{CODE_PREFIX}_"), code))
        .when(rest.startswith("_"), F.concat(F.lit(CODE_PREFIX), F.substr(rest, F.lit(2))))
        .otherwise(F.concat(F.lit(f"{CODE_PREFIX}_"), rest))
    )


def offence_variants(code: Column) -> Column:
    """Spellings to try, the given one first, without repeats."""
    code = strip(code)
    return F.array_distinct(F.array(code, offence_variant(code)))


def codes_resolving_to(section: Column) -> Column:
    """All codes whose ``offence_variant`` is the given section (inverse of the above)."""
    with_bar = section.startswith(f"{CODE_PREFIX}_")
    after_bar = F.substr(section, F.lit(len(CODE_PREFIX) + 2))
    after_prefix = F.substr(section, F.lit(len(CODE_PREFIX) + 1))
    candidates = F.array(
        F.when(with_bar & ~after_bar.startswith(CODE_PREFIX), after_bar),
        F.when(with_bar & ~after_bar.startswith("_"), F.concat(F.lit(CODE_PREFIX), after_bar)),
        F.when(section.startswith(CODE_PREFIX), F.concat(F.lit(f"{CODE_PREFIX}_"), after_prefix)),
    )
    return F.filter(candidates, lambda code: code.isNotNull() & (code == strip(code)))


def has_ycja(code: Column) -> Column:
    return F.contains(code, F.lit(YCJA_SUFFIX))


def without_ycja(code: Column) -> Column:
    return F.replace(code, F.lit(YCJA_SUFFIX), F.lit(""))
