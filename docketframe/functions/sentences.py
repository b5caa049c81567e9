"""Column parsers for the eight text columns of a sentence table.

Each public function takes the raw column and returns a struct or scalar
column. A blank cell (NULL, empty or only whitespace) means "absent".

Parsers with steps that are used several times expose the steps as well: the
public function binds them with ``let``, while a job over whole rows lays them
out as columns of successive projections, which generated code runs faster.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketframe.functions.text import WS, cell, cut, let

# Grammar of the columns.
SENTENCE_COLUMNS = ["uid", "offence", "date", "jail", "mode", "conditions", "fine", "appeal"]
DEFAULT_DEFENDANT = "a"
INDETERMINATE = "indeterminate"
DURATION_PATTERN = rf"(?i)(\d+(?:\.\d+)?){WS}*([ymd])"
CONDITION_PATTERN = (
    rf"(?i)^{WS}*(\d+(?:\.\d+)?){WS}*([ymd]){WS}*-(probation|discharge|ltso|ircs|parole){WS}*$"
)
DAYS_PER_UNIT = {"y": 365.0, "m": 30.0, "d": 1.0}
DAYS_IN_TWELVE_MONTHS = 365.0
UNIT_NAMES = {"y": "year", "m": "month", "d": "day"}
# Numbers as a float reader takes them, digit-grouping underscores included.
NUMBER_PATTERN = (
    r"^[+-]?(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?$"
)

COMPONENTS_TYPE = "array<struct<quantity:double,unit:string>>"


# uid ---------------------------------------------------------------------

def uid_parts(uid: Column) -> Column:
    """``case_docket_count_defendant`` -> struct; missing defendant is ``a``."""
    return uid_parts_of(cell(uid))


def uid_parts_of(uid: Column) -> Column:
    parts = F.split(uid, "_")
    return F.struct(
        F.get(parts, F.lit(0)).alias("case_id"),
        F.get(parts, F.lit(1)).alias("docket"),
        F.get(parts, F.lit(2)).alias("count"),
        F.coalesce(F.get(parts, F.lit(3)), F.lit(DEFAULT_DEFENDANT)).alias("defendant"),
    )


def case_id(uid: Column) -> Column:
    """First part of the uid only."""
    return F.substring_index(cell(uid), "_", 1)


# date --------------------------------------------------------------------

def date_parts(date: Column) -> Column:
    """One date, or a ``start&end`` range. Values stay text."""
    return date_parts_of(cell(date))


def date_parts_of(date: Column) -> Column:
    ranged = F.contains(date, F.lit("&"))
    start, end = cut(F.when(ranged, date), "&")
    return F.struct(
        F.when(~ranged, date).alias("offence_date"),
        start.alias("offence_start_date"),
        end.alias("offence_end_date"),
    )


# jail --------------------------------------------------------------------

def jail_matches(jail: Column) -> Column:
    """All ``number unit`` texts in a jail cell, found in one regex pass."""
    return F.regexp_extract_all(jail, F.lit(DURATION_PATTERN), F.lit(0))


def jail_components_of(jail: Column, matches: Column) -> Column:
    def component(match: Column) -> Column:
        return F.struct(
            F.regexp_extract(match, r"^[0-9.]+", 0).cast("double").alias("quantity"),
            F.lower(F.right(match, F.lit(1))).alias("unit"),
        )

    return F.when(jail.isNull(), F.array().cast(COMPONENTS_TYPE)).when(
        (F.lower(jail) != INDETERMINATE) & (F.size(matches) > 0), F.transform(matches, component)
    )


def jail_components(jail: Column) -> Column:
    """Blank -> empty array; indeterminate or unrecognised -> NULL."""
    return let(cell(jail), lambda text: let(jail_matches(text), lambda m: jail_components_of(text, m)))


def component_days(quantity: Column, unit: Column) -> Column:
    """Days of one component; exactly twelve months count as a year, unknown units as nothing."""
    days = F.when(unit.isin("m", "M") & (quantity == 12), F.lit(DAYS_IN_TWELVE_MONTHS))
    for name, factor in DAYS_PER_UNIT.items():
        days = days.when(unit.isin(name, name.upper()), quantity * factor)
    return days.otherwise(F.lit(0.0))


def custody_days(components: Column) -> Column:
    """Whole days of a component array (truncated); NULL array, or more days than a BIGINT holds -> NULL."""
    total = F.aggregate(
        components,
        F.lit(0.0),
        lambda days, c: days + component_days(c["quantity"], c["unit"]),
    )
    return total.try_cast("bigint")


def jail_summary_of(jail: Column, components: Column) -> Column:
    indeterminate = F.coalesce(F.lower(jail) == INDETERMINATE, F.lit(False))
    return F.struct(
        components.alias("components"),
        custody_days(components).alias("total_days"),
        indeterminate.alias("is_indeterminate"),
        (components.isNull() & ~indeterminate).alias("is_unrecognized"),
    )


def jail_summary(jail: Column) -> Column:
    return let(
        cell(jail),
        lambda text: let(
            let(jail_matches(text), lambda m: jail_components_of(text, m)),
            lambda components: jail_summary_of(text, components),
        ),
    )


# mode --------------------------------------------------------------------

def mode_parts(mode: Column) -> Column:
    """``type-mode`` split at the first hyphen."""
    return mode_parts_of(cell(mode))


def mode_parts_of(mode: Column) -> Column:
    kind, served = cut(mode, "-")
    return F.struct(kind.alias("jail_type"), served.alias("sentence_mode"))


# conditions --------------------------------------------------------------

def conditions_parts(conditions: Column) -> Column:
    """``18m-probation`` -> time, unit, type plus their display forms."""
    return let(let(conditions_accepted(cell(conditions)), conditions_pieces), conditions_shown)


def conditions_accepted(conditions: Column) -> Column:
    """The cell in lower case when it fits the grammar, else NULL."""
    return F.when(conditions.rlike(CONDITION_PATTERN), F.lower(conditions))


def conditions_pieces(accepted: Column) -> Column:
    # In an accepted cell the number comes first, the first letter is the unit
    # and the only hyphen stands before the type.
    return F.struct(
        F.regexp_extract(accepted, r"^[0-9.]+", 0).cast("double").alias("time"),
        F.regexp_extract(accepted, "[ymd]", 0).alias("unit"),
        F.substring_index(accepted, "-", -1).alias("type"),
    )


def conditions_shown(pieces: Column) -> Column:
    time, unit, kind = pieces["time"], pieces["unit"], pieces["type"]
    return F.struct(
        time.alias("time"),
        unit.alias("unit"),
        unit_display(time, unit).alias("unit_display"),
        kind.alias("type"),
        type_display(time, kind).alias("type_display"),
    )


def unit_display(time: Column, unit: Column) -> Column:
    name = F.lit("unknown")
    for short, long in UNIT_NAMES.items():
        name = F.when(unit == short, F.lit(long)).otherwise(name)
    return F.concat(name, F.when(time != 1, F.lit("s")).otherwise(F.lit("")))


def type_display(time: Column, kind: Column) -> Column:
    discharge = kind == "discharge"
    return (
        F.when(discharge & (time == 0), F.lit("absolute discharge"))
        .when(discharge & time.isNotNull(), F.lit("conditional discharge"))
        .otherwise(kind)
    )


# fine --------------------------------------------------------------------

def fine_amount(fine: Column) -> Column:
    """Amount as ``$1234.50`` text; NULL when the cell is no number."""
    return let(
        let(fine, fine_digits), lambda digits: let(fine_value(digits), lambda value: fine_shown(digits, value))
    )


def fine_digits(fine: Column) -> Column:
    return cell(F.translate(fine, "$,", ""))


def fine_value(digits: Column) -> Column:
    return F.when(digits.rlike(NUMBER_PATTERN), F.translate(digits, "_", "").cast("double"))


def fine_shown(digits: Column, value: Column) -> Column:
    word = F.lower(F.when(value.isNull(), digits))
    return (
        F.when(value == float("inf"), F.lit("$inf"))
        .when(value == float("-inf"), F.lit("$-inf"))
        .when(value.isNotNull(), F.format_string("$%.2f", value))
        .when(word.isin("nan", "+nan", "-nan"), F.lit("$nan"))
        .when(word.isin("inf", "+inf", "infinity", "+infinity"), F.lit("$inf"))
        .when(word.isin("-inf", "-infinity"), F.lit("$-inf"))
    )


# appeal ------------------------------------------------------------------

def appeal_parts(appeal: Column) -> Column:
    """``court_result`` split at the first underscore."""
    return appeal_parts_of(cell(appeal))


def appeal_parts_of(appeal: Column) -> Column:
    court, result = cut(appeal, "_")
    return F.struct(court.alias("court"), result.alias("result"))
