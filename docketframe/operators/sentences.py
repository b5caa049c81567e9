"""Jobs over sentence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketframe.functions import sentences as S
from docketframe.functions.text import evaluate_once, text_or_null
from docketframe.operators.joins import BROADCAST_LIMIT
from docketframe.operators.offences import resolve_offences


def canonical_sentences(df: DataFrame, keep: list[str] | None = None, by_position: bool = False) -> DataFrame:
    """The eight sentence columns as text, in order; missing ones are ``''``, extra ones go.

    Columns are found by name, or by position with ``by_position``. ``keep``
    names further columns to carry along in front.
    """
    keep = keep or []
    if by_position:
        rest = [c for c in df.columns if c not in keep]
        source = dict(zip(S.SENTENCE_COLUMNS, rest))
    else:
        source = {c: c for c in S.SENTENCE_COLUMNS if c in df.columns}
    return df.select(
        *keep,
        *[
            (F.col(f"`{source[c]}`").cast("string") if c in source else F.lit("")).alias(c)
            for c in S.SENTENCE_COLUMNS
        ],
    )


def parse_sentences(
    df: DataFrame,
    offences: DataFrame,
    keep: list[str] | None = None,
    match_plain_variants: bool = False,
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Sentence rows to typed nested rows.

    A narrow job: one scan, one lookup join, no shuffle while the offence table
    stays under the broadcast limit. Each cell is stripped once; a reader that
    takes only some fields pays only for the parsers behind them.
    """
    return _parse_cells(_cells(df, keep or []), offences, keep or [], match_plain_variants, broadcast_limit)


def _cells(df: DataFrame, keep: list[str]) -> DataFrame:
    # ``text_or_null`` and not ``cell``: eight of the latter in one projection
    # make a method too large for the JVM to compile.
    return canonical_sentences(df, keep).select(
        *keep, *[text_or_null(F.col(c)).alias(c) for c in S.SENTENCE_COLUMNS]
    )


def _parse_cells(
    cells: DataFrame, offences: DataFrame, keep: list[str], match_plain_variants: bool, broadcast_limit: int
) -> DataFrame:
    resolved = resolve_offences(
        cells,
        offences,
        match_plain_variants=match_plain_variants,
        broadcast_limit=broadcast_limit,
        stripped=True,
    )
    # Steps that later steps use several times become columns of their own.
    jail, digits = F.col("jail"), F.col("__digits")
    steps = resolved.select(
        "*",
        S.jail_matches(jail).alias("__matches"),
        S.conditions_accepted(F.col("conditions")).alias("__accepted"),
        S.fine_digits(F.col("fine")).alias("__digits"),
    ).select(
        "*",
        S.jail_components_of(jail, F.col("__matches")).alias("__components"),
        S.conditions_pieces(F.col("__accepted")).alias("__pieces"),
        S.fine_value(digits).alias("__value"),
    )
    return steps.select(
        *keep,
        S.uid_parts_of(F.col("uid")).alias("uid"),
        F.col("offence"),
        S.date_parts_of(F.col("date")).alias("date"),
        S.jail_summary_of(jail, F.col("__components")).alias("jail"),
        S.mode_parts_of(F.col("mode")).alias("mode"),
        S.conditions_shown(F.col("__pieces")).alias("conditions"),
        S.fine_shown(digits, F.col("__value")).alias("fine"),
        S.appeal_parts_of(F.col("appeal")).alias("appeal"),
    )


def sentences_as_json(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Each parsed row as one JSON text, absent values written as null."""
    keep = keep or []
    fields = [c for c in parsed.columns if c not in keep]
    return parsed.select(*keep, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def sentences_for_case(df: DataFrame, case: str) -> DataFrame:
    """Rows whose uid belongs to the case.

    The second condition follows from the first and can be checked on the
    stored uid: it starts with the case, or with whitespace (which sorts below
    ``!`` or outside ASCII). Parquet readers skip row groups by it.
    """
    uid = F.col("uid")
    stored = uid.startswith(case) | (uid < "!") | (uid >= "\x80")
    return df.where(stored & (S.case_id(uid) == case))


def sentence_counts(df: DataFrame) -> DataFrame:
    """Sentences per case; rows without a case are left out."""
    return (
        evaluate_once(df.select("uid"), case_id=S.case_id(F.col("uid")))
        .where(F.col("case_id") != "")
        .groupBy("case_id")
        .agg(F.count(F.lit(1)).alias("n_sentences"))
    )


def cases_with_many_sentences(df: DataFrame) -> DataFrame:
    """Cases with more than one sentence."""
    return sentence_counts(df).where(F.col("n_sentences") > 1)


def case_sentences(df: DataFrame, offences: DataFrame, match_plain_variants: bool = False) -> DataFrame:
    """Parsed sentences with their case: ``case_id, key`` (the uid) and the parsed fields, one row per sentence.

    Rows without a case are left out. The job is as narrow as the parse: write the rows partitioned or bucketed by
    ``case_id`` to have them by case; no group is built, so a case may hold any share of them.
    """
    rows = evaluate_once(_cells(df, []), case_id=F.substring_index("uid", "_", 1)).where(F.col("case_id") != "")
    keep = ["case_id", "key"]
    return _parse_cells(rows.withColumn("key", F.col("uid")), offences, keep, match_plain_variants, BROADCAST_LIMIT)


def total_days(components: DataFrame, *keys: str) -> DataFrame:
    """Custody days of a component table (``quantity``, ``unit``) per key, or over all of it."""
    days = F.sum(S.component_days(F.col("quantity"), F.col("unit")))
    return components.groupBy(*keys).agg(F.coalesce(days, F.lit(0.0)).try_cast("bigint").alias("total_days"))


# schema check ------------------------------------------------------------

def column_report(df: DataFrame, required: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Each required or present column: ``column_name, status, filled`` (non-NULL values), in one scan.

    ``status`` is present, missing or extra. With ``strict`` a missing column is an error, before anything is read.
    """
    required = S.SENTENCE_COLUMNS if required is None else required
    status = {c: "present" if c in df.columns else "missing" for c in required}
    absent = [c for c, s in status.items() if s == "missing"]
    if strict and absent:
        raise ValueError(f"columns not found: {', '.join(sorted(absent))}")
    status |= {c: "extra" for c in df.columns if c not in status}
    filled = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.lit(s).alias("status"), (F.lit(0).cast("bigint") if s == "missing" else F.col(f"`{c}`")).alias("filled"))
        for c, s in status.items()
    ]
    return filled.select(F.inline(F.array(*rows)))


# row by ordinal ----------------------------------------------------------

LEAST_RANGES = 64
# When so few rows are left they are sorted.
LEFT_TO_SORT = 10_000


def row_at(df: DataFrame, index: int, order_by: list[str], left_to_sort: int = LEFT_TO_SORT, ranges: int | None = None) -> DataFrame:
    """The row at a position of the given order, NULL first, the position clamped to the table.

    An order statistic without a global sort, for orders of any type, one column of the order after the other. A round deals
    the values of that column alone into ranges and counts them per range; the row is among those between the first and
    last value of the range that the position falls in, and the next round looks at these only. When a range holds one
    value the rows that have it go on with the next column. At most ``left_to_sort`` rows are ever sorted.

    A round reads one column twice (Spark samples the bounds of the ranges, then deals the values); the conditions on
    earlier ranges reach the scan, so stored columns skip row groups by them. The driver learns one range per round: two
    values and two numbers. The first and last value of a range are counted apart in the next round, so that every round
    gets on however often a value repeats.

    The order should tell rows apart; among rows with equal keys any may be the answer. For tables read with ``with_order``
    order by ``ord.file, ord.name, ord.block, ord.row``. An empty table is an error.
    """
    spark = df.sparkSession
    ranges = ranges or max(LEAST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pool, part, position = df, F.spark_partition_id(), F.greatest(F.lit(0), F.least(F.lit(index), F.col("total") - 1))
    columns = iter(enumerate(order_by, 1))
    number, column = next(columns)
    while True:
        counted = _range_counts(pool.select(F.col(column).alias("key")), ranges, part)
        in_order = Window.orderBy("part")
        whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        placed = counted.select("*", F.sum("rows").over(in_order).alias("upto"), F.sum("rows").over(whole).alias("total"))
        found = placed.where(F.col("upto") > position).orderBy("part").limit(1).select(
            "low", "high", "rows", (position - F.col("upto") + F.col("rows")).alias("position"), F.col("low").eqNullSafe(F.col("high")).alias("single")
        ).toArrow()
        if not found.num_rows:
            raise ValueError("the table is empty")
        low, high, rows, offset, single = (found.column(name)[0].as_py() for name in ("low", "high", "rows", "position", "single"))
        # The values go back as a table of one row: unlike literals it keeps values of every type as they are.
        bounds = spark.createDataFrame(found.select(["low", "high"]), placed.select("low", "high").schema)
        first, last = (bounds.select(F.col(side)["value"]).scalar() for side in ("low", "high"))
        value = F.col(column)
        under = value.isNull() if high["value"] is None else value <= last
        if low["value"] is not None:
            under &= value >= first
        elif high["value"] is not None:
            under |= value.isNull()
        pool, position = pool.where(under), F.lit(offset)
        if rows <= left_to_sort:
            return pool.orderBy(*[F.col(c).asc_nulls_first() for c in order_by[number - 1:]]).offset(offset).limit(1)
        part = F.spark_partition_id()
        if not single:
            part = F.when(F.col("key").eqNullSafe(first), -1).when(F.col("key").eqNullSafe(last), ranges).otherwise(part)
        elif number < len(order_by):
            number, column = next(columns)
        else:
            return pool.limit(1)


def _range_counts(keys: DataFrame, ranges: int, part: Column) -> DataFrame:
    """``part, rows, low, high`` of the ranges that the column ``key`` is dealt into; ``low`` and ``high`` hold a ``value``, which may be NULL."""
    dealt = keys.repartitionByRange(ranges, F.col("key").asc_nulls_first())
    whole = F.struct(F.col("key").alias("value"))
    return dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min(whole).alias("low"), F.max(whole).alias("high"))
