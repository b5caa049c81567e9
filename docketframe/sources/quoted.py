"""CSV records with line breaks inside quotes, put together from files that are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketframe.functions.text import strip

# A line that starts outside quotes and ends inside them: whole fields, then one whose quote stays open.
# A quote inside an unquoted field opens nothing; text after a closing quote belongs to the field.
_CLOSED = r'"[^"]*+(?:""[^"]*+)*+"[^,]*+'
_OPENS = rf'(?s)^(?:(?:{_CLOSED}|(?:[^",][^,]*+)?+),)*+"[^"]*+(?:""[^"]*+)*+$'


def ends_open(line: Column, from_open: bool = False) -> Column:
    """Whether quotes are open after a line; a line met inside quotes reads like one with a quote before it."""
    return (F.concat(F.lit('"'), line) if from_open else line).rlike(_OPENS)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, row, line`` and the state after the line, had it begun outside quotes or inside."""
    line = F.regexp_replace("value", "\r$", "")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        line.alias("line"),
    )
    states = {"closed_to": ends_open(F.col("line")), "open_to": ends_open(F.col("line"), True)}
    return lines.withColumns({**states, "blank": strip(F.col("line")) == ""})


def _running(lines: DataFrame) -> DataFrame:
    """Lines with ``known, flips``: the state after a line is that of the last line in its split that sets it
    whatever came before (else that at the start of the split), turned round ``flips`` times."""
    order = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("closed_to") == F.col("open_to")
    turned = lines.withColumn("turns", F.sum((F.col("closed_to") & ~F.col("open_to")).cast("long")).over(order))
    setter = F.last(F.when(same, F.struct(F.col("closed_to").alias("state"), "turns")), ignorenulls=True).over(order)
    flips = F.col("turns") - F.coalesce("setter.turns", F.lit(0))
    return turned.withColumn("setter", setter).select(
        "file", "block", "row", "blank", *(["line"] if "line" in lines.columns else []), F.col("setter.state").alias("known"), (flips % 2 == 1).alias("flips")
    )


def _starts(running: DataFrame) -> DataFrame:
    """``file, block, begins_open, head_row``: the state in which every split starts, and the row of the file's header if it is there.

    A split is one row here, so a file's chain of splits is short.
    """
    ends = running.groupBy("file", "block").agg(
        F.max_by(F.struct("known", "flips"), "row").alias("end"), F.min(F.when(~F.col("blank"), F.col("row"))).alias("first")
    )
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.sum(F.col("end.flips").cast("long"))
    upto = ends.withColumn("before", F.coalesce(turns.over(order), F.lit(0)))
    # After a split whose end is known: its state, and the turns to take off, those up to and with that split.
    setter = F.struct((F.col("end.known") != F.col("end.flips")).alias("state"), (F.col("before") + F.col("end.flips").cast("long")).alias("turns"))
    known = F.last(F.when(F.col("end.known").isNotNull(), setter), ignorenulls=True).over(order)
    state = F.coalesce("known.state", F.lit(False)) != ((F.col("before") - F.coalesce("known.turns", F.lit(0))) % 2 == 1)
    head = F.min(F.when(F.col("first").isNotNull(), F.col("block"))).over(Window.partitionBy("file"))
    head_row = F.when(F.col("block") == F.col("head"), F.col("first")).alias("head_row")
    return upto.withColumn("known", known).withColumn("head", head).select("file", "block", state.alias("begins_open"), head_row)


def split_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, nth, record``: the records of CSV files whose quotes go over lines, but for the first of each file, its header.

    Files are split as other texts are. What a line does to open quotes depends
    on the state before it alone, so splits are first read for their state
    (no texts are shuffled), the states are chained from split to split, and the
    lines, shuffled once by split, are put together where quotes stay open.
    Only pieces at the borders of splits meet in a second shuffle, at most two
    a split. A line break inside quotes becomes ``\\n``,
    also the other kind in a file that mixes both. Blank records have no
    row. A record has the place where it starts.
    """
    lines = _lines(spark, path)
    starts = _starts(_running(lines.drop("line")))
    split = Window.partitionBy("file", "block").orderBy("row")
    after = F.coalesce("known", "begins_open") != F.col("flips")
    rows = _running(lines).join(starts, ["file", "block"])
    rows = rows.withColumn("after", after).withColumn("before", F.coalesce(F.lag("after").over(split), "begins_open"))
    nth = F.sum((~F.col("before")).cast("long")).over(split.rowsBetween(Window.unboundedPreceding, 0))
    pieces = rows.withColumn("nth", nth).groupBy("file", "block", "nth").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda p: p["line"]), "\n").alias("record"),
        F.max_by("after", "row").alias("left_open"),
        F.coalesce(F.max(F.col("row") == F.col("head_row")), F.lit(False)).alias("header"),
    )
    whole = pieces.where((F.col("nth") > 0) & ~F.col("left_open")).select("file", "block", "nth", "record", "header")
    # Pieces at borders: the last start before a piece without one is its own.
    borders = pieces.where((F.col("nth") == 0) | F.col("left_open"))
    order = Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("nth") > 0, F.struct(F.col("block").alias("from"), "nth")), ignorenulls=True).over(order)
    joined = borders.withColumn("owner", owner).groupBy("file", F.col("owner.from").alias("block"), F.col("owner.nth").alias("nth")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), "record"))), lambda p: p["record"]), "\n").alias("record"),
        F.max("header").alias("header"),
    )
    return whole.unionByName(joined).where(~F.col("header") & (strip(F.col("record")) != "")).drop("header")
