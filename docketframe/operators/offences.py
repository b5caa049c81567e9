"""Offence lookup: sentence codes against the offence table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketframe.functions.offences import (
    YCJA_LABEL,
    codes_resolving_to,
    has_ycja,
    without_ycja,
)
from docketframe.functions.text import cell, strip
from docketframe.operators.joins import BROADCAST_LIMIT, broadcast_if_bounded, join_unique_by

# A section serves its own code and at most three codes spelled differently.
KEYS_PER_SECTION = 4


def first_per_section(offences: DataFrame) -> DataFrame:
    """One name per section: the first in file order (column ``ord``)."""
    return (
        offences.where(F.col("section").isNotNull())
        .groupBy("section")
        .agg(F.min_by("offence_name", "ord").alias("offence_name"))
    )


def code_table(offences: DataFrame) -> DataFrame:
    """The lookup turned round: one row per code a sentence may carry.

    A code can match a section as it is, or through its other spelling. Listing
    both on the small side lets the sentence table be joined once, on one key.
    Columns: ``code``; ``exact``/``exact_name`` for the section spelled like the
    code; ``variant``/``variant_name`` for the section of the other spelling;
    ``padded``, a map for sections that differ from the code by outer
    whitespace only.
    """
    section, name = F.col("section"), F.col("offence_name")

    def entry(code: Column, role: str) -> Column:
        return F.struct(code.alias("code"), F.lit(role).alias("role"))

    own = F.array(
        F.when(section == strip(section), entry(section, "exact")).otherwise(entry(strip(section), "padded"))
    )
    other = F.transform(codes_resolving_to(section), lambda code: entry(code, "variant"))
    role = F.col("entry.role")
    return (
        first_per_section(offences)
        .select(section, name, F.explode(F.concat(own, other)).alias("entry"))
        .groupBy(F.col("entry.code").alias("code"))
        .agg(
            F.coalesce(F.bool_or(role == "exact"), F.lit(False)).alias("exact"),
            F.max(F.when(role == "exact", name)).alias("exact_name"),
            F.max(F.when(role == "variant", section)).alias("variant"),
            F.max(F.when(role == "variant", name)).alias("variant_name"),
            F.map_from_entries(
                F.collect_list(F.when(role == "padded", F.struct(section, name)))
            ).alias("padded"),
        )
    )


def resolve_offences(
    sentences: DataFrame,
    offences: DataFrame,
    column: str = "offence",
    output: str = "offence",
    match_plain_variants: bool = False,
    broadcast_limit: int = BROADCAST_LIMIT,
    stripped: bool = False,
) -> DataFrame:
    """Replace/add ``output``: struct of ``offence_code`` and ``offence_name``.

    The code as given (youth suffix removed) wins; its other spelling counts for
    codes with the youth suffix only, unless ``match_plain_variants`` is set.
    A code found nowhere is kept as it was, without a name. ``stripped`` says
    that the column holds no outer whitespace and no empty texts.
    """
    hit, code = F.col("__hit"), F.col(f"`{column}`")
    # The code's forms are worked out before and after the join, so that the rows are shuffled with the code alone.
    code = code if stripped else cell(code)
    table = code_table(offences)
    lookup = broadcast_if_bounded(
        table.select(
            F.col("code").alias("__key"),
            F.struct(*[c for c in table.columns if c != "code"]).alias("__hit"),
        ),
        measured=offences.select("section", "offence_name"),
        copies=KEYS_PER_SECTION,
        limit=broadcast_limit,
    )
    joined = join_unique_by(sentences, lookup, strip(without_ycja(code)), "__key")
    given, base = F.col("__code"), F.col("__base")
    joined = joined.withColumn("__code", code).withColumn("__base", without_ycja(given)).withColumn("__key", strip(base))

    youth = has_ycja(given)
    label = F.when(youth, F.lit(YCJA_LABEL)).otherwise(F.lit(""))
    padded = base != F.col("__key")
    exact_here = hit["exact"] & ~padded
    padded_here = padded & F.map_contains_key(hit["padded"], base)
    other_spelling = youth | F.lit(match_plain_variants)

    def labelled(name: Column) -> Column:
        return F.when(name != "", F.concat(name, label)).otherwise(name)

    def result(code: Column, name: Column) -> Column:
        return F.struct(code.alias("offence_code"), name.alias("offence_name"))

    resolved = (
        F.when(given.isNull(), result(F.lit(None).cast("string"), F.lit(None).cast("string")))
        .when(exact_here, result(base, labelled(hit["exact_name"])))
        .when(padded_here, result(base, labelled(F.element_at(hit["padded"], base))))
        .when(
            other_spelling & padded & (hit["exact_name"] != ""),
            result(F.col("__key"), labelled(hit["exact_name"])),
        )
        .when(
            other_spelling & (hit["variant_name"] != ""),
            result(hit["variant"], labelled(hit["variant_name"])),
        )
        .otherwise(result(given, F.lit(None).cast("string")))
    )
    return joined.withColumn(output, resolved).drop("__code", "__base", "__key", "__hit")
