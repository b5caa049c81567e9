import itertools

import pytest
from pyspark.sql import functions as F

import docketframe as d
from docketframe.functions.offences import codes_resolving_to, offence_variant, offence_variants

TYPE = "ord bigint, section string, offence_name string"
TABLE = [
    (3, "cc_101", "third"), (1, "cc_101", "first"), (2, "cc266", "assault"), (4, "cc_145", "failure"), (5, "cdsa_5(2)", "drug"),
    (6, "cc_7 ", "padded"), (7, "cc_8", None), (8, "cc9", ""), (9, "145", "bare"), (10, "cc_", "stub"), (11, None, "nobody"),
    (12, "cc_320.18", "driving"),
]


def model(code, table, plain):
    """The rule stated over a dict, for comparison."""
    names = {}
    for _, section, name in sorted(table, key=lambda r: r[0]):
        if section is not None:
            names.setdefault(section, name)
    given = (code or "").strip()
    if not given:
        return None, None
    base, youth = given.replace("_ycja", ""), "_ycja" in given
    mark = " (YCJA)" if youth else ""
    if base in names:
        return base, names[base] + mark if names[base] else names[base]
    key = base.strip()
    other = "cc" + key[3:] if key.startswith("cc_") else "cc_" + (key[2:] if key.startswith("cc") else key)
    for candidate in (key, other):
        if (youth or plain) and candidate != base and names.get(candidate):
            return candidate, names[candidate] + mark
    return given, None


CODES = [None, "", " ", "_ycja", "cc_7 _ycja", " cc_101", "cc_999_ycja"] + [
    p + body + s
    for p, body, s in itertools.product(
        ["", "cc", "cc_"], ["101", "266", "145", "7", "8", "9", "", "320.18", "cdsa_5(2)", "_101"], ["", "_ycja", " _ycja", " "]
    )
]


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_lookup(spark, plain, limit):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(CODES)], "i int, offence string")
    table = spark.createDataFrame(TABLE, TYPE)
    found = d.resolve_offences(rows, table, match_plain_variants=plain, broadcast_limit=limit)
    got = {r.i: tuple(r.offence) for r in found.collect()}
    for i, code in enumerate(CODES):
        assert got[i] == model(code, TABLE, plain), code


def test_empty_lookup(spark):
    rows = spark.createDataFrame([("cc_999_ycja",)], "offence string")
    found = d.resolve_offences(rows, spark.createDataFrame([], TYPE)).first().offence
    assert tuple(found) == ("cc_999_ycja", None)


def test_variants(spark):
    codes = ["cc_101", "cc101", "101", "cc344(1)(b)", " cc_5 "]
    rows = spark.createDataFrame([(c,) for c in codes], "c string").select(offence_variants(F.col("c")).alias("v"))
    assert [r.v for r in rows.collect()] == [
        ["cc_101", "cc101"], ["cc101", "cc_101"], ["101", "cc_101"], ["cc344(1)(b)", "cc_344(1)(b)"], ["cc_5", "cc5"],
    ]


def test_inverse_of_the_variant(spark):
    parts = ["", "c", "cc", "_", "cc_", "1", "x"]
    codes = sorted({"".join(p) for p in itertools.product(parts, repeat=3)} - {""})
    rows = spark.createDataFrame([(c,) for c in codes], "c string")
    pairs = {(r.c, r.v) for r in rows.select("c", offence_variant(F.col("c")).alias("v")).collect()}
    sections = spark.createDataFrame([(v,) for v in {v for _, v in pairs}], "s string")
    back = {(r.k, r.s) for r in sections.select("s", F.explode(codes_resolving_to(F.col("s"))).alias("k")).collect()}
    assert pairs <= back
    assert all(k not in codes or (k, s) in pairs for k, s in back)


def test_large_lookup_is_not_broadcast(spark):
    rows = spark.createDataFrame([("cc_1",)], "offence string")
    table = spark.createDataFrame(TABLE, TYPE)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda limit: d.resolve_offences(rows, table, broadcast_limit=limit)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan(1 << 20)
        assert "BroadcastHashJoin" not in plan(100)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
