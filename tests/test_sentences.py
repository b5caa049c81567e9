"""Sentence columns: fixed cases, and random texts against plain restatements of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

import docketframe as d
from docketframe.functions import sentences as S
from docketframe.operators import sentences

SPACES = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def apply(spark, parser, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = rows.select("i", parser(F.col("t")).alias("p")).orderBy("i").collect()
    return [r.p.asDict(recursive=True) if hasattr(r.p, "asDict") else r.p for r in out]


@pytest.mark.parametrize(
    "parser, text, expected",
    [
        (S.uid_parts, "2024mbpc96_None_1", dict(case_id="2024mbpc96", docket="None", count="1", defendant="a")),
        (S.uid_parts, "2024mbpc96_1", dict(case_id="2024mbpc96", docket="1", count=None, defendant="a")),
        (S.uid_parts, " x_y_1_b_more ", dict(case_id="x", docket="y", count="1", defendant="b")),
        (S.uid_parts, "x_y_1_", dict(case_id="x", docket="y", count="1", defendant="")),
        (S.uid_parts, None, dict(case_id=None, docket=None, count=None, defendant="a")),
        (S.uid_parts, "\t　", dict(case_id=None, docket=None, count=None, defendant="a")),
        (S.date_parts, "2024-12-18", dict(offence_date="2024-12-18", offence_start_date=None, offence_end_date=None)),
        (S.date_parts, "1970-09-01&1981-07-01", dict(offence_date=None, offence_start_date="1970-09-01", offence_end_date="1981-07-01")),
        (S.date_parts, "2020 & ", dict(offence_date=None, offence_start_date="2020", offence_end_date=None)),
        (S.date_parts, "&a&b", dict(offence_date=None, offence_start_date=None, offence_end_date="a&b")),
        (S.mode_parts, "jail-consecutive", dict(jail_type="jail", sentence_mode="consecutive")),
        (S.mode_parts, "jail", dict(jail_type="jail", sentence_mode=None)),
        (S.mode_parts, "jail-consecutive-intermittent", dict(jail_type="jail", sentence_mode="consecutive-intermittent")),
        (S.mode_parts, "-x", dict(jail_type=None, sentence_mode="x")),
        (S.mode_parts, "-", dict(jail_type=None, sentence_mode=None)),
        (S.conditions_parts, "18m-probation", dict(time=18.0, unit="m", unit_display="months", type="probation", type_display="probation")),
        (S.conditions_parts, "1Y -LTSO", dict(time=1.0, unit="y", unit_display="year", type="ltso", type_display="ltso")),
        (S.conditions_parts, "0d-discharge", dict(time=0.0, unit="d", unit_display="days", type="discharge", type_display="absolute discharge")),
        (S.conditions_parts, "12m-discharge", dict(time=12.0, unit="m", unit_display="months", type="discharge", type_display="conditional discharge")),
        (S.conditions_parts, "ltso-10y", dict(time=None, unit=None, unit_display="unknown", type=None, type_display=None)),
        (S.conditions_parts, "18m- probation", dict(time=None, unit=None, unit_display="unknown", type=None, type_display=None)),
        (S.fine_amount, "$1,000", "$1000.00"),
        (S.fine_amount, "2500", "$2500.00"),
        (S.fine_amount, "$1,234.5", "$1234.50"),
        (S.fine_amount, "not-a-number", None),
        (S.fine_amount, "1d", None),
        (S.fine_amount, "1_000", "$1000.00"),
        (S.fine_amount, "1__000", None),
        (S.fine_amount, " $ 5 ", "$5.00"),
        (S.fine_amount, "-inf", "$-inf"),
        (S.fine_amount, "1e3", "$1000.00"),
        (S.appeal_parts, "2024skca79_upheld", dict(court="2024skca79", result="upheld")),
        (S.appeal_parts, "2024skca79", dict(court="2024skca79", result=None)),
        (S.appeal_parts, "2024skca79-upheld", dict(court="2024skca79-upheld", result=None)),
    ],
)
def test_fixed_cases(spark, parser, text, expected):
    assert apply(spark, parser, [text]) == [expected]


@pytest.mark.parametrize(
    "text, components, days, indeterminate, unrecognized",
    [
        ("n/a", None, None, False, True),
        ("", [], 0, False, False),
        (None, [], 0, False, False),
        (" InDeterminate ", None, None, True, False),
        ("1y&6m&15d", [(1, "y"), (6, "m"), (15, "d")], 560, False, False),
        ("12m", [(12, "m")], 365, False, False),
        ("12m&12m", [(12, "m"), (12, "m")], 730, False, False),
        ("1y&6m&3d", [(1, "y"), (6, "m"), (3, "d")], 548, False, False),
        ("2y6m3d", [(2, "y"), (6, "m"), (3, "d")], 913, False, False),
        ("3.5y", [(3.5, "y")], 1277, False, False),
        ("255y_7y", [(255, "y"), (7, "y")], 95630, False, False),
        ("6 Months", [(6, "m")], 180, False, False),
    ],
)
def test_jail(spark, text, components, days, indeterminate, unrecognized):
    (got,) = apply(spark, S.jail_summary, [text])
    assert got["total_days"] == days
    assert (got["is_indeterminate"], got["is_unrecognized"]) == (indeterminate, unrecognized)
    pairs = got["components"] and [(c["quantity"], c["unit"]) for c in got["components"]]
    assert pairs == components


def sides(text, mark):
    if text is None or not text.strip():
        return None, None
    left, _, right = text.partition(mark)
    return left.strip() or None, right.strip() or None


def random_texts(seed, alphabet, n=1500):
    rng = random.Random(seed)
    return [None, "", " "] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_random_two_sided_cells(spark):
    texts = random_texts(1, ["-", "_", "&", "a", "é", " ", "\t", " ", "\x1c", "9"])
    for parser, mark, names in (
        (S.mode_parts, "-", ("jail_type", "sentence_mode")),
        (S.appeal_parts, "_", ("court", "result")),
    ):
        assert [tuple(r[n] for n in names) for r in apply(spark, parser, texts)] == [sides(t, mark) for t in texts]


def test_random_durations(spark):
    texts = random_texts(2, ["1", "2", "12", ".", "y", "m", "d", "M", " ", "&", " ", "-", "x"])
    number = re.compile(r"(\d+(?:\.\d+)?)\s*([ymd])", re.I)
    for text, got in zip(texts, apply(spark, S.jail_summary, texts)):
        found = [(float(q), u.lower()) for q, u in number.findall(text or "")]
        blank = not (text or "").strip()
        assert got["is_unrecognized"] == (not blank and not found), text
        if found:
            assert [(c["quantity"], c["unit"]) for c in got["components"]] == found
            days = sum(365 if (u == "m" and q == 12) else q * {"y": 365, "m": 30, "d": 1}[u] for q, u in found)
            assert got["total_days"] == int(days)


def test_random_fines(spark):
    texts = random_texts(3, ["1", "25", ".", "_", "$", ",", " ", "e", "-", "+", "nan", "inf", "d", " "])

    def model(text):
        try:
            return f"${float((text or '').strip().replace('$', '').replace(',', '').strip()):.2f}"
        except ValueError:
            return None

    short = [t for t in texts if "e" not in (t or "") and not re.search(r"\.[0-9_]{3,}", t or "")]
    assert apply(spark, S.fine_amount, short) == [model(t) for t in short]


def test_every_strip_character(spark):
    texts = [f"{c}x{c}" for c in SPACES] + ["x​x", "​x"]
    assert [r["jail_type"] for r in apply(spark, S.mode_parts, texts)] == [t.strip() for t in texts]


def sentence(**cells):
    base = dict(uid="2024mbpc96_None_1_a", offence="cc_101", date="2024-12-18", jail="1y&6m&3d", mode="jail-consecutive",
                conditions="18m-probation", fine="1000", appeal="2024skca79_upheld")
    return {**base, **cells}


OFFENCES = [(1, "cc_101", "Test offence")]
OFFENCE_TYPE = "ord bigint, section string, offence_name string"
SENTENCE_TYPE = ", ".join(f"{c} string" for c in S.SENTENCE_COLUMNS)


def test_whole_row(spark):
    rows = spark.createDataFrame([sentence()], SENTENCE_TYPE)
    got = d.parse_sentences(rows, spark.createDataFrame(OFFENCES, OFFENCE_TYPE)).first().asDict(recursive=True)
    assert got == {
        "uid": dict(case_id="2024mbpc96", docket="None", count="1", defendant="a"),
        "offence": dict(offence_code="cc_101", offence_name="Test offence"),
        "date": dict(offence_date="2024-12-18", offence_start_date=None, offence_end_date=None),
        "jail": dict(
            components=[dict(quantity=1.0, unit="y"), dict(quantity=6.0, unit="m"), dict(quantity=3.0, unit="d")],
            total_days=548, is_indeterminate=False, is_unrecognized=False,
        ),
        "mode": dict(jail_type="jail", sentence_mode="consecutive"),
        "conditions": dict(time=18.0, unit="m", unit_display="months", type="probation", type_display="probation"),
        "fine": "$1000.00",
        "appeal": dict(court="2024skca79", result="upheld"),
    }


def test_columns_and_whole_row_parsers_agree(spark, sf_dir):
    from docketframe.plans import fixtures as fx

    rows = fx.sentences(spark, sf_dir).select(*S.SENTENCE_COLUMNS).distinct()
    offences = fx.offences(spark, sf_dir)
    tagged = rows.withColumn("raw", F.struct(*S.SENTENCE_COLUMNS))
    whole = d.parse_sentences(tagged, offences, keep=["raw"])
    for name, parser in [("uid", S.uid_parts), ("date", S.date_parts), ("jail", S.jail_summary), ("mode", S.mode_parts),
                         ("conditions", S.conditions_parts), ("fine", S.fine_amount), ("appeal", S.appeal_parts)]:
        alone = parser(F.col(f"raw.{name}"))
        assert whole.where(~F.col(name).eqNullSafe(alone)).count() == 0, name


def test_missing_and_extra_columns(spark):
    rows = spark.createDataFrame([("u_1", "x", "12m")], "uid string, extra string, jail string")
    assert d.canonical_sentences(rows).first().asDict() == {**{c: "" for c in S.SENTENCE_COLUMNS}, "uid": "u_1", "jail": "12m"}
    assert d.canonical_sentences(rows, by_position=True).first().asDict() == {
        **{c: "" for c in S.SENTENCE_COLUMNS}, "uid": "u_1", "offence": "x", "date": "12m",
    }


def test_column_report(spark):
    rows = spark.createDataFrame([("x", None)], "uid string, extra_col string")
    report = {tuple(r) for r in d.column_report(rows, ["uid", "zz"]).collect()}
    assert report == {("uid", "present", 1), ("zz", "missing", 0), ("extra_col", "extra", 0)}
    with pytest.raises(ValueError, match="aa, zz"):
        d.column_report(rows, ["uid", "zz", "aa"], strict=True)


def test_no_cell_ends_the_job(spark):
    rows = spark.createDataFrame([sentence(jail="99999999999999999999d", fine="1e400"), sentence(jail="9" * 400 + "d", fine="-1e400")], SENTENCE_TYPE)
    out = d.parse_sentences(rows, spark.createDataFrame(OFFENCES, OFFENCE_TYPE)).select("jail.total_days", "fine").collect()
    assert [tuple(r) for r in out] == [(None, "$inf"), (None, "$-inf")]


def test_json_keeps_nulls(spark):
    rows = spark.createDataFrame([sentence(appeal=None, jail="life")], SENTENCE_TYPE)
    parsed = d.parse_sentences(rows, spark.createDataFrame(OFFENCES, OFFENCE_TYPE))
    text = d.sentences_as_json(parsed).first().json
    assert '"appeal":{"court":null,"result":null}' in text and '"components":null' in text


def test_total_days_of_a_component_table(spark):
    rows = spark.createDataFrame([(1, 1.0, "y"), (1, 6.0, "M"), (1, 15.0, "d"), (2, 12.0, "m"), (3, 4.0, "w")], "k int, quantity double, unit string")
    assert {r.k: r.total_days for r in d.total_days(rows, "k").collect()} == {1: 560, 2: 365, 3: 0}
    assert d.total_days(rows.where("k > 9")).first().total_days == 0


def test_sentences_for_case_finds_padded_uids(spark):
    uids = ["c1_a_1", " c1_b", " c1", "c10_a", "xc1", None, "", "c1"]
    rows = spark.createDataFrame([sentence(uid=u) for u in uids], SENTENCE_TYPE)
    assert sorted(r.uid for r in d.sentences_for_case(rows, "c1").collect()) == sorted(["c1_a_1", " c1_b", " c1", "c1"])


def test_counts_skip_rows_without_case(spark):
    rows = spark.createDataFrame([sentence(uid=u) for u in ["a_1", "a_2", "b_1", None, " ", "_x"]], SENTENCE_TYPE)
    assert {tuple(r) for r in d.sentence_counts(rows).collect()} == {("a", 2), ("b", 1)}
    assert [tuple(r) for r in d.cases_with_many_sentences(rows).collect()] == [("a", 2)]


def test_sentences_by_case(spark):
    rows = spark.createDataFrame([sentence(uid=u) for u in ["hot_1", "hot_1", " hot_2", "c_1", None, " ", "_x"]], SENTENCE_TYPE)
    out = d.case_sentences(rows, spark.createDataFrame(OFFENCES, OFFENCE_TYPE)).collect()
    assert sorted((r.case_id, r.key) for r in out) == [("c", "c_1"), ("hot", "hot_1"), ("hot", "hot_1"), ("hot", "hot_2")]


@pytest.mark.parametrize("index", [-5, 0, 1, 57, 499, 2999, 3000, 10**9])
def test_row_at_matches_a_full_sort(spark, index):
    rng = random.Random(7)
    data = [(None if rng.random() < 0.05 else rng.choice([rng.randint(-(10**12), 10**12), 77, 78]), i) for i in range(3000)]
    rows = spark.createDataFrame(data, "k bigint, i bigint").repartition(7)
    expected = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))[max(0, min(index, 2999))]
    for limit in (10, 100_000):
        (got,) = d.row_at(rows, index, ["k", "i"], left_to_sort=limit, ranges=16).collect()
        assert tuple(got) == expected


@pytest.mark.parametrize("kind, values", [("string", ["b", "a", "", None, "z" * 50]), ("bigint", [-(2**63), 2**63 - 1, 0, None]), ("int", [-(2**31), 2**31 - 1, None])])
def test_row_at_of_any_order(spark, kind, values):
    data = [(v, i) for i in range(200) for v in values]
    rows = spark.createDataFrame(data, f"k {kind}, i int")
    ordered = sorted(data, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else "" if kind == "string" else 0, r[1]))
    for index in (0, 150, 333, len(data) - 1):
        assert tuple(d.row_at(rows, index, ["k", "i"], left_to_sort=20, ranges=16).first()) == ordered[index]
    assert d.row_at(rows.select("k"), 10, ["k"], left_to_sort=20, ranges=16).first().k is None


def test_row_at_of_an_empty_table(spark):
    with pytest.raises(ValueError, match="empty"):
        d.row_at(spark.createDataFrame([], "k bigint"), 0, ["k"])


def test_row_at_works_each_key_out_once(spark):
    rows = spark.range(40_000).select((F.col("id") * 7 % 40_009).alias("k"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"), "id")
    counts = sentences._range_counts(rows.select(F.col("t").alias("key")), 64, F.spark_partition_id())
    plan = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("concat(text ") == 1 and "rangepartitioning(key" in plan
    got = d.row_at(rows, 31_000, ["t", "k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "text 1" not in plan and "rangepartitioning" not in plan
    assert got.first().t == sorted(f"text {i}" for i in range(40_000))[31_000]


def test_row_at_of_repeated_values_and_missing_ones(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, F.col("id") % 50).cast("double").alias("k"), F.col("id").alias("i")
    )
    ordered = sorted(((r.k, r.i) for r in rows.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for index in (0, 9_999, 10_000, 12_345, 24_000, 29_999):
        assert tuple(d.row_at(rows, index, ["k", "i"], left_to_sort=500, ranges=16).first()) == ordered[index]
