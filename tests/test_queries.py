"""Every registered query against its SQL restatement, and the plans they run with."""

import pytest

from __spark_entry__ import entry
import docketframe as d
from check import connect, multiset
from docketframe.plans import fixtures as fx
from docketframe.plans.oracle import oracle_sql
from docketframe.plans.queries import QUERIES

NAMES = sorted(QUERIES)
SQL_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(NAMES) == set(oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    relation = con.sql(oracle_sql()[name])
    ours, theirs = multiset(frame.columns, frame.collect()), multiset(relation.columns, relation.fetchall())
    assert sorted(frame.columns) == sorted(relation.columns)
    assert ours and ours == theirs
    assert [SQL_TYPES[dict(frame.dtypes)[c]] for c in sorted(frame.columns)] == [
        str(dict(zip(relation.columns, relation.types))[c]) for c in sorted(frame.columns)
    ]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry(spark).limit(3).count() == 3


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "sentences")
    fx.sentences(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_parse_reads_what_is_asked_for(spark, sf_dir, stored):
    plan = plan_of(d.parse_sentences(stored, fx.offences(spark, sf_dir)).select("jail.total_days"))
    assert "ReadSchema: struct<jail:string>" in plan and "Exchange" not in plan and "Join" not in plan


def test_parse_shuffles_no_sentence(spark, sf_dir, stored):
    plan = plan_of(d.parse_sentences(stored, fx.offences(spark, sf_dir)))
    sentences_side = plan.split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange" not in sentences_side


def test_sentences_by_case_shuffle_nothing(spark, sf_dir, stored):
    plan = plan_of(d.case_sentences(stored, fx.offences(spark, sf_dir)))
    sentences_side = plan.split("BroadcastExchange")[0]
    assert sentences_side.count("FileScan parquet") == 1 and "Exchange" not in sentences_side


def test_case_filter_reaches_the_scan(stored):
    plan = plan_of(d.sentences_for_case(stored, "2024ord77"))
    assert "StringStartsWith(uid,2024ord77)" in plan


@pytest.fixture(scope="module")
def cases(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "cases")
    d.parse_cases(fx.case_markdown(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


def test_legislation_shuffles_nothing(cases):
    assert "Exchange" not in plan_of(d.ordered_legislation(cases)) and "Exchange" not in plan_of(d.legislation_lists(cases))


def test_reports_read_each_case_once(spark, sf_dir, cases):
    reports = d.build_reports(cases, d.citation_metadata(fx.citations(spark, sf_dir)), fx.relation_responses(spark, sf_dir))
    assert plan_of(reports).count("paragraphs:array<string>") == 1
