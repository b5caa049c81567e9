"""Hot keys: the joins that may meet one are split at run time, with the same result."""

import pytest
from pyspark.sql import functions as F

import docketframe as d

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}
N = 60_000


@pytest.fixture
def skewed(spark):
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    yield
    for key in SKEW:
        spark.conf.unset(key)


def final_plan(frame):
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def hot(column, value, other):
    """A third of the rows hold one value."""
    return F.when(F.col("id") % 3 == 0, F.lit(value)).otherwise(F.concat(F.lit(other), F.col("id").cast("string"))).alias(column)


def test_hot_offence(spark, skewed):
    rows = spark.range(0, N, 1, 16).select("id", hot("offence", "cc_1", "cc_x"))
    table = spark.createDataFrame([(1, "cc_1", "One"), (2, "cc_2", "Two")], "ord int, section string, offence_name string")
    found = d.resolve_offences(rows, table, output="found", broadcast_limit=0)
    assert "skew=true" in final_plan(found)
    assert found.where("found.offence_name = 'One'").count() == N // 3 and found.count() == N


def test_much_cited_case(spark, skewed):
    rows = spark.range(0, N, 1, 16).select("id", hot("citation", "2024 ABCJ 1", "2024 ABCJ 1"))
    citations = spark.createDataFrame([("2024abcj1", "raw")], "uid string, raw_citation string")
    joined = d.join_metadata(rows, d.citation_metadata(citations), F.col("citation"), how="left")
    assert "skew=true" in final_plan(joined)
    assert joined.where("metadata is not null").count() == N // 3 and joined.count() == N


def test_missing_keys_are_dealt_out(spark, skewed):
    citation = F.when(F.col("id") % 3 > 0, F.concat(F.lit("2024 ABCJ "), F.col("id").cast("string"))).alias("citation")
    rows = spark.range(0, N, 1, 16).select("id", citation)
    citations = spark.createDataFrame([("2024abcj1", "raw")], "uid string, raw_citation string")
    joined = d.join_metadata(rows, d.citation_metadata(citations), F.col("citation"), how="left")
    assert joined.count() == N and joined.where("metadata is not null").count() == 1
    missing = joined.where("citation is null").groupBy(F.spark_partition_id()).count().collect()
    assert len(missing) > 1 and max(r["count"] for r in missing) < N // 3 // 2


def test_sentences_are_shuffled_with_their_own_columns_only(spark):
    rows = spark.createDataFrame([("cc_1_ycja", 1), (" 2", 2), (None, 3)], "offence string, n long")
    table = spark.createDataFrame([(1, "cc1", "A"), (2, "2", "B")], "ord long, section string, offence_name string")
    found = d.resolve_offences(rows, table, output="found", broadcast_limit=0)
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter", 1)[1].split("\n", 1)[1]
    assert not any(name in below.split("__hit")[0] for name in ("__code", "__base", "__key", "__spread"))
    assert sorted((r.n, *r.found) for r in found.collect()) == [(1, "cc1", "A (YCJA)"), (2, "2", "B"), (3, None, None)]
