import docketframe as d
from pyspark.sql import functions as F

from docketframe.plans import fixtures as fx


def scans(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_hot_and_missing_keys(spark, tmp_path):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 1, F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("a key"),
        "id", F.array("id").alias("list"),
    )
    path = str(tmp_path / "store")
    # Small ranges stay as they are dealt, as large ones do.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d.write_keyed(rows, path, "a key", row_group=20_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = spark.read.parquet(f"{path}/rows")
    assert sorted(stored.collect(), key=str) == sorted(rows.collect(), key=str)
    # No file holds the hot key alone and whole.
    largest = stored.groupBy(F.col("_metadata.file_name")).count().agg(F.max("count")).first()[0]
    assert largest < 10_000
    for keys in (["hot"], ["k7", "k8"], ["k7", "none"]):
        found = d.read_keyed(spark, path, "a key", keys)
        assert sorted(found.collect(), key=str) == sorted(rows.where(F.col("a key").isin(keys)).collect(), key=str)
    assert len(d.read_keyed(spark, path, "a key", ["k7"]).inputFiles()) < len(stored.inputFiles())
    assert d.read_keyed(spark, path, "a key", ["none"]).count() == 0
    place = spark.read.parquet(f"{path}/manifest").where("`a key` = 'k7'").collect()
    assert sum(p.n_rows for p in place) == rows.where("`a key` = 'k7'").count()


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "store")
    d.write_keyed(spark.createDataFrame([], "k string, v int"), path, "k")
    assert d.read_keyed(spark, path, "k", ["x"]).count() == 0


def test_report_of_chosen_cases(spark, sf_dir, tmp_path):
    pages = fx.case_markdown(spark, sf_dir)
    path = str(tmp_path / "pages")
    d.write_pages(pages, path)
    metadata, responses = d.citation_metadata(fx.citations(spark, sf_dir)), fx.relation_responses(spark, sf_dir)
    reports = d.build_reports(d.parse_cases(pages), metadata, responses)
    everything = reports.collect()
    names = sorted({r.citation for r in everything})[:3]
    chosen = d.chosen_pages(spark, path, [*names, "R v Nobody, 1999 XXXX 1"])
    assert chosen.columns == pages.columns
    # The condition is at the scan, before any page is parsed.
    assert "PushedFilters: [In(decision" in scans(chosen)
    got = d.build_reports(d.parse_cases(chosen), metadata, responses).collect()
    decisions = {r.metadata.case_id for r in everything if r.citation in names}
    wanted = [r for r in everything if r.metadata.case_id in decisions]
    assert sorted(map(str, got)) == sorted(map(str, wanted)) and got
    store = str(tmp_path / "reports")
    d.store_reports(spark.createDataFrame(everything, reports.schema), store)
    assert sorted(map(str, d.stored_reports(spark, store).collect())) == sorted(map(str, everything))
    case = got[0].case_id
    one = d.stored_reports(spark, store, case)
    assert sorted(map(str, one.collect())) == sorted(str(r) for r in everything if r.case_id == case)
