"""Time the headline queries; prints one JSON line.

The inputs are first written again as several files each, as a cluster would have them, since a table of one row group is one task.
Every query runs twice and writes all its rows to the no-op sink: ``queries``
holds the second run, ``first_run`` the one that still compiles code.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from docketframe.plans.queries import QUERIES
from docketframe.session import build_session

HEADLINE = [
    "parse_sentences", "sentence_json", "offence_lookup", "jail_total_days", "fine_format", "cases_with_many_counts",
    "case_sentences", "row_at", "pages_markdown", "case_split", "case_paragraphs", "cited_legislation",
    "relation_edges", "related_cases", "case_report",
]


TABLES = ["lineitem", "part", "documents", "pages", "orders", "events"]


def staged(spark, sf_dir: str, files: int) -> str:
    """The tables that the queries read, in a new folder, every one in ``files`` files."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(files).write.parquet(f"{folder}/{table}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = staged(spark, sf_dir, 2 * int(cpus))
    runs: list[dict[str, float]] = [{}, {}]
    for name in HEADLINE:
        for seconds in runs:
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    first, second = runs
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(second.values()), 3), "unit": "sec", "queries": second,
        "sf": os.path.basename(os.path.normpath(sf_dir)), "first_run": first,
    }))


if __name__ == "__main__":
    main()
