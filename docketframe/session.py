"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution does the run-time half of the physical planning: it sizes
# shuffle partitions, splits hot join keys and swaps join strategies once the
# real sizes are known. It only merges shuffle partitions, so on a large cluster
# spark.sql.adaptive.coalescePartitions.initialPartitionNum has to be set from
# the cluster: about the largest shuffle divided by 128 MB, at least three times
# the cores. The jobs place no fixed partition counts of their own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot leaves methods above 8000 bytes of bytecode uncompiled. A stage whose
    # generated code is larger runs faster operator by operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app_name: str = "docketframe", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings above; on a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the one setting above that matters inside a session built elsewhere."""
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(key, DEFAULTS[key])
    return spark
