"""Exact deduplication as a stateful stream.

Texts are equal when they are the same bytes after each run of ASCII white space became one space. Every arriving record
carries the SHA-256 digest of its text, its stable identifier and a locator of its content. The stream keeps one state row
per digest, without expiry, in RocksDB on the executors' disks, with its snapshots in the checkpoint: the smallest
identifier met so far, that record's locator, and the number of records. A later stream on the same checkpoint goes on
from there. What the state says is then checked: the full texts of all records that hit a digest are compared, and a digest
that stands for more than one text (which only a broken or shortened digest can do) is resolved by the texts themselves.

Only DataFrame operations run on the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketframe.llm.shared import new_path, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # An executor has a database per partition: each is closed with its task, and its buffer grows in steps of an eighth of this.
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
FILTER_BITS = 1 << 24
RECORD = "digest binary, doc_id long, file string, place long"


def normalized(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; NULL is empty."""
    return F.coalesce(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(""))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def records(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``digest, doc_id, file, place`` of each row; file and row number locate the content."""
    return docs.select(
        digest(normalized(F.col("text").cast("string"))).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"),
    )


def has_places(docs: DataFrame) -> bool:
    """Whether the rows of the frame can be located in files."""
    try:
        return bool(docs.select("_metadata.file_path", "_metadata.row_index").columns) and bool(docs.inputFiles())
    except AnalysisException:
        return False


def update_state(stream: DataFrame, checkpoint: str) -> None:
    """Run a stream of records into the keyed state of the checkpoint until all that is there now has been read."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "place"))
    state = stream.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size"))
    session = stream.sparkSession
    before = {key: session.conf.get(key, None) for key in SETTINGS}
    try:
        for key, value in SETTINGS.items():
            session.conf.set(key, value)
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            session.conf.unset(key) if value is None else session.conf.set(key, value)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``digest, keep_id, file, place, group_size``: the state as of the last finished batch."""
    rows = spark.read.format("statestore").load(checkpoint)
    value = [field.name for field in rows.schema["value"].dataType]
    return rows.select(
        F.col("key")[rows.schema["key"].dataType[0].name].alias("digest"), F.col("value")[value[0]].alias("first"), F.col("value")[value[1]].alias("group_size")
    ).select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.file").alias("file"), F.col("first.place").alias("place"), "group_size")


def may_hit(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows whose digest may be one of ``hits``, so that few other texts are shuffled to be compared.

    The filter is a bitmap of 2^24 bits in at most 2^18 rows, whatever the number of hits, which bounds its broadcast. The
    fuller it is the more rows pass; none of the hits is lost.
    """
    place = F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS))
    bits = hits.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("_bits")
    )
    tested = rows.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(bits), "_word")
    return tested.where("shiftrightunsigned(_bits, CAST(_place & 63 AS INT)) & 1 = 1").drop("_place", "_word", "_bits")


def exact_duplicates(
    docs: DataFrame, checkpoint: str | None = None, files_per_batch: int = 1000, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """Every row of ``docs`` with the row of its text that stays.

    ``docs`` is a table read from files with ``doc_id`` and ``text``; another frame is stored first. Rows are told apart by
    file and row number, so a file read twice into one frame gives rows that stay together. Other columns are ignored. Returns ``doc_id, keep_id, group_size, kept, text_sha256, file, place``: of equal texts the row with the
    smallest doc_id stays (missing ids last; of rows that share it the first by file and row number), ``group_size`` is
    the number of rows with the text. NULL counts as empty, and an empty table gives an empty one. ``checkpoint`` names the folder
    of the state in the shared storage; without it a new one is made. With an old one the records of earlier calls count
    too; their texts, which may be gone, are not compared again.
    """
    spark = docs.sparkSession
    if not has_places(docs):
        docs = stored(docs.select("doc_id", "text"), "documents")
    checkpoint = checkpoint or new_path(spark, "state")
    arrived = f"{checkpoint}/records/{uuid.uuid4().hex}"
    records(docs, digest).write.parquet(arrived)
    log = spark.read.schema(RECORD).parquet(arrived)
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).parquet(f"{checkpoint}/records/*")
    update_state(stream, f"{checkpoint}/stream")
    state = stored(read_state(spark, f"{checkpoint}/stream"), "state")

    # The full texts of all hits, each group reduced inside the tasks before the shuffle.
    hits = stored(state.where("group_size > 1").select("digest"), "hits")
    content = docs.select(
        normalized(F.col("text").cast("string")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"),
    ).withColumn("digest", digest(F.col("text")))
    same_bytes = may_hit(content, hits).join(hits, "digest").groupBy("digest", "text").agg(F.count("*").alias("group_size"))
    broken = stored(same_bytes.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "collisions")

    located = log.withColumnRenamed("file", "own_file").withColumnRenamed("place", "own_place")
    sound = located.join(state, "digest")
    kept = (F.col("own_file") == F.col("file")) & (F.col("own_place") == F.col("place"))
    columns = ["doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("own_file").alias("file"), F.col("own_place").alias("place")]
    if broken.isEmpty():
        return sound.select(*columns)
    mixed = content.join(broken, "digest").withColumnRenamed("file", "own_file").withColumnRenamed("place", "own_place")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("own_file").alias("file"), F.col("own_place").alias("place")))
    classes = mixed.groupBy("digest", "text").agg(first.alias("first"), F.count("*").alias("group_size"))
    classes = classes.select("digest", "text", F.col("first.doc_id").alias("keep_id"), "first.file", "first.place", "group_size")
    resolved = mixed.join(classes, ["digest", "text"]).select(*columns)
    return sound.join(broken, "digest", "left_anti").select(*columns).unionByName(resolved)


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the options are those of ``exact_duplicates``."""
    if not has_places(docs):
        docs = stored(docs, "documents")
    gone = stored(exact_duplicates(docs, **options).where(~F.col("kept")).select(F.col("file").alias("_file"), F.col("place").alias("_place")), "gone")
    rows = docs.select(F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("row"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    return rows.join(gone, ["_file", "_place"], "left_anti").select("row.*")
