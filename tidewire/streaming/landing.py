"""Landing inbox files once, in batch or with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import structure
from tidewire.sources.inbox import read_or_empty

CHUNK = 2000
LANDED = "source_id string, name string, fragment int, byte_offset long, body string, file_sha256 string, message_sha256 string, message_id string, shard string"


def parsed(files: DataFrame) -> DataFrame:
    """Messages of files with their ids; skipped fragments are left out."""
    split = structure.messages_of_files(files)
    return structure.identity(split.where("kept").drop("kept"), files).select("source_id", "name", "fragment", "byte_offset", "body", "file_sha256", "message_sha256", "message_id")


def _shard(file_sha256: str) -> Column:
    """The folder of a file's messages, by the beginning of its hash; a letter keeps Spark from reading it as a number."""
    return F.concat(F.lit("h"), F.substring(file_sha256, 1, 2))


def landed(spark: SparkSession, table: str, shards: list[str] | None = None) -> DataFrame:
    """What has landed in a table, or in some of its shards; only their files are listed and read."""
    rows = read_or_empty(spark, f"{table}/raw", LANDED)
    return rows if shards is None else rows.where(F.col("shard").isin(shards))


def land(messages: DataFrame, table: str) -> dict[str, int]:
    """Append messages whose id the table (a Parquet folder) hasn't, once each; counts of landed and already there. All of a
    message, its position too, is one row of one append, so that a reader never sees a message half landed, and a batch
    that failed can be landed again.

    The table is partitioned by the beginning of the hash of a message's file, 256 shards. An id is made of that hash,
    so what a batch repeats lies in the shards of its own files, and only these are read."""
    spark = messages.sparkSession
    batch = messages.withColumn("shard", _shard("file_sha256")).dropDuplicates(["message_id"]).persist()
    try:
        shards = [r[0] for r in batch.select("shard").distinct().collect()]  # 256 at most
        there = landed(spark, table, shards).select("message_id").distinct().withColumn("there", F.lit(True))
        marked = batch.join(there, "message_id", "left")
        counts = marked.agg(F.count(F.lit(1)), F.count("there")).first()
        marked.where("there is null").select(*[c.split()[0] for c in LANDED.split(", ")]).write.mode("append").partitionBy("shard").parquet(f"{table}/raw")
    finally:
        batch.unpersist()
    return {"landed": counts[0] - counts[1], "already": counts[1]}


def stream(spark: SparkSession, inbox: str, table: str, checkpoint: str, source_id: str = "broker:stream"):
    """Start landing files of inbox; the checkpoint remembers which were read. Sending a file again lands nothing."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(inbox)
    named = files.select(F.lit(source_id).alias("source_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def each(batch: DataFrame, _: int) -> None:
        land(parsed(batch), table)

    return named.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunks(messages: DataFrame, size: int = CHUNK) -> DataFrame:
    """Per file and chunk of so many messages: how many, and the last offset, which is the position to send on from."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source_id", "name").orderBy("byte_offset")) - 1
    return messages.withColumn("chunk", F.floor(place / size)).groupBy("source_id", "name", "chunk").agg(F.count(F.lit(1)).alias("messages"), F.max("byte_offset").alias("position"))
