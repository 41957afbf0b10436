"""Files of FIN messages read in splits.

Spark's text source cuts a file at every {1: and gives each split to a task, so a file of any size is read by many tasks.
A record is the beginning of a message if what lies before it in the file ends in a closing brace and separators; another
{1: is text, and its record belongs to the message before. Offsets and belonging are found within a split first, then
between the splits of a file, of which each is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = "$ \t\n\f\r\x01\x03"


def _bare(text: Column) -> Column:
    return F.rtrim(text, F.lit(SEPARATORS))


def _in_order(*fields: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*fields))), lambda x: x[fields[-1]]), "")


def read_messages(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """path, byte_offset, body (separators at the end trimmed), kept: whether block 2 is there; a row per message of the files under
    path whose names end in suffix.

    The text is shuffled once, by file and split. Other text before a file's first message belongs to it, as in split_fin; a
    {1: that ends a file is no message. Empty files have no row.
    """
    texts = spark.read.option("lineSep", "{1:").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path)
    raw = texts.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    order = Window.partitionBy("path", "block").orderBy("at")
    head = (F.col("block") == 0) & (F.row_number().over(order) == 1)
    pieces = raw.withColumn("piece", F.when(head, F.col("value")).otherwise(F.concat(F.lit("{1:"), "value")))
    within = F.coalesce(F.sum(F.octet_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("within", within).withColumn("closed", F.lag(_bare(F.col("piece")).endswith("}")).over(order))
    starts = ((F.col("block") == 0) & (F.col("within") == 0)) | F.coalesce("closed", F.lit(False))
    pieces = pieces.withColumn("run", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("piece <> ''")
    # Run 0 is what a split holds before a message that surely begins in it: a message of its own, or the rest of an earlier one.
    runs = pieces.groupBy("path", "block", "run").agg(F.min("within").alias("within"), F.sum(F.octet_length("piece")).alias("bytes"), _in_order("at", "piece").alias("body"))
    closed = _bare(F.col("body")).endswith("}")
    splits = runs.groupBy("path", "block").agg(F.sum("bytes").alias("bytes"), F.max_by(closed, "run").alias("closed"), F.max("run").alias("runs"), F.max("within").alias("last"))
    file = Window.partitionBy("path").orderBy("block")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0))).withColumn("free", F.coalesce(F.lag("closed").over(file), F.lit(True)))
    began = F.when((F.col("runs") > 0) | F.col("free"), F.col("base") + F.col("last"))
    splits = splits.withColumn("owner", F.last(began, ignorenulls=True).over(before)).select("path", "block", "base", "free", "owner")
    placed = runs.join(splits, ["path", "block"]).withColumn("byte_offset", (F.col("base") + F.col("within")).cast("long")).withColumn("begins", (F.col("run") > 0) | F.col("free"))
    rest = placed.where("not begins").groupBy("path", F.col("owner").alias("byte_offset")).agg(_in_order("base", "body").alias("rest"))
    whole = placed.where("begins").join(rest, ["path", "byte_offset"], "left").withColumn("body", F.concat("body", F.coalesce("rest", F.lit(""))))
    return whole.select("path", "byte_offset", _bare(F.col("body")).alias("body"), F.col("body").contains("{2:").alias("kept"))


def write_files(messages: DataFrame, folder: str, key: str, order: str, text: str, end: str = "$\r\n") -> None:
    """Messages as text files, one per value of key in the folder <key>=<value>, in order, end behind each."""
    messages.repartition(key).sortWithinPartitions(key, order).select(key, text).write.partitionBy(key).option("lineSep", end).text(folder)
