"""Consuming an inbox once: a ledger of processed ids beside it, marked batch by batch.

A batch's ids are one folder of the ledger, named by the consumer and the batch. A batch that is run again, because it failed
before or after its marks were written, overwrites that folder and ignores it when it asks what is processed, so it
handles the same messages and marks them once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.sources.inbox import read_or_empty

MARKS = "id string, batch string"


def unprocessed(inbox: DataFrame, ledger: str, but: str | None = None) -> DataFrame:
    """The rows of inbox (id, optionally processed) that are neither flagged nor in the ledger, marks of the batch but left aside.
    Rows without an id can't be marked and are left out; of rows that repeat an id all count."""
    done = read_or_empty(inbox.sparkSession, ledger, MARKS).where(F.lit(True) if but is None else F.col("batch") != but).select("id").distinct()
    open_ = inbox.where(~F.coalesce("processed", F.lit(False))) if "processed" in inbox.columns else inbox
    return open_.where("id is not null").join(done, "id", "left_anti")


def mark(ids: DataFrame, ledger: str, batch: str) -> None:
    """Write the ids of a batch to the ledger, in place of what that batch marked before."""
    ids.select("id").distinct().write.mode("overwrite").parquet(f"{ledger}/batch={batch}")


def consume(inbox: DataFrame, ledger: str, checkpoint: str, handle: Callable[[DataFrame, str], None]):
    """Start handling a stream of inbox rows (id and whatever handle wants) that no one has processed; handle gets the rows and the
    batch's name, under which its own output must be repeatable. Ends when all that is there has been handled."""
    consumer = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def each(rows: DataFrame, number: int) -> None:
        batch = f"{consumer}-{number}"
        rows = unprocessed(rows.dropDuplicates(["id"]), ledger, batch)
        handle(rows, batch)
        mark(rows, ledger, batch)

    return inbox.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_inbox(spark: SparkSession, folder: str, schema, files_a_batch: int = 1) -> DataFrame:
    """The rows of the Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
