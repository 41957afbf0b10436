"""What the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The token of a name that no user column has.
OWN = "__tw_"
#: The key that tells rows apart, also such that repeat an id.
ROW = f"{OWN}row"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a fresh one if Spark runs in this
    process alone; on a cluster that is an error, since no other machine would see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master.startswith("local[") or master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, what: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: it cuts the lineage, and a lost executor costs no
    recomputation. An empty frame keeps its schema."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that have an id, with a long in the column ROW that tells them apart: the id itself where it is a whole
    number and no row repeats another's, else a number, in a written copy, so that a row keeps it."""
    docs = docs.where(F.col(id_col).isNotNull())
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
        return docs.withColumn(ROW, F.col(id_col).cast("long"))
    return staged(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def keyed(docs: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """row, doc_id, text of the rows with an id. row_col tells rows apart; where there is none, with_rows does."""
    picked = docs.select(*([F.col(row_col).alias("row")] if row_col else []), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return picked if row_col else with_rows(picked).withColumnRenamed(ROW, "row")


def small_parts(batches: Iterator[pa.RecordBatch], text_col: int | tuple[int, ...], size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about size bytes of text in one or several columns, or one row, so that few texts are
    Python strings at once."""
    cols = (text_col,) if isinstance(text_col, int) else text_col
    for batch in batches:
        total = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in cols))
        start = 0
        while start < batch.num_rows:
            before = int(total[start - 1]) if start else 0
            end = max(start + 1, min(int(np.searchsorted(total, before + size, side="right")), start + 4096))
            yield batch.slice(start, end - start)
            start = end
