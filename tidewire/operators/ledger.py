"""Run ledgers: latest row per job, durations, newest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.sources.inbox import read_or_empty

MOST_RUNS = 500


def upserted(old: DataFrame, new: DataFrame, key: str = "job_id", by: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The latest row of each key in either frame: one aggregation, no window."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, *by)]
    last = F.max(F.struct(*by, *rest))
    return both.groupBy(key).agg(last.alias("v")).select(key, *(F.col(f"v.{c}").alias(c) for c in (*by, *rest)))


def durations(changes: DataFrame) -> DataFrame:
    """changes: job_id, status, ts -> when each was queued, running and over, and how long it ran."""
    at = lambda *s: F.min(F.when(F.col("status").isin(*s), F.col("ts")))
    out = changes.groupBy("job_id").agg(at("queued").alias("queued_at"), at("running").alias("running_at"), at("completed", "completed_with_errors", "failed").alias("ended_at"))
    return out.withColumn("seconds", F.unix_seconds(F.to_timestamp("ended_at")) - F.unix_seconds(F.to_timestamp("running_at")))


def newest(runs: DataFrame, limit: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("updated_at"), "job_id").limit(min(limit, MOST_RUNS))


MANIFEST = "version int, upto string"


def _manifest(spark: SparkSession, folder: str) -> tuple[int, str]:
    """(the newest version of a kept ledger, the last batch in it); a ledger that was never compacted is at version 0."""
    newest = read_or_empty(spark, f"{folder}/manifest", MANIFEST).agg(F.max(F.struct("version", "upto"))).first()[0]
    return (newest["version"], newest["upto"]) if newest else (0, "")


def append(rows: DataFrame, folder: str, batch: int) -> None:
    """Append a batch to a kept ledger's log; the same batch again takes its own place, so that a batch that failed can be repeated."""
    rows.write.mode("overwrite").parquet(f"{folder}/log/batch=b{batch:012d}")


def audit(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All that was ever appended, with its batch."""
    return read_or_empty(spark, f"{folder}/log", f"{schema}, batch string")


def current(spark: SparkSession, folder: str, schema: str, key: str, by: tuple[str, ...]) -> DataFrame:
    """The latest row per key: the newest compacted version, and the batches that came after it, whose folders alone are read of
    the log."""
    version, upto = _manifest(spark, folder)
    log = audit(spark, folder, schema).where(F.col("batch") > upto).drop("batch")
    base = read_or_empty(spark, f"{folder}/base/version={version}", schema)
    return upserted(base, log, key, by)


def compact(spark: SparkSession, folder: str, schema: str, key: str, by: tuple[str, ...]) -> int:
    """Write the latest rows as a new version, then name it in the manifest in one commit. Who read before keeps the version that
    it found, which stays; who reads while this runs sees either version whole. One compaction may run at a time."""
    version, before = _manifest(spark, folder)
    log = audit(spark, folder, schema)
    upto = log.agg(F.max("batch")).first()[0] or before
    base = read_or_empty(spark, f"{folder}/base/version={version}", schema)
    # Batches that come meanwhile are not in the version, so they must not count as in it.
    upserted(base, log.where((F.col("batch") > before) & (F.col("batch") <= upto)).drop("batch"), key, by).write.mode("overwrite").parquet(f"{folder}/base/version={version + 1}")
    spark.createDataFrame([(version + 1, upto)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return version + 1
