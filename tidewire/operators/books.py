"""Positions, source inventories and run reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def positions(events: DataFrame) -> DataFrame:
    """Quantity and events per ISIN; events without one are a row of their own."""
    return events.groupBy("isin").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("quantity"), 2).alias("quantity"))


def by_account(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("safekeeping_account", F.lit("—")).alias("account")).agg(F.count(F.lit(1)).alias("positions"), F.countDistinct("isin").alias("isins"), F.round(F.sum("quantity"), 2).alias("quantity"))


def sources(items: DataFrame) -> DataFrame:
    """items: source, kind (statement or position), message_type -> counts, the set of types and the share of the largest."""
    out = items.groupBy("source").agg(F.count_if(F.col("kind") == "statement").alias("statements"), F.count_if(F.col("kind") == "position").alias("positions"), F.count(F.lit(1)).alias("total"), F.array_join(F.array_sort(F.collect_set("message_type")), ",").alias("types"))
    return out.withColumn("percent", F.round(100.0 * F.col("total") / F.max("total").over(Window.partitionBy(F.lit(0))), 2))


def type_counts(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Messages per type, with whether rules exist for it; most first."""
    known = F.broadcast(rules.select("message_type").distinct().withColumn("known", F.lit(True)))
    return items.groupBy("message_type").agg(F.count(F.lit(1)).alias("messages")).join(known, "message_type", "left").select("message_type", "messages", F.coalesce("known", F.lit(False)).alias("has_rules")).orderBy(F.desc("messages"), "message_type")


def file_report(split: DataFrame, field_rows: DataFrame, diagnostics: DataFrame, complete: DataFrame, fragments: DataFrame) -> DataFrame:
    """Per file and type: messages, field rows, messages with diagnostics, messages whose fields aren't the whole of block 4, and
    the fragments that the file's split left out. split: name, message_id, message_type; complete: message_id, complete;
    fragments: name, kept."""
    n = field_rows.groupBy("message_id").agg(F.count(F.lit(1)).alias("fields"))
    bad = diagnostics.select("message_id").distinct().withColumn("bad", F.lit(1))
    part = complete.where("not complete").select("message_id", F.lit(1).alias("part"))
    joined = split.join(n, "message_id", "left").join(bad, "message_id", "left").join(part, "message_id", "left")
    counts = joined.groupBy("name", "message_type").agg(F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum("fields"), F.lit(0)).alias("fields"), F.count("bad").alias("diagnosed"), F.count("part").alias("block4_mismatches"))
    return counts.join(fragments.groupBy("name").agg(F.count_if(~F.col("kept")).alias("skipped_fragments")), "name")


def run_status(run_messages: DataFrame) -> DataFrame:
    """run_messages: job_id, message_id, errors, rendered, failed -> counts and status per job."""
    status = F.when(F.bool_or("failed"), "failed").when(F.sum("errors") > 0, "completed_with_errors").otherwise("completed")
    return run_messages.groupBy("job_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("errors").alias("parse_errors"), F.count_if("rendered").alias("rendered"), status.alias("status"))


def metered(df: DataFrame, kind: str, size: str, kinds: list[str], edges: list[int], write: Callable[[DataFrame], None]) -> DataFrame:
    """metric, label, n of what write writes, measured in that pass by observing it: messages per kind (others under other), rows,
    bytes, and rows at or below each edge of size (cumulative). kinds and edges are fixed lists, so the metrics are few."""
    own = lambda k: F.col(kind) == k
    wanted = {("rows", ""): F.count(F.lit(1)), ("bytes", ""): F.coalesce(F.sum(F.col(size).cast("long")), F.lit(0).cast("long"))}
    wanted |= {("messages", k): F.count_if(own(k)) for k in kinds} | {("messages", "other"): F.count_if(~F.coalesce(F.col(kind).isin(kinds), F.lit(False)))}
    wanted |= {("size_at_most", str(e)): F.count_if(F.col(size) <= e) for e in edges}
    seen = Observation()
    write(df.observe(seen, *(c.alias(f"m{i}") for i, c in enumerate(wanted.values()))))
    got = seen.get
    return df.sparkSession.createDataFrame([(metric, label, got[f"m{i}"]) for i, (metric, label) in enumerate(wanted)], "metric string, label string, n long")


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Rows at or below each edge (cumulative), and in all (a null edge)."""
    marks = F.array(*(F.lit(float(e)) for e in edges), F.lit(float("inf")))
    counted = df.select(F.explode(F.filter(marks, lambda e: F.col(value) <= e)).alias("le")).groupBy("le").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.when(F.col("le") < float("inf"), F.col("le")).alias("le"), "n")
