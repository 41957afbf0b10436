"""Entity rows from captures or messages, and security events from entity rows by branch lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import capture, nearest, rules

def values_of(messages: DataFrame, catalog=rules.CATALOG, entities: tuple[str, ...] | None = None) -> DataFrame:
    """The entity_values of messages, of some entities or of all, from one pass over each message and without a shuffle. Each row of
    messages counts as one message."""
    return messages.select("message_id", "message_type", "body").mapInArrow(capture.entity_values(capture.Rules(catalog), entities and frozenset(entities)), capture.VALUES)


def entity_values(captures: DataFrame) -> DataFrame:
    """entity, message_id, message_type, seq_index, column, value, raw, row_ord: the later field wins; the raw capture stays beside
    the value for rendering."""
    good = captures.where("failure is null")
    last = F.max_by(F.struct("normal", "raw", "tag", "qualifier"), F.struct("field_seq", "rule_ord"))
    return good.groupBy("entity", "message_id", "message_type", "seq_index", "column").agg(last.alias("v"), F.min("field_seq").alias("row_ord")).select("entity", "message_id", "message_type", "seq_index", "column", F.col("v.normal").alias("value"), F.col("v.raw").alias("raw"), F.col("v.tag").alias("tag"), "row_ord")


def entity_table(values: DataFrame, layout_rows: list, entity: str) -> DataFrame:
    """One entity as a typed table: message_id, sequence_path, a column per rule column and its raw capture. The columns come from
    the layout (entity, column, type), so pivoting needs no pass of its own."""
    columns = [(r["column"], r["type"]) for r in layout_rows if r["entity"] == entity]
    rows = values.where(F.col("entity") == entity)
    pick = lambda c, v: F.max(F.when(F.col("column") == c, F.col(v)))
    typed = lambda c, t: pick(c, "value").try_cast("date") if t == "DATE" else pick(c, "value").try_cast("decimal(38,12)") if t.startswith("DEC") else pick(c, "value")
    return rows.groupBy("message_id", F.col("seq_index").alias("sequence_path")).agg(*(typed(c, t).alias(c) for c, t in columns), *(pick(c, "raw").alias(render_column(c)) for c, _ in columns))


def table_of(messages: DataFrame, layout_rows: list, entity: str, catalog=rules.CATALOG) -> DataFrame:
    """entity_table of the values_of messages, each of which is whole in its task: nothing is shuffled."""
    columns = [(r["column"], r["type"]) for r in layout_rows if r["entity"] == entity]
    n = range(len(columns))
    rows = messages.select("message_id", "message_type", "body").mapInArrow(capture.entity_rows(capture.Rules(catalog), entity, [c for c, _ in columns]), ", ".join(["message_id string, sequence_path string", *(f"{x}{i} string" for x in "vr" for i in n)]))
    typed = lambda c, t: c.try_cast("date") if t == "DATE" else c.try_cast("decimal(38,12)") if t.startswith("DEC") else c
    return rows.select("message_id", "sequence_path", *(typed(F.col(f"v{i}"), columns[i][1]).alias(columns[i][0]) for i in n), *(F.col(f"r{i}").alias(render_column(columns[i][0])) for i in n))


def render_column(column: str) -> str:
    import re

    return f"{column}__render_" + re.sub(r"[^a-z0-9]+", "_", column.lower()).strip("_")


def long_form(table: DataFrame, layout_rows: list, entity: str, message_type: str) -> DataFrame:
    """An entity's typed table (or one message's rows of it) back as values with their raw captures, as rendering takes them."""
    columns = [r["column"] for r in layout_rows if r["entity"] == entity]
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.col(render_column(c)).alias("raw")) for c in columns)))
    rows = table.select("message_id", F.col("sequence_path").alias("seq_index"), each.alias("e")).where("e.value is not null or e.raw is not null")
    return rows.select(F.lit(entity).alias("entity"), "message_id", F.lit(message_type).alias("message_type"), "seq_index", "e.column", "e.value", "e.raw")


def schema_of(spark: SparkSession, layout_rows: list, entity: str) -> DataFrame:
    """An empty table of an entity's layout, whose schema an older table is read in."""
    columns = [(r["column"], dict(TEXT="string").get(r["type"], r["type"].lower())) for r in layout_rows if r["entity"] == entity]
    return spark.createDataFrame([], ", ".join(["message_id string", "sequence_path string", *(f"{c} {t}" for c, t in columns), *(f"{render_column(c)} string" for c, _ in columns)]))


def security_events(values: DataFrame, field_rows: DataFrame, messages: DataFrame) -> DataFrame:
    """One event per row that yields an ISIN, else one per message of a type with events.

    Attributes are looked up nearest first: facts in the event's branch (above, below or beside it, or under the same
    occurrence of another first sequence), then those at root; without a path all facts of the message count (see nearest). Values,
    dates and messages are shuffled once, by message, which limits on messages bound.
    """
    day = F.regexp_extract("value", r"(\d{8})", 1)
    dates = field_rows.where("qualifier = 'SETT' and tag like '98%'").select("message_id", F.lit(2).alias("what"), F.lit(nearest.DATE[0]).alias("entity"), F.lit(nearest.DATE[1]).alias("column"), "seq_index", day.alias("value"), F.col("value").alias("raw"), F.col("field_seq").alias("row_ord"))
    facts = values.select("message_id", F.lit(1).alias("what"), "message_type", "entity", "column", "seq_index", "value", "raw", "row_ord").unionByName(dates, allowMissingColumns=True)
    rows = messages.select("message_id", F.lit(0).alias("what"), "message_type").distinct().unionByName(facts, allowMissingColumns=True)
    partitions = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = rows.select(*(c.split()[0] for c in nearest.ROWS.split(", "))).repartition(partitions, "message_id").sortWithinPartitions("message_id", "what")
    return _events(together.mapInArrow(nearest.events_of_rows, nearest.FOUND))


def _events(found: DataFrame) -> DataFrame:
    number = lambda c: F.col(c).try_cast("double").alias(c)
    kind = F.upper(F.trim("message_type"))
    return found.select(
        F.lit("swift").alias("source"), "message_id", "row_seq", F.coalesce("transaction_ref", "sender").alias("transaction_ref"), "message_type",
        F.when(kind == "MT535", "holding").when(kind.isin(*nearest.SETTLEMENT), "settlement").when(kind.isin(*nearest.TRADE), "trade_confirm").otherwise("other").alias("kind"), "isin", "instrument_desc",
        number("quantity"), number("amount"), F.nullif(F.regexp_extract("amount_raw", r"^N?([A-Z]{3})\d", 1), F.lit("")).alias("currency"),
        F.regexp_replace(F.nullif("sett", F.lit("")), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").alias("settlement_date"), "safekeeping_account", "party_bic", "status",
    )


def events_of(messages: DataFrame, catalog=rules.CATALOG) -> DataFrame:
    """The events of messages, each of which is parsed once and whole in its task."""
    return _events(messages.select("message_id", "message_type", "body").mapInArrow(nearest.events_of(capture.Rules(catalog)), nearest.FOUND))
