"""Queries over rendering, headers, layouts, reports, sinks and landing."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import books, cash, entities, penalty, render, rules, structure
from tidewire.plans import bindings, event_queries
from tidewire.plans.cash_queries import _BATCH, S16
from tidewire.sources import evolve, shared, sinks
from tidewire.streaming import first_seen, landing, marks


def n7_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MT536 statements rendered from their entity values."""
    out = render.messages_from(entities.values_of(bindings.mt536(spark, sf_dir)), rules.rules(spark))
    return out.select("message_id", "message_type", "body")


N7 = """
WITH i AS (SELECT l_orderkey, o_custkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag) AS n,
    chr(10) || ':16R:TRADDET' || chr(10) || ':35B:ISIN US' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') || chr(10) || p_type || ' ' || ['GILT 4%','ETF','5% BOND','ORD','UNITS'][CAST(p_partkey % 5 + 1 AS INT)] || chr(10) || ':36B::PSTA//UNIT/' || CAST(l_quantity AS BIGINT) || ',' || chr(10) || ':98A::SETT//' || strftime(l_shipdate, '%Y%m%d') || chr(10) || ':16S:TRADDET' AS t,
    chr(10) || ':16R:SETDET' || chr(10) || ':16R:AMT' || chr(10) || ':19A::SETT//GBP' || replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || chr(10) || ':16S:AMT' || chr(10) || ':16S:SETDET' AS s
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
SELECT 'mt536-' || l_orderkey AS message_id, 'MT536' AS message_type, '{1:F01CUSTUS33AXXX0000000000}{2:I536CSDXUS33XXXXN}{4:' || chr(10) || ':16R:GENL' || chr(10) || ':20C::SEME//P' || l_orderkey || chr(10) || ':97A::SAFE//ACC' || any_value(o_custkey) || chr(10) || ':16S:GENL' || string_agg(t, '' ORDER BY n) || string_agg(s, '' ORDER BY n) || chr(10) || '-}' AS body FROM i GROUP BY l_orderkey"""


def j7_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements rendered from their entity tables as written and read back."""
    folder, rule_rows = shared.new_folder(spark, "entities"), rules.rules(spark)
    messages, layout = shared.written(bindings.mt536(spark, sf_dir), "messages"), rules.layout(rule_rows.where("message_type = 'MT536'")).collect()  # as long as a catalog
    names = sorted({r["entity"] for r in layout})
    sinks.write_star({e: entities.table_of(messages, layout, e) for e in names}, folder)
    stored = [entities.long_form(spark.read.parquet(f"{folder}/{e}"), layout, e, "MT536") for e in names]
    return render.messages_from(functools.reduce(DataFrame.unionByName, stored), rule_rows)


def m5_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: an entity's table whose first half was written in an older layout, with a column less and one as text, read in today's."""
    folder, rule_rows = shared.new_folder(spark, "evolved"), rules.rules(spark)
    layout = rules.layout(rule_rows.where("message_type = 'MT537'")).collect()  # as long as a catalog
    even = F.expr("cast(substring(message_id, 7) as long) % 2 = 0")
    now = shared.written(entities.table_of(bindings.mt537(spark, sf_dir), layout, "mt537_transaction"), "now")
    old = now.where(even).withColumn("amount", F.col("amount").cast("string")).drop("date", "date__render_date")
    for part in (old, now.where(~even)):
        evolve.append(part, folder)
    wanted = entities.schema_of(spark, layout, "mt537_transaction").schema
    return evolve.read(spark, folder, wanted).select("message_id", "sequence_path", F.col("amount").cast("double").alias("amount"), F.col("date").cast("string").alias("date"), "amount__render_amount")


M5 = """SELECT 'mt537-' || l_orderkey AS message_id, 'STAT[' || i || ']/TRAN[0]/TRANSDET[0]' AS sequence_path, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amount,
  CASE WHEN l_orderkey % 2 <> 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS date, 'USD' || replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') AS amount__render_amount
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag) - 1 AS i FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def n9_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered messages parse to the same field rows when rendered again, and have no defect of structure or of the rules."""
    once = shared.written(render.messages_from(entities.values_of(bindings.mt536(spark, sf_dir)), rules.rules(spark)), "rendered")
    again = render.messages_from(entities.values_of(once), rules.rules(spark))
    bad = rules.errors(once).select("message_id").distinct().withColumn("bad", F.lit(True))
    return render.round_trip(once, again).join(bad, "message_id", "left").groupBy("verdict", F.coalesce("bad", F.lit(False)).alias("bad")).agg(F.count(F.lit(1)).alias("messages"))


N9 = "SELECT 'same' AS verdict, false AS bad, count(DISTINCT l_orderkey) AS messages FROM lineitem"


def n1_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required values that a message can't be rendered without."""
    messages = bindings.mt540(spark, sf_dir)
    return render.missing(entities.values_of(messages), messages, rules.rules(spark)).groupBy("name").agg(F.count(F.lit(1)).alias("messages"))


N1 = "SELECT 'sender reference' AS name, count(*) AS messages FROM orders WHERE o_orderkey % 10 = 0 HAVING count(*) > 0"


def n6_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps instructions from being rendered, by a catalog that leaves an option open, names one that it
    doesn't have and a type that can't be written, from values of which some are missing, doubled or misplaced."""
    own = [(*r[:4], ["A", "C"], *r[5:14], None) if r[:2] == ("MT540", 5) else (*r[:14], "Q") if r[:2] == ("MT540", 6) else (*r[:7], "odd", *r[8:]) if r[:2] == ("MT540", 7) else r for r in rules.CATALOG.rules]
    catalog = rules.Catalog({**rules.TYPES, "odd": [("capture", "elsewhere", "text", 3)]}, own, rules.CATALOG.sequences)
    k = F.expr("cast(substring(message_id, 7) as long)")
    values = shared.written(entities.values_of(bindings.mt540(spark, sf_dir)), "values")
    moved = values.withColumn("seq_index", F.when((F.col("column") == "instrument") & (k % 8 == 0), F.lit("FIAC[0]/TRADDET[0]")).otherwise(F.col("seq_index")))
    twice = values.where((F.col("column") == "instrument") & (k % 12 == 1))
    given = moved.unionByName(twice).where((F.col("column") != "quantity") | (k % 5 != 0))
    wide = [(*r[:2], "TRADDET|FIAC/TRADDET", *r[3:]) if r[:2] == ("MT540", 3) else r for r in own]
    messages = bindings.mt540(spark, sf_dir)
    rule_rows = rules.rules(spark, rules.Catalog(catalog.types, wide, catalog.sequences))
    return render.errors(given, messages, rule_rows, rules.sequences(spark, catalog), rules.types(spark, catalog)).groupBy("kind", "detail").agg(F.countDistinct("message_id").alias("messages"))


N6 = """WITH o AS (SELECT o_orderkey AS k FROM orders),
  r AS (SELECT k, 'missing_required' AS kind, 'sender reference' AS detail FROM o WHERE k % 10 = 0 UNION ALL SELECT k, 'missing_required', 'quantity' FROM o WHERE k % 5 = 0
    UNION ALL SELECT k, 'missing_render_option', 'account' FROM o UNION ALL SELECT k, 'invalid_render_option', 'party' FROM o UNION ALL SELECT k, 'unsupported_capture', 'amount odd' FROM o
    UNION ALL SELECT k, 'render_cardinality', 'TRADDET[0] instrument 2' FROM o WHERE k % 12 = 1 UNION ALL SELECT k, 'wrong_parent', 'TRADDET in FIAC' FROM o WHERE k % 8 = 0)
  SELECT kind, detail, count(*) AS messages FROM r GROUP BY 1, 2"""


def j6_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with one type, and ids with several."""
    messages = bindings.mt940(spark, sf_dir)
    twice = messages.where("cast(substring(message_id, 7) as long) % 13 = 0").withColumn("message_type", F.lit("MT942"))
    good, bad = render.headers(messages.unionByName(twice))
    return good.groupBy("message_type").agg(F.count(F.lit(1)).alias("ids")).unionByName(bad.agg(F.lit("several").alias("message_type"), F.count(F.lit(1)).alias("ids")))


J6 = "SELECT 'MT940' AS message_type, count(*) AS ids FROM customer WHERE c_custkey % 13 <> 0 UNION ALL SELECT 'several', count(*) FROM customer WHERE c_custkey % 13 = 0"


def m3_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M5: the layout that rules give, each table evolved by its rows' counts."""
    rows = rules.layout(rules.rules(spark))
    used = entities.values_of(bindings.mt537(spark, sf_dir)).groupBy("entity", "column").agg(F.count(F.lit(1)).alias("values"))
    return used.join(F.broadcast(rows), ["entity", "column"]).select("entity", "column", "required", "type", "values")


_M3 = [("mt537_statement", "sender_reference", True, "TEXT", "o"), ("mt537_statement", "statement_date", False, "DATE", "o"), ("mt537_account", "account", False, "TEXT", "o"), ("mt537_status", "status_code", True, "TEXT", "l"), ("mt537_transaction_link", "linked_reference", False, "TEXT", "l"), ("mt537_instrument", "instrument", True, "TEXT", "l"), ("settlement_quantity", "quantity", False, "DECIMAL(38,12)", "l"), ("mt537_transaction", "amount", False, "DECIMAL(38,12)", "l"), ("mt537_transaction", "date", False, "DATE", "l"), ("settlement_party", "party", False, "TEXT", "l"), ("mt537_settlement_party", "account", False, "TEXT", "l")]
M3 = "WITH n AS (SELECT count(*) AS l, count(DISTINCT l_orderkey) AS o FROM lineitem) " + " UNION ALL ".join(f"SELECT '{e}' AS entity, '{c}' AS \"column\", {str(r).lower()} AS required, '{t}' AS type, {k} AS \"values\" FROM n" for e, c, r, t, k in _M3)


def a12_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, fields, diagnosed messages, block-4 mismatches and skipped fragments per file and type; every 3rd statement
    begins with lines that are no field, every 4th has a tag line that is none."""
    k = F.col("k")
    odd = F.when(k % 3 == 0, F.regexp_replace("body", r"\{4:\n:20", "{4:\nlost\n:20")).when(k % 4 == 0, F.regexp_replace("body", "\n:25:", "\n:BAD\n:25:")).otherwise(F.col("body"))
    files = bindings.content(bindings.filed(spark, sf_dir).withColumn("body", odd))
    fragments = structure.messages_of_files(files)
    found = shared.written(landing.parsed(files).withColumn("message_type", structure.message_type(F.col("body"))), "messages")
    return books.file_report(found, structure.fields(found), structure.diagnostics(found), structure.block4_complete(found), fragments)


A12 = f"""SELECT 'batch' || {_BATCH} || '.fin' AS name, 'MT940' AS message_type, count(*) AS messages, CAST(sum(5 + 2 * coalesce(n, 0)) AS BIGINT) AS fields, count(*) FILTER (c_custkey % 3 <> 0 AND c_custkey % 4 = 0) AS diagnosed,
  count(*) FILTER (c_custkey % 3 = 0) AS block4_mismatches, count(*) AS skipped_fragments FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1"""


def p2_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files landed, sent again under other names, and landed in part before; counts of both landings."""
    folder = shared.new_folder(spark, "landing")
    files = bindings.files(spark, sf_dir)
    first = landing.land(landing.parsed(files.where("name < 'batch2'")), folder)
    second = landing.land(landing.parsed(files.withColumn("name", F.concat(F.lit("again-"), "name"))), folder)
    back = landing.landed(spark, folder)
    counts = back.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("message_id").alias("ids"))
    sent = landing.chunks(back, 100).agg(F.sum("messages").alias("in_chunks"))
    return counts.crossJoin(sent).select("rows", "ids", "in_chunks", F.lit(first["landed"]).cast("long").alias("first_landed"), F.lit(second["already"]).cast("long").alias("second_already"))


P2 = f"SELECT count(*) AS rows, count(*) AS ids, CAST(count(*) AS BIGINT) AS in_chunks, count(*) FILTER ('batch' || {_BATCH} || '.fin' < 'batch2') AS first_landed, count(*) FILTER ('batch' || {_BATCH} || '.fin' < 'batch2') AS second_already FROM customer"


def p4_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user, and again the first later than 24 hours after it."""
    e = bindings.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts"), "event_id")
    return first_seen.first_per_key(e, "key", "ts").select("key", "event_id")


P4 = """WITH RECURSIVE a AS (
    SELECT user_id, min(ts) AS ts FROM events WHERE user_id IS NOT NULL GROUP BY 1
    UNION ALL SELECT a.user_id, min(e.ts) FROM a JOIN events e ON e.user_id = a.user_id AND e.ts > a.ts + INTERVAL 24 HOUR GROUP BY 1)
  SELECT a.user_id AS key, min(event_id) AS event_id FROM a JOIN events e ON e.user_id = a.user_id AND e.ts = a.ts GROUP BY a.user_id, a.ts"""


def p4_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 on a stream: the same events come a day at a time."""
    folder = shared.new_folder(spark, "events")
    e = bindings.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    e.orderBy("ts", "event_id").write.parquet(f"{folder}/in")
    live = first_seen.first_per_key(spark.readStream.schema(e.schema).parquet(f"{folder}/in"), "key", "ts")
    live.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{folder}/out").select("key", "event_id")


def p1_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inbox consumed as a stream, sent again with more, and consumed again; how often each message was handled, and the
    batches that marked it."""
    folder = shared.new_folder(spark, "inbox")
    k = F.expr("cast(substring(id, 7) as long)")
    box = bindings.mt940(spark, sf_dir).withColumnRenamed("message_id", "id").withColumn("processed", k % 5 == 0)

    def handle(rows: DataFrame, batch: str) -> None:
        rows.select("id", "message_type", F.regexp_extract("body", r":20:(\w+)", 1).alias("reference")).write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    for sent in (box.where(k % 2 == 0), box):
        sent.repartition(3).write.mode("append").parquet(f"{folder}/in")
        marks.consume(marks.stream_inbox(spark, f"{folder}/in", box.schema), f"{folder}/ledger", f"{folder}/checkpoint", handle).awaitTermination()
    out = spark.read.schema("id string, message_type string, reference string, batch string").parquet(f"{folder}/out")
    done = spark.read.schema(marks.MARKS).parquet(f"{folder}/ledger").groupBy("id").agg(F.count(F.lit(1)).alias("marks"))
    left = marks.unprocessed(box, f"{folder}/ledger").agg(F.count(F.lit(1)).alias("left"))
    handled = out.groupBy("id", "message_type", "reference").agg(F.count(F.lit(1)).alias("times")).join(done, "id")
    return handled.unionByName(left.selectExpr("'unprocessed' as id", "cast(null as string) as message_type", "cast(null as string) as reference", "left as times", "0L as marks"))


P1 = "SELECT 'mt940-' || c_custkey AS id, 'MT940' AS message_type, 'ST' || c_custkey AS reference, CAST(1 AS BIGINT) AS times, CAST(1 AS BIGINT) AS marks FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'unprocessed', NULL, NULL, 0, 0"


def e16_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with their entries as snapshot documents, written and read back; a row per entry."""
    folder = shared.new_folder(spark, "snapshot")
    heads, rows = cash.cash_star(bindings.mt940(spark, sf_dir))
    k = F.expr("cast(substring(message_id, 7) as long)")
    bare = rows.withColumn("customer_ref", F.when(k % 2 == 0, F.col("customer_ref"))).withColumn("info", F.when(k % 3 == 0, F.col("info"))).withColumn("entry_date", F.col("value_date")).withColumn("value_date", F.when(k % 5 == 0, F.col("value_date")))
    sinks.snapshot_lines(heads, bare).write.text(folder)
    entry = "valueDate string, direction string, amount double, signedAmount double, transactionType string, reference string, info string"
    docs = spark.read.text(folder).select(F.from_json("value", f"version int, source string, messageId string, messageType string, account string, currency string, opening double, closing double, entries array<struct<{entry.replace(' ', ':')}>>".replace(",:", ",")).alias("d")).select("d.*")
    return docs.select("version", "messageId", "account", "currency", "opening", F.posexplode("entries").alias("place", "e")).select("version", "messageId", "account", "currency", "opening", "place", "e.*")


E16 = f"""SELECT 1 AS version, message_id AS "messageId", account, currency, opening, CAST(row_seq AS INTEGER) AS place, value_date AS "valueDate", direction, amount, signed_amount AS "signedAmount", transaction_type AS "transactionType",
    CASE WHEN c_custkey % 2 = 0 THEN customer_ref ELSE bank_ref END AS reference, CASE WHEN c_custkey % 3 = 0 THEN info END AS info
  FROM ({S16}) e JOIN (SELECT 'mt940-' || c_custkey AS id, c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS opening FROM customer) ON id = message_id"""


def k5_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: the penalty snapshot, written and read back: its lines, and how many accruals and summaries it has."""
    folder, due = shared.new_folder(spark, "penalties"), event_queries._accruals(spark, sf_dir)
    lines = penalty.reconcile(due, event_queries._reported(spark, sf_dir))
    sinks.penalty_snapshot(due, lines, penalty.summary(lines)).write.text(folder)
    docs = spark.read.text(folder).select(F.from_json("value", "version int, kind string, transactionRef string, isin string, counterparty string, computed double, reported double, diff double, status string, computedTotal double").alias("d")).select("d.*")
    counted = docs.where("kind <> 'line'").groupBy("version", "kind").agg(F.count(F.lit(1)).cast("double").alias("computed"))
    return docs.where("kind = 'line'").select("version", "kind", "transactionRef", "isin", "counterparty", "computed", "reported", "diff", "status").unionByName(counted, allowMissingColumns=True)


K5 = event_queries.LINES + """SELECT 2 AS version, 'line' AS kind, transaction_ref AS "transactionRef", isin, counterparty_bic AS counterparty, computed_amount AS computed, reported_amount AS reported, diff, status FROM l
  UNION ALL SELECT 2, 'accrual', NULL, NULL, NULL, CAST(count(*) AS DOUBLE), NULL, NULL, NULL FROM c0 UNION ALL SELECT 2, 'summary', NULL, NULL, NULL, 1.0, NULL, NULL, NULL"""


def k_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 to K6, K8, X11: every writer, with the rows read back from each and a figure that their content gives."""
    folder = shared.new_folder(spark, "sinks")
    messages = bindings.mt940(spark, sf_dir)
    heads, rows = cash.cash_star(messages)
    sinks.write_star({"cash_statement": heads, "cash_entry": rows}, f"{folder}/star")
    sinks.export(heads, f"{folder}/csv", "csv")
    failed = messages.where("cast(substring(message_id, 7) as long) % 10 = 0").selectExpr("message_id", "'stopped' as detail")
    sinks.errors_ndjson(rules.without_rules(messages, rules.rules(spark)), failed, f"{folder}/errors")
    sinks.rendered_text(messages, f"{folder}/text")
    sinks.snapshot_lines(heads).write.text(f"{folder}/snapshot")
    due = event_queries._accruals(spark, sf_dir)
    work = penalty.work_lines(penalty.reconcile(*(2 * [due.withColumn("reported_amount", F.col("computed_amount"))])), due, spark.createDataFrame([], "key string, disposition string"))
    sinks.export(sinks.certificate(work), f"{folder}/certificate", "csv")
    sinks.manifest(heads.select("message_id", F.lit(0).alias("errors"))).write.json(f"{folder}/manifest")
    lines = F.regexp_count("value", F.lit(r"\\n:61:"))
    money = lambda c: F.round(F.sum(F.col(c).cast("decimal(18,2)")), 2)
    reread = (
        ("star", spark.read.parquet(f"{folder}/star/cash_entry"), money("amount")), ("csv", spark.read.csv(f"{folder}/csv", header=True), money("opening")),
        ("errors", spark.read.json(f"{folder}/errors"), F.count_if((F.col("kind") == "failed") & (F.col("detail") == "stopped"))), ("text", spark.read.text(f"{folder}/text"), F.sum(lines)),
        ("snapshot", spark.read.text(f"{folder}/snapshot").select(F.from_json("value", "opening double").alias("d")).select("d.*"), money("opening")),
        ("certificate", spark.read.csv(f"{folder}/certificate", header=True), F.count_if((F.col("status") == "matched") & (F.col("computed_amount") == F.col("reported_amount")))), ("manifest", spark.read.json(f"{folder}/manifest"), F.sum("messages")),
    )
    out = [df.agg(F.lit(name).alias("sink"), F.count(F.lit(1)).alias("rows"), figure.cast("double").alias("figure")) for name, df, figure in reread]
    return functools.reduce(DataFrame.unionByName, out)


KS = """WITH c AS (SELECT count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS opening, count(*) FILTER (c_custkey % 10 = 0) AS failed FROM customer), o AS (SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey),
    p AS (SELECT count(DISTINCT 'L' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R'))
  SELECT 'star' AS sink, n AS rows, total AS figure FROM o UNION ALL SELECT 'csv', n, opening FROM c UNION ALL SELECT 'errors', n + failed, failed FROM c UNION ALL SELECT 'text', c.n, o.n FROM c, o UNION ALL SELECT 'snapshot', n, opening FROM c
  UNION ALL SELECT 'certificate', n, n FROM p UNION ALL SELECT 'manifest', 1, n FROM c"""

QUERIES = {
    "n7_render": (n7_render, N7), "j7_stored": (j7_stored, N7), "m5_evolved": (m5_evolved, M5), "n9_roundtrip": (n9_roundtrip, N9), "n1_missing": (n1_missing, N1), "n6_errors": (n6_errors, N6), "j6_headers": (j6_headers, J6), "m3_layout": (m3_layout, M3), "a12_report": (a12_report, A12), "p1_stream": (p1_stream, P1), "p2_landing": (p2_landing, P2), "p4_first_per_key": (p4_first_per_key, P4), "p4_stream": (p4_stream, P4),
    "k_sinks": (k_sinks, KS), "e16_snapshot": (e16_snapshot, E16), "k5_penalties": (k5_penalties, K5),
}
