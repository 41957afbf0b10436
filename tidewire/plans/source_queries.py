"""Queries over inbox sources, catalogs, ledgers and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as texts
from tidewire.operators import books, cash, ledger, rules
from tidewire.plans import bindings
from tidewire.plans.cash_queries import A4, DEFECTIVE, E_SQL, S_SQL
from tidewire.sources import adapters, inbox, shared


def s1_inbox_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, T1, P1 in batch form: the first 100 unprocessed messages by id."""
    k = F.expr("cast(substring(message_id, 7) as long)")
    table = bindings.mt940(spark, sf_dir).select(F.col("message_id").alias("id"), "message_type", "body", F.when(k % 5 == 0, None).otherwise(k % 2 == 0).alias("processed"))
    return inbox.read_batch(table, 100).select("id", "message_type", F.regexp_extract("body", r":20:(\w+)", 1).alias("reference"))


S1 = "SELECT 'mt940-' || c_custkey AS id, 'MT940' AS message_type, 'ST' || c_custkey AS reference FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 2 <> 0 ORDER BY 1 LIMIT 100"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every format, good and bad, one per order."""
    bindings._view(spark, sf_dir, "orders")
    return spark.sql("""select case o_orderkey % 3 when 0 then 'custodian:citigb2l' when 1 then 'broker:acme-1' else 'nobody' end as source_id,
      concat('f', o_orderkey, case o_orderkey % 7 when 1 then '.xml' when 2 then '.csv' when 3 then '.csv' else '.txt' end) as name,
      case o_orderkey % 7 when 0 then cast('{1:F01X}{2:I940X}{4:\\n:20:A\\n:61:x\\n-}' as binary) when 1 then cast('<Document/>' as binary) when 2 then cast('ISIN,Quantity\\nUS0000000001,5' as binary)
        when 3 then cast('a,b\\n1,2' as binary) when 4 then cast('isin, x\\n' as binary) when 5 then X'FF00FE' else cast('hello' as binary) end as content from tw_orders""")


def s5_detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats, routes, canonical sources and refused files."""
    files = inbox.inbox_rows(_mixed(spark, sf_dir))
    good, refused = inbox.sorted_out(files)
    route = inbox.detect_route(F.col("name"), F.col("content"))
    a = good.groupBy(F.col("source").alias("source"), F.col("format").alias("format"), route.alias("route")).agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit(None).cast("string"))
    b = refused.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("route"), "n", "reason")
    return a.unionByName(b)


S5 = """WITH f AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'custodian:CITIGB2LXXX' WHEN 1 THEN 'broker:acme-1' END AS source, o_orderkey % 7 AS k FROM orders),
  g AS (SELECT source, CASE k WHEN 0 THEN 'mt' WHEN 1 THEN 'camt' WHEN 2 THEN 'csv' END AS format, CASE k WHEN 0 THEN 'cash' WHEN 1 THEN 'camt' WHEN 2 THEN 'csv' END AS route,
    CASE WHEN source IS NULL THEN 'bad_source' WHEN k = 5 THEN 'not_utf8' WHEN k = 6 THEN 'unknown_format' WHEN k IN (3, 4) THEN 'unknown_layout' END AS reason FROM f)
  SELECT CASE WHEN reason IS NULL THEN source END AS source, CASE WHEN reason IS NULL THEN format END AS format, CASE WHEN reason IS NULL THEN route END AS route, count(*) AS n, reason FROM g GROUP BY ALL"""


def s8_split_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements without an envelope, several in a file, some interim reports."""
    k = F.col("c_custkey")
    text = F.when(k % 6 == 0, F.concat("text", F.lit("\n:34F:USD0,"))).when(k % 10 == 0, F.regexp_replace("text", r"(?m)^:25:.*\n", "")).otherwise(F.col("text"))
    one = bindings.bare_mt940(spark, sf_dir).withColumn("text", F.concat(text, F.lit("\n-\n")))
    files = one.groupBy(F.floor(k / bindings.PER_FILE).alias("g")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "text"))), lambda x: x["text"]), "").alias("text")).select(F.lit("broker:b").alias("source_id"), F.concat(F.lit("g"), F.col("g").cast("string")).alias("name"), "text")
    out = inbox.split_bare(files)
    return out.select("name", "message_type", F.regexp_extract("raw", r":20:(\w+)", 1).alias("reference"), F.regexp_extract("body", r"\{2:I(\d+)X", 1).alias("wrapped"))


S8 = f"SELECT 'g' || (c_custkey // {bindings.PER_FILE}) AS name, CASE WHEN c_custkey % 6 = 0 THEN 'MT942' ELSE 'MT940' END AS message_type, 'ST' || c_custkey AS reference, CASE WHEN c_custkey % 6 = 0 THEN '942' ELSE '940' END AS wrapped FROM customer WHERE c_custkey % 10 <> 0 OR c_custkey % 6 = 0"


def _csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    bindings._view(spark, sf_dir, "lineitem")
    rows = spark.sql("""select l_orderkey, concat_ws(',', if(l_partkey % 9 = 0, 'BAD', concat('us', lpad(l_partkey, 10, '0'))), if(l_partkey % 13 = 0, 'many', cast(cast(l_quantity as long) as string)), concat('S', l_suppkey), '', concat('L', l_orderkey, '-', l_partkey)) as line from tw_lineitem""")
    return rows.groupBy("l_orderkey").agg(F.concat(F.lit("ISIN,Quantity,Account,Party,Reference\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n\n")).alias("text")).select(F.concat(F.lit("p"), F.col("l_orderkey").cast("string"), F.lit(".csv")).alias("name"), "text")


def s10_csv_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions from custodian files, bad ISINs and numbers null."""
    return inbox.positions(_csv_files(spark, sf_dir)).select("name", "isin", "quantity", "safekeeping_account", "party_bic", "transaction_ref")


S10 = "SELECT 'p' || l_orderkey || '.csv' AS name, CASE WHEN l_partkey % 9 <> 0 THEN 'US' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') END AS isin, CASE WHEN l_partkey % 13 <> 0 THEN CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) END AS quantity, 'S' || l_suppkey AS safekeeping_account, CAST(NULL AS VARCHAR) AS party_bic, 'L' || l_orderkey || '-' || l_partkey AS transaction_ref FROM lineitem"


def f16_csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: every cell as a field row, its header as the tag."""
    return inbox.csv_fields(_csv_files(spark, sf_dir)).groupBy("tag", "field_seq").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") == "").alias("blank"))


F16 = "SELECT t AS tag, i AS field_seq, count(*) AS n, CASE WHEN t = 'party' THEN count(*) ELSE 0 END AS blank FROM lineitem, (VALUES ('isin', 0), ('quantity', 1), ('account', 2), ('party', 3), ('reference', 4)) v(t, i) GROUP BY 1, 2"


def _camt(spark: SparkSession, sf_dir: str) -> DataFrame:
    bindings._view(spark, sf_dir, "customer", "orders")
    return spark.sql("""
      with l as (select o_custkey, sum(cast(o_totalprice as decimal(18,2)) * case when o_orderstatus = 'O' then -1 else 1 end) as moved, array_join(transform(array_sort(collect_list(struct(o_orderkey as k, concat('<Ntry><NtryRef>ORD', o_orderkey, '</NtryRef><Amt Ccy="EUR">', cast(o_totalprice as decimal(18,2)), '</Amt><CdtDbtInd>', if(o_orderstatus = 'F', 'CRDT', 'DBIT'), '</CdtDbtInd><RvslInd>', if(o_orderstatus = 'P', 'true', 'false'), '</RvslInd><ValDt><Dt>', date_format(o_orderdate, 'yyyy-MM-dd'), '</Dt></ValDt></Ntry>') as x))), s -> s.x), '') as ns from tw_orders group by o_custkey)
      select concat('camt', c_custkey) as name, concat('<?xml version="1.0"?><Document xmlns="urn:iso:std:iso:20022:tech:xsd:camt.053.001.02"><BkToCstmrStmt><Stmt><Id>S', c_custkey, '</Id><Acct><Id><IBAN>DE', c_custkey, '</IBAN></Id></Acct>',
        '<Bal><Tp><CdOrPrtry><Cd>OPBD</Cd></CdOrPrtry></Tp><Amt Ccy="EUR">', abs(cast(c_acctbal as decimal(18,2))), '</Amt><CdtDbtInd>', if(c_acctbal < 0, 'DBIT', 'CRDT'), '</CdtDbtInd></Bal><Bal><Tp><CdOrPrtry><Cd>CLBD</Cd></CdOrPrtry></Tp><Amt Ccy="EUR">', abs(cast(c_acctbal as decimal(18,2)) + coalesce(moved, 0)), '</Amt><CdtDbtInd>', if(cast(c_acctbal as decimal(18,2)) + coalesce(moved, 0) < 0, 'DBIT', 'CRDT'), '</CdtDbtInd></Bal>', coalesce(ns, ''), '</Stmt></BkToCstmrStmt></Document>') as text
      from tw_customer left join l on o_custkey = c_custkey""")


def s13_camt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML statements, reconciled."""
    heads, rows = inbox.camt_statements(_camt(spark, sf_dir))
    return cash.verdicts(heads, rows).select("message_id", "account", "currency", "opening", F.round("net", 2).alias("net"), "closing", "reconciles")


S13 = f"SELECT replace(message_id, 'mt940-', 'camt') || '-1' AS message_id, 'DE' || c_custkey AS account, 'EUR' AS currency, opening, round(i, 2) AS net, round(opening + i, 2) AS closing, true AS reconciles FROM (SELECT s.*, coalesce((SELECT sum(signed_amount) FROM ({E_SQL}) e WHERE e.o_custkey = s.c_custkey), 0) AS i FROM ({S_SQL}) s)"


def s9_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML files cut off before their end are refused with a reason, the others are read."""
    files = _camt(spark, sf_dir)
    cut = F.regexp_extract("name", r"(\d+)", 1).cast("long") % 7 == 0
    broken = files.withColumn("text", F.when(cut, F.expr("substring(text, 1, length(text) - 20)")).otherwise(F.col("text")))
    heads, _ = inbox.camt_statements(broken)
    return inbox.refused_camt(broken).unionByName(heads.select(F.regexp_replace("message_id", "-1$", "").alias("name"), F.lit(None).cast("string").alias("reason")))


S9 = f"SELECT replace(message_id, 'mt940-', 'camt') AS name, CASE WHEN c_custkey % 7 = 0 THEN 'malformed_xml' END AS reason FROM ({S_SQL})"


def s9_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each of two statements of a document begins, behind a comment that holds one too, and what it holds."""
    twice = F.regexp_replace(F.regexp_replace("text", "(?s)(<Stmt>.*</Stmt>)", "$1\n$1"), "<BkToCstmrStmt>", "<BkToCstmrStmt><!--é<Stmt>old</Stmt>-->")
    found = inbox.camt_fragments(_camt(spark, sf_dir).withColumn("text", twice))
    own = found.where("fragment = 0").select("name", F.col("byte_offset").alias("first"), F.octet_length("raw").alias("bytes"))
    return found.join(own, "name").select("name", "fragment", (F.col("byte_offset") - F.when(F.col("fragment") > 0, F.col("first") + F.col("bytes")).otherwise(0)).alias("at"), F.regexp_extract("raw", "^<Stmt><Id>(S[0-9]+)</Id>.*</Stmt>$", 1).alias("statement"))


S9R = """SELECT 'camt' || c_custkey AS name, CAST(f AS INTEGER) AS fragment, CASE WHEN f = 0 THEN strlen('<?xml version="1.0"?><Document xmlns="urn:iso:std:iso:20022:tech:xsd:camt.053.001.02"><BkToCstmrStmt><!--é<Stmt>old</Stmt>-->') ELSE 1 END AS at, 'S' || c_custkey AS statement FROM customer, range(2) r(f)"""


def s15_penalty_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15, P-D: reported penalties from quoted lines."""
    bindings._view(spark, sf_dir, "orders")
    lines = spark.sql("""select concat('P', o_orderkey, ', L', o_orderkey, ',US0000000001,"Bank, of ', o_custkey, '",EUR,', if(o_orderkey % 4 = 0, 'lmfp', 'odd'), ',', if(o_orderkey % 6 = 0, 'none', cast(cast(o_totalprice as decimal(18,2)) as string)), ',2026-01,', if(o_orderkey % 3 = 0, 'Receivable', '')) as value from tw_orders""")
    return inbox.penalty_statement(lines)


S15 = "SELECT 'P' || o_orderkey AS penalty_ref, 'L' || o_orderkey AS transaction_ref, 'US0000000001' AS isin, 'Bank, of ' || o_custkey AS counterparty_bic, 'EUR' AS currency, CASE WHEN o_orderkey % 4 = 0 THEN 'LMFP' ELSE 'SEFP' END AS penalty_type, '2026-01' AS period, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE -1 END * CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS reported_amount, CASE WHEN o_orderkey % 3 = 0 THEN 'receivable' ELSE 'payable' END AS direction FROM orders WHERE o_orderkey % 6 <> 0"


def s17_read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star written as Parquet, read back, a missing table as empty, then cash P&L."""
    folder = shared.new_folder(spark, "star")
    heads, rows = cash.cash_star(bindings.mt940(spark, sf_dir))
    heads.write.parquet(f"{folder}/cash_statement")
    rows.write.parquet(f"{folder}/cash_entry")
    none = inbox.read_or_empty(spark, f"{folder}/penalty", "key string")
    back = cash.cash_pnl(inbox.read_or_empty(spark, f"{folder}/cash_statement", heads.schema), inbox.read_or_empty(spark, f"{folder}/cash_entry", rows.schema), ["currency"])
    return back.unionByName(none.join(back, none["key"] == back["currency"]).drop("key"))


def v7_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog with a rule per part, of which some have a defect, two sequences per type, and odd field types."""
    bindings._view(spark, sf_dir, "part")
    own = spark.sql("""select concat('MT', p_size % 5) as message_type, cast(k as int) as rule_ord, if(k % 7 = 0, 'GENL|GENL/NOWHERE', 'GENL') as path, if(k % 11 = 0, '20C', '20') as tag, array('C') as options, if(k % 31 = 0, null, 'SEME') as qualifier,
        concat('n', k) as name, case when k % 13 = 0 then 'nothing' when k % 2 = 0 then 'reference' else 'text' end as field_type, if(k % 17 = 0, map('C', 'never'), null) as option_types, false as required, if(k % 19 = 0, 3, null) as min, if(k % 19 = 0, 1, null) as max,
        if(k % 23 = 0, '', 'e') as entity, if(k % 37 = 0, 'same', concat('c', k)) as column, if(k % 29 = 0, 'Z', 'C') as render_option from (select p_partkey as k, p_size from tw_part)""")
    again = own.where("rule_ord % 500 = 0").withColumns({"path": F.lit("GENL"), "tag": F.lit("20"), "qualifier": F.lit("SEME"), "field_type": F.lit("text"), "option_types": F.lit(None).cast("map<string,string>"), "min": F.lit(None).cast("int"), "max": F.lit(None).cast("int"), "entity": F.lit("f"), "column": F.concat(F.lit("d"), F.col("rule_ord").cast("string")), "render_option": F.lit("C")})
    seq = own.select("message_type").distinct().selectExpr("message_type", "inline(array(named_struct('name', 'GENL', 'parents', array('$')), named_struct('name', 'A', 'parents', array('B'))))").selectExpr("message_type", "name", "parents", "false as repeat", "cast(null as int) as min", "cast(null as int) as max")
    kinds = rules.types(spark)
    odd = kinds.unionByName(kinds.where("name = 'text'")).unionByName(kinds.limit(1).selectExpr("'empty' as name", "cast(null as int) as step", "cast(null as string) as kind", "cast(null as string) as word", "cast(null as string) as class", "cast(null as int) as length"))
    found = rules.catalog_issues(own.unionByName(again), seq, odd)
    clash = rules.conflicts(kinds, rules.types(spark, rules.Catalog({**rules.TYPES, "text": rules.TYPES["code"]})))
    return found.unionByName(clash.selectExpr("'type_conflict' as kind", "name as detail"))


V7 = """WITH r AS (SELECT 'MT' || (p_size % 5) AS mt, p_partkey AS k FROM part)
  SELECT kind, mt || ' ' || k AS detail FROM r, (VALUES ('unknown_type', 13), ('unknown_option_type', 17), ('unknown_path', 7), ('bad_min_max', 19), ('options_on_concrete_tag', 11), ('empty_mapping', 23), ('render_option', 29)) v(kind, n) WHERE k % n = 0
  UNION ALL SELECT 'missing_qualifier', mt || ' ' || k FROM r WHERE k % 31 = 0 AND k % 13 <> 0 AND k % 2 = 0
  UNION ALL SELECT 'duplicate_mapping', mt || ' ' || min(k) FROM r WHERE k % 37 = 0 GROUP BY mt, k % 23 = 0, k % 7 = 0 HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'duplicate_message', mt FROM r WHERE k % 500 = 0 UNION ALL SELECT DISTINCT 'unknown_parent', mt || ' A' FROM r
  UNION ALL SELECT * FROM (VALUES ('type_conflict', 'text'), ('duplicate_type', 'text'), ('empty_pattern', 'empty')) v(kind, detail)"""


def v9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage report of the catalog beside the messages of each type."""
    report = rules.coverage_report(rules.rules(spark), rules.sequences(spark))
    counts = bindings.mt540(spark, sf_dir).unionByName(bindings.mt537(spark, sf_dir)).groupBy("message_type").agg(F.count(F.lit(1)).alias("messages"))
    return counts.join(F.broadcast(report), "message_type").select("message_type", "messages", "sequences", "fields", "required", "bounded", "with_options", "rendered", "ambiguous", "without_qualifier", "entities", "percent")


V9 = "SELECT 'MT540' AS message_type, (SELECT count(*) FROM orders) AS messages, CAST(6 AS BIGINT) AS sequences, CAST(7 AS BIGINT) AS fields, CAST(3 AS BIGINT) AS required, CAST(2 AS BIGINT) AS bounded, CAST(6 AS BIGINT) AS with_options, CAST(7 AS BIGINT) AS rendered, CAST(0 AS BIGINT) AS ambiguous, CAST(1 AS BIGINT) AS without_qualifier, CAST(6 AS BIGINT) AS entities, 100.0 AS percent UNION ALL SELECT 'MT537', (SELECT count(DISTINCT l_orderkey) FROM lineitem), 6, 11, 3, 0, 10, 11, 0, 1, 9, 100.0"


def a13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status per run, from its messages' events."""
    e = bindings.table(spark, sf_dir, "events")
    return books.run_status(e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("message_id"), (F.col("event_type") == "error").cast("long").alias("errors"), (F.col("event_type") == "view").alias("rendered"), ((F.col("event_type") == "purchase") & (F.col("user_id") % 7 == 0)).alias("failed")))


A13 = "SELECT user_id AS job_id, count(*) AS messages, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS parse_errors, count(*) FILTER (event_type = 'view') AS rendered, CASE WHEN bool_or(event_type = 'purchase' AND user_id % 7 = 0) THEN 'failed' WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM events GROUP BY 1"


def a14_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram, of the sizes of documents, in cumulative buckets."""
    return books.histogram(bindings.table(spark, sf_dir, "documents").select(F.octet_length("text").alias("bytes")), "bytes", [256, 1024, 4096, 16384, 65536])


A14 = "SELECT CAST(e AS DOUBLE) AS le, count(*) AS n FROM documents, (VALUES (256), (1024), (4096), (16384), (65536), (NULL)) v(e) WHERE e IS NULL OR strlen(text) <= e GROUP BY 1"


def a14_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per type, rows, bytes and a histogram of sizes, measured while the messages are written."""
    bindings._view(spark, sf_dir, "orders")
    messages = spark.sql(f"select k as id, case k % 4 when 0 then 'MT540' when 1 then 'MT541' else 'MT599' end as message_type, {DEFECTIVE} as body from (select o_orderkey as k from tw_orders)")
    folder = shared.new_folder(spark, "metered")
    return books.metered(messages.withColumn("size", F.octet_length("body")), "message_type", "size", ["MT540", "MT541", "MT542"], [100, 160, 200, 1000, 100_000], lambda df: df.drop("size").write.parquet(folder))


A14M = f"""WITH b AS (SELECT k, strlen({DEFECTIVE}) AS n FROM (SELECT o_orderkey AS k FROM orders))
  SELECT 'rows' AS metric, '' AS label, count(*) AS n FROM b UNION ALL SELECT 'bytes', '', CAST(sum(n) AS BIGINT) FROM b
  UNION ALL SELECT 'messages', 'MT540', count(*) FILTER (k % 4 = 0) FROM b UNION ALL SELECT 'messages', 'MT541', count(*) FILTER (k % 4 = 1) FROM b UNION ALL SELECT 'messages', 'MT542', 0 UNION ALL SELECT 'messages', 'other', count(*) FILTER (k % 4 > 1) FROM b
  UNION ALL SELECT 'size_at_most', CAST(e AS VARCHAR), count(*) FILTER (n <= e) FROM b, (VALUES (100), (160), (200), (1000), (100000)) v(e) GROUP BY e"""


def k9_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: runs upserted by batches into a kept ledger, compacted between them, read by one who began before and by one after;
    with how many changes the audit has of each."""
    folder, by, schema = shared.new_folder(spark, "ledger"), ("ts", "event_id"), "job_id long, ts timestamp_ntz, event_id long, status string, value double"
    e = bindings.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", F.col("event_type").alias("status"), "value")
    now = lambda: ledger.current(spark, folder, schema, "job_id", by)
    for batch in range(3):
        if batch == 2:
            ledger.compact(spark, folder, schema, "job_id", by)
        ledger.append(e.where(F.col("event_id") % 4 == batch), folder, batch)
    begun = now()
    ledger.compact(spark, folder, schema, "job_id", by)
    ledger.append(e.where("event_id % 4 = 3"), folder, 3)
    changes = ledger.audit(spark, folder, schema).groupBy("job_id").agg(F.count(F.lit(1)).alias("changes"))
    before = begun.select("job_id", F.col("event_id").alias("before"))
    return now().join(changes, "job_id").join(before, "job_id", "left").select("job_id", "event_id", "status", F.round("value", 4).alias("value"), "changes", "before")


K9 = """SELECT user_id AS job_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS status, round(arg_max(value, (ts, event_id)), 4) AS value, count(*) AS changes,
  arg_max(event_id, (ts, event_id)) FILTER (event_id % 4 < 3) AS before FROM events GROUP BY 1"""


def l1_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, K9: latest row per job over an old and a new ledger."""
    e = bindings.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("updated_at"), F.col("event_type").alias("status"), "value")
    return ledger.upserted(e.where("updated_at.event_id % 2 = 0"), e.where("updated_at.event_id % 2 = 1")).select("job_id", F.col("updated_at.event_id").alias("event_id"), "status", F.round("value", 4).alias("value"))


L1 = "SELECT user_id AS job_id, event_id, event_type AS status, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"


def l2_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: how long each run took, from its changes of status."""
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
    e = bindings.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), status.alias("status"), "ts").where("status is not null")
    return ledger.durations(e).select("job_id", "seconds")


L2 = "SELECT user_id AS job_id, CAST(floor(epoch(min(ts) FILTER (event_type IN ('purchase', 'error')))) - floor(epoch(min(ts) FILTER (event_type = 'view'))) AS BIGINT) AS seconds FROM events WHERE event_type <> 'click' GROUP BY 1"


def t2_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest runs."""
    e = bindings.table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("updated_at"), F.col("event_type").alias("status"))
    return ledger.newest(e).select("job_id", "status")


T2 = "SELECT event_id AS job_id, event_type AS status FROM events ORDER BY ts DESC, event_id LIMIT 50"


def x10_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without bank codes and long numbers, by their hash."""
    d = bindings.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(texts.redacted(F.col("text")), 256).alias("sha"), texts.safe_stem(F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(" (x)"))).alias("stem"), texts.expanded("{mt}/{message_id}", F.col("doc_id").cast("string"), F.lit("MT940")).alias("path"))


# Codes that stand side by side share the sign between them, so they are marked in two passes.
_CODE = "'(^|[^A-Za-z0-9])[A-Z]{6}[A-Za-z0-9]{2}(?:[A-Za-z0-9]{3})?($|[^A-Za-z0-9])', '\\1' || chr(1) || '\\2', 'g'"
X10 = f"""SELECT doc_id, sha256(regexp_replace(replace(regexp_replace(regexp_replace(text, {_CODE}), {_CODE}), chr(1), '[REDACTED_BIC]'), '[0-9]{{6,}}', '[REDACTED_ACCOUNT]', 'g')) AS sha,
  'doc_' || doc_id || '_x' AS stem, '940/' || doc_id AS path FROM documents"""


def ext_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source traits: one book from two cash adapters, one position list from two security adapters."""
    cash_inputs = {"swift": bindings.mt940(spark, sf_dir), "camt.053": _camt(spark, sf_dir)}
    security_inputs = {"swift": bindings.mt536(spark, sf_dir), "csv": _csv_files(spark, sf_dir)}
    out = None
    for name, given in cash_inputs.items():
        heads, rows = adapters.cash_statements(name, given)
        own = heads.agg(F.lit(name).alias("adapter"), F.lit("statement").alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.sum("opening"), 2).alias("total"))
        out = own if out is None else out.unionByName(own)
        out = out.unionByName(rows.agg(F.lit(name).alias("adapter"), F.lit("entry").alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.sum("signed_amount"), 2).alias("total")))
    for name, given in security_inputs.items():
        out = out.unionByName(adapters.security_events(name, given).agg(F.lit(name).alias("adapter"), F.lit("event").alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.sum("quantity"), 2).alias("total")))
    return out


EXT = f"""WITH e AS ({E_SQL}), v AS (VALUES ('swift'), ('camt.053')), c AS (SELECT count(*) AS n, round(sum(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE, 2) AS total FROM customer)
  SELECT a AS adapter, 'statement' AS kind, n, total FROM c, v t(a) UNION ALL SELECT a, 'entry', (SELECT count(*) FROM e), (SELECT round(sum(signed_amount), 2) FROM e) FROM v t(a)
  UNION ALL SELECT 'swift', 'event', count(*), CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) FROM lineitem UNION ALL SELECT 'csv', 'event', count(*), CAST(sum(CASE WHEN l_partkey % 13 <> 0 THEN CAST(l_quantity AS BIGINT) END) AS DOUBLE) FROM lineitem"""


QUERIES = {
    "s1_inbox_batch": (s1_inbox_batch, S1), "s5_detect_format": (s5_detect_format, S5), "s8_split_bare": (s8_split_bare, S8), "s10_csv_positions": (s10_csv_positions, S10), "f16_csv_fields": (f16_csv_fields, F16), "s13_camt": (s13_camt, S13), "s9_refused": (s9_refused, S9), "s9_ranges": (s9_ranges, S9R), "s15_penalty_csv": (s15_penalty_csv, S15), "s17_read_model": (s17_read_model, A4),
    "v7_catalog": (v7_catalog, V7), "v9_coverage": (v9_coverage, V9), "a13_runs": (a13_runs, A13), "a14_histogram": (a14_histogram, A14), "l1_ledger": (l1_ledger, L1), "k9_ledger": (k9_ledger, K9), "a14_metrics": (a14_metrics, A14M), "l2_durations": (l2_durations, L2), "t2_newest": (t2_newest, T2), "x10_redact": (x10_redact, X10), "ext_adapters": (ext_adapters, EXT),
}
