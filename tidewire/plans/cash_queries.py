"""Queries over cash statements and message structure, with DuckDB SQL over the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import cash, structure
from tidewire.plans import bindings
from tidewire.sources import inbox, reader, shared

#: The lines of a statement as DuckDB sees them.
E_SQL = """
  SELECT 'mt940-' || o_custkey AS message_id, o_custkey, o_orderkey, o_orderdate,
    CASE o_orderstatus WHEN 'F' THEN 'credit' WHEN 'O' THEN 'debit' ELSE 'reversal_debit' END AS direction,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) * CASE WHEN o_orderstatus = 'O' THEN -1 ELSE 1 END AS signed_amount,
    ['TRF','DIV','INT','CHG','FEE'][CAST(substr(o_orderpriority, 1, 1) AS INT)] AS transaction_type
  FROM orders JOIN customer ON o_custkey = c_custkey"""
S_SQL = f"""
  SELECT 'mt940-' || c_custkey AS message_id, c_custkey, c_nationkey, ['USD','EUR','GBP'][CAST(c_custkey % 3 + 1 AS INT)] AS currency,
    CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS opening, round(coalesce(m, 0), 2) AS net, coalesce(i, 0) AS inflow, coalesce(t, 0) AS outflow, coalesce(n, 0) AS n,
    round(c_acctbal + coalesce(m, 0) + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END, 2) AS closing, c_custkey % 7 <> 0 AS ok
  FROM customer LEFT JOIN (SELECT o_custkey, sum(signed_amount) AS m, sum(CASE WHEN signed_amount >= 0 THEN signed_amount ELSE 0 END) AS i,
    sum(CASE WHEN signed_amount < 0 THEN signed_amount ELSE 0 END) AS t, count(*) AS n FROM ({E_SQL}) GROUP BY 1) ON c_custkey = o_custkey"""


def a1_net_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2, A3: net movement and whether each statement reconciles."""
    out = cash.verdicts(*cash.cash_star(bindings.mt940(spark, sf_dir)))
    return out.select("message_id", "currency", "opening", "closing", F.round("net", 2).alias("net"), F.round("expected_closing", 2).alias("expected_closing"), F.round("diff", 2).alias("diff"), "reconciles", "reconciles_zero")


A1 = f"SELECT message_id, currency, opening, closing, net, round(opening + net, 2) AS expected_closing, CASE WHEN ok THEN 0.0 ELSE 1.0 END AS diff, ok AS reconciles, ok AS reconciles_zero FROM ({S_SQL})"


def a4_cash_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: cash P&L per currency, from message text."""
    return cash.cash_pnl(*cash.cash_star(bindings.mt940(spark, sf_dir)), by=["currency"])


A4 = f"SELECT currency, round(sum(inflow), 2) AS inflows, round(sum(outflow), 2) AS outflows, round(sum(inflow + outflow), 2) AS net, count(*) AS statements, CAST(sum(n) AS BIGINT) AS entries, count(*) FILTER (NOT ok) AS breaks, bool_and(ok) AS all_reconciled FROM ({S_SQL}) GROUP BY 1"


def a6_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash P&L with outflows as sizes."""
    return cash.cash_pnl(*cash.cash_star(bindings.mt940(spark, sf_dir)), by=["currency"], positive_outflows=True)


A6 = A4.replace("round(sum(outflow), 2) AS outflows", "round(-sum(outflow), 2) AS outflows")


def a5_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed total per transaction type."""
    return cash.by_type(cash.cash_star(bindings.mt940(spark, sf_dir))[1])


A5 = f"SELECT transaction_type, round(sum(signed_amount), 2) AS amount, count(*) AS entries FROM ({E_SQL}) GROUP BY 1"


def s16_mt940(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement lines as entries with their narrative."""
    rows = cash.cash_star(bindings.mt940(spark, sf_dir))[1]
    return rows.select("message_id", "row_seq", "account", "currency", "value_date", "entry_date", "direction", "amount", "signed_amount", "transaction_type", "customer_ref", "bank_ref", "info")


S16 = f"""SELECT message_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_seq, 'ACC' || o_custkey AS account, ['USD','EUR','GBP'][CAST(o_custkey % 3 + 1 AS INT)] AS currency,
  '20' || strftime(o_orderdate, '%y-%m-%d') AS value_date, CAST(NULL AS VARCHAR) AS entry_date, direction, amount, signed_amount, transaction_type, 'ORD' || o_orderkey AS customer_ref, 'B' || o_orderkey AS bank_ref, 'ORDER ' || o_orderkey AS info FROM ({E_SQL})"""


def s16_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement headers with signed balances."""
    return cash.cash_star(bindings.mt940(spark, sf_dir))[0].select("message_id", "message_type", "reference", "account", "statement_number", "currency", "opening", "closing", "available")


S16S = f"SELECT message_id, 'MT940' AS message_type, 'ST' || c_custkey AS reference, 'ACC' || c_custkey AS account, '1/1' AS statement_number, currency, opening, closing, CAST(NULL AS DOUBLE) AS available FROM ({S_SQL})"


def _written_files(spark: SparkSession, sf_dir: str) -> str:
    folder = shared.new_folder(spark, "fin")
    reader.write_files(bindings.filed(spark, sf_dir), folder, "batch", "k", "body")
    return folder


def s7_split_fin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of written files, read in splits, acknowledgements skipped; ids by file and place."""
    from pyspark.sql import Window

    split = reader.read_messages(spark, _written_files(spark, sf_dir)).where("kept").withColumn("name", F.concat(F.lit("batch"), F.regexp_extract("path", r"batch=(\d+)", 1), F.lit(".fin")))
    place = F.row_number().over(Window.partitionBy("name").orderBy("byte_offset"))
    return split.select("name", F.concat(F.regexp_replace("name", r"\.fin$", ""), F.lit("-"), place.cast("string")).alias("message_id"), structure.message_type(F.col("body")).alias("message_type"), F.regexp_extract("body", r":20:(\w+)", 1).alias("reference"))


_BATCH = f"(c_custkey // {bindings.PER_FILE})"
S7 = f"SELECT 'batch' || {_BATCH} || '.fin' AS name, 'batch' || {_BATCH} || '-' || row_number() OVER (PARTITION BY {_BATCH} ORDER BY c_custkey) AS message_id, 'MT940' AS message_type, 'ST' || c_custkey AS reference FROM customer"


def s2_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files under a prefix by suffix, with how many messages each holds, and the two refusals: no file, too many."""
    folder = _written_files(spark, sf_dir)
    found = inbox.scan_prefix(spark, folder, suffix=".txt", at_most=1_000_000)
    text = F.decode("content", "UTF-8")
    out = found.select(F.regexp_extract("path", "batch=[0-9]+", 0).alias("what"), ((F.length(text) - F.length(F.replace(text, F.lit("{2:")))) / 3).cast("long").alias("n"))
    for suffix, most in ((".none", None), (".txt", 0)):
        try:
            inbox.scan_prefix(spark, folder, suffix=suffix, at_most=most)
        except ValueError as e:
            reason = "none" if str(e).startswith("no file") else "too_many"
            out = out.unionByName(found.limit(1).select(F.lit(reason).alias("what"), F.lit(most).cast("long").alias("n")))
    return out


S2 = f"SELECT 'batch=' || {_BATCH} AS what, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'none', NULL UNION ALL SELECT 'too_many', 0"


def f15_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that only source, file content and offset decide; per file the messages, ids and skipped fragments."""
    files = bindings.files(spark, sf_dir)
    known = structure.identity(structure.messages_of_files(files), files)
    renamed = structure.identity(structure.messages_of_files(files.withColumn("name", F.concat(F.lit("x"), "name"))), files.withColumn("name", F.concat(F.lit("x"), "name")))
    same = known.where("kept").join(renamed.where("kept").select(F.col("message_id").alias("again")), F.col("message_id") == F.col("again"), "left")
    kept = same.groupBy("source_id").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("message_id").alias("ids"), F.count("again").alias("same_ids"))
    skipped = known.groupBy("source_id").agg(F.count_if(~F.col("kept")).alias("skipped_fragments"))
    return kept.join(skipped, "source_id")


F15 = f"SELECT 'broker:batch-' || {_BATCH} AS source_id, count(*) AS messages, count(*) AS ids, count(*) AS same_ids, count(*) AS skipped_fragments FROM customer GROUP BY 1"


def f1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """envelope parts, a user block three levels deep and a trailer, and the sender reference."""
    more = F.concat(F.regexp_replace("body", r"\{4:", F.concat(F.lit("{3:{108:{A:{B:"), "message_id", F.lit("}}}}{4:"))), F.lit("{5:{CHK:{X:1}}{TNG:}}"))
    messages = bindings.mt540(spark, sf_dir).withColumn("body", more)
    refs = structure.sender_reference(structure.field_rows(messages))
    deep = structure.blocks(messages).select("message_id", "block3", "block5")
    return structure.envelope(messages).join(refs, "message_id", "left").join(deep, "message_id").select("message_id", "io", "message_type3", "sender_bic", "receiver_bic", "session", "sequence", "application", "service", "priority", "sender_ref", "block3", "block5")


F1 = "SELECT 'mt540-' || o_orderkey AS message_id, 'I' AS io, '540' AS message_type3, 'CUSTUS33XXX' AS sender_bic, 'CSDXUS33XXX' AS receiver_bic, '0000' AS session, '000000' AS sequence, 'F' AS application, '01' AS service, 'N' AS priority, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'O' || o_orderkey END AS sender_ref, '{108:{A:{B:mt540-' || o_orderkey || '}}}' AS block3, '{CHK:{X:1}}{TNG:}' AS block5 FROM orders"


def f2_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how many fields of each tag and qualifier a type has."""
    rows = structure.fields(bindings.mt540(spark, sf_dir)).withColumn("qualifier", structure.qualifier(F.col("value")))
    return rows.groupBy("tag", "qualifier").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("message_id").alias("messages"))


F2 = """
WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 10 <> 0) AS seme, count(*) FILTER (o_orderkey % 15 = 0) AS two, count(*) FILTER (o_orderkey % 21 = 0) AS odd, count(*) FILTER (o_orderkey % 33 = 0) AS wrong FROM orders)
SELECT * FROM (
  SELECT '16R' AS tag, CAST(NULL AS VARCHAR) AS qualifier, 6 * n + odd + wrong AS n, n AS messages FROM o UNION ALL SELECT '16S', NULL, 6 * n + odd + wrong, n FROM o
  UNION ALL SELECT '20C', 'SEME', seme, seme FROM o UNION ALL SELECT '23G', NULL, n, n FROM o UNION ALL SELECT '98A', 'SETT', n, n FROM o UNION ALL SELECT '35B', NULL, n + two, n FROM o
  UNION ALL SELECT '36B', 'SETT', n, n FROM o UNION ALL SELECT '97A', 'SAFE', n, n FROM o UNION ALL SELECT '22F', 'SETR', n, n FROM o UNION ALL SELECT '95P', 'DEAG', n + odd, n FROM o
  UNION ALL SELECT '19A', 'SETT', n, n FROM o UNION ALL SELECT '70E', 'SPRO', wrong, wrong FROM o) WHERE n > 0"""


def m7_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: per message the raw text and values that the switches leave: both off, and values on."""
    messages = bindings.mt540(spark, sf_dir)
    bare, off = structure.without_payload(messages, structure.fields(messages))
    _, on = structure.without_payload(messages, structure.fields(messages), raw_values=True)
    filled = lambda rows, name: rows.groupBy("message_id").agg(F.count(F.lit(1)).alias(f"{name}_fields"), F.count(F.when(F.col("value") != "", 1)).alias(f"{name}_filled"))
    return bare.select("message_id", F.length("body").alias("raw_chars")).join(filled(off, "off"), "message_id").join(filled(on, "on"), "message_id")


M7 = """SELECT 'mt540-' || o_orderkey AS message_id, 0 AS raw_chars, n AS off_fields, CAST(0 AS BIGINT) AS off_filled, n AS on_fields, n AS on_filled
  FROM (SELECT o_orderkey, CAST(20 + CASE WHEN o_orderkey % 10 <> 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 15 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 21 = 0 THEN 3 ELSE 0 END + CASE WHEN o_orderkey % 33 = 0 THEN 3 ELSE 0 END AS BIGINT) AS n FROM orders)"""


def f3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence path of every link reference, with its occurrence."""
    rows = structure.field_rows(bindings.mt537(spark, sf_dir))
    return rows.where("tag = '20C' and qualifier = 'RELA'").select("message_id", "seq_index", "seq_path", "occurrence", F.regexp_replace("value", "^:RELA//", "").alias("ref"))


I_SQL = """
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag) - 1 AS i,
    'L' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS ref, 'US' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS isin,
    p_type || ' ' || ['GILT 4%','ETF','5% BOND','ORD','UNITS'][CAST(p_partkey % 5 + 1 AS INT)] AS descr, CASE l_returnflag WHEN 'A' THEN 'PEND' WHEN 'R' THEN 'PENF' ELSE 'FUTU' END AS status,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey"""
F3 = f"SELECT 'mt537-' || l_orderkey AS message_id, 'STAT[' || i || ']/TRAN[0]/LINK[0]' AS seq_index, 'STAT/TRAN/LINK' AS seq_path, CAST(0 AS BIGINT) AS occurrence, ref FROM ({I_SQL})"


ANCHORS = {"ENTRY": ("61", ("86",)), "BALANCE": (("60F", "62F"), ("64",))}


def f4_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """statement lines with their narratives, and balances with either of two anchors, as groups that no brackets hold, beside a
    sequence in brackets."""
    noted = F.regexp_replace("body", "\n:62F:", "\n:16R:NOTE\n:70E:x\n:16S:NOTE\n:62F:")
    rows = structure.field_rows(bindings.mt940(spark, sf_dir).withColumn("body", noted), ANCHORS)
    return rows.where("tag in ('61', '86', '60F', '62F', '20', '70E')").select("message_id", "tag", "seq_index", "seq_path", "occurrence", F.regexp_extract("value", r"ORD(?:ER )?(\d+)", 1).alias("order_key"))


F4 = f"""SELECT 'mt940-' || o_custkey AS message_id, t AS tag, 'ENTRY[' || (row_number() OVER (PARTITION BY o_custkey, t ORDER BY o_orderkey) - 1) || ']' AS seq_index, 'ENTRY' AS seq_path, CAST(0 AS BIGINT) AS occurrence, CAST(o_orderkey AS VARCHAR) AS order_key
  FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES ('61'), ('86')) v(t)
  UNION ALL SELECT 'mt940-' || c_custkey, t, i, p, 0, '' FROM customer, (VALUES ('60F', 'BALANCE[0]', 'BALANCE'), ('62F', 'BALANCE[1]', 'BALANCE'), ('20', '$', '$'), ('70E', 'NOTE[0]', 'NOTE')) v(t, i, p)"""

def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mt540 with an unclosed block 4 (every 4th order), a malformed tag (every 6th), a sequence end that matches none (every 9th)."""
    k = F.expr("cast(substring(message_id, 7) as long)")
    body = F.col("body")
    body = F.when(k % 9 == 0, F.regexp_replace(body, ":16S:FIAC", ":16S:OTHER")).otherwise(body)
    body = F.when(k % 6 == 0, F.regexp_replace(body, ":23G:NEWM", ":23G:NEWM\n:TOOLONG:X")).otherwise(body)
    body = F.when(k % 4 == 0, F.regexp_replace(body, "\n-\\}$", "")).otherwise(body)
    return bindings.mt540(spark, sf_dir).withColumn("body", body)


#: A message per order k, in SQL of both engines: every defect of structure by k, and text whose bytes and characters differ.
DEFECTIVE = """'{1:F01CUSTUS33AXXX0000000000}{2:I540CSDXUS33XXXXN}' || case when k % 8 = 2 then '{X}' else '' end || '{3:{108:{A:{B:é' || cast(k as string) || case when k % 8 = 1 then '' else '}}}}' end
  || '{4:' || chr(10) || ':16R:GENL' || chr(10) || ':20C::SEME//é' || cast(k as string) || chr(10) || case when k % 8 = 4 then ':TOOLONG:X' || chr(10) else '' end || case when k % 8 = 5 then ':16S:OTHER' || chr(10) else '' end
  || case when k % 24 = 0 then '' else ':16S:GENL' || chr(10) end || case when k % 8 = 6 then repeat(':16R:D' || chr(10), 17) else '' end || case when k % 10000 = 7 then repeat(':70E:x' || chr(10), 10000) else '' end
  || case when k % 10000 = 16 then ':70E:' || repeat('x', 4194304) || chr(10) when k % 10000 = 8 then ':70E:' || repeat('x', 10485760) || chr(10) else '' end || case when k % 8 = 3 then '' else '-}' end"""


def f13_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every kind of defect of structure, with its byte offset."""
    bindings._view(spark, sf_dir, "orders")
    messages = spark.sql(f"select concat('d', k) as message_id, 'MT540' as message_type, {DEFECTIVE} as body from (select o_orderkey as k from tw_orders)")
    return structure.diagnostics(messages)


F13 = f"""
WITH b AS (SELECT k, {DEFECTIVE} AS body FROM (SELECT o_orderkey AS k FROM orders)),
  p AS (SELECT k, 'd' || k AS id, strlen(body) AS n, strlen(split_part(body, '{{X}}', 1)) AS x, strlen(split_part(body, '{{3:', 1)) AS b3, strlen(split_part(body, '{{4:', 1)) AS b4, strlen(split_part(body, ':TOOLONG', 1)) AS t FROM b),
  r AS (
  SELECT id, 'missing_block_separator' AS kind, x AS o, '' AS detail, CAST(NULL AS VARCHAR) AS expected FROM p WHERE k % 8 = 2
  UNION ALL SELECT id, 'unclosed_block', b3, '', NULL FROM p WHERE k % 8 = 1
  UNION ALL SELECT id, 'unclosed_text_block', b4, '', NULL FROM p WHERE k % 8 = 3
  UNION ALL SELECT id, 'malformed_field_tag', t, '', NULL FROM p WHERE k % 8 = 4
  UNION ALL SELECT id, 'mismatched_sequence_end', NULL, 'OTHER', 'GENL' FROM p WHERE k % 8 = 5
  UNION ALL SELECT id, 'limit_sequence_depth', NULL, '17', NULL FROM p WHERE k % 8 = 6
  UNION ALL SELECT id, 'unclosed_sequence', NULL, 'D', NULL FROM p, range(16) WHERE k % 8 = 6
  UNION ALL SELECT id, 'unclosed_sequence', NULL, 'GENL', NULL FROM p WHERE k % 24 = 0 AND k % 10000 NOT IN (8, 16)
  UNION ALL SELECT id, 'limit_fields', NULL, '10001', NULL FROM p WHERE k % 10000 = 7
  UNION ALL SELECT id, 'limit_block_bytes', NULL, CAST(n - b4 AS VARCHAR), NULL FROM p WHERE k % 10000 = 16
  UNION ALL SELECT id, 'limit_message_bytes', NULL, CAST(n AS VARCHAR), NULL FROM p WHERE k % 10000 = 8)
SELECT id AS message_id, kind, CAST(o AS BIGINT) AS byte_offset, detail, expected FROM r"""


def f6_issuer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the parties whose field names an issuer, told apart from those of another form."""
    bindings._view(spark, sf_dir, "orders")
    messages = spark.sql("""select concat('i', o_orderkey) as message_id, 'MT540' as message_type, concat('{4:\n:95R::', case o_orderkey % 3 when 0 then 'DEAG/CRST/' when 1 then 'REAG/' else 'SELL//' end, 'P', o_custkey, '\r\nX\n-}') as body from tw_orders""")
    value = F.col("value")
    return structure.fields(messages).select("message_id", *(c.alias(n) for c, n in zip(structure.issuer_form(value), ("qualifier", "issuer", "rest"), strict=True)))


F6 = "SELECT 'i' || o_orderkey AS message_id, CASE WHEN o_orderkey % 3 = 0 THEN 'DEAG' END AS qualifier, CASE WHEN o_orderkey % 3 = 0 THEN 'CRST' END AS issuer, CASE WHEN o_orderkey % 3 = 0 THEN 'P' || o_custkey || chr(10) || 'X' END AS rest FROM orders"


def f14_block4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether the fields, printed again, are the whole of block 4."""
    gap = F.when(F.expr("cast(substring(message_id, 7) as long)") % 5 == 0, F.regexp_replace("body", r"\{4:\n", "{4:\nlost text\n")).otherwise(F.col("body"))
    return structure.block4_complete(bindings.mt540(spark, sf_dir).withColumn("body", gap)).groupBy("complete").agg(F.count(F.lit(1)).alias("messages"))


F14 = "SELECT o_orderkey % 5 <> 0 AS complete, count(*) AS messages FROM orders GROUP BY 1"

QUERIES = {
    "a1_net_movement": (a1_net_movement, A1), "a4_cash_pnl": (a4_cash_pnl, A4), "a6_console": (a6_console, A6), "a5_by_type": (a5_by_type, A5), "s16_mt940": (s16_mt940, S16), "s16_statements": (s16_statements, S16S),
    "s7_split_fin": (s7_split_fin, S7), "s2_prefix_scan": (s2_prefix_scan, S2), "f15_identity": (f15_identity, F15), "f1_blocks": (f1_blocks, F1), "f2_fields": (f2_fields, F2), "m7_payload": (m7_payload, M7), "f3_paths": (f3_paths, F3), "f4_anchored": (f4_anchored, F4),
    "f13_diagnostics": (f13_diagnostics, F13), "f6_issuer": (f6_issuer, F6), "f14_block4": (f14_block4, F14),
}
