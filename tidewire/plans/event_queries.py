"""Queries over rules, validation, entities, events, positions and penalties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import books, entities, penalty, rules, structure
from tidewire.plans import bindings
from tidewire.plans.cash_queries import I_SQL, _broken
from tidewire.sources import shared


def r4_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields each rule matches, and the type that reads them."""
    rows = structure.field_rows(bindings.mt537(spark, sf_dir))
    return rules.matched(rows, rules.rules(spark)).groupBy("rule_ord", "entity", "column", "field_type").agg(F.count(F.lit(1)).alias("n"))


_R = [(1, "mt537_statement", "sender_reference", "reference", "o"), (2, "mt537_statement", "statement_date", "date", "o"), (3, "mt537_account", "account", "reference", "o"), (4, "mt537_status", "status_code", "code", "l"), (5, "mt537_transaction_link", "linked_reference", "reference", "l"), (6, "mt537_instrument", "instrument", "text", "l"), (7, "settlement_quantity", "quantity", "quantity", "l"), (8, "mt537_transaction", "amount", "amount", "l"), (9, "mt537_transaction", "date", "date", "l"), (10, "settlement_party", "party", "reference", "l"), (11, "mt537_settlement_party", "account", "reference", "l")]
R4 = "WITH n AS (SELECT count(*) AS l, count(DISTINCT l_orderkey) AS o FROM lineitem) " + " UNION ALL ".join(f"SELECT {n} AS rule_ord, '{e}' AS entity, '{c}' AS \"column\", '{t}' AS field_type, {k} AS n FROM n" for n, e, c, t, k in _R)


def r6_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed captures of amounts, dates and quantities, normalised."""
    rows = structure.field_rows(bindings.mt537(spark, sf_dir))
    found = rules.captured(rules.matched(rows, rules.rules(spark)), rules.compiled(spark)).where("failure is null and rule_ord in (7, 8, 9)")
    return found.groupBy("message_id", "seq_index").agg(*(F.max(F.when(F.col("rule_ord") == n, F.col("normal"))).alias(c) for n, c in ((7, "quantity"), (8, "amount"), (9, "settled")))).select("message_id", "seq_index", F.col("quantity").try_cast("double").alias("quantity"), F.col("amount").try_cast("double").alias("amount"), "settled")


R6 = f"SELECT 'mt537-' || l_orderkey AS message_id, 'STAT[' || i || ']/TRAN[0]/TRANSDET[0]' AS seq_index, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS quantity, price AS amount, strftime(l_shipdate, '%Y-%m-%d') AS settled FROM ({I_SQL})"


def r7_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why values don't fit their types: a wrong literal, too few characters, a wrong class."""
    k = F.expr("cast(substring(message_id, 7) as long)")
    body = F.when(k % 3 == 0, F.regexp_replace("body", ":98A::SETT//", ":98A::SETT/X")).when(k % 3 == 1, F.regexp_replace("body", r":98A::SETT//(\d{4})\d{4}", ":98A::SETT//$1")).otherwise(F.regexp_replace("body", r":98A::SETT//\d", ":98A::SETT//X"))
    types = {**rules.TYPES, "text": rules.TYPES["text"]}
    catalog = rules.Catalog(types, [(*r[:5], None, *r[6:]) if r[0] == "MT540" and r[1] == 2 else r for r in rules.CATALOG.rules], rules.CATALOG.sequences)
    rows = structure.field_rows(bindings.mt540(spark, sf_dir).withColumn("body", body))
    found = rules.captured(rules.matched(rows, rules.rules(spark, catalog)), rules.compiled(spark, catalog))
    return found.where("failure is not null").groupBy("failure").agg(F.count(F.lit(1)).alias("n"))


R7 = "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'literal_mismatch' WHEN 1 THEN 'too_short' ELSE 'invalid_class' END AS failure, count(*) AS n FROM orders GROUP BY 1"


def r10_no_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of types without rules."""
    both = bindings.mt940(spark, sf_dir).unionByName(bindings.mt540(spark, sf_dir))
    return rules.without_rules(both, rules.rules(spark)).groupBy("kind", "detail").agg(F.count(F.lit(1)).alias("n"))


R10 = "SELECT 'no_rules' AS kind, 'MT940' AS detail, count(*) AS n FROM customer"


def r12_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each message that some rule is for, and the others."""
    return rules.tag_coverage(structure.field_rows(bindings.mt540(spark, sf_dir)), rules.rules(spark)).select("message_id", "tags", "matched", "unknown")


R12 = "SELECT 'mt540-' || o_orderkey AS message_id, CAST(8 - CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 33 = 0 THEN 1 ELSE 0 END + 1 AS BIGINT) AS tags, CAST(7 - CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS matched, CASE WHEN o_orderkey % 33 = 0 THEN '22F,23G,70E' ELSE '22F,23G' END AS unknown FROM orders"


def v1_missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2: required fields that a scope lacks, and fields that occur too often."""
    rows, rule_rows = structure.field_rows(bindings.mt540(spark, sf_dir)), rules.rules(spark)
    counted = rules.cardinality(rows, rules.matched(rows, rule_rows), rule_rows)
    return rules.missing_required(counted).unionByName(rules.bad_cardinality(counted)).groupBy("kind", "detail").agg(F.count(F.lit(1)).alias("n"))


V1 = """SELECT * FROM (SELECT 'missing_required' AS kind, 'GENL[0] sender reference' AS detail, count(*) AS n FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT 'cardinality', 'GENL[0] sender reference 0', count(*) FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT 'cardinality', 'TRADDET[0] instrument 2', count(*) FROM orders WHERE o_orderkey % 15 = 0) WHERE n > 0"""


def v3_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 to V5: unknown sequences, wrong parents, and counts of sequences."""
    k = F.expr("cast(substring(message_id, 7) as long)")
    twice = F.when(k % 8 == 0, F.regexp_replace("body", r":16R:TRADDET\n", ":16R:GENL\n:16S:GENL\n:16R:TRADDET\n")).otherwise(F.col("body"))
    rows = structure.field_rows(bindings.mt540(spark, sf_dir).withColumn("body", twice))
    return rules.sequence_errors(rows, rules.sequences(spark)).groupBy("kind", "detail").agg(F.count(F.lit(1)).alias("n"))


V3 = """SELECT * FROM (SELECT 'unknown_sequence' AS kind, 'WRONG' AS detail, count(*) AS n FROM orders WHERE o_orderkey % 33 = 0
  UNION ALL SELECT 'wrong_parent', 'SETPRTY in TRADDET', count(*) FROM orders WHERE o_orderkey % 21 = 0
  UNION ALL SELECT 'sequence_cardinality', '$ GENL 2', count(*) FROM orders WHERE o_orderkey % 8 = 0) WHERE n > 0"""


def v6_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All defects of messages in one table, by kind."""
    return rules.errors(_broken(spark, sf_dir)).groupBy("kind").agg(F.countDistinct("message_id").alias("messages"))


V6 = """SELECT * FROM (SELECT kind, count(*) AS messages FROM (
  SELECT o_orderkey AS k, unnest([
    CASE WHEN k % 4 = 0 THEN 'unclosed_text_block' END, CASE WHEN k % 4 <> 0 AND k % 6 = 0 THEN 'malformed_field_tag' END,
    CASE WHEN k % 4 <> 0 AND k % 9 = 0 THEN 'mismatched_sequence_end' END, CASE WHEN k % 4 <> 0 AND k % 9 = 0 THEN 'unclosed_sequence' END,
    CASE WHEN k % 4 <> 0 AND k % 10 = 0 THEN 'missing_required' END, CASE WHEN k % 4 <> 0 AND (k % 10 = 0 OR k % 15 = 0) THEN 'cardinality' END,
    CASE WHEN k % 4 <> 0 AND k % 33 = 0 THEN 'unknown_sequence' END, CASE WHEN k % 4 <> 0 AND (k % 21 = 0 OR k % 9 = 0) THEN 'wrong_parent' END]) AS kind FROM orders)
  WHERE kind IS NOT NULL GROUP BY kind)"""


def v2_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: per message the fields that a scope has too few or too many of."""
    rows, rule_rows = structure.field_rows(bindings.mt540(spark, sf_dir)), rules.rules(spark)
    return rules.bad_cardinality(rules.cardinality(rows, rules.matched(rows, rule_rows), rule_rows)).select("message_id", "detail")


V2 = """SELECT 'mt540-' || o_orderkey AS message_id, 'GENL[0] sender reference 0' AS detail FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT 'mt540-' || o_orderkey, 'TRADDET[0] instrument 2' FROM orders WHERE o_orderkey % 15 = 0"""


def m1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, M4, M8: the transaction entity as a typed table with its raw captures."""
    table = entities.table_of(bindings.mt537(spark, sf_dir), rules.layout(rules.rules(spark)).collect(), "mt537_transaction")
    return table.select("message_id", "sequence_path", F.col("amount").cast("double").alias("amount"), F.col("date").cast("string").alias("settled"), "amount__render_amount", "date__render_date")


M1 = f"SELECT 'mt537-' || l_orderkey AS message_id, 'STAT[' || i || ']/TRAN[0]/TRANSDET[0]' AS sequence_path, price AS amount, strftime(l_shipdate, '%Y-%m-%d') AS settled, 'USD' || replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') AS amount__render_amount, strftime(l_shipdate, '%Y%m%d') AS date__render_date FROM ({I_SQL})"

E_COLUMNS = ["message_id", "row_seq", "transaction_ref", "message_type", "kind", "isin", "instrument_desc", "quantity", "amount", "currency", "settlement_date", "safekeeping_account", "party_bic", "status"]


def e3_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event per transaction of MT537, each with what its own branch says."""
    return entities.events_of(bindings.mt537(spark, sf_dir)).select(*E_COLUMNS)


EV537 = f"""SELECT 'swift' AS source, 'mt537-' || l_orderkey AS message_id, i AS row_seq, ref AS transaction_ref, 'MT537' AS message_type, 'settlement' AS kind, isin, descr AS instrument_desc, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS quantity, price AS amount, 'USD' AS currency,
  strftime(l_shipdate, '%Y-%m-%d') AS settlement_date, 'S' || l_suppkey AS safekeeping_account, 'BANK' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0') AS party_bic, status FROM ({I_SQL})"""
E3 = f"SELECT {', '.join(E_COLUMNS)} FROM ({EV537})"


def e5_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In MT536 the instrument and its amount stand in sequences side by side; each keeps its own."""
    return entities.events_of(bindings.mt536(spark, sf_dir)).select("message_id", "row_seq", "isin", "quantity", "amount", "currency", "settlement_date", "safekeeping_account")


E5 = f"SELECT 'mt536-' || l_orderkey AS message_id, i AS row_seq, isin, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS quantity, price AS amount, 'GBP' AS currency, strftime(l_shipdate, '%Y-%m-%d') AS settlement_date, CASE WHEN i = 0 THEN 'ACC' || o_custkey END AS safekeeping_account FROM ({I_SQL})"


def a7_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and quantity per ISIN."""
    return books.positions(entities.events_of(bindings.mt537(spark, sf_dir)))


A7 = f"SELECT isin, count(*) AS events, round(sum(quantity), 2) AS quantity FROM ({EV537}) GROUP BY 1"


def a8_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions per safekeeping account."""
    return books.by_account(entities.events_of(bindings.mt537(spark, sf_dir)))


A8 = f"SELECT safekeeping_account AS account, count(*) AS positions, count(DISTINCT isin) AS isins, round(sum(quantity), 2) AS quantity FROM ({EV537}) GROUP BY 1"


def a9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements and positions per source, and each source's share of the largest."""
    statements = bindings.mt940(spark, sf_dir).selectExpr("'bank' as source", "'statement' as kind", "message_type")
    positions = entities.events_of(bindings.mt537(spark, sf_dir)).selectExpr("'custodian' as source", "'position' as kind", "message_type")
    return books.sources(statements.unionByName(positions))


A9 = "WITH n AS (SELECT (SELECT count(*) FROM customer) AS s, (SELECT count(*) FROM lineitem) AS p) SELECT 'bank' AS source, s AS statements, 0 AS positions, s AS total, 'MT940' AS types, round(100.0 * s / greatest(s, p), 2) AS percent FROM n UNION ALL SELECT 'custodian', 0, p, p, 'MT537', round(100.0 * p / greatest(s, p), 2) FROM n"


def a11_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per type, and whether rules exist for it."""
    every = bindings.mt940(spark, sf_dir).unionByName(bindings.mt540(spark, sf_dir)).unionByName(bindings.mt537(spark, sf_dir))
    return books.type_counts(every, rules.rules(spark))


A11 = "SELECT 'MT940' AS message_type, (SELECT count(*) FROM customer) AS messages, false AS has_rules UNION ALL SELECT 'MT540', (SELECT count(*) FROM orders), true UNION ALL SELECT 'MT537', (SELECT count(DISTINCT l_orderkey) FROM lineitem), true"


def _due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return penalty.accruals(entities.events_of(bindings.mt537(spark, sf_dir)), penalty.rates(spark))


def _accruals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accruals, written once, for queries that read them more than once."""
    return shared.written(_due(spark, sf_dir), "accruals")


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a depository reports: every 11th order is missing, every 17th is off by 1.50, every 19th has its sign turned, and each 50th
    adds a line that nobody expects."""
    bindings._view(spark, sf_dir, "lineitem", "part", "orders")
    lines = bindings.lines537(spark, sf_dir).where("status in ('PEND', 'PENF')")
    rate = F.when(F.col("descr").contains("GILT"), 0.1).when(F.col("descr").contains("ETF"), 0.5).when(F.col("descr").contains("BOND"), 0.2).otherwise(1.0)
    due = penalty.round2(-(rate / 10000.0 * F.expr("cast(cast(price as decimal(18,2)) as double)")))
    k = F.col("l_orderkey")
    amount = F.when(k % 17 == 0, due - 1.5).when(k % 19 == 0, -due).otherwise(due)
    base = lines.where(k % 11 != 0).select(F.col("ref").alias("transaction_ref"), "isin", F.format_string("BANK%04d", "l_suppkey").alias("counterparty_bic"), F.lit("USD").alias("currency"), F.lit("SEFP").alias("penalty_type"), amount.alias("reported_amount"))
    extra = spark.sql("select concat('X', o_orderkey) as transaction_ref, 'US0000000000' as isin, 'BANK9999' as counterparty_bic, 'USD' as currency, 'LMFP' as penalty_type, -2.5D as reported_amount from tw_orders where o_orderkey % 50 = 0")
    return base.unionByName(extra)


ACC = f"""SELECT *, CASE WHEN instrument_desc LIKE '%GILT%' THEN 'sovereign_bond' WHEN instrument_desc LIKE '%ETF%' THEN 'etf' WHEN instrument_desc LIKE '%BOND%' THEN 'corporate_bond' ELSE 'liquid_share' END AS instrument_type,
  CASE WHEN instrument_desc LIKE '%GILT%' THEN 0.1::DOUBLE WHEN instrument_desc LIKE '%ETF%' THEN 0.5 WHEN instrument_desc LIKE '%BOND%' THEN 0.2 ELSE 1.0 END AS bps FROM ({EV537}) WHERE status IN ('PEND', 'PENF')"""


def pc_accruals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-A, P-B, P-C, X7: a day's penalty of every pending or failing transaction."""
    return _due(spark, sf_dir).select("transaction_ref", "isin", "instrument_type", "counterparty_bic", "currency", "quantity", "reference_amount", "penalty_type", "penalty_rate_bps", "status", "intended_settlement_date", "business_days_failed", "computed_amount", "direction")


PC = f"SELECT transaction_ref, isin, instrument_type, party_bic AS counterparty_bic, currency, quantity, amount AS reference_amount, 'SEFP' AS penalty_type, bps AS penalty_rate_bps, status, settlement_date AS intended_settlement_date, 1 AS business_days_failed, round(-(bps / 10000.0::DOUBLE * amount) * 100) / 100 AS computed_amount, 'payable' AS direction FROM ({ACC})"

LINES = f"""
  WITH c0 AS (SELECT *, CAST(regexp_extract(transaction_ref, '^L(\\d+)-', 1) AS BIGINT) AS k, round(-(bps / 10000.0::DOUBLE * amount) * 100) / 100 AS computed FROM ({ACC})),
  c AS (SELECT transaction_ref || '|' || isin || '|SEFP' AS key, any_value(transaction_ref) AS ref, any_value(isin) AS isin, min(party_bic) AS party, sum(computed) AS computed, max(struct_pack(a := amount, b := bps)) AS acc FROM c0 GROUP BY 1),
  r0 AS (SELECT transaction_ref || '|' || isin || '|SEFP' AS key, transaction_ref AS ref, isin, party_bic AS party, 'SEFP' AS t, CASE WHEN k % 17 = 0 THEN computed - 1.5 WHEN k % 19 = 0 THEN -computed ELSE computed END AS reported FROM c0 WHERE k % 11 <> 0
    UNION ALL SELECT 'X' || o_orderkey || '|US0000000000|LMFP', 'X' || o_orderkey, 'US0000000000', 'BANK9999', 'LMFP', -2.5 FROM orders WHERE o_orderkey % 50 = 0),
  r AS (SELECT key, any_value(ref) AS ref, any_value(isin) AS isin, min(party) AS party, any_value(t) AS t, sum(reported) AS reported FROM r0 GROUP BY 1),
  j AS (SELECT coalesce(c.key, r.key) AS key, coalesce(c.ref, r.ref) AS transaction_ref, coalesce(c.isin, r.isin) AS isin, coalesce(c.party, r.party) AS counterparty_bic, CASE WHEN c.key IS NULL THEN r.t ELSE 'SEFP' END AS penalty_type,
    round(coalesce(computed, 0), 2) AS computed_amount, round(coalesce(reported, 0), 2) AS reported_amount, round((coalesce(reported, 0) - coalesce(computed, 0)) * 100) / 100 AS diff, acc, c.key IS NULL AS nc, r.key IS NULL AS nr FROM c FULL JOIN r ON c.key = r.key),
  l AS (SELECT key, transaction_ref, isin, counterparty_bic, 'USD' AS currency, penalty_type, computed_amount, reported_amount, diff, acc, CASE WHEN nc THEN 'missing_computed' WHEN nr THEN 'missing_reported' WHEN abs(diff) <= 0.01 THEN 'matched' ELSE 'break' END AS status FROM j),
  w AS (SELECT *, abs(diff) AS abs_diff, CASE WHEN status <> 'break' THEN status WHEN abs(abs(reported_amount) / acc.a * 10000 - acc.b) / acc.b > 0.05 THEN 'rate_mismatch' WHEN abs(abs(diff) - acc.b / 10000 * acc.a) / (acc.b / 10000 * acc.a) < 0.2 THEN 'day_count' ELSE 'amount_mismatch' END AS reason,
    CASE ascii(right(transaction_ref, 1)) % 4 WHEN 0 THEN 'flagged' WHEN 1 THEN 'investigating' WHEN 2 THEN 'accepted' ELSE 'open' END AS disposition FROM l)
"""


def pe_recon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-E, J2, T3: computed against reported penalties by key."""
    return penalty.reconcile(_due(spark, sf_dir), _reported(spark, sf_dir)).orderBy("key")


PE = LINES + "SELECT key, transaction_ref, isin, counterparty_bic, currency, penalty_type, computed_amount, reported_amount, diff, status FROM l"


def pf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-F: totals of the reconciliation."""
    return penalty.summary(penalty.reconcile(_due(spark, sf_dir), _reported(spark, sf_dir)))


PF = LINES + "SELECT round(sum(computed_amount), 2) AS computed_total, round(sum(reported_amount), 2) AS reported_total, round(sum(reported_amount) - sum(computed_amount), 2) AS net_diff, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'break') AS breaks, count(*) FILTER (status = 'missing_reported') AS missing_reported, count(*) FILTER (status = 'missing_computed') AS missing_computed, round(sum(CASE WHEN status <> 'matched' THEN abs(diff) ELSE 0 END), 2) AS break_amount, bool_and(status = 'matched') AS all_reconciled FROM l"


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    accrual_rows = _accruals(spark, sf_dir)
    lines = penalty.reconcile(accrual_rows, _reported(spark, sf_dir))
    kind = F.ascii(F.substring("transaction_ref", -1, 1)) % 4
    given = lines.where(kind < 3).select("key", F.when(kind == 0, "flagged").when(kind == 1, "investigating").otherwise("accepted").alias("disposition"))
    return penalty.work_lines(lines, accrual_rows, given)


def pg_workqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-G, P-L, J3, J4, T4: breaks with their reason and disposition, the largest difference first."""
    return penalty.queue(_work(spark, sf_dir)).select("key", "status", "reason", "disposition", "abs_diff")


PG = LINES + "SELECT key, status, reason, disposition, abs_diff FROM w WHERE status <> 'matched'"


def ph_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-H: open breaks, unresolved amount and dispositioned lines per reason."""
    return penalty.open_totals(_work(spark, sf_dir))


PH = LINES + "SELECT reason, count(*) FILTER (status <> 'matched' AND disposition IN ('open', 'investigating')) AS open_breaks, round(sum(CASE WHEN status <> 'matched' AND disposition IN ('open', 'investigating') THEN abs_diff ELSE 0 END), 2) AS unresolved, count(*) FILTER (status <> 'matched' AND disposition <> 'open') AS dispositioned FROM w GROUP BY 1"


def pi_netting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-I: positions per counterparty and currency, with and without open disputes."""
    return penalty.netting(_work(spark, sf_dir))


PI = LINES + "SELECT counterparty_bic AS counterparty, currency, round(sum(computed_amount), 2) AS computed, round(sum(reported_amount), 2) AS reported, round(sum(CASE WHEN disposition = 'flagged' THEN computed_amount ELSE reported_amount END), 2) AS dispute_adjusted, count(*) AS lines, count(*) FILTER (status <> 'matched' AND disposition IN ('open', 'investigating')) AS open_breaks FROM w GROUP BY 1, 2"


def pj_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-J: the latest month of intended settlement dates."""
    return _due(spark, sf_dir).agg(F.max(F.substring("intended_settlement_date", 1, 7)).alias("period"))


PJ = f"SELECT max(substr(settlement_date, 1, 7)) AS period FROM ({ACC})"


def pk_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-K, X14: statement date, cutoff and state of every month with shipments, as of a fixed day."""
    periods = bindings.table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("period")).distinct()
    return penalty.dispute_window(periods, F.to_date(F.lit("1998-06-12"))).withColumn("statement_date", F.col("statement_date").cast("string")).withColumn("cutoff", F.col("cutoff").cast("string"))


PK = """WITH p AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS period FROM lineitem), d AS (SELECT CAST(range AS DATE) AS day FROM range(DATE '1994-12-01', DATE '2003-01-01', INTERVAL 1 DAY) WHERE isodow(range) < 6),
  n AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM d),
  s AS (SELECT period, (SELECT min(i) FROM n WHERE day > last_day(CAST(period || '-01' AS DATE))) + 3 AS si FROM p),
  w AS (SELECT period, a.day AS st, b.day AS cu, b.i AS bi FROM s JOIN n a ON a.i = si JOIN n b ON b.i = si + 10), t AS (SELECT DATE '1998-06-12' AS now)
  SELECT period, CAST(st AS VARCHAR) AS statement_date, CAST(cu AS VARCHAR) AS cutoff, CAST(CASE WHEN now < st THEN 10 WHEN now > cu THEN 0 ELSE (SELECT count(*) FROM n WHERE day > now AND day <= cu) END AS INTEGER) AS remaining,
    CASE WHEN now < st THEN 'upcoming' WHEN now > cu THEN 'closed' WHEN (SELECT count(*) FROM n WHERE day > now AND day <= cu) <= 3 THEN 'closing' ELSE 'open' END AS state FROM w, t"""

QUERIES = {
    "r4_rule_match": (r4_rule_match, R4), "r6_captures": (r6_captures, R6), "r7_failures": (r7_failures, R7), "r10_no_rules": (r10_no_rules, R10), "r12_coverage": (r12_coverage, R12), "v1_missing_required": (v1_missing_required, V1), "v3_sequences": (v3_sequences, V3), "v2_cardinality": (v2_cardinality, V2), "v6_errors": (v6_errors, V6),
    "m1_entities": (m1_entities, M1), "e3_events": (e3_events, E3), "e5_scoped": (e5_scoped, E5), "a7_positions": (a7_positions, A7), "a8_accounts": (a8_accounts, A8), "a9_sources": (a9_sources, A9), "a11_types": (a11_types, A11),
    "pc_accruals": (pc_accruals, PC), "pe_recon": (pe_recon, PE), "pf_summary": (pf_summary, PF), "pg_workqueue": (pg_workqueue, PG), "ph_open": (ph_open, PH), "pi_netting": (pi_netting, PI), "pj_period": (pj_period, PJ), "pk_window": (pk_window, PK),
}
