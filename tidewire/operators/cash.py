"""Cash statements and their entries from MT940/942 fields, and the books over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.sources.shared import written

from . import structure

RECONCILES = 0.005
_LINE = r"^(\d{6})(?:\d{4}(?=[CDR]))?(RC|RD|C|D)[A-Za-z]?([0-9.]*,?[0-9]*)N(.{3})?(.*)$"
_BALANCE = r"^([CD])(\d{6})(.{3})([0-9]+[,.]?[0-9]*)$"


def iso_date(yymmdd: Column) -> Column:
    """YYMMDD in this century as YYYY-MM-DD; null unless six digits."""
    return F.when(yymmdd.rlike(r"^\d{6}$"), F.regexp_replace(yymmdd, r"^(\d{2})(\d{2})(\d{2})$", "20$1-$2-$3"))


def amount(text: Column) -> Column:
    """A decimal with a comma as a double; null if it isn't one."""
    return F.regexp_replace(text, ",", ".").try_cast("double")


def signed(direction: Column, size: Column) -> Column:
    """Credits and reversals of debits add, debits and reversals of credits take."""
    return F.when(direction.isin("credit", "reversal_debit"), size).when(direction.isin("debit", "reversal_credit"), -size)


def _balance(text: Column) -> Column:
    size = amount(F.regexp_extract(text, _BALANCE, 4))
    return F.when(text.rlike(_BALANCE), F.when(F.regexp_extract(text, _BALANCE, 1) == "C", size).otherwise(-size))


def entries(flat: DataFrame) -> DataFrame:
    """message_id, row_seq, value_date, entry_date, direction, amount, signed_amount, transaction_type, customer_ref, bank_ref, info
    of :61: fields; info is the second line, else the :86: that follows directly."""
    order = Window.partitionBy("message_id").orderBy("field_seq")
    rows = flat.withColumn("_next", F.lead("tag").over(order)).withColumn("_text", F.lead("value").over(order)).where("tag = '61'")
    head, more = structure.trimmed(F.substring_index("value", "\n", 1)), F.when(F.col("value").contains("\n"), structure.trimmed(F.expr("substring(value, instr(value, '\n') + 1)")))
    part = lambda i: F.regexp_extract(head, _LINE, i)
    mark, refs = part(2), part(5)
    direction = F.when(mark == "RC", "reversal_credit").when(mark == "RD", "reversal_debit").when(mark == "C", "credit").otherwise("debit")
    some = lambda c: F.nullif(c, F.lit(""))
    size = amount(part(3))
    own = some(more)
    out = rows.where(head.rlike(_LINE)).select(
        "message_id", "field_seq", iso_date(part(1)).alias("value_date"), F.lit(None).cast("string").alias("entry_date"), direction.alias("direction"), size.alias("amount"),
        some(part(4)).alias("transaction_type"), some(F.substring_index(refs, "//", 1)).alias("customer_ref"),
        F.when(refs.contains("//"), some(F.regexp_replace(refs, "^.*?//", ""))).alias("bank_ref"),
        F.coalesce(own, F.when(F.col("_next") == "86", some(F.col("_text")))).alias("info"),
    ).where("amount is not null")
    return out.withColumn("signed_amount", signed(F.col("direction"), F.col("amount"))).withColumn("row_seq", (F.row_number().over(order) - 1).cast("long")).drop("field_seq")


def statements(flat: DataFrame) -> DataFrame:
    """message_id, message_type, reference, account, statement_number, currency, opening, closing, available (signed) per message
    with a tag 20, 25 or 61."""
    last = lambda *tags: F.max_by(F.when(F.col("tag").isin(*tags), F.col("value")), F.when(F.col("tag").isin(*tags), F.col("field_seq")))
    wide = flat.groupBy("message_id", "message_type").agg(
        last("20").alias("reference"), last("25", "25P").alias("account"), last("28C", "28").alias("statement_number"), last("60F", "60M").alias("o"), last("62F", "62M").alias("c"), last("64").alias("a"), F.max(F.col("tag") == "61").alias("has61"),
    )
    currency = lambda c: F.when(F.col(c).rlike(_BALANCE), F.regexp_extract(c, _BALANCE, 3))
    known = wide.where("reference is not null or account is not null or has61")
    return known.select("message_id", "message_type", "reference", "account", "statement_number", F.coalesce(currency("o"), currency("c")).alias("currency"), _balance(F.col("o")).alias("opening"), _balance(F.col("c")).alias("closing"), _balance(F.col("a")).alias("available"))


def cash_star(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statement rows, entry rows with the statement's account and currency); statements are read whole, without limits. Their fields
    are written once, as statements and entries both read them."""
    flat = written(structure.fields(messages, limits=False), "fields")
    heads = statements(flat)
    return heads, entries(flat).join(heads.select("message_id", "account", "currency"), "message_id", "left")


def verdicts(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """Per statement: net movement, expected closing, difference; reconciles is null without both balances, reconciles_zero takes a
    missing balance as 0."""
    net = rows.groupBy("message_id").agg(F.sum("signed_amount").alias("net"))
    joined = heads.join(net, "message_id", "left").withColumn("net", F.coalesce("net", F.lit(0.0)))
    opening, closing = F.coalesce("opening", F.lit(0.0)), F.coalesce("closing", F.lit(0.0))
    return joined.select("message_id", "account", "currency", "opening", "closing", "net", (opening + F.col("net")).alias("expected_closing"), (closing - opening - F.col("net")).alias("diff")).withColumns(
        {"reconciles": F.when(F.col("opening").isNotNull() & F.col("closing").isNotNull(), F.abs("diff") < RECONCILES), "reconciles_zero": F.abs("diff") < RECONCILES}
    )


def cash_pnl(heads: DataFrame, rows: DataFrame, by: list[str], positive_outflows: bool = False) -> DataFrame:
    """Per group of statements: inflows, outflows (negative, or as a size), net, statements, entries, breaks, all_reconciled."""
    side = F.lit(-1.0 if positive_outflows else 1.0)
    per = rows.groupBy("message_id").agg(F.sum(F.when(F.col("signed_amount") >= 0, F.col("signed_amount")).otherwise(0.0)).alias("inflow"), F.sum(F.when(F.col("signed_amount") < 0, F.col("signed_amount")).otherwise(0.0)).alias("outflow"), F.count(F.lit(1)).alias("n"))
    judged = verdicts(heads, rows).join(per, "message_id", "left")
    ok = F.coalesce(F.bool_and("reconciles"), F.lit(False))
    return judged.groupBy(*by).agg(
        F.round(F.coalesce(F.sum("inflow"), F.lit(0.0)), 2).alias("inflows"), F.round(side * F.coalesce(F.sum("outflow"), F.lit(0.0)), 2).alias("outflows"), F.round(F.coalesce(F.sum(F.col("inflow") + F.col("outflow")), F.lit(0.0)), 2).alias("net"),
        F.count(F.lit(1)).alias("statements"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.count_if(~F.col("reconciles_zero")).alias("breaks"), ok.alias("all_reconciled"),
    )


def by_type(rows: DataFrame) -> DataFrame:
    """Signed total per transaction type, a blank one shown as a dash, largest magnitude first."""
    kind = F.coalesce(F.nullif("transaction_type", F.lit("")), F.lit("—"))
    return rows.groupBy(kind.alias("transaction_type")).agg(F.round(F.sum("signed_amount"), 2).alias("amount"), F.count(F.lit(1)).alias("entries")).orderBy(F.abs("amount").desc(), "transaction_type")
