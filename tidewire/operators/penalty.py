"""Settlement-fail penalties: accrual, reported statements, reconciliation, break work and netting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOLERANCE = 0.01
# Starter rates in basis points by instrument type.
RATES = {"liquid_share": 1.0, "illiquid_share": 0.5, "sme_growth_share": 0.25, "corporate_bond": 0.20, "sme_growth_bond": 0.15, "sovereign_bond": 0.10, "etf": 0.5, "other": 0.5}
# Keywords of sovereign bonds.
SOVEREIGN = "GILT|TREASURY|TREAS|BUND|BTP|OAT|GOVT|SOVEREIGN|T-BILL"
STATEMENT_DAY, DISPUTE_DAYS, CLOSING_DAYS = 4, 10, 3


def rates(spark: SparkSession, table: dict[str, float] = RATES) -> DataFrame:
    return spark.createDataFrame(list(table.items()), "instrument_type string, penalty_rate_bps double")


def instrument_type(desc: Column) -> Column:
    """By keywords anywhere in the description, in order; a liquid share without any."""
    d = F.upper(F.coalesce(desc, F.lit("")))
    return F.when(d.rlike(SOVEREIGN), "sovereign_bond").when(d.contains("ETF"), "etf").when(d.rlike("BOND|NOTE|FRN|%"), "corporate_bond").otherwise("liquid_share")


def round2(x: Column) -> Column:
    return F.round(x * 100) / 100


def signed(size: Column, direction: Column) -> Column:
    return F.when(F.lower(F.btrim(direction)) == "receivable", F.abs(size)).otherwise(-F.abs(size))


def accruals(events: DataFrame, rate_rows: DataFrame, default_currency: str = "EUR") -> DataFrame:
    """A day's penalty of every pending or failing event with an ISIN and an amount."""
    due = events.where("upper(trim(status)) in ('PEND', 'PENF') and isin is not null and amount is not null").withColumn("instrument_type", instrument_type(F.col("instrument_desc")))
    priced = due.join(F.broadcast(rate_rows), "instrument_type")
    return priced.select(
        "source", F.coalesce("transaction_ref", "message_id").alias("transaction_ref"), "isin", "instrument_desc", "instrument_type", F.col("party_bic").alias("counterparty_bic"), F.coalesce("currency", F.lit(default_currency)).alias("currency"), "quantity",
        F.col("amount").alias("reference_amount"), F.lit("SEFP").alias("penalty_type"), "penalty_rate_bps", "status", F.col("settlement_date").alias("intended_settlement_date"), F.lit(1).alias("business_days_failed"),
        round2(signed(F.col("penalty_rate_bps") / 10000.0 * F.col("amount"), F.lit("payable"))).alias("computed_amount"), F.lit("payable").alias("direction"),
    )


def penalty_type(text: Column) -> Column:
    """SEFP or LMFP; anything else counts as SEFP."""
    t = F.upper(F.btrim(text))
    return F.when(t == "LMFP", "LMFP").otherwise("SEFP")


def recon_key(ref: Column, isin: Column, kind: Column) -> Column:
    return F.concat_ws("|", F.upper(F.btrim(ref)), F.upper(F.btrim(isin)), penalty_type(kind))


def reconcile(computed: DataFrame, reported: DataFrame) -> DataFrame:
    """A line per key of either side. Each side is summed by key before the join; what describes a line comes from the computed side,
    if it has the key."""

    def side(df: DataFrame, amount: str, to: str) -> DataFrame:
        keyed = df.withColumn("key", recon_key(F.col("transaction_ref"), F.col("isin"), F.col("penalty_type")))
        about = F.struct("transaction_ref", "isin", "counterparty_bic", "currency", "penalty_type")
        return keyed.groupBy("key").agg(F.sum(amount).alias(f"{to}_sum"), F.min(about).alias(f"{to}_about"), F.count(F.lit(1)).alias(f"{to}_rows"))

    both = side(computed, "computed_amount", "c").join(side(reported, "reported_amount", "r"), "key", "full_outer")
    about = F.coalesce("c_about", "r_about")
    c, r = F.coalesce("c_sum", F.lit(0.0)), F.coalesce("r_sum", F.lit(0.0))
    diff = round2(r - c)
    status = F.when(F.col("c_about").isNull(), "missing_computed").when(F.col("r_about").isNull(), "missing_reported").when(F.abs(diff) <= TOLERANCE, "matched").otherwise("break")
    return both.select("key", about["transaction_ref"].alias("transaction_ref"), about["isin"].alias("isin"), about["counterparty_bic"].alias("counterparty_bic"), about["currency"].alias("currency"), about["penalty_type"].alias("penalty_type"), round2(c).alias("computed_amount"), round2(r).alias("reported_amount"), diff.alias("diff"), status.alias("status"))


def summary(lines: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias({"break": "breaks"}.get(s, s))
    return lines.agg(
        F.round(F.sum("computed_amount"), 2).alias("computed_total"), F.round(F.sum("reported_amount"), 2).alias("reported_total"), F.round(F.sum("reported_amount") - F.sum("computed_amount"), 2).alias("net_diff"),
        *map(count, ("matched", "break", "missing_reported", "missing_computed")), F.round(F.sum(F.when(F.col("status") != "matched", F.abs("diff")).otherwise(0.0)), 2).alias("break_amount"), F.bool_and(F.col("status") == "matched").alias("all_reconciled"),
    )


def work_lines(lines: DataFrame, accrual_rows: DataFrame, dispositions: DataFrame) -> DataFrame:
    """lines with reason, abs_diff and disposition (open where none is given); dispositions: key, disposition, and period if they and
    the lines have one: then a line has that of its own period alone."""
    keyed = accrual_rows.withColumn("key", recon_key(F.col("transaction_ref"), F.col("isin"), F.col("penalty_type")))
    one = keyed.groupBy("key").agg(F.max_by(F.struct("reference_amount", "penalty_rate_bps"), F.struct("reference_amount", "penalty_rate_bps")).alias("a"))
    joined = lines.join(one, "key", "left").join(dispositions, [c for c in ("period", "key") if c in dispositions.columns and c in lines.columns], "left")
    amount, ours = F.col("a.reference_amount"), F.col("a.penalty_rate_bps")
    implied = F.abs("reported_amount") / amount * 10000
    day = ours / 10000 * amount
    reason = (
        F.when(F.col("status") != "break", F.col("status")).when(F.col("a").isNull() | ~((amount > 0) & (ours > 0)), "other")
        .when(F.abs(implied - ours) / ours > 0.05, "rate_mismatch").when((day > 0) & (F.abs(F.abs("diff") - day) / day < 0.2), "day_count").otherwise("amount_mismatch")
    )
    return joined.withColumn("reason", reason).withColumn("abs_diff", F.abs("diff")).withColumn("disposition", F.coalesce("disposition", F.lit("open"))).drop("a")


def queue(work: DataFrame, limit: int | None = None) -> DataFrame:
    """Breaks, the largest difference first."""
    out = work.where("status <> 'matched'").orderBy(F.desc("abs_diff"), "key")
    return out.limit(limit) if limit else out


def open_totals(work: DataFrame) -> DataFrame:
    broken, still = F.col("status") != "matched", F.col("disposition").isin("open", "investigating")
    return work.groupBy("reason").agg(F.count_if(broken & still).alias("open_breaks"), F.round(F.sum(F.when(broken & still, F.col("abs_diff")).otherwise(0.0)), 2).alias("unresolved"), F.count_if(broken & (F.col("disposition") != "open")).alias("dispositioned"))


def netting(work: DataFrame) -> DataFrame:
    """Per counterparty and currency: computed, reported, reported with flagged lines at the computed amount, lines, open breaks."""
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("—")).alias({"counterparty_bic": "counterparty"}.get(c, c))
    open_break = (F.col("status") != "matched") & F.col("disposition").isin("open", "investigating")
    adjusted = F.when(F.col("disposition") == "flagged", F.col("computed_amount")).otherwise(F.col("reported_amount"))
    cells = work.groupBy(dash("counterparty_bic"), dash("currency")).agg(F.round(F.sum("computed_amount"), 2).alias("computed"), F.round(F.sum("reported_amount"), 2).alias("reported"), F.round(F.sum(adjusted), 2).alias("dispute_adjusted"), F.count(F.lit(1)).alias("lines"), F.count_if(open_break).alias("open_breaks"))
    return cells.orderBy(F.abs("reported").desc(), "counterparty", "currency")


def weekday_after(day: Column, n: int) -> Column:
    """The n-th weekday after a date."""
    days = F.filter(F.sequence(F.date_add(day, 1), F.date_add(day, 2 * n + 7)), lambda d: F.weekday(d) < 5)
    return days[n - 1]


def weekdays_between(a: Column, b: Column) -> Column:
    """Weekdays after a, up to b; 0 if b isn't later."""
    return F.when(b > a, F.size(F.filter(F.sequence(F.date_add(a, 1), F.greatest(b, F.date_add(a, 1))), lambda d: F.weekday(d) < 5))).otherwise(0)


def dispute_window(periods: DataFrame, now: Column) -> DataFrame:
    """Per period (YYYY-MM): statement date, cutoff, weekdays remaining and state."""
    last = F.last_day(F.to_date(F.concat("period", F.lit("-01"))))
    out = periods.withColumn("statement_date", weekday_after(last, STATEMENT_DAY)).withColumn("cutoff", weekday_after(F.col("statement_date"), DISPUTE_DAYS))
    remaining = F.when(now < F.col("statement_date"), DISPUTE_DAYS).when(now > F.col("cutoff"), 0).otherwise(weekdays_between(now, F.col("cutoff")))
    state = F.when(now < F.col("statement_date"), "upcoming").when(now > F.col("cutoff"), "closed").when(remaining <= CLOSING_DAYS, "closing").otherwise("open")
    return out.withColumn("remaining", remaining.cast("int")).withColumn("state", state)
