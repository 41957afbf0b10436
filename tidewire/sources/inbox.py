"""Inbox files: listing, column aliases, format detection, and the readers of each format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewire.operators import structure


def read_batch(inbox: DataFrame, limit: int) -> DataFrame:
    """The first unprocessed rows by id."""
    return inbox.where(~F.coalesce("processed", F.lit(False))).select("id", "message_type", "body").orderBy("id").limit(limit)


def scan_prefix(spark: SparkSession, prefix: str, suffix: str = ".fin", at_most: int | None = None) -> DataFrame:
    """path, length, content of the files under a prefix whose names end in suffix; refuses none, or more than at_most."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(prefix)
    names = found.select("path").limit((at_most or 0) + 1).count()
    if not names:
        raise ValueError(f"no file under {prefix} ends in {suffix}")
    if at_most is not None and names > at_most:
        raise ValueError(f"more than {at_most} files under {prefix}")
    return found.select("path", "length", "content")


def inbox_rows(df: DataFrame, default_source: str = "default") -> DataFrame:
    """source_id, name, content from whichever of the known column names df has."""

    def first(names: tuple[str, ...], default: Column) -> Column:
        return F.coalesce(*(F.col(n) for n in names if n in df.columns), default)

    file_n = F.concat(F.lit("file-"), F.monotonically_increasing_id().cast("string"))
    content = [F.col(n).cast("binary") for n in ("bytes", "content", "text", "body") if n in df.columns]
    return df.select(first(("source_id", "source"), F.lit(default_source)).alias("source_id"), first(("name", "file_name", "file", "path"), file_n).alias("name"), (F.coalesce(*content) if content else F.lit(None).cast("binary")).alias("content"))


def detect_format(name: Column, content: Column) -> Column:
    """mt, camt or csv as the sink tells them, or null: refused."""
    text = F.decode(content, "UTF-8")
    lower = F.lower(name)
    head = F.lower(F.substring_index(F.ltrim(text), "\n", 1))
    return (
        F.when(~F.is_valid_utf8(content), None).when(text.rlike(r"(?m)^:20:") | text.contains("{1:"), "mt").when(lower.endswith(".xml") | F.ltrim(text).startswith("<?xml") | text.contains("camt.053"), "camt")
        .when(lower.endswith(".csv") | (head.contains("isin") & head.contains(",")), "csv")
    )


def detect_route(name: Column, content: Column) -> Column:
    """The route that a command line gives a file: camt, csv by name, cash, securities, csv by header, else as the sink tells."""
    text, lower = F.decode(content, "UTF-8"), F.lower(name)
    head = F.lower(F.substring_index(F.ltrim(text), "\n", 1))
    return (
        F.when(lower.endswith(".xml") | F.ltrim(text).startswith("<?xml") | text.contains("camt.053"), "camt").when(lower.endswith(".csv"), "csv").when(text.contains(":61:"), "cash")
        .when(text.contains(":35B:"), "securities").when(head.contains("isin") & head.contains(","), "csv").otherwise(detect_format(name, content))
    )


def canonical_source(source: Column) -> Column:
    """custodian:BIC11 in upper case, or broker:name; null where refused."""
    bic = F.upper(F.regexp_extract(source, r"^custodian:([A-Za-z0-9]{8}(?:[A-Za-z0-9]{3})?)$", 1))
    return F.when(bic != "", F.concat(F.lit("custodian:"), bic, F.when(F.length(bic) == 8, "XXX").otherwise(""))).when(source.rlike(r"^broker:[a-z0-9-]{1,40}$"), source)


def sorted_out(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with their format and canonical source, refused files with the reason); no bad file stops the others."""
    judged = files.withColumn("format", detect_format(F.col("name"), F.col("content"))).withColumn("source", canonical_source(F.col("source_id")))
    reason = F.when(F.col("source").isNull(), "bad_source").when(~F.is_valid_utf8("content"), "not_utf8").when(F.col("format").isNull(), "unknown_format")
    header = F.lower(F.substring_index(F.ltrim(F.decode("content", "UTF-8")), "\n", 1))
    reason = F.coalesce(reason, F.when((F.col("format") == "csv") & ~(header.contains("isin") & header.contains("quantity")), "unknown_layout"))
    judged = judged.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("name", "source_id", "reason")


def split_bare(files: DataFrame) -> DataFrame:
    """source_id, name, fragment, raw, message_type, body (in an envelope) of statements without one; name and text columns in."""
    pieces = files.select("source_id", "name", F.posexplode(F.split("text", r"(?m)(?=^:20:)")).alias("fragment", "raw"))
    clean = F.regexp_replace("raw", r"(?m)^-\}?\s*$\n?", "")
    rows = pieces.where(F.col("raw").startswith(":20:")).withColumn("clean", structure.trimmed(clean)).where(F.col("clean").rlike(r"(?m)^:25P?:"))
    interim = F.col("clean").rlike(r"(?m)^:(34F|90D|90C):") | (F.col("clean").rlike(r"(?m)^:13D:") & ~F.col("clean").rlike(r"(?m)^:60"))
    kind = F.when(interim, "942").otherwise("940")
    body = F.concat(F.lit("{1:F01XXXXXXXXAXXX0000000000}{2:I"), kind, F.lit("XXXXXXXXXXXXN}{4:\n"), F.col("clean"), F.lit("\n-}"))
    return rows.select("source_id", "name", "fragment", "raw", F.concat(F.lit("MT"), kind).alias("message_type"), body.alias("body"))


def csv_rows(files: DataFrame) -> DataFrame:
    """name, line, byte_offset, header (lower-cased cells), cells of every line that isn't blank but the first."""
    lines = files.select("name", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    from pyspark.sql import Window

    order = Window.partitionBy("name").orderBy("line")
    placed = lines.withColumn("byte_offset", F.coalesce(F.sum(F.octet_length("raw") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")).withColumn("text", F.btrim(F.regexp_replace("raw", "\r", ""))).where("text <> ''")
    head = placed.groupBy("name").agg(F.min_by("text", "line").alias("head"), F.min("line").alias("first"))
    joined = placed.join(head, "name").where("line > first")
    cells = lambda c: F.transform(F.split(c, ","), lambda x: F.btrim(x))
    return joined.select("name", "line", "byte_offset", cells(F.lower("head")).alias("header"), cells(F.col("text")).alias("cells"))


def cell(*names: str) -> Column:
    """The cell under the first header of these that there is; null if empty."""
    pick = lambda n: F.when(F.array_position("header", F.lit(n)) > 0, F.nullif(F.try_element_at("cells", F.array_position("header", F.lit(n)).cast("int")), F.lit("")))
    return F.coalesce(*map(pick, names))


def positions(files: DataFrame) -> DataFrame:
    """Events of custodian position files (name, text): headers in any order and case, bad ISINs and numbers null."""
    isin = F.upper(cell("isin"))
    rows = csv_rows(files)
    return rows.select("name", F.coalesce(cell("id"), F.concat(F.lit("row-"), F.col("line").cast("string"))).alias("message_id"), F.when(isin.rlike(r"^[A-Z]{2}[A-Z0-9]{10}$"), isin).alias("isin"), cell("description").alias("instrument_desc"), cell("quantity").try_cast("double").alias("quantity"), cell("settlement_date").alias("settlement_date"), cell("account").alias("safekeeping_account"), cell("party").alias("party_bic"), cell("status").alias("status"), cell("amount").try_cast("double").alias("amount"), cell("currency").alias("currency"), cell("transaction_ref", "reference").alias("transaction_ref"), "byte_offset")


def csv_fields(files: DataFrame) -> DataFrame:
    """name, line, field_seq, tag (the header), value of every cell."""
    return csv_rows(files).select("name", "line", F.posexplode(F.arrays_zip("header", "cells")).alias("field_seq", "z")).select("name", "line", "field_seq", F.col("z.header").alias("tag"), F.col("z.cells").alias("value"))


PENALTY_CSV = "penalty_ref string, transaction_ref string, isin string, counterparty string, currency string, penalty_type string, amount string, period string, direction string"


def penalty_statement(lines: DataFrame) -> DataFrame:
    """Reported penalties from lines (value) of a quoted CSV with these columns; lines without a numeric amount are dropped."""
    from tidewire.operators import penalty

    rows = lines.select(F.from_csv("value", PENALTY_CSV, {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("c")).select("c.*")
    direction = F.coalesce(F.lower("direction"), F.lit("payable"))
    return rows.withColumn("size", F.col("amount").try_cast("double")).where("size is not null").select("penalty_ref", "transaction_ref", "isin", F.col("counterparty").alias("counterparty_bic"), "currency", penalty.penalty_type(F.col("penalty_type")).alias("penalty_type"), "period", penalty.signed(F.col("size"), direction).alias("reported_amount"), direction.alias("direction"))


_AMT = "Amt struct<_VALUE:string,_Ccy:string>"
_BAL = f"array<struct<Tp:struct<CdOrPrtry:struct<Cd:string>>,{_AMT.replace(' ', ':', 1)},CdtDbtInd:string>>"
_NTRY = f"array<struct<{_AMT.replace(' ', ':', 1)},CdtDbtInd:string,RvslInd:string,ValDt:struct<Dt:string>,BookgDt:struct<Dt:string>,BkTxCd:struct<Domn:struct<Cd:string>,Prtry:struct<Cd:string>>,NtryRef:string,AcctSvcrRef:string,NtryDtls:struct<TxDtls:array<struct<Refs:struct<EndToEndId:string>,AddtlTxInf:string>>>>>"
CAMT = f"BkToCstmrStmt struct<Stmt:array<struct<Id:string,Acct:struct<Id:struct<IBAN:string>,Ccy:string>,Bal:{_BAL},Ntry:{_NTRY}>>>"


def camt_statements(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements, entries) of camt.053 documents (name, text). Of balances of one kind the last counts; amounts that aren't numbers
    are 0."""
    doc = F.from_xml("text", CAMT, {"ignoreNamespace": "true"})
    s = files.select("name", F.posexplode(doc["BkToCstmrStmt"]["Stmt"]).alias("at", "s")).select(F.concat("name", F.lit("-"), (F.col("at") + 1).cast("string")).alias("message_id"), "s")
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    sign = lambda x: F.when(x["CdtDbtInd"] == "DBIT", -1.0).otherwise(1.0)

    def balance(*codes: str) -> Column:
        last = F.try_element_at(F.filter("s.Bal", lambda b: b["Tp"]["CdOrPrtry"]["Cd"].isin(*codes)), F.lit(-1))
        return F.when(last.isNotNull(), sign(last) * number(last["Amt"]["_VALUE"]))

    heads = s.select("message_id", F.lit("camt.053").alias("message_type"), F.col("s.Id").alias("reference"), F.col("s.Acct.Id.IBAN").alias("account"), F.coalesce("s.Acct.Ccy", F.col("s.Bal")[0]["Amt"]["_Ccy"]).alias("currency"), balance("OPBD", "PRCD").alias("opening"), balance("CLBD").alias("closing"), balance("CLAV", "FWAV").alias("available"))
    e = s.select("message_id", F.posexplode("s.Ntry").alias("row_seq", "n"))
    back = F.lower(F.coalesce(F.col("n.RvslInd"), F.lit("false"))) == "true"
    direction = F.when(back & (F.col("n.CdtDbtInd") == "DBIT"), "reversal_debit").when(back, "reversal_credit").when(F.col("n.CdtDbtInd") == "DBIT", "debit").otherwise("credit")
    size = number(F.col("n.Amt._VALUE"))
    rows = e.select("message_id", F.col("row_seq").cast("long").alias("row_seq"), F.col("n.ValDt.Dt").alias("value_date"), F.col("n.BookgDt.Dt").alias("entry_date"), direction.alias("direction"), size.alias("amount"), F.when(direction.isin("credit", "reversal_debit"), size).otherwise(-size).alias("signed_amount"), F.coalesce("n.BkTxCd.Domn.Cd", "n.BkTxCd.Prtry.Cd").alias("transaction_type"), F.coalesce(F.get("n.NtryDtls.TxDtls", F.lit(0))["Refs"]["EndToEndId"], "n.NtryRef").alias("customer_ref"), F.col("n.AcctSvcrRef").alias("bank_ref"), F.get("n.NtryDtls.TxDtls", F.lit(0))["AddtlTxInf"].alias("info"))
    return heads, rows.join(heads.select("message_id", "account", "currency"), "message_id")


def refused_camt(files: DataFrame) -> DataFrame:
    """name, reason of the documents (name, text) that are no well-formed XML; camt_statements has no row of them."""
    doc = F.from_xml("text", f"{CAMT}, _corrupt_record string", {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return files.select("name", doc.alias("doc")).where("doc is null or doc._corrupt_record is not null").select("name", F.lit("malformed_xml").alias("reason"))


_STATEMENT = r"<((?:[A-Za-z_][\w.-]*:)?)Stmt(?:\s[^>]*)?(?:/>|(?<!/)>.*?</\1Stmt\s*>)"


def camt_fragments(files: DataFrame) -> DataFrame:
    """name, fragment, byte_offset, raw: each statement of camt.053 documents (name, text) as it is written, with the byte at which it
    begins. Comments and CDATA outside of statements are passed over; of documents that are no well-formed XML there is no row.
    A document is one value, its pieces are numbered in one window."""
    from pyspark.sql import Window

    bad = refused_camt(files).select("name")
    pieces = F.split(F.regexp_replace("text", f"(?s)<!--.*?-->|<!\\[CDATA\\[.*?\\]\\]>|{_STATEMENT}", "\0$0\0"), "\0")
    rows = files.join(bad, "name", "left_anti").select("name", F.posexplode(pieces).alias("place", "raw"))
    order = Window.partitionBy("name").orderBy("place")
    offset = F.coalesce(F.sum(F.octet_length("raw")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    # What was matched stands at every other place.
    found = rows.withColumn("byte_offset", offset).where((F.col("place") % 2 == 1) & ~F.col("raw").startswith("<!"))
    return found.withColumn("fragment", F.row_number().over(order) - 1).select("name", "fragment", "byte_offset", "raw")


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet table, or an empty frame of its schema where there is none yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
