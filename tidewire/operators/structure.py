"""Messages to blocks, fields and sequence paths.

Everything up to the field rows happens within a message, in one pass of an Arrow function over whole messages (see parse),
so that nothing is shuffled before a business key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import parse
from .parse import MAX_BLOCK_BYTES, MAX_DEPTH, MAX_FIELDS, MAX_MESSAGE_BYTES  # noqa: F401


def trimmed(value: Column) -> Column:
    """Without ASCII white space at the ends."""
    return F.btrim(value, F.lit(" \t\n\f\r"))


def split_fin(text: Column) -> Column:
    """The pieces of a file of messages: each starts at {1: at the start or after a closing brace with only $, white space, SOH or
    ETX between, however many. A pattern can't look back without a bound, so a mark is put behind such separators and
    the text cut at the marks; what looks like a mark in the text is spelled otherwise meanwhile."""
    spelled = F.replace(text, F.lit("\0"), F.lit("\0\2"))
    marked = F.regexp_replace(spelled, r"(\}[$ \t\n\f\r\x01\x03]*+)(?=\{1:)", "$1\0\3\0")
    return F.transform(F.split(marked, "\0\3\0"), lambda x: F.replace(x, F.lit("\0\2"), F.lit("\0")))


def messages_of_files(files: DataFrame) -> DataFrame:
    """source_id, name, fragment, byte_offset, body (separators at the end trimmed), kept: whether block 2 is there."""
    pieces = files.select("source_id", "name", F.posexplode(split_fin(F.decode("content", "UTF-8"))).alias("fragment", "piece"))
    before = Window.partitionBy("source_id", "name").orderBy("fragment").rowsBetween(Window.unboundedPreceding, -1)
    body = F.regexp_replace("piece", r"[$ \t\n\f\r\x01\x03]+$", "")
    return pieces.where("piece <> ''").select("source_id", "name", "fragment", F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0)).cast("long").alias("byte_offset"), body.alias("body"), F.col("piece").contains("{2:").alias("kept"))


def message_type(body: Column) -> Column:
    found = F.regexp_extract(body, r"\{2:[IO](\d{3})", 1)
    return F.when(found != "", F.concat(F.lit("MT"), found))


def blocks(messages: DataFrame) -> DataFrame:
    """messages with block1 to block5: the contents of the first block of each, matched by the depth of braces, block 4 up to
    the next -}; null where there is none, or only after a block that isn't closed."""
    rest = messages.drop(*(f"block{b}" for b in parse.BLOCKS))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), *(f"block{b} string" for b in parse.BLOCKS)])
    return rest.mapInArrow(parse.add_blocks(rest.columns.index("body")), schema)


def qualifier(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"^:([A-Za-z0-9]{4})//", 1), F.lit(""))


def fields(messages: DataFrame, limits: bool = True) -> DataFrame:
    """message_id, message_type, field_seq, tag, value of block 4 in order; text before the first tag line is no field. What lies
    beyond the limits is left out, or held by the last field within them, and diagnostics has a row for it; without limits
    all fields are kept."""
    return messages.select("message_id", "message_type", "body").mapInArrow(parse.cut_fields(limits), parse.FIELDS)


def walked(messages: DataFrame, full: bool = True, anchors: dict | None = None) -> DataFrame:
    """Field rows with seq_index and seq_path (the sequences that hold the row, $ at root; a 16R row has its parents', a 16S row
    its own), problem, qualifier, and occurrence per (seq_index, tag, qualifier); if full also path, an array, and unclosed:
    at the last field of a message the sequences that were never closed. Nothing is shuffled.

    anchors: name -> (anchor tag or tags, member tags) of groups without brackets. At root an anchor tag begins an
    occurrence of its group, member tags stay in it, any other field ends it. A bracketed sequence of the name counts with it."""
    known = {name: ((tags,) if isinstance(tags, str) else tuple(tags), tuple(members)) for name, (tags, members) in (anchors or {}).items()}
    return messages.select("message_id", "message_type", "body").mapInArrow(parse.walk_fields(full, known), parse.FULL if full else parse.WALKED)


def field_rows(messages: DataFrame, anchors: dict | None = None) -> DataFrame:
    """Rows that are fields, with their paths; anchors: see walked."""
    return walked(messages, False, anchors).where("problem is null or problem <> 'mismatched_end'")


def issuer_form(value: Column) -> tuple[Column, Column, Column]:
    """(qualifier, issuer, what follows) of :QUAL/ISSR/value, nulls where the value has another form."""
    pattern = r"(?s)^:([A-Z0-9]{4})/([A-Z0-9]{1,8})/(.*)$"
    pick = lambda i: F.when(value.rlike(pattern), F.regexp_replace(F.regexp_extract(value, pattern, i), "\r\n", "\n"))
    return pick(1), pick(2), pick(3)


def without_payload(messages: DataFrame, rows: DataFrame, raw_text: bool = False, raw_values: bool = False) -> tuple[DataFrame, DataFrame]:
    """(messages, field rows) with the raw text and the raw values emptied, unless they are asked for."""
    return messages if raw_text else messages.withColumn("body", F.lit("")), rows if raw_values else rows.withColumn("value", F.lit(""))


def bic11(terminal: Column) -> Column:
    """The eleven characters of a twelve-character terminal address."""
    return F.concat(F.substring(terminal, 1, 8), F.substring(terminal, 10, 3))


def envelope(messages: DataFrame) -> DataFrame:
    """message_id, io, message_type3, sender_bic, receiver_bic, session, sequence, application, service, priority."""
    b = blocks(messages)
    own = bic11(F.substring("block1", 4, 12))
    io = F.substring("block2", 1, 1)
    other = F.when(io == "I", bic11(F.substring("block2", 5, 12))).otherwise(bic11(F.substring("block2", 15, 12)))
    return b.select(
        "message_id", io.alias("io"), F.substring("block2", 2, 3).alias("message_type3"),
        F.when(io == "I", own).otherwise(other).alias("sender_bic"), F.when(io == "I", other).otherwise(own).alias("receiver_bic"),
        F.substring("block1", 16, 4).alias("session"), F.substring("block1", 20, 6).alias("sequence"), F.substring("block1", 1, 1).alias("application"), F.substring("block1", 2, 2).alias("service"),
        F.when(io == "I", F.substring("block2", 17, 1)).otherwise(F.substring("block2", -1, 1)).alias("priority"),
    )


def sender_reference(rows: DataFrame) -> DataFrame:
    """message_id, sender_ref: the first tag 20, else the first 20C with SEME."""
    first = lambda cond: F.min_by(F.when(cond, F.col("value")), F.when(cond, F.col("field_seq")))
    seme = F.regexp_replace(first((F.col("tag") == "20C") & (F.col("qualifier") == "SEME")), "^:SEME//", "")
    return rows.groupBy("message_id").agg(F.coalesce(first(F.col("tag") == "20"), seme).alias("sender_ref"))


def identity(split: DataFrame, files: DataFrame) -> DataFrame:
    """split with file_sha256, message_sha256 and a message_id that source, file and offset give."""
    hashed = files.select("source_id", "name", F.sha2("content", 256).alias("file_sha256"))
    joined = split.join(hashed, ["source_id", "name"])
    mark = F.concat_ws(chr(31), "source_id", "file_sha256", F.col("byte_offset").cast("string"))
    return joined.withColumn("message_sha256", F.sha2("body", 256)).withColumn("message_id", F.concat(F.lit("m-"), F.substring(F.sha2(mark, 256), 1, 32)))


def block4_complete(messages: DataFrame) -> DataFrame:
    """message_id, complete: whether the field rows, printed again, are block 4."""
    flat = fields(messages).groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("field_seq", F.concat(F.lit(":"), F.col("tag"), F.lit(":"), F.col("value")).alias("line")))).alias("ls"))
    printed = flat.select("message_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("printed"))
    return blocks(messages).where("block4 is not null").join(printed, "message_id", "left").select("message_id", F.coalesce(trimmed(F.regexp_replace("block4", "\r\n", "\n")) == F.col("printed"), F.lit(False)).alias("complete"))


def diagnostics(messages: DataFrame) -> DataFrame:
    """message_id, kind, byte_offset, detail, expected of what is wrong with the structure of a message.

    byte_offset counts in the UTF-8 of the body; it is there for missing_block_separator, unclosed_block, unclosed_text_block
    (the brace that opens) and malformed_field_tag (the line's colon). detail: what was observed of a limit (limit_message_bytes,
    limit_block_bytes, limit_fields, limit_sequence_depth), or the name of a sequence (mismatched_sequence_end with what was
    expected, null at root; unclosed_sequence, innermost first). Reading ends at the first defect of a block."""
    return messages.select("message_id", "message_type", "body").mapInArrow(parse.find_defects(), parse.DEFECTS)
