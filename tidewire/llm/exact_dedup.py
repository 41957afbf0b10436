"""Exact deduplication by deterministic block naming (native: DataFrame operations only).

A text is cut into blocks of a fixed number of characters. The distinct blocks are sorted and numbered, so that equal
blocks, and no others, share an integer name. Adjacent names are then paired, the distinct pairs are sorted and numbered
in turn, and so on until each document has one name; with the number of its blocks, that name stands for the text
without any collision.

Blocks are sorted by (64-bit hash, length, content). Where a hash and length have one content only, which the grouping
by whole content has established, occurrences find their name by hash and length alone and no text is shuffled twice;
the others are joined by content. A name that many rows have is joined in several tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, staged

#: One run of white space, as the contract has it.
WHITE = r"[\x20\x09-\x0D]+"
BLOCK_CHARS = 8192
#: Rows that share a name are dealt over so many tasks; at most 63, as a long has a bit for each.
SALTS = 32

SALT = f"cast(pmod(xxhash64(row), {SALTS}) as int) as salt"
#: An aggregate: a bit for each salt among the rows of a name.
SALTS_MET = "bit_or(shiftleft(1L, salt)) as met"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _blocks(text: Column, chars: int) -> Column:
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    return F.when(F.size(cut) == 0, F.array(F.lit(""))).otherwise(cut)


def _numbered(df: DataFrame, by: list[str], what: str) -> DataFrame:
    """The rows of df in ascending order with an integer name; written at once, so that a name never changes."""
    return staged(df.orderBy(*by).withColumn("name", F.monotonically_increasing_id()), what)


def _dealt(names: DataFrame) -> DataFrame:
    """names with a row for each salt that a row of the name has, so that joining a frequent name takes many tasks and
    joining a rare one costs no more rows than it occurs in."""
    return names.withColumn("salt", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> getbit(met, i) = 1)"))).drop("met")


def _block_names(texts: DataFrame, found: DataFrame, chars: int, key: Callable[[Column], Column]) -> DataFrame:
    """(row, pos, name) of every block. found: row, blocks (key, chars)."""
    contents = texts.select(F.expr(SALT), F.explode(_blocks(F.col("norm"), chars)).alias("block")).groupBy("block").agg(F.expr(SALTS_MET)).select(key(F.col("block")).alias("h"), F.length("block").alias("len"), "block", "met")
    # The count of contents per hash shows whether the hash names the content.
    names = _numbered(contents.groupBy("h", "len").agg(F.count(F.lit(1)).alias("contents"), F.expr("bit_or(met)").alias("met")), ["h", "len"], "block-names")
    places = found.select("row", F.posexplode("blocks").alias("pos", "b")).select("row", F.expr(SALT), "pos", "b.h", "b.len")
    named = places.join(_dealt(names.where("contents = 1").drop("contents")), ["h", "len", "salt"]).select("row", "pos", "name")
    mixed = names.where("contents > 1").select("h", "len")
    if mixed.isEmpty():
        return named
    # A hash with several contents: their own names follow the others', and occurrences find them by content.
    more = _numbered(contents.join(mixed, ["h", "len"], "left_semi"), ["h", "len", "block"], "mixed-names")
    above = names.agg(F.max("name")).first()[0] + 1
    spelled = texts.select("row", F.expr(SALT), F.posexplode(_blocks(F.col("norm"), chars)).alias("pos", "block"))
    return named.unionByName(spelled.join(_dealt(more.withColumn("name", F.col("name") + F.lit(above))), ["block", "salt"]).select("row", "pos", "name"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, key: Callable[[Column], Column] = F.xxhash64, row_col: str | None = None) -> DataFrame:
    """One row per document: id_col, keep_id, group_size long, kept boolean, text_sha256 string, and row_col if it is given.

    Texts are equal when identical after each run of white space became one space; a null text counts as empty. The row
    with the smallest id stays; of rows that repeat that id, one stays. Very long texts are cut into blocks of block_chars
    characters, and all blocks count. Rows without an id are left out. row_col names a long column that tells rows apart;
    without it ids do, or, where they repeat, numbers in a written copy. Other columns are not read, so their names don't
    matter. An empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col, row_col).select("row", "doc_id", normalised(F.col("text")).alias("norm"))
    found = staged(
        rows.select("row", "doc_id", F.sha2("norm", 256).alias("text_sha256"), F.transform(_blocks(F.col("norm"), block_chars), lambda b: F.struct(key(b).alias("h"), F.length(b).alias("len"))).alias("blocks")).withColumn("n", F.size("blocks")),
        "dedup-rows",
    )
    names = _block_names(rows, found, block_chars, key)
    longest = found.agg(F.max("n")).first()[0] or 1
    if longest == 1:
        identity = names.withColumn("n", F.lit(1)).select("row", "n", "name")
    else:
        names = staged(names.join(found.select("row", "n"), "row").withColumn("left", F.col("n")), "dedup-names")
        done = [names.where("n = 1").select("row", "n", "name")]
        current = names.where("n > 1")
        while longest > 1:
            pairs = staged(
                current.groupBy("row", "n", "left", F.expr("pos div 2").alias("pair")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")),
                "dedup-pairs",
            )
            numbered = _numbered(pairs.select("*", F.expr(SALT)).groupBy("a", "b").agg(F.expr(SALTS_MET)), ["a", "b"], "pair-names")
            level = staged(pairs.select("*", F.expr(SALT)).join(_dealt(numbered), ["a", "b", "salt"]).select("row", "n", F.ceil(F.col("left") / 2).cast("int").alias("left"), F.col("pair").cast("int").alias("pos"), "name"), "dedup-level")
            done.append(level.where("left = 1").select("row", "n", "name"))
            current, longest = level.where("left > 1"), (longest + 1) // 2
        identity = done[0]
        for more in done[1:]:
            identity = identity.unionByName(more)
    known = staged(found.select("row", "doc_id", "text_sha256").join(identity, "row"), "dedup-identity").select("*", F.expr(SALT))
    groups = known.groupBy("n", "name").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"), F.expr(SALTS_MET))
    return known.join(_dealt(groups), ["n", "name", "salt"]).select(*([F.col("row").alias(row_col)] if row_col else []), F.col("doc_id").alias(id_col), F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
