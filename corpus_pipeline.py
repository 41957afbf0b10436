"""A corpus pipeline over documents: language, exact copies, near copies, mixture, packed sequences.

Each stage takes all that the one before kept and returns the columns of documents, whatever they are called, but for the
last, which returns the pieces of the packed sequences. Rows are told apart also where they repeat an id, so that of rows
that repeat an id and a text one stays. Rows without an id are rejected by the first stage, since the pieces name documents by
it. Null texts have no language and are rejected with it; very long texts are taken whole. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import exact_dedup, langid, mixing, near_dedup, packing
from tidewire.llm.common import OWN, ROW, staged, with_rows
from tidewire.llm.queries import _tokenizer

#: The least score of a language: below it two languages need about as few phrases, and the text is in none of them.
SURE = 0.5


def _of(rows: DataFrame, kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows that kept names, with the columns of docs."""
    return rows.join(kept.select(ROW), ROW, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of SURE at least; those without any letter have none."""
    rows = with_rows(docs)
    told = langid.identify(rows, row_col=ROW).where((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return _of(rows, told, docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    rows = with_rows(docs)
    return _of(rows, exact_dedup.exact_dedup(rows, row_col=ROW).where("kept"), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    rows = with_rows(docs)
    return _of(rows, near_dedup.near_dedup(rows, words=5, num=80, den=100, row_col=ROW).where("kept"), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, so that the domains' token totals meet the target weights."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = f"{OWN}copies"
    rated = mixing.mix_by_labels(docs.select("doc_id", "text", F.struct(*(f"`{c}`" for c in docs.columns)).alias(f"{OWN}doc")), labels).where("copies > 0")
    return rated.withColumn(own, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(f"{OWN}doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    pieces = packing.pack(docs, _tokenizer("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", pack)]

#: SQL can't express the stages; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after another over documents, each result but the last written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
