"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, read_table
from tidemark.llm.decontamination import keep_clean
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import TURN, pack
from tidemark.llm.quality_rules import fit_field, keep_good

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field keeps; it is fitted on the labelled documents of the tables given."""
    field = fit_field(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return keep_good(docs.select(*COLUMNS), field)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many share; n_chars follows the text."""
    kept = dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return keep_clean(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens, small sources more often than they are."""
    return pack(docs, temper=0.7, turn=TURN, payload=F.crc32, payload_name="ids_crc32")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The line field and the edit distances are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's rows written before the next reads them."""
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop_but(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
