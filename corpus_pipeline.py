"""The corpus pipeline: documents in, packed sequences out.

Five stages, each on all rows that the one before kept. All but the last return
the columns of their input, so extra columns pass through. Nulls in any column,
empty and very long texts, ties, repeated rows and empty tables are handled as
the operators' modules say; in short:

1. language: rows whose language can't be told go (null or empty text among them).
2. dedup: of each group of near duplicates (similarity 0.8 or more) the row with
   the smallest doc_id stays (null ids last, one row of those that repeat); rows without words stay.
3. pii: personal data and the words that disclose it are replaced in the text; all rows stay.
4. mixing: the rows are written in the mixed order of their sources (null is a source); all rows stay.
5. packing: pieces of sequences; the files that mixing wrote are packed one after
   another, so the sequences follow the mixture, and along the curve within each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import langid, minhash, mixing, packing, sanitise
from marlstone.llm.common import held_out, scanned, store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, F.col("doc_id").isNotNull() & ~held_out())


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # mixing's order is that of its files, in their names' order; a frame that isn't a scan is written first, in its own order
    files = scanned(docs, "packing")
    return packing.pack(files.select("doc_id", "text", F.col("_metadata.file_path").alias("__file")), window="__file")


STAGES = [("language", language), ("dedup", dedup), ("pii", pii), ("mixing", mix), ("packing", pack)]

#: Naive Bayes, statistics of words and tokenizers have no SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
