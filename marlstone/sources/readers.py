"""Scans. All go through Spark's readers, so any file system that Spark reaches will do."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import md5_shard
from ..functions.text import clean, english_transcript, spaced_transcript, strip


def csv_rows(spark: SparkSession, path: str, sep: str = ",", breaks: bool = True) -> DataFrame:
    """All columns as text. With ``breaks`` quoted fields may hold line breaks, and a file is one task; without, files are split."""
    return spark.read.csv(path, header=True, sep=sep, multiLine=breaks, escape='"', charToEscapeQuoteEscaping='"')


def csv_scores(spark: SparkSession, path: str, column: str = "score") -> DataFrame:
    """(sample_id, score, raw_path) of a CSV whose rows are known by the stem of their audio's path."""
    rows = csv_rows(spark, path, breaks=False)
    return rows.select(path_stem(F.col("audio_path")).alias("sample_id"), F.col(column).alias("score"), F.col("audio_path").alias("raw_path"))


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row: a JSON document of several lines."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def finished_rows(rows: DataFrame, keys: list[str], ord: str) -> DataFrame:
    """Rows of an earlier run, the first of each key: what a resumed run starts from. The key is the first column of ``keys`` that isn't blank."""
    key = F.coalesce(*[clean(F.col(k)) for k in keys], F.to_json(F.struct(*keys)))
    return rows.withColumn("__key", key).groupBy("__key").agg(F.min_by(F.struct(*rows.columns), ord).alias("r")).select("r.*")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a missing path is an empty table, blank lines are skipped."""
    try:
        return spark.read.schema(schema).json(path).dropna("all")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def scores(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, score, label, raw_path); a missing file is empty."""
    schema = "sample_id string, score string, label string, raw_path string"
    try:
        return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")


def raw_scores(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``path ... score``: the first token's stem and the last token; lines of fewer than two tokens go."""
    tokens = F.filter(F.split(strip(F.col("value")), r"\s+"), lambda t: t != "")
    lines = spark.read.text(path).select(tokens.alias("t")).filter("size(t) >= 2")
    return lines.select(path_stem(F.col("t")[0]).alias("sample_id"), F.element_at("t", -1).alias("score"), F.col("t")[0].alias("raw_path"))


def protocol(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, label) of lines ``speaker sample_id - source label``; 1 is bonafide."""
    lines = spark.read.text(path).select(F.split(strip(F.col("value")), r"\s+").alias("t")).filter("size(t) >= 5")
    return lines.select(F.col("t")[1].alias("sample_id"), (F.col("t")[4] == "bonafide").cast("int").alias("label"))


def speakers(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated speaker lines of exactly four fields; comments and blank lines go."""
    lines = spark.read.text(path).filter("trim(value) <> '' and not startswith(value, '#')").select(F.split("value", "\t").alias("t")).filter("size(t) = 4")
    return lines.select(*[strip(F.col("t")[k]).alias(c) for k, c in enumerate(("speaker_id", "age", "gender", "accent"))])


def spaced_corpus(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``id<TAB>text`` files by split; the speaker is the first seven characters of the id; unusable transcripts go."""
    out = None
    for split, path in paths.items():
        t = F.split("value", "\t", 2)
        one = spark.read.text(path).filter(F.size(t) == 2).select(t[0].alias("utterance_id"), F.substring(t[0], 1, 7).alias("speaker_id"), t[1].alias("raw_transcript"), F.lit(split).alias("source_split"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("transcript", spaced_transcript(F.col("raw_transcript"))).filter("transcript is not null")


def sentence_corpus(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """A TSV of client_id, path, sentence, ...; unusable transcripts go, and rows whose file isn't in ``files`` (path)."""
    rows = csv_rows(spark, path, sep="\t").withColumn("transcript", english_transcript(F.col("sentence"))).filter("transcript is not null").withColumnRenamed("client_id", "speaker_id")
    return rows if files is None else rows.join(files.select("path"), "path", "left_semi")


def file_listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files under ``path``; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")


def in_shard(shards: int, shard: int) -> Column:
    """Whether a row's parent (its own id without one) belongs to a shard, so that parents never straddle shards."""
    return md5_shard(F.coalesce(clean(F.col("parent_id").cast("string")), clean(F.col("sample_id").cast("string")), F.lit("")), shards) == shard


def select_rows(rows: DataFrame, *, splits: list[str] | None = None, languages: list[str] | None = None, shards: int = 1, shard: int = 0, limit: int = 0, ord: str = "ord") -> DataFrame:
    """Split, language and shard filters, then the first ``limit`` rows by ``ord``."""
    if splits:
        rows = rows.filter(F.col("split").isin(splits))
    if languages:
        rows = rows.filter(F.col("language").isin(languages))
    if shards > 1:
        rows = rows.filter(in_shard(shards, shard))
    return rows.orderBy(ord).limit(limit) if limit else rows


def required(rows: DataFrame, message: str) -> DataFrame:
    """``rows``, or an error if there are none."""
    if rows.isEmpty():
        raise ValueError(message)
    return rows
