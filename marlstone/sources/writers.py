"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import protocol_label, strip
from ..storage import written


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None, mode: str = "error") -> None:
    """Chosen columns, nulls blank, white space and control characters at the ends of a value kept; an empty table is an error."""
    if rows.isEmpty():
        raise ValueError(f"no rows for {path}")
    chosen = columns or rows.columns
    rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in chosen]).write.mode(mode).csv(path, header=True, escape='"', charToEscapeQuoteEscaping='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_partitioned(rows: DataFrame, path: str, by: list[str], fmt: str = "parquet", mode: str = "error") -> None:
    """A folder for each value of ``by``, e.g. each language or family; rows are dealt by value, hot values over several tasks."""
    rows.repartition(*by, F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.mode(mode).partitionBy(*by).format(fmt).save(path)


def split_relative(rows: DataFrame) -> DataFrame:
    """``rows`` with file_name relative to its split's folder; a name outside it is an error."""
    inside = F.col("file_name").startswith(F.concat(F.col("split"), F.lit("/")))
    cut = F.expr("substring(file_name, length(split) + 2)")
    return rows.withColumn("file_name", F.when(inside, cut).otherwise(F.raise_error(F.concat(F.lit("not in its split: "), F.col("file_name")))))


def attack_label(rows: DataFrame, ord: str = "ord") -> DataFrame:
    """Protocol columns in order: spoof rows take A07 to A19 in turn, rows without speaker a number of their own.

    Running numbers over one ordered list, as a protocol file is one: the rows
    are range-sorted and written, and a number is a row's place in its range plus
    the sizes of the ranges before, so that no task sees all rows.
    """
    sorted_ = rows.repartitionByRange(ord).sortWithinPartitions(ord).withColumn("__place", F.monotonically_increasing_id())
    placed = written(sorted_, "protocol").withColumn("__part", F.shiftrightunsigned("__place", 33))
    spoof = (protocol_label(F.col("label")) == "spoof").cast("long")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.sum(spoof).alias("spoofs"))
    bases = sizes.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in ("n", "spoofs")])  # a row per range
    rows = placed.join(F.broadcast(bases), "__part")
    inside = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.col("__spoofs") + F.sum(spoof).over(inside) - 1
    index = F.col("__n") + F.col("__place").bitwiseAND((1 << 33) - 1)
    speaker = F.coalesce(F.nullif(strip(F.col("speaker_id").cast("string")), F.lit("")), F.format_string("spk_%06d", index))
    attack = F.when(spoof == 1, F.format_string("A%02d", F.pmod(turn, F.lit(13)) + 7)).otherwise("-")
    return rows.select(F.col(ord), speaker.alias("speaker"), "sample_id", attack.alias("attack"), protocol_label(F.col("label")).alias("label"))


def write_protocol(rows: DataFrame, path: str, ord: str = "ord") -> None:
    made = attack_label(rows, ord)
    made.orderBy(ord).select(F.concat_ws(" ", "speaker", "sample_id", F.lit("-"), "attack", "label").alias("value")).write.text(path)


def write_scores(rows: DataFrame, path: str) -> None:
    """``id score`` lines."""
    rows.select(F.concat_ws(" ", "sample_id", F.col("score").cast("string")).alias("value")).write.text(path)


def write_json_lines(rows: DataFrame, path: str, mode: str = "error") -> None:
    """A JSON object a line, nulls as nulls, text as it is; ``append`` makes it a log of results."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_document(rows: DataFrame, path: str) -> None:
    """One row as an indented JSON document in ``path``: a summary, so it passes the driver. Any file system that Spark reaches will do."""
    first = rows.select(F.to_json(F.struct(*rows.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).limit(1)
    first.coalesce(1).write.mode("overwrite").text(path)


#: The tables of counts that go with a release.
COUNT_TABLES = {"label_language_split": ["label", "language", "split"], "chain_family_label": ["chain_family", "label"], "generator_family_label": ["generator_family", "label"]}


def write_count_tables(rows: DataFrame, path: str) -> dict[str, str]:
    """Counts by each of ``COUNT_TABLES`` as sorted CSV; returns their paths."""
    out = {}
    for name, keys in COUNT_TABLES.items():
        out[name] = f"{path}/stats_{name}"
        rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("string").alias("samples")).orderBy(*keys).write.mode("overwrite").csv(out[name], header=True)
    return out


def write_metrics(per_run: DataFrame, path: str) -> None:
    """JSON metrics in a folder for each (task, variant, baseline)."""
    per_run.repartition("task_id", "variant", "baseline").write.mode("overwrite").partitionBy("task_id", "variant", "baseline").json(path)


def write_score_table(rows: DataFrame, path: str) -> None:
    """The four columns of scores as CSV."""
    write_csv(rows, path, ["sample_id", "score", "label", "raw_path"], "overwrite")


#: Lines that a detector wants to find, whatever is evaluated.
PLACEHOLDER_SCORES = ["utt_tar_1 target 0.95", "utt_tar_2 target 0.82", "utt_non_1 nontarget -0.45", "utt_non_2 nontarget -0.22", "utt_spoof_1 spoof -0.71", "utt_spoof_2 spoof -0.54"]


def placeholder_scores(spark) -> DataFrame:
    return spark.createDataFrame([(k, x) for k, x in enumerate(PLACEHOLDER_SCORES)], "ord int, value string")


def exported_path(rows: DataFrame) -> DataFrame:
    """``rows`` with file_name, where a release keeps their audio: split/audio/language/label/id and the suffix of audio_path."""
    suffix = F.regexp_extract("audio_path", r"[^/](\.[^./]*)$", 1)
    return rows.withColumn("file_name", F.concat(F.concat_ws("/", "split", F.lit("audio"), "language", "label", "sample_id"), suffix))


def linked(rows: DataFrame, database: str, track: str = "LA", suffix: str = "flac") -> DataFrame:
    """``rows`` with linked_audio_path, their place in a detector's folders by split."""
    split = F.when(F.col("split") == "test", "eval").otherwise(F.col("split"))
    return rows.withColumn("linked_audio_path", F.concat(F.lit(f"{database}/ASVspoof2019_{track}_"), split, F.lit(f"/{suffix}/"), F.col("sample_id"), F.lit(f".{suffix}")))


def write_view(pack: DataFrame, path: str, track: str = "LA") -> DataFrame:
    """A detector's view of one pack (split, ord, speaker_id, sample_id, label): a protocol for each split and the placeholder scores, rewritten if the pack has changed.

    Returns its rows (split, ord, line). The view's manifest holds the digest of
    the pack's rows; where that is the same nothing is written.
    """
    spark, used, splits = pack.sparkSession, ["split", "ord", "speaker_id", "sample_id", "label"], ("train", "dev", "test")
    pack = written(pack.select(used).filter(F.col("split").isin(*splits)), "pack")
    # independent of the order of summing; of the rows themselves, so that an unchanged pack is neither sorted nor numbered
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    digest = pack.select(F.sha1(F.to_json(F.struct(*used))).alias("h")).agg(*[part(k).alias(f"d{k}") for k in range(4)])
    now = f"{track} " + "-".join(digest.first())
    kept = f"split string, ord {dict(pack.dtypes)['ord']}, line string"
    if read_text(spark, f"{path}/manifest") == [now]:
        return spark.read.schema(kept).parquet(f"{path}/lines")
    parts = []
    for split in splits:
        made = attack_label(pack.filter(F.col("split") == split))
        parts.append(made.select(F.lit(split).alias("split"), "ord", F.concat_ws(" ", "speaker", "sample_id", F.lit("-"), "attack", "label").alias("line")))
    lines = parts[0].unionByName(parts[1]).unionByName(parts[2])
    lines.write.mode("overwrite").parquet(f"{path}/lines")
    for split in ("train", "dev", "test"):
        own = spark.read.parquet(f"{path}/lines").filter(F.col("split") == split)
        own.orderBy("ord").select("line").write.mode("overwrite").text(f"{path}/protocols/{split}")
    placeholder_scores(spark).orderBy("ord").select("value").write.mode("overwrite").text(f"{path}/asv_scores")
    spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return spark.read.schema(kept).parquet(f"{path}/lines")


def list_lines(pack: DataFrame, root: str, track: str = "LA") -> DataFrame:
    """(split, ord, line) of the lists that another detector reads: first the root, then each row's file below it."""
    of = F.when(F.col("split") == "test", "eval").otherwise(F.col("split"))
    files = pack.select("split", "ord", F.concat(F.lit(f"ASVspoof2019_{track}_"), of, F.lit("/flac/"), F.col("sample_id"), F.lit(".flac")).alias("line"))
    heads = pack.select("split").distinct().select("split", F.lit(-1).cast(dict(pack.dtypes)["ord"]).alias("ord"), F.lit(root).alias("line"))
    return heads.unionByName(files)


def read_text(spark, path: str) -> list[str]:
    """The lines of a small text file, [] where there is none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return []
    return [r["value"] for r in spark.read.text(path).collect()]
