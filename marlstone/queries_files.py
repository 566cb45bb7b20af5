"""Queries that write files in the engine's formats, in the shared folder, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import DELIVERIES, deliveries, table
from .operators import states
from .queries_runs import SPEECH, speech
from .registry import query
from .sources import readers, writers
from .storage import shared_path

#: The protocol's columns of a pack, numbered within each split; SQL as for a single list.
PACK_SQL = f"""{DELIVERIES}, pack AS (SELECT * FROM deliveries WHERE chain_family = 'hybrid'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ord) - 1 AS i, sum(1 - y) OVER (PARTITION BY split ORDER BY ord) - 1 AS k FROM pack),
plines AS (SELECT split, ord, CASE WHEN speaker_id % 4 = 0 THEN printf('spk_%06d', i) ELSE CAST(speaker_id AS VARCHAR) END || ' ' || sample_id || ' - ' || CASE WHEN y = 0 THEN printf('A%02d', CAST(k % 13 + 7 AS INTEGER)) ELSE '-' END || ' ' || CASE WHEN y = 1 THEN 'bonafide' ELSE 'spoof' END AS line FROM numbered)"""


def _pack(spark, d):
    rows = deliveries(spark, d).filter("chain_family = 'hybrid'")
    return rows.select("split", "ord", F.when(F.col("speaker_id") % 4 != 0, F.col("speaker_id").cast("string")).alias("speaker_id"), "sample_id", "label")


def _written(spark, rows, name: str, write) -> str:
    path = shared_path(spark, name)
    write(rows, path)
    return path


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, '' AS missing FROM documents")
def src01_csv(spark, d):
    """Quotes, line breaks and blanks survive; a column that isn't there is blank."""
    path = _written(spark, table(spark, d, "documents").select("doc_id", "text", "lang"), "csv", lambda rows, p: writers.write_csv(rows, p, ["doc_id", "text", "lang", "missing"]))
    return readers.csv_rows(spark, path).fillna("")


@query("SELECT conv_id, turn, role, text FROM conversations")
def src02_json_lines(spark, d):
    path = _written(spark, table(spark, d, "conversations"), "jsonl", writers.write_json_lines)
    return readers.json_rows(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, turn, text FROM conversations WHERE turn = 0")
def snk04_result_log(spark, d):
    """A log of results: what is appended again is there again."""
    rows, path = table(spark, d, "conversations").select("conv_id", "turn", "text"), shared_path(spark, "log")
    for part in (rows, rows.filter("turn = 0")):
        writers.write_json_lines(part, path, "append")
    return readers.json_rows(spark, path, "conv_id long, turn long, text string")


@query("SELECT count(*) AS rows, round(sum(o_totalprice), 2) AS total, min(o_orderpriority) AS first FROM orders")
def src03_document(spark, d):
    row = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderpriority").alias("first"))
    return readers.json_document(spark, _written(spark, row, "document", writers.write_document), "rows long, total double, first string")


@query(f"WITH {DELIVERIES} SELECT sample_id, CAST(score AS VARCHAR) AS score, label, '' AS raw_path FROM deliveries")
def src10_scores(spark, d):
    path = _written(spark, deliveries(spark, d).select("sample_id", F.format_string("%.2f", "score").alias("score"), "label"), "scores", writers.write_score_table)
    return readers.scores(spark, path).fillna("").select("sample_id", F.col("score").cast("double").cast("string").alias("score"), "label", "raw_path")


@query("SELECT sample_id, score, raw_path FROM (SELECT 'f' || event_id AS sample_id, CAST(event_id AS VARCHAR) AS score, 'a.b/f' || event_id || '.wav' AS raw_path, event_id FROM events) WHERE event_id % 7 > 0")
def src11_raw_scores(spark, d):
    """Lines of one token go; the stem of the first is the id."""
    n = F.col("event_id").cast("string")
    rows = table(spark, d, "events").select(F.when(F.col("event_id") % 7 > 0, F.concat(F.lit(" a.b/f"), n, F.lit(".wav  x "), n)).otherwise(n).alias("value"))
    return readers.raw_scores(spark, _written(spark, rows, "raw", lambda r, p: r.write.text(p)))


@query("SELECT 'f' || event_id AS sample_id, CAST(event_id AS VARCHAR) AS score, 'a.b/f' || event_id || '.wav' AS raw_path FROM events")
def src12_csv_scores(spark, d):
    n = F.col("event_id").cast("string")
    rows = table(spark, d, "events").select(F.concat(F.lit("a.b/f"), n, F.lit(".wav")).alias("audio_path"), n.alias("score"))
    return readers.csv_scores(spark, _written(spark, rows, "csv_scores", writers.write_csv))


@query(f"WITH {PACK_SQL} SELECT sample_id, y AS label FROM pack")
def src13_protocol(spark, d):
    rows = _pack(spark, d)
    return readers.protocol(spark, _written(spark, rows, "protocol", writers.write_protocol))


@query(f"""WITH {SPEECH} SELECT 'S' || ord AS utterance_id, substr('S' || ord, 1, 7) AS speaker_id, split AS source_split, '一二三四' AS transcript FROM speech WHERE ord % 3 = 0 AND split <> 'test'""")
def src06_spaced_corpus(spark, d):
    rows = speech(spark, d)
    said = F.when(F.col("ord") % 3 == 0, "一 x 二 y 三 z 四 w").when(F.col("ord") % 3 == 1, "一 x").otherwise("12 x 3")
    paths = {s: _written(spark, rows.filter(F.col("split") == s).select(F.concat(F.lit("S"), F.col("ord").cast("string"), F.lit("\t"), said).alias("value")), s, lambda r, p: r.write.text(p)) for s in ("train", "dev")}
    return readers.spaced_corpus(spark, paths).select("utterance_id", "speaker_id", "source_split", "transcript")


@query("SELECT 'S' || c_custkey AS speaker_id, '30' AS age, c_mktsegment AS gender, 'north' AS accent FROM customer WHERE c_custkey % 4 > 1")
def src07_speakers(spark, d):
    key = F.col("c_custkey").cast("string")
    line = F.concat_ws("\t", F.concat(F.lit("S"), key), F.lit("30"), F.col("c_mktsegment"), F.lit(" north "))
    odd = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("#"), line)).when(F.col("c_custkey") % 4 == 1, F.concat(key, F.lit("\tx"))).otherwise(line)
    return readers.speakers(spark, _written(spark, table(spark, d, "customer").select(odd.alias("value")), "speakers", lambda r, p: r.write.text(p)))


@query(f"WITH {SPEECH} SELECT speaker_id, 'clip' || ord || '.mp3' AS path, 'it is number ' || ord AS transcript FROM speech WHERE ord % 3 = 0 AND ord % 2 = 0")
def src05_sentence_corpus(spark, d):
    """Sentences too short go, and rows whose file isn't listed."""
    rows = speech(spark, d).select(F.col("speaker_id").alias("client_id"), F.concat(F.lit("clip"), F.col("ord").cast("string"), F.lit(".mp3")).alias("path"), "ord")
    said = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("it is, number: "), F.col("ord").cast("string"))).otherwise("too short")
    path = _written(spark, rows.select("client_id", "path", said.alias("sentence")), "tsv", lambda r, p: r.write.csv(p, header=True, sep="\t"))
    files = rows.filter("ord % 2 = 0").select("path")
    return readers.sentence_corpus(spark, path, files).select("speaker_id", "path", "transcript")


@query("SELECT 5 AS files, true AS sized")
def jn14_file_listing(spark, d):
    """Files are found without reading them: a partitioned sink's, by their folder."""
    path = _written(spark, table(spark, d, "events").select("event_id", "event_type"), "listed", lambda r, p: writers.write_partitioned(r, p, ["event_type"]))
    files = readers.file_listing(spark, path, "*.parquet").select(F.regexp_extract("path", "event_type=([^/]*)/", 1).alias("type"), "length")
    return files.agg(F.count_distinct("type").cast("int").alias("files"), (F.min("length") > 0).alias("sized"))


@query("SELECT event_type, event_id, user_id FROM events")
def snk05_partitioned(spark, d):
    path = _written(spark, table(spark, d, "events").select("event_type", "event_id", "user_id"), "by_type", lambda r, p: writers.write_partitioned(r, p, ["event_type"]))
    return spark.read.parquet(path).select(F.col("event_type").cast("string").alias("event_type"), "event_id", "user_id")


@query(f"WITH {DELIVERIES} SELECT 'family' AS way, chain_family AS folder, count(*) AS n FROM deliveries GROUP BY 2 UNION ALL SELECT 'split', split, count(*) FROM deliveries GROUP BY 2")
def snk06_two_ways(spark, d):
    rows, out = deliveries(spark, d).select("sample_id", "chain_family", "split"), None
    for way, column in (("family", "chain_family"), ("split", "split")):
        path = _written(spark, rows, way, lambda r, p, column=column: writers.write_partitioned(r, p, [column]))
        one = spark.read.parquet(path).groupBy(F.lit(way).alias("way"), F.col(column).cast("string").alias("folder")).agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {DELIVERIES} SELECT split, sample_id || '.wav' AS file_name FROM deliveries")
def snk07_split_folders(spark, d):
    rows = deliveries(spark, d).select("split", F.concat(F.col("split"), F.lit("/"), F.col("sample_id"), F.lit(".wav")).alias("file_name"))
    path = _written(spark, writers.split_relative(rows), "splits", lambda r, p: writers.write_partitioned(r, p, ["split"], "json"))
    return spark.read.schema("file_name string, split string").json(path).select("split", "file_name")


@query(f"""WITH {SPEECH} SELECT 'label_language_split' AS name, status || '/' || language || '/' || split AS key, CAST(count(*) AS VARCHAR) AS samples FROM speech GROUP BY 2
UNION ALL SELECT 'chain_family_label', priority || '/' || status, CAST(count(*) AS VARCHAR) FROM speech GROUP BY 2 UNION ALL SELECT 'generator_family_label', segment || '/' || status, CAST(count(*) AS VARCHAR) FROM speech GROUP BY 2""")
def snk08_count_tables(spark, d):
    rows = speech(spark, d).select(F.col("status").alias("label"), "language", "split", F.col("priority").alias("chain_family"), F.col("segment").alias("generator_family"))
    paths, out = writers.write_count_tables(rows, shared_path(spark, "counts")), None
    for name, path in paths.items():
        one = readers.csv_rows(spark, path).select(F.lit(name).alias("name"), F.concat_ws("/", *writers.COUNT_TABLES[name]).alias("key"), "samples")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {DELIVERIES} SELECT sample_id, split || '/audio/en/' || label || '/' || sample_id || '.flac' AS file_name FROM deliveries")
def snk09_exported_paths(spark, d):
    rows = deliveries(spark, d).select("sample_id", "split", F.lit("en").alias("language"), "label", F.concat(F.lit("x/y.z/"), F.col("sample_id"), F.lit(".flac")).alias("audio_path"))
    return writers.exported_path(rows).select("sample_id", "file_name")


@query(f"WITH {PACK_SQL} SELECT split, ord, line FROM plines UNION ALL SELECT 'asv', -1, unnest(['utt_tar_1 target 0.95', 'utt_tar_2 target 0.82', 'utt_non_1 nontarget -0.45', 'utt_non_2 nontarget -0.22', 'utt_spoof_1 spoof -0.71', 'utt_spoof_2 spoof -0.54'])")
def snk10_detector_view(spark, d):
    """Written twice: the second time the view is found unchanged and read."""
    path, pack = shared_path(spark, "view"), _pack(spark, d)
    writers.write_view(pack, path)
    lines = writers.write_view(pack, path)
    scores = spark.read.text(f"{path}/asv_scores").select(F.lit("asv").alias("split"), F.lit(-1).cast("long").alias("ord"), F.col("value").alias("line"))
    return lines.select("split", F.col("ord").cast("long").alias("ord"), "line").unionByName(scores)


@query(f"WITH {PACK_SQL} SELECT split, -1 AS ord, '/view' AS line FROM (SELECT DISTINCT split FROM pack) UNION ALL SELECT split, ord, 'ASVspoof2019_LA_' || CASE split WHEN 'test' THEN 'eval' ELSE split END || '/flac/' || sample_id || '.flac' FROM pack")
def snk11_file_lists(spark, d):
    return writers.list_lines(_pack(spark, d), "/view").select("split", F.col("ord").cast("long").alias("ord"), "line")


@query(f"WITH {DELIVERIES} SELECT sample_id, CAST(score AS VARCHAR) AS score, label, '' AS raw_path FROM deliveries")
def snk13_score_table(spark, d):
    rows = deliveries(spark, d).select("sample_id", F.format_string("%.2f", "score").alias("score"), "label", F.lit("never").alias("extra"))
    back = readers.csv_rows(spark, _written(spark, rows, "table", writers.write_score_table)).fillna("")
    return back.select("sample_id", F.col("score").cast("double").cast("string").alias("score"), "label", "raw_path")


@query(f"WITH {DELIVERIES} SELECT 't' AS task_id, chain_family AS variant, 'm' AS baseline, count(*) AS n FROM deliveries GROUP BY 2")
def snk14_metrics_files(spark, d):
    rows = deliveries(spark, d).groupBy(F.lit("t").alias("task_id"), F.col("chain_family").alias("variant"), F.lit("m").alias("baseline")).agg(F.count(F.lit(1)).alias("n"))
    path = _written(spark, rows, "metrics", writers.write_metrics)
    return spark.read.schema("n long, task_id string, variant string, baseline string").json(path).select("task_id", "variant", "baseline", "n")


@query("SELECT event_id, user_id FROM events")
def snk15_row_cache(spark, d):
    """Batches that overlap, and a run that goes on where another stopped; each row once."""
    rows = table(spark, d, "events").select("event_id", "user_id")
    path = shared_path(spark, "cache")
    first = states.RowCache(spark, path, "event_id long, user_id long", table="events")
    first.add(rows.filter("event_id % 3 = 0"))
    first.add(rows.filter("event_id % 6 = 0"))
    second = states.RowCache(spark, path, "event_id long, user_id long", table="events")
    second.add(second.missing(rows, "event_id", "user_id"))
    return second.rows(["event_id"], "user_id")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def src16_finished_rows(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), "o_custkey", "o_orderkey")
    return readers.finished_rows(rows, ["key"], "o_orderkey").select("o_custkey", "o_orderkey")


@query(f"WITH {DELIVERIES} SELECT sample_id, '/db/ASVspoof2019_LA_' || CASE split WHEN 'test' THEN 'eval' ELSE split END || '/flac/' || sample_id || '.flac' AS linked_audio_path FROM deliveries")
def snk19_linked_paths(spark, d):
    return writers.linked(deliveries(spark, d), "/db").select("sample_id", "linked_audio_path")


@query(f"WITH {DELIVERIES} SELECT sample_id, score FROM deliveries")
def snk20_raw_scores(spark, d):
    back = readers.raw_scores(spark, _written(spark, deliveries(spark, d).select("sample_id", "score"), "raw", writers.write_scores))
    return back.select("sample_id", F.col("score").cast("double").alias("score"))


@query("SELECT unnest([0, 1, 2, 3, 4, 5]) AS ord, unnest(['utt_tar_1 target 0.95', 'utt_tar_2 target 0.82', 'utt_non_1 nontarget -0.45', 'utt_non_2 nontarget -0.22', 'utt_spoof_1 spoof -0.71', 'utt_spoof_2 spoof -0.54']) AS value")
def snk21_placeholder_scores(spark, d):
    return writers.placeholder_scores(spark)
