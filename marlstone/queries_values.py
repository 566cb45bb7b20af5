"""Queries of the functions on strings, numbers, arrays and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import DELIVERIES, deliveries, table
from .functions import arrays, buckets, chains, text
from .operators import preservation, signals, validation
from .registry import query
from .sources import audio

#: Characters that count as white space, as SQL text; the fixed values are in functions/text.py.
BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8195) || chr(12288)"


@query(f"""WITH v AS (SELECT c_custkey, [chr(9) || 'spoof', chr(160) || 'Bona_Fide ', ' ' || chr(12288), '1', 'x', NULL][c_custkey % 6 + 1] AS raw FROM customer), t AS (SELECT *, trim(raw, {BLANKS}) AS s FROM v)
SELECT c_custkey, nullif(s, '') AS clean, CASE WHEN lower(s) IN ('bonafide', 'bona_fide', '1') THEN 'bonafide' WHEN lower(s) IN ('spoof', '0') THEN 'spoof' ELSE '' END AS label FROM t""")
def str12_unicode_white_space(spark, d):
    raw = F.get(F.array(F.lit("\tspoof"), F.lit(" Bona_Fide "), F.lit(" 　"), F.lit("1"), F.lit("x"), F.lit(None).cast("string")), (F.col("c_custkey") % 6).cast("int"))
    return table(spark, d, "customer").select("c_custkey", text.clean(raw).alias("clean"), text.binary_label(raw).alias("label"))


@query("""WITH v AS (SELECT event_id, ['1d', '2F', '-3.5e1', ' 7 ', 'nan?', '', NULL, '.5'][event_id % 8 + 1] AS raw FROM events)
SELECT event_id, CASE WHEN regexp_full_match(trim(raw), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?') THEN CAST(trim(raw) AS DOUBLE) END AS number, CASE WHEN regexp_full_match(trim(raw), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?') THEN CAST(trim(raw) AS DOUBLE) ELSE 0 END AS score FROM v""")
def prj14_score_text(spark, d):
    """Score text such as 1d isn't a number and counts as 0."""
    raw = F.get(F.array(*[F.lit(x).cast("string") for x in ("1d", "2F", "-3.5e1", " 7 ", "nan?", "", None, ".5")]), (F.col("event_id") % 8).cast("int"))
    return table(spark, d, "events").select("event_id", buckets.number(raw).alias("number"), F.coalesce(buckets.number(raw), F.lit(0.0)).alias("score"))


@query("""WITH s AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[ \\n]+', ' ', 'g')), ' ') AS t FROM documents WHERE text IS NOT NULL), j AS (SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(t) + 1), lambda i: i % 2 = 1), lambda i: t[i]), '') AS j FROM s)
SELECT doc_id, CASE WHEN len(regexp_extract_all(j, '[\\x{4E00}-\\x{9FFF}]')) >= 4 AND NOT regexp_full_match(j, '[0-9]+') THEN j END AS transcript FROM j""")
def str02_spaced_transcript(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.spaced_transcript(F.regexp_replace("text", "[ \n]+", " ")).alias("transcript"))


@query("""SELECT conv_id, turn, list_filter(string_split(t, ' '), lambda x: x <> '') AS words, string_split(replace(t, ' ', ''), '') AS chars
FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^a-z ]', '', 'g') AS t FROM conversations) WHERE replace(t, ' ', '') <> ''""")
def str05_tokens(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z ]", "").alias("t"))
    return rows.filter("replace(t, ' ', '') <> ''").select("conv_id", "turn", text.word_tokens(F.col("t"), F.lit("en")).alias("words"), text.char_tokens(F.col("t")).alias("chars"))


@query("""SELECT event_id, ['ready', 'job ' || event_id, 'x: 1'][event_id % 3 + 1] AS line FROM events""")
def str16_log_line(spark, d):
    heads = F.get(F.array(F.lit("[2024-05-01 10:00:00,123] "), F.lit("INFO: "), F.lit("2024-05-01T10:00:00 [WARNING] ")), (F.col("event_id") % 3).cast("int"))
    tails = F.get(F.array(F.lit("ready"), F.concat(F.lit("job "), F.col("event_id").cast("string")), F.lit("x: 1")), (F.col("event_id") % 3).cast("int"))
    return table(spark, d, "events").select("event_id", text.log_line(F.concat(heads, tails)).alias("line"))


@query("SELECT doc_id, CASE lower(trim(lang)) WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'zh' THEN 'Chinese' ELSE 'Auto' END AS language FROM documents")
def str19_language_name(spark, d):
    return table(spark, d, "documents").select("doc_id", text.language_name(F.col("lang"), {"en": "English", "de": "German", "zh": "Chinese"}, "Auto").alias("language"))


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'e' || event_id WHEN event_id % 2 > 0 THEN event_type ELSE '["",""]' END AS key FROM events""")
def str20_row_key(spark, d):
    sample, other = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).otherwise(" "), F.when(F.col("event_id") % 2 > 0, F.col("event_type"))
    return table(spark, d, "events").select("event_id", F.regexp_replace(text.row_key(sample, other), r'^\[" ",', '["",').alias("key"))


@query("""WITH v AS (SELECT event_id, ['["a","b"]', '[]', '{}', 'x', NULL][event_id % 5 + 1] AS names, ['[{"op":"a"},1,{"op":"b"}]', '{}', '[]', 'x', NULL][event_id % 5 + 1] AS ops FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a,b' ELSE '' END AS names, CASE event_id % 5 WHEN 0 THEN 'a,b' ELSE '' END AS ops FROM v""")
def arr01_json_lists(spark, d):
    pick = lambda *xs: F.get(F.array(*[F.lit(x).cast("string") for x in xs]), (F.col("event_id") % 5).cast("int"))
    names, ops = pick('["a","b"]', "[]", "{}", "x", None), pick('[{"op":"a"},1,{"op":"b"}]', "{}", "[]", "x", None)
    return table(spark, d, "events").select("event_id", F.array_join(chains.parse_names(names), ",").alias("names"), F.array_join(F.filter(chains.names_of(chains.parse_operators(ops)), lambda x: x.isNotNull()), ",").alias("ops"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 'rir[distance=' || CASE WHEN l_quantity / 10 < 1 THEN 'near' WHEN l_quantity / 10 < CAST(2.5 AS DOUBLE) THEN 'mid' ELSE 'far' END || ',room=' || l_returnflag || ',rt60=' || CASE WHEN l_tax * 10 < CAST(0.35 AS DOUBLE) THEN 'short' WHEN l_tax * 10 < CAST(0.65 AS DOUBLE) THEN 'medium' ELSE 'long' END || ']' AS room,
  'call_path[agc=mild,codec=gsm,encode_sr=8k,jitter=' || regexp_replace(printf('%.3f', l_tax), '\\.?0+$', '') || ',plr=' || CASE WHEN l_quantity <= 2 THEN 'light' WHEN l_quantity <= 5 THEN 'moderate' ELSE 'severe' END || ',profile=NB]' AS session FROM lineitem""")
def arr07_room_and_session_tokens(spark, d):
    rows = table(spark, d, "lineitem")
    room = F.struct(F.lit("rir").alias("op"), (F.col("l_tax") * 10).alias("rt60"), (F.col("l_quantity") / 10).alias("distance"), F.struct(F.col("l_returnflag").alias("name")).alias("room"))
    session = F.struct(F.lit("call_path").alias("op"), F.lit("NB").alias("profile"), F.lit("gsm").alias("codec"), F.lit("16k").alias("bitrate"), F.lit(8000).alias("encode_sample_rate"), F.col("l_quantity").alias("loss_rate_pct"), F.lit("mild").alias("agc_profile"), F.col("l_tax").alias("jitter_ms"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", chains.token(room, ("rt60", "distance", "room")).alias("room"), chains.token(session, ("profile", "codec", "bitrate", "encode_sample_rate", "loss_rate_pct", "agc_profile", "jitter_ms")).alias("session"))


@query(f"""WITH {DELIVERIES} SELECT sample_id, array_to_string(list_reverse(list_distinct(list_transform(sig, lambda t: split_part(t, '[', 1)))), '') <> '' AS some, len(sig) AS n FROM deliveries""")
def arr12_operator_names(spark, d):
    rows = deliveries(spark, d)
    return rows.select("sample_id", (F.array_join(F.array_distinct(F.transform("sig", chains.operator_name)), "") != "").alias("some"), F.size("sig").cast("long").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'codec,rir' ELSE 'rir,codec' END AS names FROM customer")
def arr11_reorder(spark, d):
    ops = F.array(F.struct(F.lit("rir").alias("op"), F.col("c_custkey").alias("v")), F.struct(F.lit("codec").alias("op"), F.col("c_nationkey").cast("long").alias("v")))
    names = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("codec"), F.lit("rir"))).otherwise(F.array(F.lit("rir"), F.lit("codec")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(chains.names_of(chains.reorder(ops, names)), ",").alias("names"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a' || c_custkey WHEN 1 THEN 'g' || c_nationkey ELSE '' END AS age FROM customer")
def arr13_map_fallback(spark, d):
    k = F.col("c_custkey")
    meta = F.when(k % 3 == 0, F.create_map(F.lit("age"), F.concat(F.lit("a"), k.cast("string")), F.lit("age_group"), F.lit("x"))).when(k % 3 == 1, F.create_map(F.lit("age_group"), F.concat(F.lit("g"), F.col("c_nationkey").cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, d, "customer").select("c_custkey", text.first_of(meta, "age", "age_group").alias("age"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(round(l_extendedprice / 7, 2) AS VARCHAR) END AS shown, CAST(CASE WHEN l_linenumber - 3 <= 0 THEN l_quantity ELSE least(l_quantity, l_linenumber - 3) END AS DOUBLE) AS checks,
  least(1.0, greatest(0.0, l_discount * 20 - 0.5)) AS share, round(l_extendedprice * 100000 / 1073741824, 3) AS gib FROM lineitem""")
def mth09_small_numbers(spark, d):
    """Rounded text, a limit that 0 lifts, a share and bytes as GiB."""
    price, n = F.col("l_extendedprice"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", buckets.rounded_text(F.when(n % 3 != 0, price / 7), 2).alias("shown"), buckets.at_most(F.col("l_quantity"), (n - 3).cast("double")).alias("checks"),
        buckets.share(F.col("l_discount") * 20 - 0.5).alias("share"), buckets.gibibytes(price * 100000).alias("gib"),
    )


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] + e[len(e) + 1 - i] + 1) / 3)), 6) AS total, round(CASE WHEN vec_id % 2 = 0 THEN -120.0 ELSE 10 * log10(greatest(list_dot_product(e, e) / len(e), 1e-12)) END, 6) AS rms FROM v""")
def sig17_channels_and_silence(spark, d):
    """The mean of three channels; silence has -120 dBFS, and samples that aren't finite don't count."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    mean = arrays.channel_mean(F.array(F.col("e"), F.reverse(F.col("e")), F.transform("e", lambda x: F.lit(1.0))))
    rows = table(spark, d, "embeddings").select("vec_id", e.alias("e")).withColumn("heard", F.when(F.col("vec_id") % 2 == 0, F.array(F.lit(0.0), F.lit(float("nan")))).otherwise(F.concat("e", F.array(F.lit(float("inf"))))))
    return rows.select("vec_id", F.round(F.aggregate(mean, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(arrays.loudness(F.col("heard"), 16000)["rms_dbfs"], 6).alias("rms"))


LIMITS = {"min_duration": 5.0, "max_duration": 45.0, "sample_rate": 1, "channels": 2, "codec_name": "O"}
PROBE_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 5 THEN printf('duration too short: %.3fs', l_quantity) WHEN l_quantity > 45 THEN printf('duration too long: %.3fs', l_quantity) WHEN l_linenumber % 4 <> 1 THEN 'unexpected sample rate: ' || l_linenumber % 4
  WHEN l_suppkey % 3 <> 2 THEN 'unexpected channels: ' || l_suppkey % 3 WHEN l_linestatus <> 'O' THEN 'unexpected codec name: ' || l_linestatus WHEN l_tax <= 0 THEN 'empty output file' END AS reason FROM lineitem"""


def _probes(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("duration_sec"), (F.col("l_linenumber") % 4).alias("sample_rate"), (F.col("l_suppkey") % 3).alias("channels"), F.col("l_linestatus").alias("codec_name"), F.col("l_tax").alias("size_bytes"),
    )


@query(PROBE_SQL)
def flt08_delivered_probe(spark, d):
    return _probes(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", validation.output_reason(LIMITS).alias("reason"))


@query(PROBE_SQL)
def flt09_rendered_probe(spark, d):
    return _probes(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", validation.output_reason(LIMITS).alias("reason"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 4 = 1 AND l_suppkey % 3 = 2 AND l_linestatus = 'O' AND l_tax > 0 AS final FROM lineitem")
def flt14_final_format(spark, d):
    return _probes(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", validation.is_final(LIMITS).alias("final"))


@query(f"""WITH {DELIVERIES}, p AS (SELECT a.sample_id AS a, b.sample_id AS b, a.sig AS sa, b.sig AS sb, list_filter(range(1, len(a.sig) + 1), lambda i: a.sig[i] <> b.sig[i]) AS d FROM deliveries a JOIN deliveries b ON a.parent_id = b.parent_id AND a.chain_family = b.chain_family AND a.label = b.label AND len(a.sig) = len(b.sig) AND a.sample_id < b.sample_id)
SELECT a, b, CASE WHEN len(d) = 1 THEN CASE WHEN split_part(sa[d[1]], '[', 1) = split_part(sb[d[1]], '[', 1) THEN 'parameter@' ELSE 'operator@' END || (d[1] - 1) END AS axis FROM p""")
def flt17_one_slot(spark, d):
    keys = ["parent_id", "chain_family", "label", "n"]
    own = deliveries(spark, d).withColumn("n", F.size("sig"))
    a, b = (own.select(*keys, F.col("sample_id").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
    return a.join(b, keys).filter("a < b").select("a", "b", chains.one_slot_axis(F.col("sa"), F.col("sb")).alias("axis"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'dev' ELSE event_type END AS task_split, CASE WHEN event_id % 3 = 1 THEN 'dev' ELSE event_type END AS chosen_split FROM events""")
def prj10_splits(spark, d):
    standard = F.when(F.col("event_id") % 3 == 0, " ").when(F.col("event_id") % 3 == 1, "dev")
    return table(spark, d, "events").select("event_id", text.standard_split(standard, F.col("event_type")).alias("task_split"), text.requested_split(standard, F.col("event_type")).alias("chosen_split"))


@query("""WITH v AS (SELECT a.vec_id AS a, b.vec_id AS b, list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)) AS x, list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)) AS y FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT a, b, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 5) AS similarity FROM v""")
def mth08_cosine_within_labels(spark, d):
    """All pairs of a label: the view vector_pairs."""
    found = preservation.pairs_within(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return found.select("a", "b", F.round("similarity", 5).alias("similarity"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 10 > 0 THEN len(e) / 8000.0 END AS duration, CASE WHEN vec_id % 10 > 0 THEN 44 + 2 * len(e) END AS size, CASE WHEN vec_id % 10 > 0 THEN 8000 END AS sample_rate, CASE WHEN vec_id % 10 > 0 THEN round(list_sum(list_transform(e, lambda x: round_even(greatest(-1, least(x, CAST(32767 AS DOUBLE) / 32768)) * 32768, 0) / 32768)), 4) END AS total FROM v""")
def src08_probe_and_decode(spark, d):
    """Files made from arrays, probed and decoded; what isn't a file has neither."""
    made = F.when(F.col("vec_id") % 10 > 0, audio.encode(F.col("embedding"), 8000)).otherwise(F.lit("no file").cast("binary"))
    rows = table(spark, d, "embeddings").select("vec_id", made.alias("content")).select("vec_id", audio.probe(F.col("content")).alias("p"), audio.decode(F.col("content")).alias("x"))
    total = F.when(F.col("x").isNotNull(), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")), 4))
    return rows.select("vec_id", "p.duration", "p.size", "p.sample_rate", total.alias("total"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, round(10 * log10(greatest(list_dot_product(e, e) / len(e), 1e-12)), 6) AS mean_db, round(20 * log10(greatest(list_max(list_transform(e, lambda x: abs(x))), 1e-6)), 6) AS max_db, len(list_filter(e, lambda x: abs(x) < CAST(power(10, -1) AS DOUBLE))) / 16000.0 AS silence_sec FROM v""")
def sig19_quality(spark, d):
    """Runs of any length count as silence here; tests have longer ones."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    made = signals.quality(rows, "e", floor_db=-20.0, least_sec=0.0)
    return made.select("vec_id", F.round("mean_db", 6).alias("mean_db"), F.round("max_db", 6).alias("max_db"), "silence_sec")
