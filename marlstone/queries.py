"""Queries of the mining, matching, metric, sampling, planning and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures
from .fixtures import DELIVERIES, DOC_SCORES, TRANSCRIPTS, deliveries, doc_scores, table, transcripts
from .functions import arrays, buckets, chains, hashing, text
from .operators import joins, matching, metrics, preservation, projections, robustness, sampling, signals, splits, summaries, tasks, validation
from .plans import planner
from .registry import ORACLES, QUERIES, query  # noqa: F401  the registry is also known from here
from .sources import readers, writers
from .storage import written
from .streaming import summary as streaming

# --- sources, filters, projections ---------------------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN (SELECT min(event_type) FROM events) ORDER BY event_id LIMIT 300")
def src04_filtered_scan(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("language"))
    first = rows.agg(F.min("language")).first()[0]
    return readers.select_rows(rows, languages=[first], limit=300, ord="event_id").withColumnRenamed("language", "event_type")


@query(f"""WITH RECURSIVE {DELIVERIES}, digits AS (SELECT sample_id, parent_id, md5(parent_id) AS h FROM deliveries WHERE split IN ('dev', 'test')),
hex(sample_id, parent_id, h, i, m) AS (SELECT sample_id, parent_id, h, 0, CAST(0 AS BIGINT) FROM digits UNION ALL
  SELECT sample_id, parent_id, h, i + 1, (m * 16 + instr('0123456789abcdef', substr(h, i + 1, 1)) - 1) % 7 FROM hex WHERE i < 32)
SELECT sample_id, parent_id FROM hex WHERE i = 32 AND m = 3""")
def src14_sharded_scan(spark, d):
    return readers.select_rows(deliveries(spark, d), splits=["dev", "test"], shards=7, shard=3).select("sample_id", "parent_id")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus <> 'O' THEN 'unexpected codec_name: ' || l_linestatus WHEN NOT starts_with(l_returnflag, 'N') THEN 'unexpected sample_fmt: ' || l_returnflag
  WHEN l_quantity < 5 THEN 'too short' WHEN l_quantity > 45 THEN 'too long' WHEN l_extendedprice < 5000 THEN 'file too small' END AS reason FROM lineitem""")
def flt07_probe_reason(spark, d):
    limits = {"codec_name": "O", "sample_fmt": "N", "min_duration": 5.0, "max_duration": 45.0, "min_size": 5000}
    rows = table(spark, d, "lineitem").select("*", F.col("l_linestatus").alias("codec_name"), F.col("l_returnflag").alias("sample_fmt"), F.col("l_quantity").alias("duration_sec"), F.col("l_extendedprice").alias("size_bytes"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", validation.probe_reason(limits).alias("reason"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice < 3000 THEN 'file too small' WHEN l_quantity < 3 THEN 'too short' WHEN l_quantity > 48 THEN 'too long'
  WHEN l_quantity / greatest(p_size, 0.000001) < 0.5 THEN 'ratio too small' WHEN l_quantity / greatest(p_size, 0.000001) > 2 THEN 'ratio too large' END AS reason FROM lineitem JOIN part ON p_partkey = l_partkey""")
def flt10_spoof_reason(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("source_duration_sec")), F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.select("*", F.col("l_quantity").alias("duration_sec"), F.col("l_extendedprice").alias("size_bytes"))
    limits = {"min_size": 3000, "min_duration": 3.0, "max_duration": 48.0, "min_ratio": 0.5, "max_ratio": 2.0}
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", validation.spoof_reason(limits).alias("reason"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT vec_id, list_max(list_transform(e, lambda x: abs(x))) AS peak, len(list_filter(e, lambda x: abs(x) >= 0.3)) / len(e) AS clipped, len(e) / 64.0 AS duration_sec FROM v)
SELECT CASE WHEN peak < 0.2 THEN 'silent' WHEN clipped > 0.04 THEN 'clipped' ELSE 'ok' END AS status, count(*) AS n FROM s GROUP BY 1""")
def flt11_row_status(spark, d):
    seen = table(spark, d, "embeddings").select("vec_id", arrays.inspect(F.col("embedding"), 0.3).alias("i"))
    rows = seen.select("vec_id", "i.*", (F.col("i.frames") / 64.0).alias("duration_sec"), F.lit(1.0).alias("parent_duration_sec"))
    limits = {"min_peak": 0.2, "max_clipped": 0.04, "min_ratio": 0.5, "max_ratio": 2.0}
    return rows.groupBy(validation.row_status(limits).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT CASE WHEN l_discount < 0.02 THEN 'mean_volume' WHEN l_tax > 0.07 THEN 'peak' WHEN greatest(0, 1 - l_quantity / 40) < 0.2 THEN 'speech_ratio' ELSE 'accepted' END AS reason FROM lineitem)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def flt12_speech_reasons(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_discount").alias("mean_db"), F.col("l_tax").alias("max_db"), F.col("l_quantity").alias("silence_sec"), F.lit(40.0).alias("duration_sec"))
    reason = F.coalesce(validation.speech_reason({"min_mean_db": 0.02, "max_db": 0.07, "min_speech": 0.2}), F.lit("accepted"))
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DELIVERIES}, ops AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY rn DESC) AS back FROM lines WHERE rn <= 4)
SELECT sample_id, coalesce(max(CASE WHEN l_returnflag = 'A' AND back = 1 THEN CAST(l_quantity AS VARCHAR) END), '') AS bitrate, coalesce(max(CASE WHEN l_returnflag = 'N' AND back = 1 THEN CAST(l_quantity AS VARCHAR) END), '') AS snr,
  coalesce(max(CASE WHEN l_returnflag = 'R' AND back = 1 THEN CAST(round(100 * l_discount) AS VARCHAR) END), '') AS packet_loss FROM deliveries JOIN ops ON l_orderkey = ord GROUP BY 1""")
def prj05_manifest_rows(spark, d):
    return projections.manifest_row(deliveries(spark, d)).select("sample_id", "bitrate", "snr", "packet_loss")


@query(f"WITH {DELIVERIES} SELECT sample_id, '' AS trace_path, split AS split_standard, chain_family, CAST(speaker_id AS VARCHAR) AS speaker_id, '' AS codec_name FROM deliveries")
def prj06_release_rows(spark, d):
    return projections.fixed_columns(deliveries(spark, d), ["sample_id", "trace_path", "split_standard", "chain_family", "speaker_id", "codec_name"], {"split_standard": "split"})


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice - p_retailprice, 6) AS duration_delta, round(l_tax - l_discount, 6) AS rms_delta, l_quantity - p_size AS peak_delta, round(CASE WHEN p_retailprice > 0 THEN l_extendedprice / p_retailprice END, 6) AS duration_ratio
FROM lineitem JOIN part ON p_partkey = l_partkey""")
def prj12_audio_deltas(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("child_duration"), F.col("p_retailprice").alias("parent_duration"), F.col("l_tax").alias("child_rms"), F.col("l_discount").alias("parent_rms"),
        F.col("l_quantity").alias("child_peak"), F.col("p_size").cast("double").alias("parent_peak"),
    )
    rounded = [F.round(c, 6).alias(c) for c in ("duration_delta", "rms_delta", "duration_ratio")]
    return projections.audio_deltas(rows).select("l_orderkey", "l_linenumber", "l_partkey", "peak_delta", *rounded)


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN coalesce(props, '') = '' THEN 'missing_child' WHEN event_id % 7 = 0 THEN 'missing_parent' WHEN value < 5 THEN 'unreadable_audio' ELSE 'ok' END AS status FROM events) GROUP BY 1""")
def prj15_status_ladder(spark, d):
    rows = table(spark, d, "events").select(F.col("props").alias("child_path"), F.when(F.col("event_id") % 7 != 0, F.lit("p")).alias("parent_path"), F.when(F.col("value") >= 5, F.col("value")).alias("child_duration"))
    return projections.status_ladder(rows).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- strings, arrays, numbers ---------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN len(t) >= 4 AND NOT list_bool_and(list_transform(t, lambda x: regexp_full_match(x, '[0-9]+'))) THEN array_to_string(t, ' ') END AS transcript
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?|[0-9]+') AS t FROM documents)""")
def str01_english_transcript(spark, d):
    return table(spark, d, "documents").select("doc_id", text.english_transcript(F.col("text")).alias("transcript"))


@query(f"WITH {TRANSCRIPTS} SELECT conv_id, turn, text FROM normal")
def str03_reference_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.reference_text(F.col("text"), F.lit("en")).alias("text"))


@query(f"""WITH {TRANSCRIPTS}, c AS (SELECT conv_id, turn, replace(reference, ' ', '') AS a, replace(hypothesis, ' ', '') AS b FROM transcripts)
SELECT conv_id, turn, CASE WHEN len(a) > 0 THEN levenshtein(a, b) / len(a) WHEN len(b) > 0 THEN 1.0 END AS cer FROM c""")
def str09_cer(spark, d):
    return transcripts(spark, d).select("conv_id", "turn", text.char_error_rate(F.col("reference"), F.col("hypothesis"), F.lit("en")).alias("cer"))


@query(f"""WITH {TRANSCRIPTS}, w AS (SELECT conv_id, turn, list_filter(string_split(reference, ' '), lambda x: x <> '') AS a, list_filter(string_split(hypothesis, ' '), lambda x: x <> '') AS b FROM transcripts),
s AS (SELECT *, list_intersect(a, b) AS shared FROM w), -- a word that one side alone has equals nothing, so all such share a character; each of both has its own
c AS (SELECT conv_id, turn, len(a) AS n, len(b) AS m, levenshtein(array_to_string(list_transform(a, lambda x: coalesce(chr(CAST(list_position(shared, x) AS INTEGER) + 2), chr(1))), ''), array_to_string(list_transform(b, lambda x: coalesce(chr(CAST(list_position(shared, x) AS INTEGER) + 2), chr(2))), '')) AS dist, len(shared) AS k FROM s)
SELECT conv_id, turn, CASE WHEN k > 125 THEN error('no single byte is left') WHEN n > 0 THEN dist / n WHEN m > 0 THEN 1.0 END AS wer FROM c""")
def str08_wer(spark, d):
    return transcripts(spark, d).select("conv_id", "turn", text.word_error_rate(F.col("reference"), F.col("hypothesis"), F.lit("en")).alias("wer"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, regexp_replace(printf('%.3f', l_discount * l_quantity), '\\.?0+$', '') AS compact FROM lineitem""".replace("\\\\", "\\"))
def str13_compact_number(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", buckets.compact_number(F.col("l_discount") * F.col("l_quantity")).alias("compact"))


@query("""SELECT quality, toxic, CASE CAST(quality AS VARCHAR) WHEN '1' THEN 'bonafide' ELSE 'spoof' END AS label, CASE CAST(toxic AS VARCHAR) WHEN '1' THEN 'bonafide' ELSE 'spoof' END AS protocol, count(*) AS n FROM labels GROUP BY ALL""")
def str14_labels(spark, d):
    rows = table(spark, d, "labels").select("quality", "toxic", text.binary_label(F.col("quality")).alias("label"), text.protocol_label(F.col("toxic")).alias("protocol"))
    return rows.groupBy("quality", "toxic", "label", "protocol").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS elapsed FROM (SELECT event_id, CAST(greatest(floor(value * 60), 0) AS BIGINT) AS s FROM events)""")
def str17_elapsed(spark, d):
    return table(spark, d, "events").select("event_id", text.elapsed(F.col("value") * 60).alias("elapsed"))


@query(f"""WITH {DELIVERIES} SELECT sample_id, array_to_string(sig, '>') AS chain, '["' || array_to_string(list_sort(sig), '","') || '"]' AS operator_multiset_key, sig[-1] AS path_endpoint_key FROM deliveries""")
def arr03_signatures(spark, d):
    rows = deliveries(spark, d).withColumn("sig", chains.signature(F.col("operator_params"), F.lit("[]")))  # by way of the JSON text
    sig = F.col("sig")
    return rows.select("sample_id", F.array_join(sig, ">").alias("chain"), chains.multiset_key(sig).alias("operator_multiset_key"), chains.endpoint_key(sig).alias("path_endpoint_key"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <= 16 THEN 'very_low' WHEN l_quantity <= 24 THEN 'low' WHEN l_quantity <= 32 THEN 'medium' ELSE 'high' END AS bitrate,
  CASE WHEN l_tax * 100 <= 2 THEN 'light' WHEN l_tax * 100 <= 5 THEN 'moderate' ELSE 'severe' END AS loss, CASE WHEN l_quantity / 50 < CAST(0.35 AS DOUBLE) THEN 'short' WHEN l_quantity / 50 < CAST(0.65 AS DOUBLE) THEN 'medium' ELSE 'long' END AS rt60,
  CASE WHEN l_quantity / 10 < 1 THEN 'near' WHEN l_quantity / 10 < CAST(2.5 AS DOUBLE) THEN 'mid' ELSE 'far' END AS distance, CASE WHEN l_quantity * 1000 <= 8000 THEN '8k' WHEN l_quantity * 1000 <= 16000 THEN '16k' WHEN l_quantity * 1000 <= 24000 THEN '24k' ELSE '32k_plus' END AS rate
FROM lineitem""")
def mth01_buckets(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", buckets.bitrate_bucket(q).alias("bitrate"), buckets.bucket(F.col("l_tax") * 100, buckets.PACKET_LOSS).alias("loss"), buckets.bucket(q / 50, buckets.RT60).alias("rt60"),
        buckets.bucket(q / 10, buckets.DISTANCE).alias("distance"), buckets.bucket(q * 1000, buckets.SAMPLE_RATE).alias("rate"),
    )


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS c FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT a, b, round(c, 6) AS similarity FROM n""")
def mth08_cosine(spark, d):
    v = table(spark, d, "embeddings")
    pairs = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "a")
    return pairs.select("a", "b", F.round(arrays.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("SELECT c_custkey, 42 + CAST(('0x' || substr(sha1(c_name), 1, 8)) AS BIGINT) % 100000 AS seed FROM customer")
def mth12_render_seed(spark, d):
    return table(spark, d, "customer").select("c_custkey", hashing.render_seed(42, F.col("c_name")).alias("seed"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: 5 * CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT *, list_max(list_transform(e, lambda x: abs(x))) AS peak FROM v)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: CASE WHEN peak > CAST(0.98 AS DOUBLE) THEN x * CAST(0.98 AS DOUBLE) / peak ELSE x END)), 6) AS normal, round(list_sum(list_transform(e, lambda x: CASE WHEN peak > CAST(0.98 AS DOUBLE) THEN tanh(2 * x) / tanh(2) * CAST(0.98 AS DOUBLE) ELSE x END)), 6) AS soft,
  round(20 * log10(greatest(sqrt(list_dot_product(e, e) / len(e)), 1e-12)), 6) AS rms_dbfs, round(peak, 6) AS peak, round(list_sum((list_concat(e, e))[1:100]), 6) AS tiled FROM p""")
def sig13_levels(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 5).alias("e"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6)
    e = F.col("e")
    loud = arrays.loudness(e, 16000)
    return rows.select("vec_id", total(arrays.peak_normalize(e)).alias("normal"), total(arrays.soft_clip(e)).alias("soft"), F.round(loud["rms_dbfs"], 6).alias("rms_dbfs"), F.round(loud["peak"], 6).alias("peak"), total(arrays.tile(e, 100)).alias("tiled"))


@query()
def sig23_rendered(spark, d):
    """Default plans of one parent folded over toy waveforms."""
    plan = planner.plan_jobs(spark.createDataFrame([("p",)], "parent_id string")).select("job_id", "operator_params", "seed")
    # a small file of vectors is a task or two, its jobs are work for all cores
    waves = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("signal")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    jobs = waves.crossJoin(F.broadcast(plan))  # one parent's jobs, seventeen rows
    out = signals.apply(jobs, "signal", "operator_params", F.col("seed") + F.col("vec_id"))
    return out.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.array_max("rendered")), 6).alias("mean_peak"))


# --- joins and sets -------------------------------------------------------------------------------


@query("""WITH m AS (SELECT o_custkey AS k, max_by(o_orderpriority, o_orderkey) AS p, max_by(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment ELSE s END AS label, p AS priority FROM customer LEFT JOIN m ON k = c_custkey""")
def jn01_enrich(spark, d):
    scores = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), "c_custkey", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_mktsegment")).otherwise(" ").alias("label"))
    meta = table(spark, d, "orders").select(F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("sample_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("priority"))
    return joins.enrich(scores, meta).select("c_custkey", "label", "priority")


@query("""WITH s AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0)
SELECT count(*) FILTER (WHERE n IS NULL) AS n_missing, count(*) FILTER (WHERE n > 1) AS n_duplicate, count(*) FILTER (WHERE e.k IS NULL) AS n_unexpected FROM s FULL JOIN e ON s.k = e.k""")
def jn03_coverage(spark, d):
    expected = table(spark, d, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("sample_id"))
    return joins.score_coverage(table(spark, d, "orders").select(F.col("o_custkey").alias("sample_id")), expected)


PAIRS = f"""{DELIVERIES},
near AS (SELECT parent_id, chain_family, label, a.sample_id AS a, b.sample_id AS b, a.sig AS sa, b.sig AS sb FROM deliveries a JOIN deliveries b USING (parent_id, chain_family, label) WHERE a.sample_id < b.sample_id AND len(a.sig) = len(b.sig)),
diff AS (SELECT *, list_filter(range(1, len(sa) + 1), lambda i: sa[i] <> sb[i]) AS d FROM near),
parameter_pairs AS (SELECT parent_id, chain_family, label, a, b, sha1('parameter' || chr(0) || a || chr(0) || b) AS pair_id, 'parameter@' || (d[1] - 1) AS detail FROM diff WHERE len(d) = 1 AND split_part(sa[d[1]], '[', 1) = split_part(sb[d[1]], '[', 1)),
substitution_pairs AS (SELECT parent_id, chain_family, label, a, b, sha1('operator' || chr(0) || a || chr(0) || b) AS pair_id, 'indices=' || array_to_string(list_transform(d, lambda i: i - 1), ',') AS detail FROM diff
  WHERE len(d) > 0 AND len(list_filter(d, lambda i: split_part(sa[i], '[', 1) = split_part(sb[i], '[', 1))) = 0),
swap_pairs AS (SELECT parent_id, chain_family, label, a, b, sha1('swap' || chr(0) || a || chr(0) || b) AS pair_id, d[2] - d[1] AS gap FROM diff WHERE len(d) = 2 AND sa[d[1]] = sb[d[2]] AND sa[d[2]] = sb[d[1]]),
prefix_pairs AS (SELECT parent_id, chain_family, label, a.sample_id AS a, b.sample_id AS b, sha1('path' || chr(0) || least(a.sample_id, b.sample_id) || chr(0) || greatest(a.sample_id, b.sample_id)) AS pair_id, len(b.sig) AS step
  FROM deliveries a JOIN deliveries b USING (parent_id, chain_family, label) WHERE len(a.sig) > 0 AND len(b.sig) = len(a.sig) + 1 AND b.sig[1:len(a.sig)] = a.sig)"""


@query(f"WITH {PAIRS} SELECT * FROM parameter_pairs")
def jn04_parameter_pairs(spark, d):
    return matching.parameter_pairs(deliveries(spark, d))


@query(f"WITH {PAIRS} SELECT * FROM substitution_pairs")
def jn05_substitution_pairs(spark, d):
    return matching.substitution_pairs(deliveries(spark, d))


@query(f"WITH {PAIRS} SELECT * FROM swap_pairs")
def jn06_swap_pairs(spark, d):
    return matching.swap_pairs(deliveries(spark, d))


@query(f"WITH {PAIRS} SELECT * FROM prefix_pairs")
def jn07_prefix_pairs(spark, d):
    return matching.prefix_pairs(deliveries(spark, d))


MATCHES = f"""{PAIRS},
cand AS (SELECT g, relation, a, b, pair_id, row_number() OVER (PARTITION BY g ORDER BY relation, pair_id) AS k FROM (
  SELECT 'i|' || parent_id || '|' || chain_family || '|' || label AS g, '1' AS relation, a, b, pair_id FROM parameter_pairs UNION ALL SELECT 'i|' || parent_id || '|' || chain_family || '|' || label, '2', a, b, pair_id FROM substitution_pairs
  UNION ALL SELECT 's|' || parent_id || '|' || chain_family || '|' || label, '3', a, b, pair_id FROM swap_pairs UNION ALL SELECT 'p|' || parent_id || '|' || chain_family || '|' || label, '4', a, b, pair_id FROM prefix_pairs)),
fold(g, k, used, ok) AS (SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false FROM cand UNION ALL
  SELECT g, k, CASE WHEN hit THEN used ELSE list_concat(used, [a, b]) END, NOT hit FROM (SELECT c.g, c.k, c.a, c.b, f.used, list_contains(f.used, c.a) OR list_contains(f.used, c.b) AS hit FROM fold f JOIN cand c ON c.g = f.g AND c.k = f.k + 1)),
matched AS (SELECT c.relation, c.a, c.b, c.pair_id FROM fold f JOIN cand c ON c.g = f.g AND c.k = f.k WHERE f.ok)"""


def _matches(spark, d, *relations: str) -> dict[str, DataFrame]:
    return matching.match_all(deliveries(spark, d), relations or tuple(matching.RELATIONS))


@query(f"WITH RECURSIVE {MATCHES} SELECT CASE relation WHEN '1' THEN 'parameter' WHEN '2' THEN 'substitution' WHEN '3' THEN 'swap' ELSE 'path' END AS relation, a, b, pair_id FROM matched")
def grf02_matches(spark, d):
    found = [m.select(F.lit(k).alias("relation"), "a", "b", "pair_id") for k, m in _matches(spark, d).items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(f"""WITH RECURSIVE {MATCHES}, ends AS (SELECT relation, pair_id, unnest([a, b]) AS sample_id FROM matched)
SELECT sample_id, max(CASE WHEN relation = '1' THEN pair_id END) AS parameter_group_id, max(CASE WHEN relation = '2' THEN pair_id END) AS substitution_group_id, max(CASE WHEN relation = '3' THEN pair_id END) AS swap_group_id, max(CASE WHEN relation = '4' THEN pair_id END) AS path_group_id
FROM deliveries LEFT JOIN ends USING (sample_id) GROUP BY 1""")
def grf02_annotations(spark, d):
    return matching.annotate(deliveries(spark, d)).select("sample_id", "parameter_group_id", "substitution_group_id", "swap_group_id", "path_group_id")


EDITS = """
nodes AS (SELECT DISTINCT lineage, sig FROM own),
pairs AS (SELECT lineage, a.sig AS sa, b.sig AS sb, list_filter(range(1, len(a.sig) + 1), lambda i: a.sig[i] <> b.sig[i]) AS d FROM nodes a JOIN nodes b USING (lineage) WHERE a.sig <> b.sig AND len(b.sig) BETWEEN len(a.sig) - 1 AND len(a.sig) + 1),
edges AS (SELECT lineage, sa, sb FROM pairs WHERE (len(sa) = len(sb) AND (len(d) = 1 OR (len(d) = 2 AND d[2] = d[1] + 1 AND sa[d[1]] = sb[d[2]] AND sa[d[2]] = sb[d[1]])))
  OR (len(sa) + 1 = len(sb) AND len(list_filter(range(1, len(sb) + 1), lambda i: list_concat(sb[1:i - 1], sb[i + 1:len(sb)]) = sa)) > 0)
  OR (len(sb) + 1 = len(sa) AND len(list_filter(range(1, len(sa) + 1), lambda i: list_concat(sa[1:i - 1], sa[i + 1:len(sa)]) = sb)) > 0)),
refs AS (SELECT lineage, sig FROM (SELECT lineage, sig, row_number() OVER (PARTITION BY lineage ORDER BY len(sig), sample_id) AS r, count(*) OVER (PARTITION BY lineage) AS n FROM own) WHERE r = 1 AND n >= 2),
walk(lineage, sig, distance) AS (SELECT lineage, sig, 0 FROM refs UNION SELECT w.lineage, e.sb, w.distance + 1 FROM walk w JOIN edges e ON e.lineage = w.lineage AND e.sa = w.sig WHERE w.distance < 12),
near_ref AS (SELECT lineage, sig, min(distance) AS distance FROM walk GROUP BY ALL)"""

OWN_TEST = "own AS (SELECT parent_id || '|' || chain_family || '|' || CASE label WHEN 'bona_fide' THEN 'bonafide' ELSE label END AS lineage, sample_id, sig, score, y FROM deliveries WHERE split = 'test')"


@query(f"WITH RECURSIVE {DELIVERIES}, {OWN_TEST}, {EDITS} SELECT lineage, distance, count(*) AS chains FROM near_ref GROUP BY ALL")
def grf01_distances(spark, d):
    own = written(matching.lineages(deliveries(spark, d).filter("split = 'test'")).select("lineage", "sample_id", "sig"), "lineages")
    refs = own.groupBy("lineage").agg(F.min_by("sig", F.struct(F.size("sig"), "sample_id")).alias("sig"), F.count(F.lit(1)).alias("n")).filter("n >= 2").select("lineage", "sig")
    found = matching.graph_distances(own.join(refs.select("lineage"), "lineage", "left_semi").select("lineage", "sig"), refs, ["lineage"])
    return found.groupBy("lineage", "distance").agg(F.count(F.lit(1)).alias("chains"))


@query(f"WITH RECURSIVE {DELIVERIES}, {OWN_TEST}, {EDITS} SELECT lineage, array_to_string(sa, '>') AS chain_a, array_to_string(sb, '>') AS chain_b FROM edges")
def jn09_edit_edges(spark, d):
    own = matching.lineages(deliveries(spark, d).filter("split = 'test'"))
    return matching.edit_edges(own, ["lineage"]).select("lineage", F.array_join("sig_a", ">").alias("chain_a"), F.array_join("sig_b", ">").alias("chain_b"))


@query("""SELECT coalesce(s, 'missing result entry') AS status, count(*) AS n FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1""")
def jn11_results(spark, d):
    results = table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("ord"))
    return joins.collect_results(table(spark, d, "customer").select(F.col("c_custkey").alias("job_id")), results).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, c_acctbal AS parent_duration FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def jn12_parent_lookup(spark, d):
    parents = table(spark, d, "customer").select(F.col("c_custkey").alias("parent_id"), "c_acctbal")
    return joins.parent_value(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("parent_id")), parents, "c_acctbal", "parent_duration").select("o_orderkey", "parent_duration")


@query(f"""WITH {DELIVERIES}, ring AS (SELECT DISTINCT speaker_id % 50 AS speaker, parent_id FROM deliveries), h AS (SELECT *, sha1('prompt' || chr(0) || parent_id) AS h FROM ring)
SELECT speaker, parent_id, coalesce(lead(parent_id) OVER (PARTITION BY speaker ORDER BY h, parent_id), first(parent_id) OVER (PARTITION BY speaker ORDER BY h, parent_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prompt FROM h""")
def jn10_prompts(spark, d):
    rows = deliveries(spark, d).select((F.col("speaker_id") % 50).alias("speaker"), "parent_id").distinct()
    return joins.prompt_reference(rows, "prompt", "speaker").select("speaker", "parent_id", "prompt")


@query("SELECT DISTINCT p AS path, l_returnflag FROM (SELECT unnest(['p' || l_partkey, 's' || l_suppkey]) AS p, l_returnflag FROM lineitem)")
def jn13_distinct_files(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b"), "l_returnflag")
    return joins.distinct_files(rows, ["a", "b"], "l_returnflag")


@query("SELECT o_custkey, max(o_orderkey) FILTER (WHERE r = 1) AS first_order FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1")
def set05_first_of_each(spark, d):
    return joins.first_of_each(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query("""SELECT 'customer' AS kind, c_name AS name, c_mktsegment AS segment, '' AS brand FROM customer UNION ALL SELECT 'part', p_name, '', p_brand FROM part""")
def set01_union(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return joins.union_named([a, table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))])


# --- aggregations ---------------------------------------------------------------------------------


@query(f"""WITH {DELIVERIES} SELECT CASE WHEN grouping(split) = 0 AND grouping(label) = 0 THEN 'label/split' WHEN grouping(chain_family) = 0 THEN 'chain_family/label' ELSE 'split' END AS "grouping",
  CASE WHEN grouping(split) = 0 AND grouping(label) = 0 THEN label || '/' || split WHEN grouping(chain_family) = 0 THEN chain_family || '/' || label ELSE split END AS key, count(*) AS n, count(DISTINCT speaker_id) AS distinct_values
FROM deliveries GROUP BY GROUPING SETS ((label, split), (chain_family, label), (split))""")
def agg05_grouping_sets(spark, d):
    return summaries.grouped_counts(deliveries(spark, d), [("label", "split"), ("chain_family", "label"), ("split",)], "speaker_id")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def agg01_group_by_field(spark, d):
    return summaries.group_by_field(table(spark, d, "events"), "event_type")


@query("SELECT 'o_custkey' AS field, count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'o_orderkey', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def agg10_duplicates(spark, d):
    return summaries.duplicate_keys(table(spark, d, "orders"), ["o_custkey", "o_orderkey"])


@query("""WITH m AS (SELECT DISTINCT event_type AS s, user_id AS u FROM events), names AS (SELECT DISTINCT s FROM m), p AS (SELECT a.s AS a, b.s AS b FROM names a JOIN names b ON a.s < b.s)
SELECT a AS split_a, b AS split_b, count(y.u) AS shared, count(y.u) = 0 AS disjoint FROM p LEFT JOIN m x ON x.s = a LEFT JOIN m y ON y.s = b AND y.u = x.u GROUP BY 1, 2""")
def agg11_split_overlap(spark, d):
    return summaries.split_overlap(table(spark, d, "events"), "event_type", "user_id")


@query(f"""WITH {DELIVERIES} SELECT DISTINCT 'dev' AS split_a, 'test' AS split_b, CAST(0 AS BIGINT) AS shared, true AS disjoint FROM deliveries UNION ALL SELECT 'dev', 'train', 0, true UNION ALL SELECT 'test', 'train', 0, true""")
def agg11_parents_disjoint(spark, d):
    return summaries.split_overlap(deliveries(spark, d), "split", "parent_id")


@query(f"""WITH {DELIVERIES}, have AS (SELECT parent_id, list_filter(['direct', 'hybrid', 'telephony'], lambda f: NOT list_contains(list(DISTINCT chain_family), f)) AS missing FROM deliveries GROUP BY 1),
states AS (SELECT unnest(CASE WHEN len(missing) = 0 THEN ['complete'] ELSE list_concat(['incomplete'], list_transform(missing, lambda m: 'missing:' || m)) END) AS state FROM have) SELECT state, count(*) AS n FROM states GROUP BY 1""")
def agg12_parent_coverage(spark, d):
    return summaries.parent_coverage(deliveries(spark, d), ["direct", "hybrid", "telephony"])


@query(f"""WITH {DELIVERIES}, r AS (SELECT *, CASE WHEN score < 60000 THEN 'unreadable_audio' ELSE 'ok' END AS status FROM deliveries)
SELECT CASE WHEN grouping(chain_family) = 1 THEN 'overall' WHEN grouping(split) = 1 THEN 'family' ELSE 'family_language' END AS level, coalesce(chain_family, '') AS chain_family, coalesce(split, '') AS language, count(*) AS rows, count(DISTINCT parent_id) AS parents,
  count(*) FILTER (WHERE status = 'ok') AS ok_rows, count(*) FILTER (WHERE status = 'ok') / count(*) AS ok_fraction, round(avg(score), 4) AS mean_score FROM r GROUP BY ROLLUP (chain_family, split)""")
def agg14_preservation_summary(spark, d):
    rows = deliveries(spark, d).withColumn("status", F.when(F.col("score") < 60000, "unreadable_audio").otherwise("ok")).withColumnRenamed("split", "language")
    return summaries.status_summary(rows, ["score"]).withColumn("mean_score", F.round("mean_score", 4))


def _auc_sql(keys: str) -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""auc AS (SELECT {head}CASE WHEN p > 0 AND n > 0 THEN greatest(0.0, least(1.0, (r - p * (p + 1) / 2) / (p * n))) ELSE 0.0 END AS auc FROM (
  SELECT {head}CAST(sum(rank) FILTER (WHERE y = 1) AS DOUBLE) AS r, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS n
  FROM (SELECT *, row_number() OVER ({by}ORDER BY s, sample_id) AS rank FROM scored) {group}))"""


def _eer_sql(keys: str) -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    head = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    join = f"JOIN totals USING ({keys})" if keys else "CROSS JOIN totals"
    return f"""totals AS (SELECT {head}count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM scored {group}),
steps AS (SELECT {head}s, sum(y) AS t1, sum(1 - y) AS f1 FROM scored GROUP BY {head}s), curve AS (SELECT {head}s, sum(t1) OVER w AS tp, sum(f1) OVER w AS fp FROM steps WINDOW w AS ({by}ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
bends AS (SELECT *, lead(tp) OVER w - 2 * tp + lag(tp) OVER w AS bt, lead(fp) OVER w - 2 * fp + lag(fp) OVER w AS bf FROM curve WINDOW w AS ({by}ORDER BY s DESC)),
points AS (SELECT {head}s, tp, fp FROM bends WHERE bt IS NULL OR bt <> 0 OR bf <> 0 UNION ALL SELECT {head}CAST('inf' AS DOUBLE), 0, 0 FROM totals),
rates AS (SELECT {head}s, 1 - CAST(tp AS DOUBLE) / p AS fnr, CAST(fp AS DOUBLE) / n AS fpr, row_number() OVER ({by}ORDER BY abs((1 - CAST(tp AS DOUBLE) / p) - CAST(fp AS DOUBLE) / n), s DESC) AS r FROM points {join} WHERE p > 0 AND n > 0),
eer AS (SELECT {head}coalesce((fnr + fpr) / 2, 0.0) AS eer, coalesce(s, 0.0) AS threshold FROM totals LEFT JOIN (SELECT * FROM rates WHERE r = 1) best {f"USING ({keys})" if keys else "ON true"})"""


SCORED = f"{DELIVERIES}, scored AS (SELECT chain_family, sample_id, score AS s, y FROM deliveries)"


@query(f"WITH {SCORED}, {_auc_sql('chain_family')} SELECT * FROM auc")
def agg18_auc(spark, d):
    return metrics.auc(deliveries(spark, d), ["chain_family"], tie="sample_id")


@query(f"WITH {DOC_SCORES}, scored AS (SELECT * FROM doc_scores), {_auc_sql('')} SELECT * FROM auc")
def agg18_auc_overall(spark, d):
    return metrics.auc(doc_scores(spark, d), [])


@query(f"WITH {SCORED}, {_eer_sql('chain_family')} SELECT * FROM eer")
def agg19_eer(spark, d):
    return metrics.eer(deliveries(spark, d), ["chain_family"])


@query(f"WITH {DOC_SCORES}, scored AS (SELECT * FROM doc_scores), {_eer_sql('')} SELECT * FROM eer")
def agg20_eer_overall(spark, d):
    return metrics.eer_or_zero(doc_scores(spark, d), [])


@query(f"WITH {DELIVERIES}, scored AS (SELECT chain_family, ord AS sample_id, round(score / 10000) * 10000 AS s, y FROM deliveries), {_auc_sql('chain_family')} SELECT * FROM auc")
def agg18_auc_ties_in_input_order(spark, d):
    return metrics.auc(deliveries(spark, d).withColumn("score", F.round(F.col("score") / 10000) * 10000), ["chain_family"])


@query(f"WITH {DELIVERIES}, scored AS (SELECT speaker_id, sample_id, score AS s, y FROM deliveries), {_eer_sql('speaker_id').replace('coalesce((fnr + fpr) / 2, 0.0)', 'coalesce((fnr + fpr) / 2, 1.0)')} SELECT * FROM eer")
def agg19_eer_of_one_class(spark, d):
    """Many speakers have one class alone: 1 and 0."""
    return metrics.eer(deliveries(spark, d), ["speaker_id"])


@query(f"WITH {DELIVERIES}, scored AS (SELECT speaker_id, sample_id, score AS s, y FROM deliveries), {_eer_sql('speaker_id')} SELECT * FROM eer")
def agg20_eer_of_one_class(spark, d):
    return metrics.eer_or_zero(deliveries(spark, d), ["speaker_id"])


@query(f"""WITH {SCORED}, h AS (SELECT *, CASE WHEN s >= 100000 THEN 1 ELSE 0 END AS hit FROM scored)
SELECT chain_family, avg(CASE WHEN hit = y THEN 1.0 ELSE 0.0 END) AS accuracy, 2.0 * sum(hit * y) / (sum(hit) + sum(y)) AS f1 FROM h GROUP BY 1""")
def agg21_accuracy_f1(spark, d):
    return metrics.accuracy_f1(deliveries(spark, d), ["chain_family"], threshold=100000.0)


@query(f"""WITH {DOC_SCORES}, scored AS (SELECT 'lang' AS grouper, coalesce(nullif(trim(lang), ''), 'unknown') AS value, sample_id, s, y FROM doc_scores UNION ALL SELECT 'source', coalesce(nullif(trim(source), ''), 'unknown'), sample_id, s, y FROM doc_scores), {_auc_sql('grouper, value')}, {_eer_sql('grouper, value')}
SELECT grouper, value, p + n AS n_samples, p AS n_bonafide, n AS n_spoof, auc, eer FROM totals JOIN auc USING (grouper, value) JOIN eer USING (grouper, value)""")
def agg24_subgroups(spark, d):
    return metrics.subgroups(doc_scores(spark, d), ["lang", "source"])


@query(f"""WITH {SCORED}, {_auc_sql('chain_family')}, {_eer_sql('chain_family')}, v AS (SELECT 'm' AS baseline, chain_family AS variant, auc, eer FROM auc JOIN eer USING (chain_family))
SELECT baseline, variant, round(auc, 9) AS auc, round(eer, 9) AS eer FROM v UNION ALL SELECT baseline, 'macro_avg', round(avg(auc), 9), round(avg(eer), 9) FROM v GROUP BY 1""")
def agg31_macro(spark, d):
    rows = deliveries(spark, d)
    per = metrics.auc(rows, ["chain_family"], tie="sample_id").join(metrics.eer(rows, ["chain_family"]), "chain_family").select(F.lit("m").alias("baseline"), F.col("chain_family").alias("variant"), "auc", "eer")
    return metrics.macro_average(per, ["baseline"], ["auc", "eer"]).select("baseline", "variant", F.round("auc", 9).alias("auc"), F.round("eer", 9).alias("eer"))


def _pair_sql(relation: str, breakdown: str = "") -> str:
    part = f"UNION ALL SELECT '{breakdown}', part, same, ok, wrong, moved FROM judged" if breakdown else ""
    return f"""WITH RECURSIVE {MATCHES}, test AS (SELECT * FROM deliveries WHERE split = 'test'),
judged AS (SELECT CAST((l.score >= 100000) = (r.score >= 100000) AS INTEGER) AS same, CAST((l.score >= 100000) = (l.y = 1) AND (r.score >= 100000) = (r.y = 1) AS INTEGER) AS ok,
  0.5 * (CAST((l.score >= 100000) <> (l.y = 1) AS INTEGER) + CAST((r.score >= 100000) <> (r.y = 1) AS INTEGER)) AS wrong, abs(l.score - r.score) AS moved, CASE WHEN l.y = 1 THEN 'bonafide' ELSE 'spoof' END AS label, l.chain_family AS part
  FROM matched m JOIN test l ON l.sample_id = m.a JOIN test r ON r.sample_id = m.b WHERE m.relation = '{relation}'),
iqr AS (SELECT quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr FROM test), long AS (SELECT 'all' AS scope, '' AS value, same, ok, wrong, moved FROM judged UNION ALL SELECT 'label', label, same, ok, wrong, moved FROM judged {part})
SELECT scope, value, count(*) AS pairs, round(avg(same), 9) AS consistency, round(avg(ok), 9) AS joint_accuracy, round(avg(wrong), 9) AS risk, round(avg(moved) / max(iqr), 9) AS drift FROM long CROSS JOIN iqr GROUP BY 1, 2"""


def _pair_query(spark, d, relation: str, group: str, breakdown: str | None = None) -> DataFrame:
    rows = deliveries(spark, d).filter("split = 'test'")
    pairs = _matches(spark, d, relation)[relation].select(F.explode(F.array("a", "b")).alias("sample_id"), F.col("pair_id").alias(group))
    out = robustness.pair_robustness(rows.join(matching.grows(pairs), "sample_id", "left"), group, 100000.0, breakdown)
    return out.select("scope", "value", "pairs", *[F.round(c, 9).alias(c) for c in ("consistency", "joint_accuracy", "risk", "drift")])


@query(_pair_sql("1", "chain_family"))
def agg25_parameter_robustness(spark, d):
    return _pair_query(spark, d, "parameter", "parameter_group_id", "chain_family")


@query(_pair_sql("2"))
def agg25_substitution_robustness(spark, d):
    return _pair_query(spark, d, "substitution", "substitution_group_id")


@query(_pair_sql("3"))
def agg26_swap_robustness(spark, d):
    return _pair_query(spark, d, "swap", "swap_group_id")


@query(f"""WITH RECURSIVE {DELIVERIES}, {OWN_TEST}, {EDITS},
radii AS (SELECT lineage, CASE WHEN max(y) = 1 THEN 'bonafide' ELSE 'spoof' END AS label, min(distance) FILTER (WHERE (score >= 100000) <> (y = 1)) AS radius, max(distance) AS reach FROM own JOIN near_ref USING (lineage, sig) GROUP BY 1),
top AS (SELECT max(reach) AS top FROM radii), capped AS (SELECT *, coalesce(radius, top + 1) AS capped FROM radii CROSS JOIN top), at_k AS (SELECT k, avg(CASE WHEN radius IS NULL OR radius > k THEN 1.0 ELSE 0.0 END) AS v FROM capped, (SELECT unnest(range(0, top + 1)) AS k FROM top) GROUP BY 1)
SELECT 'n_lineages' AS metric, round(CAST(count(*) AS DOUBLE), 9) AS value FROM capped UNION ALL SELECT 'mean_radius', round(coalesce(avg(radius), 0), 9) FROM capped UNION ALL SELECT 'mean_radius_capped', round(avg(capped), 9) FROM capped UNION ALL SELECT 'aurc_chain', round(avg(v), 9) FROM at_k
UNION ALL SELECT 'robust_at_' || k, round(v, 9) FROM at_k UNION ALL SELECT 'mean_radius_' || label, round(avg(capped), 9) FROM capped GROUP BY label""")
def agg29_lineage_robustness(spark, d):
    return robustness.lineage_robustness(deliveries(spark, d).filter("split = 'test'"), 100000.0).withColumn("value", F.round("value", 9))


@query("SELECT string_agg(value || '=' || n, ', ' ORDER BY n DESC, value) AS summary FROM (SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)")
def agg34_counter_summary(spark, d):
    return summaries.top_text(table(spark, d, "customer"), "c_mktsegment", 3)


@query()
def agg35_table_digest(spark, d):
    return summaries.table_digest(table(spark, d, "orders"))


@query("SELECT o_custkey, sha1(string_agg(o_orderpriority, chr(10) ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1")
def agg36_ordered_digest(spark, d):
    return summaries.ordered_digest(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", F.col("o_orderpriority"))


# --- samples, ranks, splits -----------------------------------------------------------------------


@query(f"WITH {DELIVERIES} SELECT sample_id FROM deliveries ORDER BY sha1('salt' || chr(0) || sample_id), ord LIMIT 100")
def win01_bottom_k(spark, d):
    return sampling.bottom_k(deliveries(spark, d).select("sample_id", "ord"), 100, "salt").select("sample_id")


@query(f"""WITH {DELIVERIES}, h AS (SELECT sample_id, chain_family, row_number() OVER (PARTITION BY chain_family ORDER BY sha1('salt:' || chain_family || chr(0) || sample_id), ord) AS r, count(*) OVER (PARTITION BY chain_family) AS n FROM deliveries)
SELECT sample_id, chain_family FROM h WHERE r <= least(n, greatest(1, round_even(n * CAST(0.05 AS DOUBLE), 0)))""")
def win03_stratified(spark, d):
    return sampling.stratified(deliveries(spark, d).select("sample_id", "chain_family", "ord"), 0.05, "salt", "chain_family").select("sample_id", "chain_family")


@query(f"""WITH {DELIVERIES}, units AS (SELECT DISTINCT chain_family, parent_id FROM deliveries), h AS (SELECT *, row_number() OVER (PARTITION BY chain_family ORDER BY sha1('u:' || chain_family || chr(0) || parent_id), parent_id) AS r, count(*) OVER (PARTITION BY chain_family) AS n FROM units)
SELECT sample_id FROM deliveries JOIN h USING (chain_family, parent_id) WHERE r <= least(n, greatest(1, round_even(n * CAST(0.2 AS DOUBLE), 0)))""")
def win04_unit_sample(spark, d):
    return sampling.unit_sample(deliveries(spark, d).select("sample_id", "chain_family", "parent_id"), 0.2, "u", "chain_family", "parent_id").select("sample_id")


@query(f"WITH {DELIVERIES}, r AS (SELECT sample_id, split, row_number() OVER (PARTITION BY split ORDER BY ord) AS r FROM deliveries) SELECT sample_id, split FROM r WHERE r <= 166")
def win07_smoke(spark, d):
    return sampling.smoke(deliveries(spark, d).select("sample_id", "split", "ord")).select("sample_id", "split")


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_suppkey) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_quantity BETWEEN 10 AND 30 THEN 0 ELSE 1 END, CASE WHEN l_quantity BETWEEN 10 AND 30 THEN abs(l_quantity - 20) ELSE greatest(10 - l_quantity, l_quantity - 30) END,
  l_discount DESC, abs(l_tax * 100 + 20), l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_extendedprice) AS place FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, place FROM r WHERE n >= 20 AND place <= 5""")
def win08_curate(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("duration"), F.col("l_discount").alias("speech_ratio"), (F.col("l_tax") * 100).alias("mean_db"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]).alias("sample_id"),
    )
    return splits.curate(rows, "l_suppkey", 5, 20, (10.0, 30.0)).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("place").cast("long").alias("place"))


@query("SELECT c_mktsegment, c_custkey, printf('spk_%s_%04d', c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey)) AS id FROM customer")
def win11_dense_ids(spark, d):
    return splits.dense_ids(table(spark, d, "customer"), "c_mktsegment", "c_custkey", "spk")


APPORTION = """t AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), long AS (SELECT c_mktsegment, n, place, split, n * CAST(ratio AS DOUBLE) AS exact FROM t, (VALUES (0, 'train', 0.7), (1, 'dev', 0.15), (2, 'test', 0.15)) s(place, split, ratio)),
cut AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(exact - floor(exact), 9) DESC, place) AS r, n - sum(floor(exact)) OVER (PARTITION BY c_mktsegment) AS spare FROM long),
parts AS (SELECT c_mktsegment, place, split, CAST(floor(exact) + CASE WHEN r <= spare THEN 1 ELSE 0 END AS BIGINT) AS n FROM cut)"""


@query(f"WITH {APPORTION} SELECT c_mktsegment, split, n FROM parts")
def win12_apportion(spark, d):
    totals = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("total"))
    return splits.apportion(totals, ["c_mktsegment"], "total")


@query(f"""WITH {APPORTION}, ends AS (SELECT c_mktsegment, split, sum(n) OVER (PARTITION BY c_mktsegment ORDER BY place) AS upto, sum(n) OVER (PARTITION BY c_mktsegment ORDER BY place) - n AS above FROM parts),
ranked AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha1('split' || chr(0) || c_custkey), c_custkey) AS r FROM customer) SELECT ranked.c_mktsegment, c_custkey, split FROM ranked JOIN ends ON ends.c_mktsegment = ranked.c_mktsegment AND r > above AND r <= upto""")
def win13_assign_splits(spark, d):
    return splits.assign_splits(table(spark, d, "customer"), "c_mktsegment", "c_custkey", "split")


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha1('gen' || chr(0) || c_custkey), c_custkey) - 1 AS r FROM customer) SELECT c_custkey, unnest([['a', 'b', 'c', 'd', 'e', 'f'][(r * 2) % 6 + 1], ['a', 'b', 'c', 'd', 'e', 'f'][(r * 2 + 1) % 6 + 1]]) AS name FROM r""")
def win14_generators(spark, d):
    return splits.round_robin(table(spark, d, "customer"), "c_custkey", list("abcdef"), 2, "gen")


# --- tasks, plans, sinks, streams -----------------------------------------------------------------


@query(f"WITH {DELIVERIES} SELECT 'in_chain_detection' AS task_id, chain_family AS variant, split, sample_id FROM deliveries")
def tsk02_in_chain(spark, d):
    return tasks.in_chain(deliveries(spark, d))


@query(f"""WITH {DELIVERIES}, folds AS (SELECT DISTINCT chain_family, chain_template_id AS held FROM deliveries)
SELECT 'template_holdout' AS task_id, chain_family || '__' || held AS variant, split, sample_id FROM deliveries JOIN folds USING (chain_family) WHERE (chain_template_id = held AND split = 'test') OR (chain_template_id <> held AND split <> 'test')""")
def tsk03_template_holdout(spark, d):
    return tasks.template_holdout(deliveries(spark, d))


@query(f"""WITH {DELIVERIES}, rows AS (SELECT * FROM deliveries WHERE split <> 'dev'), folds AS (SELECT DISTINCT chain_family, chain_template_id AS held FROM rows),
used AS (SELECT chain_family || '__' || held AS variant, split, sample_id FROM rows JOIN folds USING (chain_family) WHERE (chain_template_id = held AND split = 'test') OR (chain_template_id <> held AND split = 'train')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY variant, split ORDER BY sha1('dev:' || variant || chr(0) || sample_id), sample_id) AS r, count(*) OVER (PARTITION BY variant, split) AS n FROM used)
SELECT 'template_holdout' AS task_id, variant, CASE WHEN split = 'train' AND n > 1 AND r <= least(n - 1, greatest(1, round_even(n * CAST(0.1 AS DOUBLE), 0))) THEN 'dev' ELSE split END AS split, sample_id FROM ranked""")
def tsk04_dev_fallback(spark, d):
    return tasks.template_holdout(deliveries(spark, d).filter("split <> 'dev'"))


def _task_sql(task: str, relation: str, where: str = "true") -> str:
    return f"""WITH RECURSIVE {MATCHES}, pairs AS (SELECT unnest([m.a, m.b]) AS sample_id FROM matched m JOIN deliveries l ON l.sample_id = m.a LEFT JOIN swap_pairs s ON s.pair_id = m.pair_id WHERE m.relation = '{relation}' AND l.split = 'test' AND {where})
SELECT '{task}' AS task_id, 'default' AS variant, split, sample_id FROM deliveries WHERE split <> 'test' UNION ALL SELECT '{task}', 'default', 'test', sample_id FROM pairs"""


@query(_task_sql("operator_substitution", "2"))
def tsk07_substitution(spark, d):
    return tasks.operator_substitution(matching.annotate(deliveries(spark, d)))


@query(_task_sql("parameter_perturbation", "1"))
def tsk08_perturbation(spark, d):
    return tasks.parameter_perturbation(matching.annotate(deliveries(spark, d)))


@query(_task_sql("order_swap", "3", "s.gap = 1"))
def tsk09_order_swap(spark, d):
    return tasks.order_swap(matching.annotate(deliveries(spark, d)))


@query(f"""WITH {DELIVERIES} SELECT 'delivery_robustness' AS task_id, 'default' AS variant, split, sample_id FROM deliveries WHERE split <> 'test' UNION ALL
SELECT 'delivery_robustness', 'default', 'test', sample_id FROM (SELECT sample_id, count(*) OVER (PARTITION BY parent_id, chain_family, label) AS n FROM deliveries WHERE split = 'test') WHERE n >= 2""")
def tsk10_delivery_robustness(spark, d):
    return tasks.delivery_robustness(deliveries(spark, d))


@query(f"""WITH {DELIVERIES} SELECT CASE WHEN grouping(t) = 1 THEN 'total' ELSE t END AS task_id, CASE WHEN grouping(chain_family) = 1 THEN 'total' ELSE chain_family END AS variant, CASE WHEN grouping(split) = 1 THEN 'total' ELSE split END AS split, count(*) AS n
FROM (SELECT 'in_chain_detection' AS t, chain_family, split FROM deliveries) GROUP BY ROLLUP (t, chain_family, split)""")
def agg32_pack_counts(spark, d):
    return tasks.pack_counts(tasks.in_chain(deliveries(spark, d)))


@query(f"""WITH {DELIVERIES}, p AS (SELECT chain_family AS variant, split, sample_id, row_number() OVER (PARTITION BY chain_family, split ORDER BY sha1('pack:' || split || chr(0) || sample_id), sample_id) AS r, count(*) OVER (PARTITION BY chain_family, split) AS n FROM deliveries)
SELECT 'in_chain_detection' AS task_id, variant, split, sample_id FROM p WHERE r <= greatest(1, round_even(n * CASE split WHEN 'train' THEN CAST(0.1 AS DOUBLE) WHEN 'test' THEN CAST(0.5 AS DOUBLE) ELSE 1 END, 0))""")
def win05_sample_pack(spark, d):
    return tasks.sample_pack(tasks.in_chain(deliveries(spark, d)), {"train": 0.1, "test": 0.5})


@query(f"WITH {DELIVERIES}, {planner.plan_sql('deliveries')} SELECT * FROM planned")
def pln01_jobs(spark, d):
    return planner.plan_jobs(deliveries(spark, d).select("parent_id"))


@query("SELECT f AS chain_family, n * v AS jobs FROM (SELECT count(DISTINCT o_custkey // 30) AS n FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey), (VALUES ('direct', 1), ('platform_like', 4), ('telephony', 4), ('simreplay', 4), ('hybrid', 4)) x(f, v)")
def agg33_job_counts(spark, d):
    return planner.count_jobs(deliveries(spark, d))


@query("SELECT f AS chain_family, n * v AS jobs FROM (SELECT count(DISTINCT o_custkey // 30) AS n FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey), (VALUES ('direct', 1), ('platform_like', 4), ('telephony', 4), ('simreplay', 4), ('hybrid', 4)) x(f, v)")
def pln01_emitted(spark, d):
    return pln01_jobs(spark, d).groupBy("chain_family").agg(F.count_distinct("job_id").alias("jobs"))


@query("""WITH p AS (SELECT event_id, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'bonafide' ELSE 'spoof' END AS label, user_id FROM events), r AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, sum(CASE WHEN label = 'spoof' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) - 1 AS k FROM p)
SELECT event_id AS ord, CASE WHEN user_id % 4 = 0 THEN printf('spk_%06d', i) ELSE CAST(user_id AS VARCHAR) END AS speaker, 'e' || event_id AS sample_id, CASE WHEN label = 'spoof' THEN printf('A%02d', CAST(k % 13 + 7 AS INTEGER)) ELSE '-' END AS attack, label FROM r""")
def snk12_protocol(spark, d):
    events = table(spark, d, "events")
    first = events.agg(F.min("event_type").alias("first"))
    rows = events.crossJoin(F.broadcast(first)).select(  # one row
        F.col("event_id").alias("ord"), F.when(F.col("user_id") % 4 != 0, F.col("user_id").cast("string")).alias("speaker_id"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("sample_id"), F.when(F.col("event_type") == F.col("first"), "bona_fide").otherwise("other").alias("label"),
    )
    return writers.attack_label(rows)


STREAMED = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1"


def _event_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query(STREAMED)
def stm01_available_now(spark, d):
    return streaming.analyse(spark, d, "events.parquet", lambda rows: rows.select("event_id", "event_type", "user_id", "value"), _event_summary)


@query(STREAMED)
def stm06_batch(spark, d):
    return _event_summary(table(spark, d, "events"))


@query(f"""WITH {TRANSCRIPTS}, c AS (SELECT conv_id, turn, replace(reference, ' ', '') AS a, replace(hypothesis, ' ', '') AS b FROM transcripts), r AS (SELECT conv_id, turn, CASE WHEN len(a) > 0 THEN 0.0 END AS parent_cer, CASE WHEN len(a) > 0 THEN levenshtein(a, b) / len(a) WHEN len(b) > 0 THEN 1.0 END AS child_cer FROM c)
SELECT conv_id, turn, parent_cer, child_cer, child_cer - parent_cer AS cer_drift FROM r""")
def prj13_transcript_metrics(spark, d):
    rows = transcripts(spark, d).select("conv_id", "turn", "reference", F.col("reference").alias("parent"), F.col("hypothesis").alias("child"), F.lit("en").alias("language"))
    return preservation.transcript_metrics(rows).select("conv_id", "turn", "parent_cer", "child_cer", "cer_drift")


@query("SELECT conv_id, turn, coalesce(text, '') AS hypothesis, 'ok' AS status FROM conversations")
def udf06_identity_backend(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("reference"))
    return preservation.transcribe(rows).select("conv_id", "turn", "hypothesis", "status")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains from raw lines, mined parameter pairs, greedy matches, and the scores' robustness over them."""
    return agg25_parameter_robustness(spark, sf_dir)
