"""Queries of single steps that the larger operators are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import DELIVERIES, deliveries, table
from .functions import arrays, buckets, chains, hashing, text
from .operators import matching, metrics, robustness, splits, summaries, tasks
from .queries import EDITS, OWN_TEST, SCORED
from .registry import query
from .sources import readers

GROUP = "parent_id, chain_family, label"


@query(f"WITH {DELIVERIES} SELECT sample_id FROM deliveries WHERE split = 'test'")
def flt01_one_split(spark, d):
    return readers.select_rows(deliveries(spark, d), splits=["test"]).select("sample_id")


@query(f"WITH {DELIVERIES} SELECT sample_id, chain_family FROM deliveries WHERE chain_family IN ('direct', 'hybrid') AND split <> 'dev'")
def flt02_known_families(spark, d):
    """Rows of other families or splits go."""
    rows = deliveries(spark, d).withColumn("chain_family", F.when(F.col("chain_family").isin("direct", "hybrid"), F.col("chain_family")).otherwise("else")).withColumn("split", F.when(F.col("split") != "dev", F.col("split")).otherwise("x"))
    return tasks.supported(rows).select("sample_id", "chain_family")


@query(f"WITH {DELIVERIES} SELECT sample_id, split FROM deliveries WHERE split <> 'test'")
def flt04_train_and_dev(spark, d):
    return tasks._train_dev(deliveries(spark, d), "t").select("sample_id", "split")


@query(f"WITH {DELIVERIES} SELECT split, count(*) AS n FROM deliveries GROUP BY 1")
def flt05_no_split_is_all(spark, d):
    return readers.select_rows(deliveries(spark, d), splits=[]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


PAIRED = f"""{DELIVERIES}, p AS (SELECT a.sample_id AS a, b.sample_id AS b, a.sig AS sa, b.sig AS sb, list_filter(range(1, len(a.sig) + 1), lambda i: a.sig[i] <> b.sig[i]) AS d FROM deliveries a JOIN deliveries b USING ({GROUP}) WHERE len(a.sig) = len(b.sig) AND a.sample_id < b.sample_id)"""


def _same_length(spark, d):
    keys = ["parent_id", "chain_family", "label", "n"]
    own = deliveries(spark, d).withColumn("n", F.size("sig"))
    a, b = (own.select(*keys, F.col("sample_id").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
    return a.join(b, keys).filter("a < b")


@query(f"WITH {PAIRED} SELECT a, b, CASE WHEN len(d) > 0 AND len(list_filter(d, lambda i: split_part(sa[i], '[', 1) = split_part(sb[i], '[', 1))) = 0 THEN 'indices=' || array_to_string(list_transform(d, lambda i: i - 1), ',') END AS detail FROM p")
def flt18_substitution(spark, d):
    return _same_length(spark, d).select("a", "b", chains.substitution_detail(F.col("sa"), F.col("sb")).alias("detail"))


@query(f"WITH {PAIRED} SELECT a, b, CASE WHEN len(d) = 2 AND sa[d[1]] = sb[d[2]] AND sa[d[2]] = sb[d[1]] THEN CAST(d[2] - d[1] AS INTEGER) END AS gap FROM p")
def flt19_swap_gap(spark, d):
    return _same_length(spark, d).select("a", "b", chains.swap_gap(F.col("sa"), F.col("sb")).alias("gap"))


@query(f"WITH {DELIVERIES}, {OWN_TEST}, {EDITS.split('refs AS')[0].rstrip().rstrip(',')} SELECT CASE WHEN len(sa) <> len(sb) THEN 'length' WHEN len(list_filter(range(1, len(sa) + 1), lambda i: sa[i] <> sb[i])) = 1 THEN 'slot' ELSE 'swap' END AS kind, count(*) AS n FROM edges GROUP BY 1")
def flt25_kinds_of_edits(spark, d):
    edges = matching.edit_edges(matching.lineages(deliveries(spark, d).filter("split = 'test'")), ["lineage"])
    kind = F.when(F.size("sig_a") != F.size("sig_b"), "length").when(F.size(chains.differences(F.col("sig_a"), F.col("sig_b"))) == 1, "slot").otherwise("swap")
    return edges.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


COMPLETE = f"""{DELIVERIES}, g AS (SELECT *, speaker_id || chain_family AS grp FROM deliveries), c AS (SELECT grp, min(sample_id) AS id_l, max(sample_id) AS id_r, min(y) AS y FROM g GROUP BY 1 HAVING count(*) = 2 AND min(y) = max(y))"""


@query(f"WITH {COMPLETE} SELECT grp AS \"group\", id_l, id_r, y FROM c")
def jn08_complete_pairs(spark, d):
    """Groups of exactly two rows of one label, the smaller id on the left."""
    rows = deliveries(spark, d).withColumn("grp", F.concat(F.col("speaker_id").cast("string"), "chain_family"))
    return robustness.complete_pairs(rows, "grp").select("group", "id_l", "id_r", "y")


@query(f"WITH {DELIVERIES}, p AS (SELECT DISTINCT parent_id FROM deliveries) SELECT parent_id, unnest(['direct', 'platform_like', 'telephony', 'simreplay', 'hybrid']) AS chain_family FROM p")
def jn17_parents_by_families(spark, d):
    families = F.explode(F.array(*map(F.lit, tasks.FAMILIES))).alias("chain_family")
    return deliveries(spark, d).select("parent_id").distinct().select("parent_id", families)


@query(f"WITH {SCORED}, h AS (SELECT *, CASE WHEN s >= 250000 THEN 1 ELSE 0 END AS hit FROM scored) SELECT chain_family, CASE WHEN sum(hit) + sum(y) > 0 THEN 2.0 * sum(hit * y) / (sum(hit) + sum(y)) ELSE 0 END AS f1 FROM h GROUP BY 1")
def agg22_f1(spark, d):
    return metrics.accuracy_f1(deliveries(spark, d), ["chain_family"], threshold=250000.0).select("chain_family", "f1")


@query(f"WITH {DELIVERIES} SELECT round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 6) AS iqr FROM deliveries")
def agg28_iqr(spark, d):
    return robustness.score_iqr(deliveries(spark, d)).select(F.round("iqr", 6).alias("iqr"))


@query(f"WITH {COMPLETE}, j AS (SELECT (l.score >= 150000) = (r.score >= 150000) AS same, (l.score >= 150000) = (c.y = 1) AND (r.score >= 150000) = (c.y = 1) AS ok FROM c JOIN deliveries l ON l.sample_id = id_l JOIN deliveries r ON r.sample_id = id_r) SELECT count(*) AS pairs, round(avg(CAST(same AS INTEGER)), 9) AS consistency, round(avg(CAST(ok AS INTEGER)), 9) AS joint_accuracy FROM j")
def agg27_paired_rows(spark, d):
    rows = deliveries(spark, d).withColumn("grp", F.concat(F.col("speaker_id").cast("string"), "chain_family"))
    return robustness.pair_robustness(rows, "grp", 150000.0).filter("scope = 'all'").select("pairs", F.round("consistency", 9).alias("consistency"), F.round("joint_accuracy", 9).alias("joint_accuracy"))


@query(f"""WITH RECURSIVE {DELIVERIES}, {OWN_TEST}, {EDITS} SELECT lineage, CASE WHEN max(y) = 1 THEN 'bonafide' ELSE 'spoof' END AS label, min(distance) FILTER (WHERE (score >= 100000) <> (y = 1)) AS radius, max(distance) AS reach FROM own JOIN near_ref USING (lineage, sig) GROUP BY 1""")
def agg30_radii(spark, d):
    """A lineage is robust at k where its radius is null or above k."""
    return robustness.lineage_radii(deliveries(spark, d).filter("split = 'test'"), 100000.0)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY CASE WHEN l_quantity BETWEEN 10 AND 30 THEN 0 ELSE 1 END, CASE WHEN l_quantity BETWEEN 10 AND 30 THEN abs(l_quantity - 20) ELSE greatest(10 - l_quantity, l_quantity - 30) END, l_discount DESC, abs(l_tax * 100 + 20), l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_extendedprice) AS place FROM lineitem""")
def win10_candidate_order(spark, d):
    """All candidates as one speaker's."""
    rows = table(spark, d, "lineitem").select(
        F.lit("s").alias("speaker"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("duration"), F.col("l_discount").alias("speech_ratio"), (F.col("l_tax") * 100).alias("mean_db"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]).alias("sample_id"),
    )
    return splits.curate(rows, "speaker", 1 << 40, 1, (10.0, 30.0)).select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 77")
def win19_limit(spark, d):
    return readers.select_rows(table(spark, d, "events"), limit=77, ord="event_id").select("event_id")


@query(f"WITH {DELIVERIES}, {OWN_TEST} SELECT lineage, array_to_string(sig, '>') AS chain FROM (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY len(sig), sample_id) AS r FROM own) WHERE r = 1")
def win20_reference_rows(spark, d):
    own = matching.lineages(deliveries(spark, d).filter("split = 'test'"))
    return own.groupBy("lineage").agg(F.array_join(F.min_by("sig", F.struct(F.size("sig"), "sample_id")), ">").alias("chain"))


@query("SELECT count(*) AS shared FROM (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) INTERSECT SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT max(event_type) FROM events))")
def set02_shared_speakers(spark, d):
    events = table(spark, d, "events")
    ends = events.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    both = summaries.split_overlap(events.filter(F.col("event_type").isin(ends["a"], ends["b"])), "event_type", "user_id")
    return both.select("shared")


@query(f"WITH {DELIVERIES} SELECT parent_id, array_to_string(list_sort(list_filter(['direct', 'hybrid', 'simreplay'], lambda f: NOT list_contains(list(DISTINCT chain_family), f))), ',') AS missing FROM deliveries GROUP BY 1")
def set03_missing_families(spark, d):
    want = F.array(F.lit("direct"), F.lit("hybrid"), F.lit("simreplay"))
    return deliveries(spark, d).groupBy("parent_id").agg(F.array_join(F.array_sort(F.array_except(want, F.collect_set("chain_family"))), ",").alias("missing"))  # five families at most


@query(f"WITH {DELIVERIES}, {OWN_TEST} SELECT lineage, count(DISTINCT sig) AS chains FROM own GROUP BY 1")
def set06_distinct_chains(spark, d):
    own = matching.lineages(deliveries(spark, d).filter("split = 'test'"))
    return matching.numbered(own, ["lineage"]).groupBy("lineage").agg(F.count("node").alias("chains"))


@query("SELECT o_orderkey, sha1('swap' || chr(0) || least(o_orderpriority, o_orderstatus) || chr(0) || greatest(o_orderpriority, o_orderstatus)) AS pair_id FROM orders")
def grf03_pair_ids(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hashing.pair_id("swap", F.col("o_orderpriority"), F.col("o_orderstatus")).alias("pair_id"))


@query(f"WITH {DELIVERIES} SELECT sample_id, parent_id || '|' || chain_family || '|' || CASE label WHEN 'bona_fide' THEN 'bonafide' ELSE label END AS lineage FROM deliveries WHERE speaker_id % 7 > 0")
def grf04_lineage_keys(spark, d):
    """Rows of unknown label have no lineage."""
    rows = deliveries(spark, d).withColumn("label", F.when(F.col("speaker_id") % 7 > 0, F.col("label")).otherwise("?"))
    return matching.lineages(rows).select("sample_id", "lineage")


@query(f"WITH {DELIVERIES} SELECT sample_id, parent_id, chain_family, label FROM deliveries WHERE speaker_id % 5 > 0")
def grf05_minable_rows(spark, d):
    """Rows with a blank part of their group take no part."""
    rows = deliveries(spark, d).withColumn("parent_id", F.when(F.col("speaker_id") % 5 > 0, F.concat(F.lit(" "), "parent_id")).otherwise("\t"))
    return matching.minable(rows).select("sample_id", "parent_id", "chain_family", "label")


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'e' || event_id ELSE '[\"\",\"' || event_type || '\"]' END AS token FROM events WHERE event_id % 3 > 0 OR event_type <> ''")
def grf07_row_tokens(spark, d):
    sample = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit(" e"), F.col("event_id").cast("string")))
    return table(spark, d, "events").select("event_id", F.coalesce(text.clean(sample), F.to_json(F.array(F.lit(""), F.col("event_type")))).alias("token"))


@query("SELECT doc_id, len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS words, length(replace(t, ' ', '')) AS chars FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS t FROM documents)")
def str04_token_counts(spark, d):
    plain = text.strip(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z0-9 ]", " "), " +", " "))
    rows = table(spark, d, "documents").select("doc_id", plain.alias("t"))
    return rows.select("doc_id", F.size(text.word_tokens(F.col("t"), F.lit("en"))).cast("long").alias("words"), F.size(text.char_tokens(F.col("t"))).cast("long").alias("chars"))


@query("SELECT a.p_partkey, levenshtein(a.p_brand, b.p_brand) AS distance, CAST(levenshtein(a.p_brand, b.p_brand) AS DOUBLE) / length(a.p_brand) AS rate FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def str06_sequence_distance(spark, d):
    """Distance of the letters of two brands, as sequences, and the rate of error."""
    part = table(spark, d, "part")
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    both = part.select("p_partkey", letters("p_brand").alias("a")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), letters("p_brand").alias("b")), "p_partkey")
    distance = text.sequence_distance(F.col("a"), F.col("b"))
    return both.select("p_partkey", distance.cast("long").alias("distance"), text.error_rate(F.col("a"), distance, F.col("b")).alias("rate"))


@query(f"WITH {DELIVERIES} SELECT sample_id, array_to_string(list_transform(sig, lambda t: split_part(t, '[', 1)), ',') AS names FROM deliveries")
def str10_operator_names(spark, d):
    return deliveries(spark, d).select("sample_id", F.array_join(F.transform("sig", chains.operator_name), ",").alias("names"))


@query("SELECT event_type, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'bonafide' ELSE 'spoof' END AS label, count(*) AS n FROM events GROUP BY 1")
def str15_protocol_labels(spark, d):
    """What isn't known is spoof."""
    events = table(spark, d, "events")
    first = events.agg(F.min("event_type")).first()[0]
    label = text.protocol_label(F.when(F.col("event_type") == first, " Bona_Fide").otherwise(F.col("event_type")))
    return events.groupBy("event_type", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 'reencode[bitrate=' || CASE WHEN l_quantity <= 16 THEN 'very_low' WHEN l_quantity <= 24 THEN 'low' WHEN l_quantity <= 32 THEN 'medium' ELSE 'high' END || ',codec=' || l_returnflag || ',encode_sr=' || CASE WHEN l_quantity * 1000 <= 8000 THEN '8k' WHEN l_quantity * 1000 <= 16000 THEN '16k' WHEN l_quantity * 1000 <= 24000 THEN '24k' ELSE '32k_plus' END || ']' AS codec,
  'packet_loss[concealment=' || l_linestatus || ',plr=' || CASE WHEN l_quantity <= 2 THEN 'light' WHEN l_quantity <= 5 THEN 'moderate' ELSE 'severe' END || ']' AS loss, 'other' AS other FROM lineitem""")
def arr05_codec_and_loss_tokens(spark, d):
    q = F.col("l_quantity")
    codec = F.struct(F.lit("reencode").alias("op"), F.col("l_returnflag").alias("codec"), F.concat(q.cast("string"), F.lit("K")).alias("bitrate"), (q * 1000).alias("encode_sample_rate"))
    loss = F.struct(F.lit("packet_loss").alias("op"), q.cast("string").alias("loss_rate_pct"), F.col("l_linestatus").alias("concealment"))
    other = F.struct(F.lit(" other ").alias("op"), F.lit("x").alias("codec"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", chains.token(codec, ("codec", "bitrate", "encode_sample_rate")).alias("codec"), chains.token(loss, ("loss_rate_pct", "concealment")).alias("loss"), chains.token(other, ("codec",)).alias("other"),
    )


@query(f"""WITH {DELIVERIES} SELECT CASE WHEN len(sig) > 1 THEN '["' || array_to_string(list_sort(sig), '","') || '"]' ELSE '' END AS key, CASE WHEN len(sig) > 1 THEN sig[-1] ELSE '' END AS endpoint, count(*) AS n FROM deliveries GROUP BY 1, 2""")
def arr09_keys_of_chains(spark, d):
    """Empty chains have blank keys."""
    sig = F.when(F.size("sig") > 1, F.col("sig")).otherwise(F.array().cast("array<string>"))
    rows = deliveries(spark, d).withColumn("sig", sig)
    return rows.groupBy(chains.multiset_key(F.col("sig")).alias("key"), chains.endpoint_key(F.col("sig")).alias("endpoint")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DELIVERIES} SELECT array_to_string(sig, '>') AS chain, count(*) AS n FROM deliveries GROUP BY sig")
def arr15_grouped_chains(spark, d):
    return deliveries(spark, d).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).select(F.array_join("sig", ">").alias("chain"), "n")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <= 12 THEN 'low' WHEN l_quantity <= 24 THEN 'medium' ELSE 'high' END AS snr, CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END AS hit FROM lineitem")
def mth06_snr(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", buckets.bucket(q, buckets.SNR).alias("snr"), (q >= 25).cast("int").alias("hit"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 1 ELSE 64 + vec_id % 2 END AS frames, CASE WHEN vec_id % 10 = 0 THEN CAST('inf' AS DOUBLE) ELSE round(list_max(list_transform(e, lambda x: abs(x))), 6) END AS peak, CASE WHEN vec_id % 10 = 0 THEN 1.0 ELSE round(len(list_filter(e, lambda x: abs(x) >= 0.3)) / len(e), 6) END AS clipped, vec_id % 10 = 0 OR vec_id % 2 = 1 AS has_nan, false AS has_inf FROM v""")
def sig16_inspected(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    signal = F.when(F.col("vec_id") % 10 == 0, F.array(F.lit(float("nan")))).when(F.col("vec_id") % 2 == 1, F.concat(e, F.array(F.lit(float("nan"))))).otherwise(e)
    rows = table(spark, d, "embeddings").select("vec_id", signal.alias("s")).select("vec_id", arrays.inspect(F.col("s"), 0.3).alias("i"))
    return rows.select("vec_id", F.col("i.frames"), F.round("i.peak", 6).alias("peak"), F.round("i.clipped", 6).alias("clipped"), "i.has_nan", "i.has_inf")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: 3 * CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT *, list_max(list_transform(e, lambda x: abs(x))) AS peak FROM v)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: CASE WHEN peak > 0.5 THEN tanh(2 * x) / tanh(2) * 0.5 ELSE x END)), 6) AS soft, round(list_sum((list_concat(list_concat(e, e), e))[1:150]), 6) AS tiled, round(list_sum(e[1:10]), 6) AS cut FROM p""")
def sig14_limited_and_tiled(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double") * 3)
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6)
    return table(spark, d, "embeddings").select("vec_id", e.alias("e")).select("vec_id", total(arrays.soft_clip(F.col("e"), 0.5)).alias("soft"), total(arrays.tile(F.col("e"), 150)).alias("tiled"), total(arrays.tile(F.col("e"), 10)).alias("cut"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a_b__' || event_type WHEN 1 THEN 'x__' || event_type ELSE 'fold' END AS name FROM events""")
def tsk05_fold_names(spark, d):
    part = F.col("event_id") % 3
    head = F.when(part == 0, "a b").when(part == 1, "..x").otherwise("--")
    return table(spark, d, "events").select("event_id", text.fold_name(head, F.when(part < 2, F.col("event_type")).otherwise("_.")).alias("name"))
