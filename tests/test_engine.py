import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone import queries, queries_files, queries_parts, queries_runs, queries_values, registry  # noqa: F401  they register queries
from marlstone.functions import arrays, buckets, chains, hashing, text
from marlstone.operators import jobs, joins, matching, metrics, preservation, projections, ranks, robustness, runs, sampling, signals, splits, states, summaries, tasks, validation
from marlstone.plans import catalogue, planner
from marlstone.sources import audio, readers, writers
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLES[name]) == ""


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_bucket_edges_and_numbers(spark):
    rows = [("0.35",), ("0.65",), ("24K",), ("x",), (None,), ("1d",), ("16",)]
    got = values(spark, rows, "x string", buckets.bucket(F.col("x"), buckets.RT60), buckets.bitrate_bucket(F.col("x")), buckets.compact_number(F.col("x")))
    assert got == [("medium", "very_low", "0.35"), ("long", "very_low", "0.65"), (None, "low", "24K"), (None, None, "x"), (None, None, None), (None, None, "1d"), ("long", "very_low", "16")]


def test_bad_operator_json_is_empty(spark):
    rows = [("{}",), ("[]",), ("nonsense",), (None,), ('[{"op":"rir","rt60":0.2,"room":{"name":"small"}}]',)]
    got = values(spark, rows, "x string", chains.signature(F.col("x"), F.lit('["a"]')))
    assert [r[0] for r in got] == [["a"]] * 4 + [["rir[room=small,rt60=short]"]]


def test_word_distance_equals_brute_force(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = following(row, i, x, b)
        return row[-1]

    def following(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return out

    pick = random.Random(5)
    rows = [([pick.choice("abcdefg") * 3 for _ in range(pick.randrange(9))], [pick.choice("abcdefg") * 3 for _ in range(pick.randrange(9))]) for _ in range(40)] + [([f"w{k}" for k in range(300)], [f"w{k}" for k in range(50, 400)])]
    got = values(spark, rows, "a array<string>, b array<string>", text.sequence_distance(F.col("a"), F.col("b")))
    assert [r[0] for r in got] == [distance(a, b) for a, b in rows]


def test_empty_references(spark):
    got = values(spark, [("", ""), ("", "x"), ("a b", ""), (None, None)], "a string, b string", text.word_error_rate(F.col("a"), F.col("b"), F.lit("en")), text.char_error_rate(F.col("a"), F.col("b"), F.lit("en")))
    assert got == [(None, None), (1.0, 1.0), (1.0, 1.0), (None, None)]


def greedy(pairs):
    used, out = set(), []
    for a, b, name in sorted(pairs, key=lambda p: p[2]):
        if not used & {a, b}:
            used |= {a, b}
            out.append((a, b, name))
    return sorted(out)


def test_greedy_matching_equals_one_pass(spark):
    pick = random.Random(3)
    pairs = [(f"n{a}", f"n{b}", f"{pick.random():.12f}") for a, b in itertools.combinations(range(25), 2) if pick.random() < 0.3]
    got = matching.greedy_matching(spark.createDataFrame(pairs, "a string, b string, pair_id string"))
    assert sorted(map(tuple, got.collect())) == greedy(pairs)
    assert matching.greedy_matching(spark.createDataFrame([], "a string, b string, pair_id string")).count() == 0


def test_blank_group_parts_take_no_part(spark):
    rows = spark.createDataFrame([("a", "p", "f", " ", ["x[1]"]), ("b", None, "f", "spoof", ["x[2]"]), ("c", "p", "f", "spoof", []), ("d", "p", "f", "spoof", ["x[1]"])], "sample_id string, parent_id string, chain_family string, label string, sig array<string>")
    assert sum(m.count() for m in matching.match_all(rows).values()) == 0


def test_metrics_of_one_class_and_of_nothing(spark):
    schema = "sample_id string, score string, label string"
    for rows in ([("a", "1", "bona_fide"), ("b", "x", "1")], [], [("a", "1", "who")]):
        df = spark.createDataFrame(rows, schema)
        assert [r.auc for r in metrics.auc(df, []).collect()] in ([0.0], [])
        assert [(r.eer, r.threshold) for r in metrics.eer(df, []).collect()] in ([(1.0, 0.0)], [])
        assert [r.eer for r in metrics.eer_or_zero(df, []).collect()] in ([0.0], [])
        base = runs.base_metrics(df, []).first()
        assert (base.eer, base.auc, base.n_samples) == (0.0, 0.0, len(rows)) and base.calibrated_threshold == (0.0 if len(rows) == 2 else 0.5)


def test_groups_of_three_are_no_pairs(spark):
    rows = spark.createDataFrame([(f"s{k}", float(k), "spoof", "g" if k < 3 else "h") for k in range(5)], "sample_id string, score double, label string, grp string")
    assert [r.group for r in robustness.complete_pairs(rows, "grp").collect()] == ["h"]
    none = robustness.pair_robustness(rows.filter("grp = 'g'"), "grp", 0.5).collect()
    assert [(r.scope, r.pairs, r.drift) for r in none] == [("all", 0, 0.0)]


def test_half_even_sample_size(spark):
    assert [sampling.ratio_sample(spark.range(n).select(F.col("id").alias("sample_id"), F.col("id").alias("ord")), 0.5, "s").count() for n in (1, 3, 5)] == [1, 2, 2]


def test_signals_keep_their_length_and_are_repeatable(spark):
    rows = spark.createDataFrame([([0.1] * 700, '[{"op":"packet_loss","loss_rate_pct":30,"frame":40},{"op":"noise","snr_db":10},{"op":"rir"},{"op":"jitter","frame":40}]'), ([0.2], "[]"), (None, "[]"), ([0.1], "no JSON")], "x array<double>, ops string")
    one, two = (signals.apply(rows, "x", "ops", F.lit(7)).collect() for _ in range(2))
    assert [r.rendered for r in one] == [r.rendered for r in two]
    assert len(one[0].rendered) == 700 and one[1].rendered == [0.2] and one[2].rendered is None and one[3].rendered is None


def test_vectors_without_a_norm(spark):
    rows = [([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], []), ([3.0, 0.0], [2.0, 0.0])]
    assert [r[0] for r in values(spark, rows, "a array<double>, b array<double>", arrays.cosine(F.col("a"), F.col("b")))] == [None, None, None, 1.0]


def test_plan_is_the_same_however_dealt(spark):
    parents = spark.createDataFrame([(f"p{k}",) for k in range(20)], "parent_id string")
    a, b = (sorted(map(tuple, planner.plan_jobs(p).collect())) for p in (parents.repartition(7), parents.coalesce(1)))
    assert a == b and len(a) == 20 * sum(c["variants_per_parent"] for c in catalogue.FAMILIES.values()) and len({r[4] for r in a}) == len(a)
    with pytest.raises(ValueError):
        planner.in_order(planner.compiled([{"op": "a"}, {"op": "a"}], {}), ["a", "b"])


def test_plans_follow_their_templates(spark):
    jobs = planner.plan_jobs(spark.createDataFrame([(f"p{k}",) for k in range(80)], "parent_id string"), seed=3).collect()
    by_parent = {}
    for j in jobs:
        ops, template = json.loads(j.operator_params), catalogue.FAMILIES[j.chain_family]["templates"][j.chain_template_id]
        assert [o["op"] for o in ops] == [o["op"] for o in template] == json.loads(j.operator_seq)
        assert j.job_id == f"{j.parent_id}__{j.chain_family}__{j.chain_template_id}" + ("" if j.chain_family == "direct" else f"__v{j.chain_variant_index + 1:02d}")
        before = None
        for o, spec in zip(ops, template):
            for k, v in spec.items():
                options = catalogue.POOLS[v["$pool"]] if isinstance(v, dict) and "$pool" in v else v["$choice"] if isinstance(v, dict) else [v]
                assert o[k] in options or (k, o.get("codec")) == ("encode_sample_rate", "gsm"), (k, o)
            if o["op"] == "reencode":
                known = before or o.get("default_codec", "aac")
                assert o["codec"] == known if o["mode"] == "same" else o["codec"] != known
            if o["op"] in ("codec", "reencode"):
                before = o["codec"]
                assert (o.get("encode_sample_rate"), o.get("decode_sample_rate")) == (8000, 8000) if before == "gsm" else "decode_sample_rate" not in o
        by_parent.setdefault((j.parent_id, j.chain_family), {})[j.chain_template_id] = sorted(ops, key=lambda o: o["op"])
    for (_, family), own in by_parent.items():
        groups = catalogue.FAMILIES[family].get("paired_template_groups", [])
        # of one group all templates are there, with the same parameters
        assert not groups or any(set(g) <= set(own) and all(own[t] == own[g[0]] for t in g) for g in groups)
    assert {o["room"]["name"] for j in jobs for o in json.loads(j.operator_params) if "room" in o} == {"small", "medium", "large"}


def test_catalogue_has_all_templates():
    assert [len(c["templates"]) for c in catalogue.FAMILIES.values()] == [1, 6, 10, 7, 9] and len(catalogue.POOLS) == 19
    own = {"x": {"variants_per_parent": 2, "templates": {"t": [{"op": "codec", "codec": {"$choice": ["gsm", "opus"]}}, {"op": "reencode", "codec": {"$previous": "last_codec"}}]}}}
    codec = dict(planner.compiled(own["x"]["templates"]["t"], {})[1])["codec"]
    assert codec.texts(str) == ["gsm", "opus"]


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a b", 'say "x"', None), ("c", "l1\nl2", "z")], "sample_id string, t string, u string")
    writers.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(tuple(x or "" for x in r) for r in readers.csv_rows(spark, str(tmp_path / "csv")).collect()) == [("a b", 'say "x"', ""), ("c", "l1\nl2", "z")]
    with pytest.raises(ValueError):
        writers.write_csv(rows.filter("false"), str(tmp_path / "none"))
    assert readers.scores(spark, str(tmp_path / "missing")).count() == 0
    writers.write_scores(spark.createDataFrame([("d/e.flac", 0.5)], "sample_id string, score double"), str(tmp_path / "raw"))
    assert [tuple(r)[:2] for r in readers.raw_scores(spark, str(tmp_path / "raw")).collect()] == [("e", "0.5")]
    protocol = spark.createDataFrame([(1, "s", "a", "spoof"), (2, None, "b", "bona_fide")], "ord int, speaker_id string, sample_id string, label string")
    writers.write_protocol(protocol, str(tmp_path / "protocol"))
    assert sorted(map(tuple, readers.protocol(spark, str(tmp_path / "protocol")).collect())) == [("a", 0), ("b", 1)]


def test_protocol_numbers_run_on_over_ranges(spark):
    pick = random.Random(3)
    rows = [(k, None if pick.random() < 0.3 else f"s{k}", f"e{k}", pick.choice(["spoof", "bona_fide"])) for k in range(3000)]
    frame = spark.createDataFrame(pick.sample(rows, len(rows)), "ord int, speaker_id string, sample_id string, label string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        made = writers.attack_label(frame)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, turn = [], 0
    for k, speaker, sample, label in rows:
        spoof = label == "spoof"
        want.append((k, speaker or f"spk_{k:06d}", sample, f"A{turn % 13 + 7:02d}" if spoof else "-", "spoof" if spoof else "bonafide"))
        turn += spoof
    assert sorted(map(tuple, made.collect())) == want


def test_protocol_holds_every_event(spark):
    assert queries.snk12_protocol(spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_coverage_names_missing_families_and_holds_every_parent(spark):
    rows = [("a", "direct"), ("a", "hybrid"), ("a", "telephony"), ("b", "direct"), ("b", "direct"), ("c", "other"), ("d", "hybrid"), ("d", None), ("d", "telephony")]
    got = dict(map(tuple, summaries.parent_coverage(spark.createDataFrame(rows, "parent_id string, chain_family string"), ["direct", "hybrid", "telephony"]).collect()))
    assert got == {"complete": 1, "incomplete": 3, "missing:direct": 2, "missing:hybrid": 2, "missing:telephony": 2}
    states = dict(map(tuple, queries.agg12_parent_coverage(spark, SF).collect()))
    assert states.get("complete", 0) + states.get("incomplete", 0) == queries.deliveries(spark, SF).select("parent_id").distinct().count()


def test_enrich_keeps_the_last_metadata_and_repairs_labels(spark):
    scores = spark.createDataFrame([("a", ""), ("b", "spoof"), ("z", None)], "sample_id string, label string")
    meta = spark.createDataFrame([(" a", 1, "x", "old"), ("a", 2, "bona_fide", "new"), ("b", 3, "bona_fide", "m")], "sample_id string, ord int, label string, m string")
    assert sorted(tuple(x or "" for x in r) for r in joins.enrich(scores, meta).collect()) == [("a", "bona_fide", "new"), ("b", "spoof", "m"), ("z", "", "")]


def test_digest_ignores_order(spark):
    rows = spark.range(50).withColumn("x", F.when(F.col("id") % 3 > 0, F.col("id")))
    a, b, c = (summaries.table_digest(r).first().digest for r in (rows, rows.orderBy(F.desc("id")).repartition(5), rows.limit(49)))
    assert a == b != c


def test_shards_cover_all_rows(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("t"))
    counts = {r.s: r.n for r in rows.groupBy(hashing.md5_shard(F.col("t"), 3).alias("s")).agg(F.count("*").alias("n")).collect()}
    assert sorted(counts) == [0, 1, 2] and sum(counts.values()) == 200


def test_apportionment_sums_to_the_total(spark):
    rows = spark.createDataFrame([(n,) for n in range(12)], "n long").withColumn("k", F.col("n"))
    got = splits.apportion(rows, ["k"], "n").groupBy("k").agg(F.sum("n").alias("s")).collect()
    assert all(r.k == r.s for r in got)


def test_ranks_over_many_ranges_equal_brute_force(spark):
    pick = random.Random(4)
    rows = [(pick.choice(["a", "b", None, "hot", "hot", "hot"]), pick.randrange(9), k, pick.randrange(3)) for k in range(2000)]
    frame = spark.createDataFrame(rows, "k string, s int, ord int, v int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        ranked = ranks.ranked(frame, ["k"], ["s", "ord"], "r", "n")
        ranked, totals = ranked.collect(), ranks.running(frame, ["k"], ["s", "ord"], {"run": "v"}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for key in {r[0] for r in rows}:
        own, total = sorted((r[1], r[2], r[3]) for r in rows if r[0] == key), 0
        for place, (_, ord_, v) in enumerate(own):
            total += v
            want[ord_] = place + 1, len(own), total, own[place + 1][2] if place + 1 < len(own) else None, place == 0
    assert {r.ord: (r.r, r.n) for r in ranked} == {k: v[:2] for k, v in want.items()}
    assert {r.ord: (r.run, r.next_v, r.first) for r in totals} == {k: v[2:] for k, v in want.items()}
    none = ranks.ranked(frame.limit(0), [], ["s"])
    assert none.count() == 0


def test_coverage_mismatch_is_an_error(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "sample_id string")
    assert runs.checked_coverage(ids("a ", "b"), ids("b", "a")).count() == 2 and runs.checked_coverage(ids("a"), ids(" ")).count() == 1
    for scores, due in ((ids("a"), ids("a", "b")), (ids("a", "a"), ids("a")), (ids("a", "c"), ids("a"))):
        with pytest.raises(ValueError, match="missing="):
            runs.checked_coverage(scores, due)


def test_cache_refuses_other_arguments(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, ord int")
    cache = states.RowCache(spark, str(tmp_path / "c"), "k string, ord int", split="test")
    assert cache.rows(["k"], "ord").count() == 0
    cache.add(rows)
    again = states.RowCache(spark, str(tmp_path / "c"), "k string, ord int", split="test")
    assert again.missing(rows, "k", "ord").count() == 0
    with pytest.raises(ValueError, match="other arguments"):
        states.RowCache(spark, str(tmp_path / "c"), "k string, ord int", split="dev")
    assert states.state_path("r", "rows") == "r/rows" and states.state_path("r", "rows", 4, 3) == "r/rows.shard03of04"
    with pytest.raises(ValueError):
        states.state_path("r", "rows", 4, 4)


def test_ratios_and_folds_are_checked():
    assert tasks.split_ratios(0.5) == {"train": 0.5, "dev": 0.5, "test": 0.5} == tasks.split_ratios([0.5] * 3) and tasks.task_ratios(["t"], None) == {}
    for bad in (0, 1.5, [1, 1], {"train": 1}, {"train": 1, "dev": 1, "test": 1, "x": 1}, "x"):
        with pytest.raises(ValueError):
            tasks.split_ratios(bad)
    assert tasks.generalization("", ["t"]) is None and tasks.generalization({"protocol": "template_holdout"}, ["in_chain_detection"]) == {"protocol": "template_holdout", "scope": "per_family"}
    for bad in ({"protocol": "x"}, {"protocol": "template_holdout", "scope": "x"}):
        with pytest.raises(ValueError):
            tasks.generalization(bad, ["in_chain_detection"])
    with pytest.raises(ValueError):
        tasks.generalization({"protocol": "template_holdout"}, ["order_swap"])
    assert list(validation.active({"a": {"enabled": True}, "b": {"enabled": True}, "c": {}}, ["b", "c"])) == ["b"]
    with pytest.raises(ValueError):
        validation.active({"a": {}})


def test_unknown_operators_are_an_error(spark):
    rows = spark.createDataFrame([([0.1], '[{"op":"none"}]')], "x array<double>, ops string")
    with pytest.raises(Exception, match="unknown operators"):
        signals.apply(rows, "x", "ops", F.lit(1)).collect()


def test_silence_and_companding(spark):
    loud, quiet = [0.5] * 800, [0.0001] * 1600
    got = signals.quality(spark.createDataFrame([(loud + quiet + loud + quiet[:100],), ([],), (None,)], "x array<double>"), "x", rate=1000, least_sec=0.5).collect()
    assert got[0].silence_sec == 1.6 and abs(got[0].max_db + 6.0206) < 1e-3 and got[1].mean_db is None and got[2].mean_db is None
    import numpy as np

    x = np.linspace(-1, 1, 999)
    for codec in ("pcm_mulaw", "pcm_alaw"):
        assert np.abs(signals.companded(x, {"codec": codec}, 0) - x).max() < 0.03


def test_silence_has_no_level_below_the_floor(spark):
    rows = [([0.0, 0.0],), ([float("nan")],), ([],), ([1.0, float("inf")],)]
    got = [r[0] for r in values(spark, rows, "x array<double>", arrays.loudness(F.col("x"), 2))]
    assert (got[0].duration, round(got[0].rms_dbfs, 6), got[0].peak) == (1.0, -120.0, 0.0) and got[1] is None and got[2] is None and got[3].duration == 0.5


def test_audio_of_two_channels(spark):
    import struct

    head = struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16)
    data = struct.pack("<4h", 100, 300, -200, 0)
    body = b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", 8) + data
    rows = spark.createDataFrame([(bytearray(b"RIFF" + struct.pack("<I", len(body)) + body),), (bytearray(b""),), (None,)], "c binary")
    got = rows.select(audio.probe(F.col("c")).alias("p"), audio.decode(F.col("c")).alias("x")).collect()
    assert (got[0].p.channels, got[0].p.duration) == (2, 2 / 8000) and got[0].x == [200 / 32768, -100 / 32768] and got[1].p is None and got[2].x is None


def test_word_errors_of_all_pairs_equal_brute_force(spark):
    from marlstone.fixtures import transcripts

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def words(t):
        import re

        return re.sub(" +", " ", re.sub("[^a-z0-9 ]", " ", re.sub(r"\s+", " ", t).strip().lower())).split()

    want = {(r.conv_id, r.turn): (words(r.reference or ""), words(r.hypothesis or "")) for r in transcripts(spark, SF).collect()}
    for r in queries.str08_wer(spark, SF).collect():
        a, b = want.pop((r.conv_id, r.turn))
        assert r.wer == (distance(a, b) / len(a) if a else 1.0 if b else None)
    assert not want


def test_streams_refuse_other_arguments(spark, tmp_path):
    from marlstone.streaming import summary as streaming

    count = lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"))
    for _ in range(2):  # the second run finds nothing new
        got = streaming.analyse(spark, SF, "events.parquet", lambda r: r.select("event_type"), count, root=str(tmp_path / "s"), limit=1)
        assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
    with pytest.raises(ValueError, match="other arguments"):
        streaming.analyse(spark, SF, "events.parquet", lambda r: r.select("event_type"), count, root=str(tmp_path / "s"), limit=2)


def test_factories_get_what_they_take():
    assert jobs.load("marlstone.sources.readers:path_stem", path=F.lit("a/b.c"), device="gpu") is not None
    with pytest.raises(AttributeError):
        jobs.load("marlstone.sources.readers:nothing")


def test_decimals_are_rounded_by_the_binary_value(spark):
    draw = random.Random(5)
    xs = [0.0125, 0.2975, 0.125, 0.375, 2.5, -1.005, 0.9995, 999999.9995, -0.0001, -0.0, 2.0**62, 5e-324, float("nan"), float("-inf")]
    xs += [draw.randrange(-(10**7), 10**7) / 2000 for _ in range(500)] + [draw.uniform(-1, 1) * 10 ** draw.randrange(-8, 18) for _ in range(500)]
    for x, *got in values(spark, [(x,) for x in xs], "x double", "x", *[buckets.fixed(F.col("x"), k) for k in range(4)]):
        assert got == [f"{x:.{k}f}" for k in range(4)], x


def test_speech_ratios_at_a_tie_equal_printf(spark):
    schema = "language string, split string, source_corpus string, speaker_id string, source_speaker_id string, utterance_id string, transcript string, raw_transcript string, seed int, duration double, sample_rate int, channels int, codec_name string, mean_volume_db double, max_volume_db double, silence_duration_sec double, speech_ratio double, source_split string, license_tag string, source_audio_path string, speaker_meta map<string,string>, extra_meta map<string,string>"
    row = ("en", "dev", "c", "s", "S", "u", "t", "t", 1, 1.0005, 1, 1, "x", 0.125, -0.125, 2.0005, 0.2975, "all", "l", "/r/in/u.wav", {}, {})
    made = projections.source_rows(spark.createDataFrame([row], schema), "/r", "/r/raw")
    want = {"duration_sec": f"{1.0005:.3f}", "mean_volume_db": "0.12", "max_volume_db": "-0.12", "silence_duration_sec": f"{2.0005:.3f}", "effective_speech_ratio": "0.297"}
    assert made.select(*want).first().asDict() == want


def test_clean_durations_at_a_tie_equal_printf(spark):
    rows = spark.createDataFrame([("s", "1", "2", "3", "x")], "sample_id string, duration_sec string, sample_rate string, channels string, codec_name string")
    output = F.expr("named_struct('path', 'p', 'duration', 0.2975D, 'sample_rate', 1, 'channels', 1, 'codec_name', 'x', 'sample_fmt', 's', 'size', 1L)")
    assert projections.clean_rows(rows.withColumn("output", output), "[]", "{}").first().duration_sec == "0.297"


def test_csv_keeps_white_space_and_control_characters(spark, tmp_path):
    draw = random.Random(6)
    texts = [" a", "a\t", "\n", "\r\n", "\x00a", "a\x1f", 'a\\"', '"\r\n" ', "", "\x01"] + ["".join(draw.choice('ab"\\,\n\r \t\x00\'#') for _ in range(draw.randrange(1, 9))) for _ in range(300)]
    writers.write_csv(spark.createDataFrame(list(enumerate(texts)), "i int, x string"), str(tmp_path / "csv"))
    got = readers.csv_rows(spark, str(tmp_path / "csv")).fillna("").collect()
    assert {int(r.i): r.x for r in got} == dict(enumerate(texts))


def _chains(spark, n: int = 60):
    """Rows of few groups, with chains of one to three tokens."""
    draw = random.Random(9)
    names = ["codec[bitrate=low]", "codec[bitrate=high]", "noise[snr=low]", "noise[snr=high]", "plr[x=1]"]
    rows = [(f"r{i}", str(i % 3), "hybrid", "spoof", [draw.choice(names) for _ in range(draw.randrange(1, 4))]) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, parent_id string, chain_family string, label string, sig array<string>")


def _unbroadcast(frame, rows_joined: int) -> None:
    """All joins of the plan are sorted and merged, whatever the tables' files weigh."""
    plan = frame._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == rows_joined and "Broadcast" not in plan, plan


def test_parameter_pairs_are_not_broadcast(spark):
    _unbroadcast(matching.parameter_pairs(_chains(spark)), 1)


def test_a_token_reads_its_name_once(spark):
    plan = spark.createDataFrame([("codec", "16K")], "op string, bitrate string").select(F.struct("op", "bitrate").alias("o")).select(chains.token(F.col("o"), ("bitrate",)))
    text_of = plan._jdf.queryExecution().analyzed().toString().splitlines()[0]
    assert text_of.count(".op") == 1 and text_of.count(".bitrate") <= 2, text_of


def test_matching_broadcasts_nothing(spark, monkeypatch):
    rows, seen, real = _chains(spark), [], matching.written
    for mine, joins_of in ((matching.substitution_pairs, 3), (matching.swap_pairs, 1), (matching.prefix_pairs, 1)):
        _unbroadcast(mine(rows), joins_of)
    monkeypatch.setattr(matching, "written", lambda df, name: (seen.append(df._jdf.queryExecution().sparkPlan().toString()), real(df, name))[1])
    matching.match_all(rows)
    assert len(seen) > 4 and not any("Broadcast" in plan for plan in seen)


def test_vectors_meet_in_blocks(spark):
    draw = random.Random(4)
    rows = [(k, k % 3 if k % 7 else None, [draw.uniform(-1, 1) for _ in range(4)]) for k in range(40)]
    odd = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [1.0, 2.0], [2.0, 1.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0]]
    rows += [(100 + k, k % 2, v) for k, v in enumerate(odd * 2)] + [(5, 2, [1.0, 0.0, 0.0, 1.0]), (None, 1, [1.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    a, b = (table.select("label", F.col("vec_id").alias(k), F.col("embedding").alias(f"{side}_vector")) for k, side in (("a", "parent"), ("b", "child")))
    want = preservation.speaker_similarity(a.join(b, "label").filter("a < b")).select("a", "b", F.round("similarity", 9).cast("string").alias("similarity"))
    for block in (1, 3, 1000):
        got = preservation.pairs_within(table, "label", "vec_id", "embedding", block)
        assert sorted(map(str, got.select("a", "b", F.round("similarity", 9).cast("string").alias("similarity")).collect())) == sorted(map(str, want.collect())), block


def test_samples_are_gathered_by_no_task(spark, monkeypatch):
    draw = random.Random(8)
    rows = spark.createDataFrame([(f"s{k}", k) for k in range(900)], "sample_id string, ord long")
    token = lambda k: __import__("hashlib").sha1(f"salt\0s{k}".encode()).hexdigest()
    want = sorted(range(900), key=token)
    monkeypatch.setattr(sampling, "TOP", 10, raising=False)
    for made, n in ((sampling.ratio_sample(rows, 0.07, "salt"), 63), (sampling.bottom_k(rows, 450, "salt"), 450), (sampling.bottom_k(rows, 1000, "salt"), 900), (sampling.ratio_sample(rows, 1e-9, "salt"), 1)):
        assert "TakeOrdered" not in made._jdf.queryExecution().sparkPlan().toString()
        assert sorted(r.ord for r in made.collect()) == sorted(want[:n])
    assert sampling.ratio_sample(rows.limit(0), 0.5, "salt").count() == 0
    # hashes in one bin, null keys and keys of which nothing is due
    odd = [(draw.choice("ab") if k % 9 else None, "same" if k % 4 else f"{k:03d}", k) for k in range(200)]
    got = ranks.lowest(spark.createDataFrame(odd, "key string, h string, ord long"), ["key"], "h", "ord", lambda n: F.when(F.col("key") == "b", 0).otherwise(F.floor(n * 0.6)))
    for key in ("a", "b", None):
        own = sorted((h, k) for x, h, k in odd if x == key)
        due = 0 if key == "b" else int(len(own) * 0.6)
        assert sorted((r.h, r.ord) for r in got.collect() if r.key == key and r.chosen) == own[:due]
    assert got.count() == 200


def test_folds_meet_no_rows_by_name(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(f"s{k}", draw.choice(["direct", "hybrid"]), draw.choice(["t1", "t2", "t3", None]), draw.choice(["train", "train", "test", "dev"]), k) for k in range(300)]
    rows = [r for r in rows if (r[1], r[3]) != ("direct", "dev")] + [("x", "telephony", "only", "train", 1), ("y", "simreplay", "a", "train", 1), ("z", "simreplay", "b", "test", 1)]
    table = spark.createDataFrame(rows, "sample_id string, chain_family string, chain_template_id string, split string, ord long")
    used = {}
    for s, family, template, split, _ in rows:
        for held in {r[2] for r in rows if r[1] == family and r[2]} if template else ():
            if (template == held) == (split == "test"):
                used.setdefault((family, held), []).append((split, s))
    want = set()
    for (family, held), own in used.items():
        name = spark.range(1).select(text.fold_name(F.lit(family), F.lit(held))).first()[0]
        train = sorted((s for split, s in own if split == "train"), key=lambda s: __import__("hashlib").sha1(f"dev:{name}\0{s}".encode()).hexdigest())
        if train and any(split == "test" for split, _ in own):
            lends = len(train) > 1 and not any(split == "dev" for split, _ in own)
            moved = set(train[: min(len(train) - 1, max(1, round(len(train) * 0.1)))] if lends else [])
            want |= {("template_holdout", name, "dev" if s in moved else split, s) for split, s in own}
    made = tasks.template_holdout(table)
    assert "sample_id" not in "".join(line for line in made._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line)
    assert sorted(map(tuple, made.collect())) == sorted(want)


def test_packs_read_their_rows_once(spark, tmp_path):
    draw = random.Random(6)
    rows = [(f"s{k}", f"p{k % 5}", draw.choice(["direct", "hybrid"]), draw.choice(["t1", "t2"]), draw.choice(["train", "test", "dev"]), draw.choice(["spoof", "bona_fide"]), -k) for k in range(400)]
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    table = spark.createDataFrame(rows, "sample_id string, parent_id string, chain_family string, chain_template_id string, split string, label string, ord long").withColumn("sample_id", F.udf(seen)("sample_id"))
    for most in (7, 2000):
        config = {"sample_ratio": {"in_chain_detection": (0.5, 1.0, 1.0)}, "limits": {"train": most, "test": 30}}
        before = read.value
        got = [tuple(r) for r in tasks.build_packs(table, ["in_chain_detection", "delivery_robustness"], config).collect()]
        assert read.value - before == len(rows)
        robust = [r for r in rows if r[4] == "train"]
        assert {r[3] for r in got if r[0] == "delivery_robustness" and r[2] == "train"} == {r[0] for r in sorted(robust, key=lambda r: r[6])[:most]}
        assert sum(r[0] == "in_chain_detection" and r[1] == "direct" and r[2] == "dev" for r in got) == sum(r[2] == "direct" and r[4] == "dev" for r in rows)
        assert sum(r[0] == "in_chain_detection" and r[2] == "test" for r in got) == 60


def test_rendering_is_work_for_all_cores(spark):
    assert "Repartition" in queries.sig23_rendered(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    import numpy as np

    x = np.random.default_rng(1).normal(size=64)
    for seed, params in enumerate(({"rt60": 0.8, "distance": 2.0}, {"rt60": 0.4, "distance": 0.5}, {})):
        random_, rt60 = np.random.default_rng(seed), params.get("rt60", 0.4)
        n = int(rt60 * signals.RATE)
        decay = 10 ** (-3 * np.arange(n) / (rt60 * signals.RATE))
        want = 0.01 * random_.normal(size=n) * decay
        at = random_.integers(1, n, 24)
        want[at] += random_.uniform(-0.5, 0.5, 24) * decay[at]
        want[0] = 1 / max(0.5, params.get("distance", 1))
        want /= np.abs(want).max()
        assert (signals.impulse_response(params, seed) == want).all()
        assert np.abs(signals.convolve(x, want) - np.convolve(x, want)[:64]).max() < 1e-12


def test_an_unchanged_view_is_not_numbered_again(spark, tmp_path, monkeypatch):
    rows = [(split, k, "s" if k % 2 else None, f"{split}{k}", "spoof" if k % 3 else "bona_fide") for split in ("train", "dev", "test", "other") for k in range(20)]
    pack = spark.createDataFrame(rows, "split string, ord long, speaker_id string, sample_id string, label string")
    path, calls, real = str(tmp_path / "v"), [], writers.attack_label
    monkeypatch.setattr(writers, "attack_label", lambda *a: (calls.append(1), real(*a))[1])
    first = sorted(map(tuple, writers.write_view(pack, path).collect()))
    assert len(first) == 60 and len(calls) == 3
    assert sorted(map(tuple, writers.write_view(pack, path).collect())) == first and len(calls) == 3
    # a speaker that is another row's field now is a change
    moved = pack.withColumn("speaker_id", F.when(F.col("ord") == 0, "s").otherwise(F.col("speaker_id")))
    assert sorted(map(tuple, writers.write_view(moved, path).collect())) != first and len(calls) == 6


def test_substituted_rows_meet_by_number(spark):
    rows = _chains(spark)
    plan = matching.substitution_pairs(rows)._jdf.queryExecution().sparkPlan().toString()
    assert sum("sig" in line for line in plan.splitlines() if "SortMergeJoin" in line) == 0, plan
    assert plan.count("indices=") == 1, plan
    own = [(r.sample_id, r.parent_id, r.sig) for r in rows.collect()]
    want = set()
    for (a, p, x), (b, q, y) in itertools.combinations(sorted(own), 2):
        d = [i for i, (s, t) in enumerate(zip(x, y)) if s != t]
        if p == q and len(x) == len(y) and d and all(x[i].split("[")[0] != y[i].split("[")[0] for i in d):
            want.add((a, b, "indices=" + ",".join(map(str, d))))
    assert {(r.a, r.b, r.detail) for r in matching.substitution_pairs(rows).collect()} == want


def _reads(spark, frame):
    """``frame`` with a count of the rows that are made of it."""
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    return frame.withColumn("sample_id", F.udf(seen)("sample_id")), made


def test_scores_are_made_once(spark):
    keys = ["task_id", "variant", "baseline"]
    rows = [("t", "v", "m", f"s{k}", float(k % 7), "spoof" if k % 2 else "bona_fide") for k in range(60)]
    scores, made = _reads(spark, spark.createDataFrame(rows, "task_id string, variant string, baseline string, sample_id string, score double, label string"))
    none = spark.createDataFrame([], "task_id string, variant string, baseline string, eer double, auc double, digest string")
    assert states.refreshed(none, scores, keys, lambda s: runs.base_metrics(s, keys).select(*keys, "eer", "auc")).count() == 1
    assert made.value == 60


def test_rows_of_pairs_and_lineages_are_made_once(spark):
    rows, made = _reads(spark, _chains(spark).withColumn("score", F.rand(3)).withColumn("parameter", F.col("parent_id")))
    robustness.pair_robustness(rows, "parameter", 0.5).collect()
    assert made.value == 60
    robustness.lineage_radii(rows, 0.5).collect()
    assert made.value == 120


def test_clean_rows_without_a_price(spark, tmp_path):
    for name in ("orders", "customer"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        rows = rows.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice"))) if name == "orders" else rows
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("prj02_clean_rows", "prj03_generation_jobs"):
        assert difference(registry.QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), registry.ORACLES[name]) == ""
