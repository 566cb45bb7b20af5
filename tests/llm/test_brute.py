"""Whole results held against brute force, and odd input of every operator."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import chat, common, edit_embedding, langid, minhash, mixing, packing, quality, queries, sanitise, telephony, tokens, warc
from tests.llm.test_llm import SF, documents, sentence, shingles


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- 1 WARC ---------------------------------------------------------------------------------------


def test_digests_are_those_of_the_payload_that_is_read(spark, tmp_path):
    body = "HTTP/1.1 200 OK\r\n\r\nhello"
    record = lambda kind, rid, extra, block: f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n{extra}Content-Type: application/{'warc-fields' if kind == 'metadata' else 'http'}\r\nContent-Length: {len(block)}\r\n\r\n{block}"
    one = record("response", "<a>", "WARC-Payload-Digest: sha1:WRONG\r\n", body)
    two = record("revisit", "<b>", "WARC-Refers-To: <a>\r\n", "HTTP/1.1 200 OK\r\n\r\n")
    lost = record("revisit", "<c>", "WARC-Refers-To: <z>\r\n", "HTTP/1.1 200 OK\r\n\r\n")
    ask = record("request", "<q>", "WARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\n", "GET / HTTP/1.1\r\n\r\n")
    spare = record("request", "<r>", "WARC-Concurrent-To: <a>\r\n", "GET / HTTP/1.1\r\n\r\n")
    meta = record("metadata", "<m>", "WARC-Concurrent-To: <nobody>\r\n", "page-id: 1\r\n")
    spark.createDataFrame([(x,) for x in (one, two, lost, ask, spare, meta)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    got = {r.capture_id: r for r in warc.assemble(records).collect()}
    want = "VL2MMHO4YXUKFWV63YHTWSBM3GXKSQ2N"
    assert got["<a>"].response.payload_digest == got["<b>"].response.payload_digest == want and got["<a>"].response.digest_ok is False
    assert got["<a>"].response.payload_length == got["<b>"].response.payload_length == 5 and got["<c>"].response.payload_digest is None
    assert (got["<a>"].n_requests, got["<b>"].n_requests, got["<a>"].request.record_id, got["<b>"].request.record_id) == (2, 1, "<q>", "<q>")
    assert sorted(r.record_id for r in warc.surplus(records).collect()) == ["<m>", "<r>"]


def test_warc_of_small_payloads_repeats_and_nothing(spark):
    rows = [(5, "u", "same"), (5, "u", "same"), (2, "u", "same"), (9, "v", "tiny"), (8, "v", "tiny"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for frame, least in ((pages, 0), (pages, 5), (pages.repartition(4), 0)):
        got = warc.capture_digests(warc.assemble(warc.read_records(spark, warc.write_captures(frame, least_revisit=least)))).collect()
        kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
        assert len(got) == 6 and all(r.payload_digest == __import__("base64").b32encode(hashlib.sha1({5: b"same", 2: b"same", 9: b"tiny", 8: b"tiny", None: b""}[r.page_id]).digest()).decode() for r in got)
        assert kinds[2, "response", None] == 1 and (kinds[5, "revisit", 2] == 2 if least == 0 else kinds[5, "response", None] == 2)
    none = warc.write_captures(pages.limit(0))
    assert warc.assemble(warc.read_records(spark, none)).count() == 0


# --- 2 near duplicates ----------------------------------------------------------------------------


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_regular_words_do_not_collide(spark):
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    got = minhash.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a.upper()), (4, a + " " + b), (5, b + " " + a)], "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_shingles_of_odd_spaces(spark):
    texts = ["a\tb\x0bc\rd  e f", "A b c d E f", "a b c d", "a b", " ", "", None, "é É", "a b c d e f"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k][0] for k in range(len(texts))] == [len(shingles(t)) for t in texts] and got[1][1] == got[8][1] == 0 and got[2][1] == 2


def test_dedup_of_a_frame_that_changes_its_partitions(spark):
    rows = [(k % 40, sentence(k % 13, 30), "en", "s", 1, None, "b", "r") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __row string, bucket string, row string").repartition(7)
    kept = minhash.deduplicate(docs).collect()
    # sentences with one seed are one class: of each the smallest doc_id, once
    assert sorted(r.doc_id for r in kept) == sorted(min(k % 40 for k in range(400) if k % 13 == c) for c in range(13))


def test_tiles_are_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", 0)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 200)
    pick, texts = random.Random(8), []
    for group in range(3):
        words = sentence(group, 100).split()
        for _ in range(12):
            own = list(words)
            for _ in range(pick.randrange(4)):
                own[pick.randrange(len(own))] = "x" + str(pick.randrange(9))
            texts.append(" ".join(own))
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, list(enumerate(texts)))).collect()}
    assert got == {k: find(k) for k in range(len(texts))}


# --- 3 language -----------------------------------------------------------------------------------


def naive_bayes(texts, langs, learn, alpha=0.5):
    """(language, score) of each text, from dictionaries of the operator's buckets."""
    def buckets(t):
        doc, bucket, has = langid.grams([t or ""])
        return Counter(bucket.tolist()), bool(has[0])

    counts, seen = {}, Counter()
    for t, lang, ok in zip(texts, langs, learn):
        if ok and lang is not None and t is not None:
            counts.setdefault(lang, Counter()).update(buckets(t)[0])
            seen[lang] += 1
    out = []
    for t in texts:
        own, has = buckets(t)
        if not has or not counts:
            out.append(("und", 0.0))
            continue
        size = max(1, sum(own.values()))
        total = {x: sum(n * math.log((c[b] + alpha) / (sum(c.values()) + alpha * langid.BUCKETS)) for b, n in own.items()) for x, c in counts.items()}
        prior = {x: math.log(seen[x] / sum(seen.values())) for x in counts}
        best = min(counts, key=lambda x: (-(total[x] + prior[x]), x.encode()))
        shown = {x: total[x] / size * min(size, langid.EVIDENCE) + prior[x] for x in counts}
        top = max(shown.values())
        out.append((best, math.exp(shown[best] - top) / sum(math.exp(v - top) for v in shown.values())))
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_languages_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "CHAIN", 1)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()] + [(900, None, "en"), (901, "", "en"), (902, "12 34", None), (None, "words of none", "en"), (903, "déjà vu", "fr"), (903, "déjà vu", "fr")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = [i is not None and zlib.crc32(str(i).encode()) % 4 != 2 for i, _, _ in rows]
    want = naive_bayes([t for _, t, _ in rows], [x for _, _, x in rows], learn)
    model = langid.train(frame, F.col("doc_id").isNotNull() & ~common.held_out())
    got = langid.identify(frame.withColumn("at", F.monotonically_increasing_id()).orderBy("at"), model, ["doc_id", "text"]).collect()
    by_text = {}
    for (i, t, _), w in zip(rows, want):
        by_text[i, t] = w
    assert len(got) == len(rows)
    for r in got:
        lang, score = by_text[r.doc_id, r.text]
        assert r.lang_pred == lang and math.isclose(r.score, score, rel_tol=1e-4, abs_tol=1e-6), (r, lang, score)


def test_six_hundred_languages(spark):
    rows = [(k, f"{chr(97 + k % 26) * 3} {chr(97 + k // 26) * 4} {chr(200 + k) * 5}", f"l{k}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    got = langid.identify(docs, model, ["lang"]).collect()
    assert len(list(model.blocks())) == 3 and all(r.lang == r.lang_pred and 0 < r.score <= 1 for r in got)


def test_unsure_languages_go(spark):
    docs = documents(spark, [(1, "aaa bbb"), (2, "12"), (3, None), (4, "aaa")])
    assert sorted(r.doc_id for r in langid.keep_identified(docs, F.lit(True)).collect()) == [1, 4]
    half = spark.createDataFrame([(1, "aaa", "x"), (2, "aaa", "y"), (3, "aaa", "z")], "doc_id long, text string, lang string")
    assert langid.keep_identified(half, F.lit(True)).count() == 0 and langid.keep_identified(half.limit(0), F.lit(True)).count() == 0


# --- 4 packing ------------------------------------------------------------------------------------


def test_pieces_equal_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = [(9001, "a<|endoftext|>b"), (9002, None), (9003, ""), (9004, sentence(4, 20_000)), (None, "no id"), (9005, "same"), (9005, "same")]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + extra
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = Counter()
    for i, t in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    whole = {(i, n): c for (i, n, c) in want}
    ids_of = {(i, len(own.encode(t or "", add_special_tokens=False).ids) + 1): own.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == Counter({k: sum(v for (i, n, _), v in want.items() if (i, n) == k) for k in whole})
    for p in pieces:
        part = ids_of[p.doc_id, p.doc_tokens][p.start : p.start + p.length]
        assert len(part) == p.length > 0 and zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32
    spans = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    end = 0
    for s, o, n in spans:  # gapless, and full but for the last
        assert s * 1024 + o == end and o + n <= 1024
        end += n
    assert sum(v * n for (_, n, _), v in want.items()) == end


def test_windows_are_packed_one_after_another(spark):
    rows = [(k, sentence(k, 40), f"w{k % 3}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, w string").repartition(5)
    at = {p.doc_id: p.sequence_id * 1024 + p.offset for p in packing.pack(docs, window="w").filter("start = 0").collect()}
    order = [k % 3 for k in sorted(at, key=at.get)]
    assert order == sorted(order) and packing.pack(docs.limit(0), window="w").count() == 0


# --- 5 telephony ----------------------------------------------------------------------------------


def decoded(media):
    """Samples of a stored file, one at a time."""
    codec, _, block, data = telephony.parse_wav(media)
    if codec != telephony.IMA_ADPCM:
        return [int(telephony.EXPAND[codec][b]) for b in data]
    out = []
    for at in range(0, len(data), block):
        part = data[at : at + block]
        value, index = int.from_bytes(part[:2], "little", signed=True), min(part[2], 88)
        out.append(value)
        for byte in part[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                out.append(value)
    return out


def test_payloads_equal_brute_force(spark):
    texts = [None, "", "x" * 576, "é" * 400, "<b>\r\n", *[sentence(k, 90) for k in range(12)], sentence(3, 90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = telephony.store_payloads(docs)
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    rows = {r.doc_id: r for r in telephony.payload_digests(stored).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        data = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[k]), hashlib.sha256(media[k]).hexdigest()) and telephony.parse_wav(media[k])[3] == data
        x = decoded(media[k])
        pcm = [(x[j // 2] * (2 - j % 2) + x[min(j // 2 + 1, len(x) - 1)] * (j % 2)) // 2 for j in range(2 * len(x))]
        assert np.frombuffer(bytes(r.pcm), "<i2").tolist() == pcm and r.pcm_rate == 16000 and f"crc32={zlib.crc32(bytes(r.pcm))}" in r.feature
    assert rows[8].feature == rows[len(texts) - 1].feature and {r.codec for r in rows.values()} == set(telephony.FORMS)


def test_audio_columns_keep_the_others(spark):
    rows = spark.createDataFrame([(1, bytearray(b"abc"), "x"), (2, None, "y"), (3, bytearray(b""), None)], "pcm long, payload binary, rate string")
    for codec in ("mulaw", "alaw"):
        made = telephony.decode_column(telephony.encode_column(rows, "payload", "media", codec), "media", "out").orderBy("pcm").collect()
        assert [r.rate for r in made] == ["x", "y", None] and len(made[0].out.pcm) == 12 and made[1].out.pcm is None and len(made[2].out.pcm) == 0
    assert telephony.expand_all([telephony.wav(b"\1\2\3\4\5", telephony.IMA_ADPCM, 8000, 64)])[0][0].tolist() == decoded(telephony.wav(b"\1\2\3\4\5", telephony.IMA_ADPCM, 8000, 64))


# --- 8 chat ---------------------------------------------------------------------------------------


def test_chat_of_odd_rows(spark):
    rows = [(1, 1, "user", "x"), (1, 1, "user", "x"), (2, 5, "assistant", sentence(1, 20_000)), (2, 5, "assistant", ""), (3, None, None, None), (4, 2, "[END]", "\\[END]")]
    frame = spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    turns = chat.read_back(chat.format_turns(frame)).orderBy("conv_id", "seq").collect()
    want = sorted(((c, "" if t is None else t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (r[0], r[2], r[3]))
    assert [(t.conv_id, t.role, t.text) for t in turns] == [(c, r, x) for c, _, r, x in want]
    digests = {r.conv_id: r for r in chat.conversation_digests(chat.read_back(chat.format_turns(frame))).collect()}
    assert digests[2].loss_chars == len(rows[2][3]) and digests[1].n_turns == 2 and digests[1].turns_sha256 == hashlib.sha256(b"user\nx\nuser\nx\n").hexdigest()
    assert chat.format_turns(frame.limit(0)).count() == 0 and chat.conversation_digests(chat.read_back(chat.format_turns(frame.limit(0)))).count() == 0


# --- 9 edit embedding -----------------------------------------------------------------------------


def walked(text):
    """The fingerprint of a text, by one step after another."""
    walk = edit_embedding.shared_walk()
    symbols = [*edit_embedding._symbols(text).tolist(), edit_embedding.PAD]
    at, out, wanted = 0, [], set(walk.steps)
    for j in range(3 * len(text)):
        if j in wanted:
            out.append("0123456789abcdef"[walk.nibble[symbols[at]]])
        at += int(walk.moves[j % edit_embedding.PERIOD][symbols[at]])
    return "".join(out)


def test_fingerprints_equal_a_walk(spark):
    texts = ["", "a", "é中", sentence(1, 15), sentence(2, 400), *[sentence(k, 30) for k in range(60)]]
    assert edit_embedding.fingerprints(texts) == [walked(t) for t in texts]


def test_report_equals_brute_force(spark):
    pick = random.Random(6)
    rows = [(k, None if k == 3 else "" if k == 5 else sentence(k, 40)) for k in range(40)] + [(50, sentence(7, 40)), (-4, "first"), (60, "last")]
    docs = spark.createDataFrame(pick.sample(rows, len(rows)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in edit_embedding.edit_report(docs).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        own, other, after = walked(t), walked(changed), walked(following)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(changed.encode()).hexdigest(), own, other)
        assert r.near_edited == edit_embedding.likeness(own, other) and r.near_next == edit_embedding.likeness(own, after)
    assert got[50].near_class == got[7].near_class == 7 and got[3].near_class == 3
    assert edit_embedding.edit_report(docs.limit(0)).count() == 0


def test_recall_of_bands(spark):
    """Of all pairs of likeness 0.9 or more nine in ten share a band, and classes join them."""
    pick, texts = random.Random(11), []
    for group in range(12):
        base = sentence(700 + group, 200)
        for _ in range(12):
            words = base.split()
            for _ in range(pick.randrange(3)):
                words[pick.randrange(len(words))] = pick.choice(["other", "word", "here"])
            texts.append(" ".join(words))
    texts += [sentence(900 + k, 200) for k in range(100)]
    prints = edit_embedding.fingerprints(texts)
    keys = [set(edit_embedding.band_keys(p)) for p in prints]
    like = edit_embedding.likeness_grid(prints, prints)
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if like[a, b] >= 0.9 and prints[a] != prints[b]]
    met = sum(bool(keys[a] & keys[b]) for a, b in near) / len(near)
    unlike = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if like[a, b] < 0.5]
    false = sum(bool(keys[a] & keys[b]) for a, b in unlike) / len(unlike)
    print(f"recall {met:.3f} of {len(near)} pairs, {false:.5f} of unlike ones")
    assert len(near) > 100 and met >= 0.9 and false < 0.01
    classes = {r.doc_id: r.near_class for r in edit_embedding.edit_report(documents(spark, list(enumerate(texts)))).collect()}
    assert sum(classes[a] == classes[b] for a, b in near) / len(near) >= 0.9 and all(classes[k] == k for k in range(144, 244))


# --- 10 quality -----------------------------------------------------------------------------------


def test_quality_does_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.createDataFrame([(k % 300, sentence(k, 10 + k % 50) + (" $$ # " * (k % 7))) for k in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 300, None if k % 11 == 0 else k % 2) for k in range(400)] * 2, "doc_id long, quality int")
    found = []
    for d, x in ((docs.coalesce(1), labels.coalesce(1)), (docs.repartition(9), labels.repartition(7))):
        stats = quality.document_statistics(d)
        found.append(sorted(rows_of(quality.score(stats, quality.train(stats, x, bound=120)))))
    assert found[0] == found[1] and len(found[0]) == 600
    for doc_id, held, score, predicted in found[0]:
        assert held == (zlib.crc32(str(doc_id).encode()) % 4 == 2) and 0 <= score <= 1 and predicted == (score >= 0.7)


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "")], "doc_id long, text string")
    stats = quality.document_statistics(docs)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(stats, quality.train(stats, none)).collect()] == [0.5] * 3
    assert quality.score(stats.limit(0), quality.train(stats.limit(0), none)).count() == 0


# --- the pipeline ---------------------------------------------------------------------------------


def test_pii_and_mixing_stages_equal_brute_force(spark):
    rows = [(k, f"mail p{k}@x.org and word {sentence(k % 5, 30)}", "en", ["hot", "hot", "hot", "b", None][k % 5]) for k in range(200)]
    docs = spark.createDataFrame([(*r, len(r[1]), None, "b", "r") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __row string, bucket string, row string")
    clean = corpus_pipeline.pii(spark, docs, SF).collect()
    assert len(clean) == 200 and not any("@" in r.text for r in clean) and all("[EMAIL]" in r.text and r.n_chars == len(r.text) for r in clean)
    mixed = corpus_pipeline.mix(spark, docs.repartition(6), SF)
    order = {r.doc_id: r.mix_order for r in mixing.mix_order(docs).collect()}
    assert [r.doc_id for r in mixed.collect()] == sorted(order, key=order.get) and mixed.columns == docs.columns
    # brute force of the schedule: earliest deadline first among released blocks
    counts = Counter(r[3] for r in rows)
    names = sorted(counts, key=lambda x: (x is not None, x or ""))
    weights = [max(1, math.isqrt(counts[x])) for x in names]
    spare = 1024 - len(names)
    base = [spare * w // sum(weights) for w in weights]
    rest = sorted(range(len(names)), key=lambda i: (-(spare * weights[i] % sum(weights)), i))[: spare - sum(base)]
    slots = [1 + b + (i in rest) for i, b in enumerate(base)]
    done, at = [0] * len(names), {}
    for t in range(1024):
        ready = [i for i in range(len(names)) if done[i] < slots[i] and done[i] * 1024 // slots[i] <= t]
        i = min(ready, key=lambda i: (-(-(done[i] + 1) * 1024 // slots[i]), i))
        at[i, done[i]] = t
        done[i] += 1
    ranks = {x: sorted(r[0] for r in rows if r[3] == x) for x in names}
    want = {doc: at[i, rank // 16] * 16 + rank % 16 for i, x in enumerate(names) for rank, doc in enumerate(ranks[x])}
    assert order == want


def test_pipeline_packs_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.store(stage(spark, docs, SF), name)
    pieces = corpus_pipeline.pack(spark, docs, SF).collect()
    kept = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    bpe = tokens.load()
    assert {p.doc_id for p in pieces} == set(kept) and len(kept) == docs.count()
    for p in pieces:
        if p.start == 0:
            assert p.doc_tokens == len(bpe.ids(kept[p.doc_id] or "")) + 1
    whole = corpus_pipeline.pack(spark, docs.filter("true").repartition(3), SF)  # no scan: written first
    assert sum(p.length for p in whole.collect()) == sum(p.length for p in pieces)


def test_pipeline_stages_take_empty_and_odd_tables(spark):
    odd = documents(spark, [(1, None), (2, ""), (-1, "words of none here"), (4, "a b c"), (4, "a b c")])
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns, name
        assert corpus_pipeline.pack(spark, docs, SF).filter("start = 0").count() == docs.count()


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.scratch(Session, "x")


def test_keys_of_rows_stay_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert common.scanned(docs.filter("doc_id > 3").select("text"), "x").inputFiles() == docs.inputFiles()
    assert common.scanned(docs.repartition(2), "x").inputFiles() != docs.inputFiles()
    one = {r["__key"]: r.doc_id for r in common.keyed(docs, "x").collect()}
    assert len(one) == docs.count() and one == {r["__key"]: r.doc_id for r in common.keyed(docs, "x").repartition(3).collect()}
    assert queries.op6_mixing(spark, SF).count() == docs.count() and sanitise.report(docs.limit(0)).count() == 0
