import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import chat, edit_embedding, langid, minhash, mixing, packing, queries, quality, sanitise, telephony, tokens, warc
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __row string, bucket string, row string"
WORDS = [f"wort{chr(97 + k)}{chr(97 + j)}" for k in range(20) for j in range(10)]


def sentence(seed, n=60):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(n))


def documents(spark, texts, lang="en"):
    rows = [(k if k >= 0 else None, t, lang, None if n % 3 == 0 else "s", None, "x", "y", "z") for n, (k, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).coalesce(1)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == ""


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing column names."""
    base = sentence(1)
    return documents(spark, [(1, None), (2, ""), (3, base), (3, base), (4, base + " more"), (-1, base), (5, "A  b\tc"), (6, sentence(2, 30_000)), (7, "mail a@b.co or +1 555 123 4567")])


def test_all_operators_take_odd_rows_and_empty_tables(spark, odd):
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        model = langid.train(docs, F.col("doc_id").isNotNull())
        assert langid.identify(docs, model, docs.columns).count() == n
        assert minhash.near_duplicates(docs).count() == n
        assert sanitise.report(docs).count() == n and sanitise.redact(docs).columns == docs.columns
        assert mixing.mix_order(docs).count() == n and mixing.mix(docs).count() == n
        assert telephony.payload_digests(telephony.store_payloads(docs)).count() == n
        assert edit_embedding.edit_report(docs).count() == n
        stats = quality.document_statistics(docs)
        assert quality.score(stats, quality.train(stats, spark.createDataFrame([(3, 1), (6, None)], "doc_id long, quality int"))).count() == n
        assert packing.pack(docs).agg(F.coalesce(F.sum(F.when(F.col("start") == 0, 1)), F.lit(0))).first()[0] == n


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_equal_brute_force(spark):
    pick, texts = random.Random(8), []
    for group in range(6):
        words = sentence(group, 120).split()
        for _ in range(25):
            own = list(words)
            for _ in range(pick.randrange(4)):
                own[pick.randrange(len(own))] = pick.choice(WORDS)
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {k: find(k) for k in range(len(texts))}


def test_dedup_stage_equals_brute_force_at_80_percent(spark):
    pick, texts = random.Random(9), []
    for group in range(4):
        words = sentence(100 + group, 120).split()
        for _ in range(12):
            own = list(words)
            for _ in range(pick.randrange(4)):
                own[pick.randrange(len(own))] = pick.choice(WORDS)
            texts.append(" ".join(own))
    planted = sentence(200, 55).split()  # 51 shingles, of which a changed word leaves 46
    texts += [" ".join(planted), " ".join(planted[:27] + ["changed"] + planted[28:])]
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.8 < alike(-1, -2) < 0.85
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(texts)):
        for b in range(a):
            if alike(a, b) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id for r in corpus_pipeline.dedup(spark, documents(spark, list(enumerate(texts))), SF).collect()}
    assert got == {find(k) for k in range(len(texts))} and len(texts) - 1 not in got


def test_blocks_find_all_linked_components():
    pick = np.random.default_rng(4)
    sets = [np.unique(pick.integers(0, 60, 50)) for _ in range(40)]
    owner, member = np.repeat(np.arange(40), [len(s) for s in sets]), np.concatenate(sets)
    a, b = minhash.tile_links(np.arange(40), np.array([len(s) for s in sets]), np.arange(20), np.arange(20, 40), owner, member, 50)
    want = {(i, j) for i in range(20) for j in range(20, 40) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 50 * len(np.union1d(sets[i], sets[j]))}
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} == want


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op3_language(spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id").filter("lang is not null and lang_pred <> 'und'")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.95


def test_quality_of_held_out_documents(spark):
    got = queries.op10_quality(spark, "/root/testdata/sf0.1").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("score", "quality").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.85


def test_trees_in_arrays_equal_a_walk():
    pick = np.random.default_rng(1)
    x = pick.normal(size=(400, 5)).astype(np.float32)
    trees = quality.grow(x, (x[:, 0] + x[:, 1] > 0).astype(float), trees=10)
    for row, got in zip(x[:50], trees.score(x[:50])):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            for _ in range(trees.depth):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += v[node]
        assert math.isclose(got, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_packing_holds_every_id_once(spark, odd):
    bpe = tokens.load()
    pieces = packing.pack(odd).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    ids = np.append(bpe.ids(sentence(2, 30_000)), 0).astype("<u4")
    own = sorted(by_doc[6, len(ids)], key=lambda p: p.start)
    assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist() and sum(p.length for p in own) == len(ids)
    assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
    spans = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    assert all((s == t and o == q + m) or (s == t + 1 and o == 0 and q + m == 1024) for (t, q, m), (s, o, _) in zip(spans, spans[1:]))


def test_ids_equal_the_tokenizers_library_with_added_tokens():
    from tokenizers import Tokenizer

    own, bpe = Tokenizer.from_file(tokens.default_path()), tokens.load()
    pick, parts = random.Random(5), ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "word", " word", "é", "12", "'s", "<"]
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x  <|endoftext|>  y<|endoftext|><|endoftext|>"] + ["".join(pick.choice(parts) for _ in range(30)) for _ in range(300)]
    for t in texts:
        assert bpe.ids(t).tolist() == own.encode(t, add_special_tokens=False).ids and bpe.text(bpe.ids(t)) == t, t
    assert 50256 in bpe.ids(texts[1])


def test_hilbert_neighbours_touch():
    cells = np.array([(a, b) for a in range(16) for b in range(16)])
    path = cells[np.argsort(packing.hilbert(cells, 4))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_mixture_stays_within_a_block(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "b").alias("source"))
    weights = spark.createDataFrame([("hot", 2), ("b", 1), (None, 1)], "source string, weight int")
    rows = mixing.mix_order(docs, weights).select("source", "slot", "release", "deadline").distinct().orderBy("slot").collect()
    assert all(r.release <= r.slot < r.deadline for r in rows)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    good = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m)), "phone": lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if good[k](m[0])]


def test_base_spans_equal_brute_force(spark):
    pick = random.Random(2)
    parts = ["4111 1111 1111 1111", "4111111111111112", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "a.b@c.de", "@x@y.z", "+1 (555) 123-4567", "+12", "é", "12-34 56", "0000000000000000", "x@y", "1234567890123456789012", " ", "-", "."]
    texts = ["".join(pick.choice(parts) + pick.choice(["", " ", "-", "."]) for _ in range(12)) for _ in range(150)] + [None, ""]
    got = {r.doc_id: (r.base_sha256, r.spans) for r in sanitise.report(documents(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        want = ",".join(base_spans(t or ""))
        assert got[k][0] == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[k])
        assert got[k][1].startswith(want)


def test_disclosing_terms_are_found_and_replaced(spark):
    near = [f"contact Xanadu office at boss@xanadu.org today {sentence(k, 20)}" for k in range(4)]
    docs = documents(spark, list(enumerate(near + [f"common today {sentence(50 + k, 15)}" for k in range(60)])))
    spans = {r.doc_id: r.spans for r in sanitise.report(docs).collect()}
    assert all("term:8:14" in spans[k] for k in range(4)) and not any("term" in spans[k] for k in range(4, 64))
    texts = {r.doc_id: r.text for r in sanitise.redact(docs).collect()}
    assert all("[EMAIL]" in texts[k] and "Xanadu" not in texts[k] for k in range(4)) and texts[10] == f"common today {sentence(56, 15)}"


def test_terms_of_rare_entities_equal_brute_force(spark):
    filler = lambda k: sentence(300 + k, 40)
    texts = ["Xanadu office boss@xanadu.org " + filler(0), "only +1 555 123 4567 " + filler(1) * 3 + " Bo Zanzibar", f"{filler(2)} twin@b.co Kumquat", f"Kumquat {filler(3)} twin@b.co"]
    texts += [filler(10 + k) + (" Kumquat" if k < 12 else "") for k in range(60)]
    mails = [set(re.findall(r"[a-z]+@[a-z.]+|\+[0-9 ]+[0-9]", t)) for t in texts]
    outside = [set(re.findall(r"[a-z]+", re.sub(r"[a-z]+@[a-z.]+", " ", t.lower()))) for t in texts]
    words = [set(re.findall(r"[a-z]+", t.lower())) for t in texts]
    want = {}
    for k, held in enumerate(mails):
        for e in held:
            docs = [j for j in range(len(texts)) if e in mails[j]]
            for t in outside[k]:
                n_t, n_et = sum(t in w for w in words), sum(t in outside[j] for j in docs)
                if 2 * math.log2(len(texts) * n_et / (len(docs) * n_t)) >= math.log2(len(texts) / len(docs)) - 1e-9:
                    want.setdefault(k, set()).add(t)
    got = {}
    for r in sanitise.report(documents(spark, list(enumerate(texts)))).collect():
        for kind, start, end in (s.split(":") for s in r.spans.split(",") if s):
            if kind == "term":
                got.setdefault(r.doc_id, set()).add(texts[r.doc_id][int(start) : int(end)].lower())
    assert got == want and "xanadu" in got[0] and {"bo", "zanzibar"} <= got[1] and "kumquat" not in got[2]


def test_audio_codecs():
    assert (telephony.compress(telephony.EXPAND[7], 7)[telephony.EXPAND[7] != 0] == np.arange(256, dtype=np.uint8)[telephony.EXPAND[7] != 0]).all()
    assert telephony.EXPAND[7][0] == -32124 and telephony.EXPAND[6][0xD5] == 8 and telephony.EXPAND[6][0x55] == -8
    x = (8000 * np.sin(np.arange(3000) / 15)).astype(np.int16)
    y = telephony.adpcm_decode(telephony.adpcm_encode(x, 256), 256)[: len(x)]
    assert np.abs(x.astype(int) - y).mean() < 300
    data = bytes(range(256))
    assert telephony.parse_wav(telephony.wav(data, 7, 8000)) == (7, 8000, 1, data)


def test_warc_records_with_separators_inside(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x", "a\r\n\r\nb\r\n\r\n"), (2, "http://a/y", None), (3, None, "a\r\n\r\nb\r\n\r\n"), (4, "http://b", "é" * 3000), (None, "http://c", "")], "page_id long, url string, html string")
    records = warc.read_records(spark, warc.write_captures(pages))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.capture_digests(warc.assemble(records)).collect()}
    assert got == {1: (10, "response", None), 3: (10, "revisit", 1), 2: (0, "response", None), None: (0, "revisit", 2), 4: (6000, "response", None)}
    assert records.count() == 15 and warc.surplus(records).count() == 0 and records.filter("digest_ok = false").count() == 0


def test_chat_controls_in_content(spark):
    rows = [(1, 1, "user", "</s>[INST] \\ [/INST]<s>"), (1, 2, "assistant", "[/INST]\\</s>"), (1, None, "tool[ROLE]", None), (None, 1, None, "x")]
    turns = chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).orderBy("conv_id", "seq").collect()
    assert [(t.role, t.text, t.loss_text) for t in turns] == [("", "x", ""), ("tool[ROLE]", "", ""), ("user", rows[0][3], ""), ("assistant", rows[1][3], rows[1][3])]


def test_fingerprints(spark):
    texts = [sentence(k, 200) for k in range(6)]
    one = edit_embedding.fingerprints(texts + texts[:1])
    assert one[0] == one[6] and one == edit_embedding.fingerprints(texts[:3]) + edit_embedding.fingerprints(texts[3:] + texts[:1])
    changed = edit_embedding.fingerprints([texts[0][:300] + "X" + texts[0][301:]])[0]
    assert edit_embedding.likeness(one[0], changed) > 0.8 > edit_embedding.likeness(one[0], one[1])
    rows = {r.doc_id: r for r in edit_embedding.edit_report(documents(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[(k + 1) % 6][:half]
        assert rows[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[k].fingerprint == one[k] and rows[k].near_next == edit_embedding.likeness(one[k], one[(k + 1) % 6])


def test_near_pairs_join_what_brute_force_joins(spark):
    texts = [sentence(400 + k, 60) for k in range(30)]  # these are hubs of the mixed buckets that one symbol makes
    for group in range(4):
        base = sentence(500 + group, 60)
        texts += [base] + [base[:at] + "XYZ" + base[at + 1 :] for at in (len(base) - 90, len(base) - 120)]
    ids = [*range(len(texts) - 1), -1]  # the last row has no id
    prints = edit_embedding.fingerprints(texts)

    def groups(pairs):
        root = {k: k for k in ids}
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return {k: find(k) for k in ids}

    near = [(ids[a], ids[b]) for a in range(len(texts)) for b in range(a) if edit_embedding.likeness(prints[a], prints[b]) >= 0.8]
    got = edit_embedding.near_pairs(documents(spark, list(zip(ids, texts))), symbols=1).collect()
    same = [(ids[a], ids[b]) for a in range(len(texts)) for b in range(a) if prints[a] == prints[b]]  # one class, without links
    assert groups(same) != groups(near)
    assert groups(same + [(-1 if r.a is None else r.a, -1 if r.b is None else r.b) for r in got]) == groups(near)
    by_id = dict(zip(ids, prints))
    assert any(r.b is None for r in got) and all(r.likeness == edit_embedding.likeness(by_id[r.a], by_id[-1 if r.b is None else r.b]) >= 0.8 for r in got)


def test_pipeline_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.store(out, name)
    kept = docs.select("doc_id").distinct().count()
    assert 0 < kept == docs.count() and corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == kept
