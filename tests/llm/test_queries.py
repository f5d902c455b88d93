"""The registered queries on small tables of their own: contracts, empty tables, clashing names, very long texts, hot groups."""

import base64
import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from chronolith.llm import decontaminate, neardup, pieces, quality, registry, secret_scan, substrings, urls, warc
from chronolith.llm.common import Workspace, free
from tests.llm.test_ops import SECRETS, brute_components, brute_spans, brute_windows, corpus, sentence

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


def write(spark, folder, docs, labels, pages, items):
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("pages", pages, PAGES), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def texts():
    rows = dict(corpus())
    rows.update({i + 1 + max(rows): t for i, t in enumerate(SECRETS)})
    return rows


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    rows = texts()
    rng = random.Random(3)
    pages = [(i, f"http://a.example.com/{i}", rng.choice(["<a>", "<b>", None, "", f"<p>{i}"])) for i in range(60)]
    docs = [(i, t, "en", "web", len(t or "")) for i, t in rows.items()]
    return write(spark, tmp_path_factory.mktemp("tiny"), docs, [(i, i % 2, 0) for i in rows], pages, [(1, "A question of some words here? The answer is forty two.")])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


def by_id(spark, name, folder):
    rows = registry.QUERIES[name](spark, folder).collect()
    out = {r[0]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).collect() == []


def test_the_pipeline_of_empty_tables(spark, empty):
    assert pipeline.run(spark, empty).collect() == []


def test_op3(spark, tiny):
    got = by_id(spark, "op3_secret_scan", tiny)
    assert list(got) and set(got) == set(texts())
    for i, t in texts().items():
        found = brute_spans(t)
        join = lambda x: ",".join(f"{k}:{s}:{e}" for s, _, e, k in x)
        base = [x for x in found if x[1] < 3]
        assert tuple(got[i]) == (i, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(join(base).encode()).hexdigest(), join(found))


def test_op4(spark, tiny):
    got, want = by_id(spark, "op4_substring_dedup", tiny), brute_windows(list(texts().items()))
    assert {i: tuple(r)[1:] for i, r in got.items()} == want and got[next(iter(got))].__fields__ == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_op5(spark, tiny):
    got = by_id(spark, "op5_media_columns", tiny)
    for i, t in texts().items():
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert len(r.media_sha256) == 64 and r.media_bytes > len(padded) and len(r.keyframes) == -(-len(padded) // 64 // 16) and r.codec == "raw"


def test_op7(spark, tiny):
    got = by_id(spark, "op7_quality", tiny)
    assert got[next(iter(got))].__fields__[:4] == ["doc_id", "held_out", "score", "predicted"]
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op8(spark, tiny):
    got = by_id(spark, "op8_minhash_neardup", tiny)
    for i, (n, c) in brute_components(list(texts().items()), 2).items():
        assert tuple(got[i]) == (i, n, c, i == c)


def test_op9(spark, tiny):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = by_id(spark, "op9_sentencepiece", tiny)
    for i, t in texts().items():
        r = got[i]
        assert r.parity == (sp.encode(t or "") == list(r.ids)) and r.round_trip and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    assert sum(not r.parity for r in got.values()) < 3


def test_op10(spark, tiny):
    got = by_id(spark, "op10_warc", tiny)
    rows = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    for i, p in rows.items():
        top = max(j for j, q in rows.items() if q == p)
        assert tuple(got[i]) == (i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == top else "revisit", None if i == top else top)


def test_op1_op2_op6_rows(spark, tiny):
    assert registry.QUERIES["op1_decontaminate"](spark, tiny).columns == ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    assert set(by_id(spark, "op2_pii", tiny)) == set(texts()) and len(by_id(spark, "op6_url_filter", tiny)) == 60


# --- clashing names and other ids


def test_free_names():
    assert free(["a", "A_"], "a") == "a__" and free(["b"], "a") == "a"


def test_columns_with_taken_names(spark):
    ws = Workspace(spark, "clash")
    row = (1, "token=abcdefgh12 and more words", "kept")
    for name in ("found", "__found", "__id", "__kinds"):
        df = spark.createDataFrame([row], f"doc_id long, text string, {name} string")
        assert secret_scan.redact(df, "doc_id", "text", ws).first() == (1, "[SECRET] and more words", "kept")
        out = secret_scan.scan(df, "doc_id", "text", ws).first()
        assert out[2] == "kept" and out[3][0].kind == "assign"
    for name in ("ids", "n_tokens", "parity", "round_trip"):
        out = pieces.encode(spark.createDataFrame([row], f"doc_id long, text string, {name} string"), "text")
        assert len(set(out.columns)) == 7 and out.first()[2] == "kept"
    back = pieces.decode(spark.createDataFrame([([1, 2], "kept")], "ids array<int>, text string"), "ids")
    assert back.columns == ["ids", "text", "text_"] and back.first().text == "kept"
    df = spark.createDataFrame([(i, f"{w} " * 30, "kept") for i, w in enumerate("abc")], "doc_id long, text string, score string")
    assert quality.keep_good(df, "text", None).columns == df.columns and neardup.drop_duplicates(df, "doc_id", "text", ws).columns == df.columns


def test_ids_that_are_no_integers(spark):
    df = spark.createDataFrame([("a", "x y z")], "doc_id string, text string")
    ws = Workspace(spark, "ids")
    for f in (lambda: neardup.near_duplicates(df, "doc_id", "text", ws), lambda: substrings.dedup_substrings(df, "doc_id", "text", ws)):
        with pytest.raises(TypeError):
            f()
    assert pieces.encode(df, "text").first().doc_id == "a"
    items = spark.createDataFrame([("q1", "some words of a question here? and the answer follows")], "item_id string, text string")
    docs = df.select("doc_id", F.lit("before some words of a question here? and the answer follows after").alias("text"))
    assert [(r.id, r.item_id) for r in decontaminate.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()] == [("a", "q1")]


def test_texts_of_one_id(spark):
    """Texts that share an id link what each of them is linked with."""
    base = [" ".join(f"{c}{i}" for i in range(30)) for c in "ab"]
    rows = [(1, base[0]), (1, base[1]), (2, base[0]), (3, base[1]), (4, "else " + base[0][:20])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", Workspace(spark, "one"), k=2).collect()
    assert {(r.id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


# --- very long texts


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(12)
    big = sentence(rng, 400_000, 50_000)
    assert len(big) > 2_400_000
    cut = big.split(" ")
    return [(1, big), (2, " ".join(cut[1000:1100]) + " and else"), (3, " ".join(cut[:399_000]) + " end"), (4, "short"), (5, "A" * 300_000), (6, "A" * 300_000 + " b")]


def test_long_texts(spark, long_rows):
    df = spark.createDataFrame(long_rows, "doc_id long, text string").repartition(2)
    ws = Workspace(spark, "long")
    got = {r.doc_id: tuple(r)[1:4] for r in substrings.dedup_substrings(df, "doc_id", "text", ws, keep_text=False).collect()}
    assert got == brute_windows(long_rows)
    near = {r.id: r.component_id for r in neardup.near_duplicates(df, "doc_id", "text", ws, k=2).collect()}
    assert near == {i: c for i, (_, c) in brute_components(long_rows, 2).items()} and near[3] == 1
    enc = {r.doc_id: r for r in pieces.encode(df, "text").collect()}
    assert all(r.round_trip for r in enc.values())
    item = spark.createDataFrame([(9, " ".join(long_rows[0][1].split(" ")[2000:2060]) + ". " + " ".join(long_rows[0][1].split(" ")[2060:2070]))], "item_id long, text string")
    assert {r.id for r in decontaminate.leaks(df, "doc_id", "text", item, "item_id", "text").collect()} == {1, 3}


def test_many_matches_in_one_text(spark):
    text = "token=abcdefgh1 " * 20_000 + "é deadbeef" * 3
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    found = secret_scan.scan(df, "doc_id", "text", Workspace(spark, "many")).first().found
    assert [(s.start, s["at"], s.end, s.kind) for s in found] == brute_spans(text) and len(found) == 20_000
    clean = secret_scan.redact(df, "doc_id", "text", Workspace(spark, "many")).first().text
    assert clean == text.replace("token=abcdefgh1", "[SECRET]") and time.time() - began < 60


def test_running_values(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        values = [(i * 37) % 11 - 3 for i in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        total, top, want, most = df.selectExpr(secret_scan.running("v", "0", lambda a, v: f"({a} + {v})"), secret_scan.running("v", "-9", lambda a, v: f"greatest({a}, {v})")).first(), None, [0], [-9]
        for v in values:
            want.append(want[-1] + v)
            most.append(max(most[-1], v))
        assert list(total[0]) == want and list(total[1]) == most


# --- hot groups and blocks


def test_a_payload_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARED", 50)
    rows = [(i, f"http://x/{i}", "same" if i % 3 == 0 else f"<p>{i}") for i in range(600)]
    headers, blobs = warc.write_archive(spark.createDataFrame(rows, PAGES), "page_id", "url", "html", Workspace(spark, "hot"))
    got = {r.id: r for r in warc.read_records(warc.reconstruct(headers, blobs, 50)).collect()}
    assert blobs.count() == 401 and len(got) == 600
    assert sum(r.refers_to == "597" for r in got.values()) == 199 and sum(r.record_type == "response" for r in got.values()) == 401


def test_aliases_at_length(spark):
    """A chain of redirects, a star of canonical links, and an allow that meets a block, among many pages."""
    go = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [(i, f"http://c.example.com/{i}", go(f"http://c.example.com/{i + 1}")) for i in range(400)] + [(400, "http://c.example.com/400", go("http://x.net/"))]
    rows += [(1000 + i, f"http://s.example.com/{i}", link("http://hub.example.com/")) for i in range(3000)] + [(5000, "http://s.example.com/9", go("http://bad.net/"))]
    rows += [(6000, "http://b.example.com/1", link("http://a.example.org/fr/1")), (6001, "http://b.example.com/2", go("http://b.example.com/1")), (6002, "http://b.example.com/2", go("http://bad.net/other"))]
    rows += [(7000 + i, f"http://p.example.com/{i}", None) for i in range(10_000)]
    got = {r.id: r.verdict for r in urls.judge(spark.createDataFrame(rows, PAGES), "page_id", "url", "html", Workspace(spark, "aliases")).collect()}
    assert all(got[i] == "block" for i in range(401)) and all(got[1000 + i] == "block" for i in range(3000))
    assert [got[6000], got[6001], got[6002]] == ["allow"] * 3 and all(got[7000 + i] == "allow" for i in range(10_000))


def test_blocks_of_items_score_alike(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, sentence(rng, 40, 900) + ". " + sentence(rng, 8, 900)) for i in range(60)]
    docs = [(i, sentence(rng, 50, 900) + " " + items[i][1] + " " + sentence(rng, 50, 900)) for i in range(0, 60, 2)] + [(100 + i, sentence(rng, 200, 900)) for i in range(10)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    run = lambda: sorted((r.id, r.item_id, round(r.score, 9)) for r in decontaminate.leaks(df, "doc_id", "text", bench, "item_id", "text").collect())
    whole = run()
    monkeypatch.setattr(decontaminate, "LIMIT", 10)
    assert run() == whole and len(whole) == 30
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(df, "text", bench, "item_id", "text").collect()) == [100 + i for i in range(10)]


def test_training_takes_whole_texts_within_its_bound(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, sentence(rng, 640) if i % 2 else "!!! ??? " * 300) for i in range(80)]
    df = spark.createDataFrame([*rows, (1, "another text of the same id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    monkeypatch.setattr(quality, "PASSAGES", 60)
    scores = [[r.score for r in quality.score(df, "doc_id", "text", quality.train(df.repartition(n), labels, "doc_id", "text", "quality", Workspace(spark, "q"))).orderBy("doc_id", "score").collect()] for n in (1, 3)]
    assert scores[0] == scores[1]


def test_features_of_a_text_are_its_own():
    import numpy as np
    import pyarrow as pa

    from chronolith.llm import textcore

    rng = random.Random(1)
    rows = ["a", "", "bc", None, "x y", *(sentence(rng, n) for n in (1, 70, 200)), "é"]
    x, first = quality.encode(*textcore.column(pa.array(rows)))
    for i, t in enumerate(rows):
        assert np.array_equal(x[first[i] : first[i + 1]], quality.encode(*textcore.column(pa.array([t], pa.string())))[0])
