"""Learnt operators, archives and the pipeline: held-out accuracy, brute force, round trips."""

import hashlib
import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexweave.llm import resampling, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, score double, label int"
RUDE = ["blorkface", "snarfhead", "grubnut"]


def corpus(seed, n=600, disguise=False):
    """Prose, some of it rude (spelled out or disguised), some of it junk."""
    rng = random.Random(seed)
    words = [a + b for a in ("ka", "lo", "mi", "ter", "sun", "bel") for b in ("ran", "dis", "ment", "tor", "ly", "ful", "ness")]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        rude, junk = rng.random() < 0.25, rng.random() < 0.25
        if rude:
            word = rng.choice(RUDE)
            if disguise and rng.random() < 0.5:
                word = rng.choice([word.replace("a", "4").replace("o", "0").replace("u", "u"), word[0] + word[1] * 5 + word[2:], ".".join(word)])
            text[rng.randrange(len(text))] = word
        if junk:
            text = [w + rng.choice(["$$", "%%", "&&"]) for w in text]
        rows.append((i, " ".join(text), "en", "s", 0.5, 7))
        labels.append((i, int(not junk), int(rude)))
    return rows, labels


@pytest.fixture(scope="module")
def frames(spark):
    rows, labels = corpus(1)
    extra = [(9001, None, "en", "s", 0.0, 1), (9002, "", None, None, 0.0, 1), (None, "kaly kator", "en", "s", 0.0, 1), (3, rows[3][1], "en", "s", 0.0, 1)]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    marks = spark.createDataFrame(labels + [(5, None, None), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, marks, labels


def test_decoder_restores_disguises(spark):
    text = " ".join(["blorkface snarfhead grubnut kaly kator lodis miment"] * 50)
    counts = toxicity.trigram_counts(spark.createDataFrame([(1, text)], "id long, text string"))
    decoder = toxicity.Decoder(toxicity.language_model(counts))
    for written in ("bl0rkf4ce", "blooooorkface", "b.l.o.r.k.f.a.c.e", "BLORKFACE!!".lower(), "blorkface***"):
        assert decoder.restore(written) == "blorkface", written
    assert "grubnut" in decoder.words("you g r u b n u t there")
    assert decoder.restore("kator,") == "kator" and decoder.restore("2024") == "2024" and decoder.restore("***") == ""


def test_toxicity_holds_out_and_generalises(spark):
    rows, labels = corpus(2, disguise=True)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, marks).collect()
    truth = {i: t for i, _, t in labels}
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(truth[r.id], r.score) for r in found if r.held_out]
    bad, good = [s for t, s in held if t], [s for t, s in held if not t]
    assert np.mean([b > g for b in bad for g in good]) > 0.95
    flipped = marks.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.id: r.score for r in toxicity.toxicity(docs, flipped).collect()} == {r.id: r.score for r in found}


def test_toxicity_of_awkward_rows(frames):
    docs, marks, _ = frames
    found = toxicity.toxicity(docs, marks).collect()
    by = {r.id: r for r in found}
    assert len(found) == docs.count() and by[9001].score == by[9002].score and by[None].held_out is False
    assert toxicity.toxicity(docs.where("false"), marks.where("false")).count() == 0


def test_resampling_keeps_good_and_drops_junk(frames):
    docs, marks, labels = frames
    found = resampling.importance_resample(docs, marks).collect()
    assert len(found) == docs.count()
    by = {r.id: r.selected for r in found}
    good = [by[i] for i, q, _ in labels if q]
    bad = [by[i] for i, q, _ in labels if not q]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05
    kept = resampling.keep_selected(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.selected for r in found)
    assert resampling.importance_resample(docs.where("false"), marks).count() == 0
    assert all(r.selected for r in resampling.importance_resample(docs, marks.where("false")).collect())


def test_an_id_on_a_good_and_a_bad_text_loses_the_bad_one_only(frames, spark):
    docs, marks, labels = frames
    found = {r.id: r for r in resampling.importance_resample(docs, marks).collect()}
    cut = min(r.gumbel_key for r in found.values() if r.selected)
    noise = {i: r.gumbel_key - r.log_weight for i, r in found.items()}
    good, bad = next((i, j) for i, q, _ in labels if q and i != 3 and found[i].selected for j, p, _ in labels if not p and found[j].log_weight + noise[i] < cut - 5)
    texts = {r.doc_id: r.text for r in docs.collect()}
    more = docs.where(F.col("doc_id") == bad).withColumn("doc_id", F.lit(good).cast("long"))
    kept = [r.text for r in resampling.keep_selected(docs.unionByName(more), marks).where(F.col("doc_id") == good).collect()]
    assert texts[good] in kept and texts[bad] not in kept


def test_weights_equal_a_brute_force_of_the_two_models(frames):
    """Counts, ratios, sums, noise and cut computed again from the words, text by text."""
    docs, marks, labels = frames
    result = resampling.importance_resample(docs, marks, k=150).collect()
    found = {r.id: r for r in result}

    def grams(text):
        words = (text or "").encode().lower().split()
        shift = 64 - 15
        h = [zlib.crc32(w) for w in words]
        single = [(x + 1) * 0x9E3779B97F4A7C15 % 2**64 >> shift for x in h]
        return single + [((a << 32 | b) ^ 0xA5A5) * 0x9E3779B97F4A7C15 % 2**64 >> shift for a, b in zip(h, h[1:])]

    rows = [(r.doc_id, grams(r.text)) for r in docs.collect()]
    fitted = {r[0] for r in marks.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(resampling.SEED)), F.lit(2)) == 0).select("doc_id").collect()}
    targets = {i for i, q, _ in labels if q and i in fitted}
    raw, target = np.zeros(1 << 15), np.zeros(1 << 15)
    for i, g in rows:
        for b in g:
            raw[b] += 1
            target[b] += i in targets
    prior = (raw + 1) / (raw.sum() + len(raw))
    ratio = np.log((target + 4 * len(raw) * prior) / (target.sum() + 4 * len(raw))) - np.log(prior)
    for i, g in rows:
        assert found[i].grams == len(g) and abs(found[i].log_weight - sum(ratio[b] for b in g)) < 1e-4
    keys = sorted((r.gumbel_key for r in result), reverse=True)
    assert all(r.selected == (r.gumbel_key >= keys[149]) for r in result) and sum(r.selected for r in result) >= 150


def test_top_k_is_exact(spark):
    rows = spark.range(20_000).withColumn("key", F.floor(F.rand(3) * 3000) / 7)
    values = sorted((r.key for r in rows.collect()), reverse=True)
    for k in (1, 50, 9_999, 19_999):
        assert resampling.top_k_cut(rows, "key", k) == values[k - 1]
    assert resampling.top_k_cut(rows, "key", 20_000) == -np.inf and resampling.top_k_cut(rows, "key", 0) == np.inf


def test_selection_is_by_gumbel_key(frames):
    docs, marks, _ = frames
    found = resampling.importance_resample(docs, marks, k=100).collect()
    keys = sorted((r.gumbel_key for r in found), reverse=True)
    assert {r.id for r in found if r.selected} == {r.id for r in found if r.gumbel_key >= keys[99]}


def test_gram_counts_equal_brute_force():
    texts = [b"One two one", b"", b"single", b"a b\tc\n d"]
    grams, sizes = resampling.gram_buckets(texts)
    assert sizes.tolist() == [5, 0, 1, 7] and len(grams) == 13
    again, _ = resampling.gram_buckets([b"one TWO one"])
    assert again.tolist() == grams[:5].tolist() and grams[0] == grams[4]


PAGES = "page_id long, url string, html string, refers_to long"


def test_archives_give_back_every_page(spark):
    rows = [(3, "http://a", "<p>é</p>", 1), (1, "http://b", "<p>é</p>", 1), (2, None, None, 1), (5, "http://c\r\nX: y", "", 1), (7, "u", "x" * 100_000, 1), (1, "http://b", "<p>é</p>", 1), (None, "n", "<p>é</p>", 1), (8, "crlf", "a\r\n\r\nb", 1)]
    found = warc.archive_round_trip(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert len(found) == len(rows)
    first = {}
    for i, _, html, _ in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    texts = {i: html or "" for i, _, html, _ in rows}
    for r in found:
        payload = texts[r.page_id].encode()
        chief = first[texts[r.page_id]]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), warc.payload_digest(payload))
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == chief else ("revisit", chief))
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_small_payloads_are_never_revisits(spark):
    rows = [(1, "a", "same", 0), (2, "b", "same", 0)]
    assert {r.record_type for r in warc.archive_round_trip(spark.createDataFrame(rows, PAGES), least_bytes=5).collect()} == {"response"}


def test_directory_of_an_ordinary_package():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a.txt", b"hello world")
        z.writestr("é/b.txt", b"second")
        z.writestr(zipfile.ZipInfo("deflated"), b"x" * 99, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    d = warc.ZipDirectory(raw, len(raw.getvalue()))
    assert d.read("a.txt", 6, 5) == b"world" and d.read("é/b.txt") == b"second"
    for call in (lambda: d.read("deflated"), lambda: d.read("a.txt", 8, 9)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(ValueError):
        warc.ZipDirectory(io.BytesIO(b"not a package"), 13)


def test_zip64_directory():
    """A package whose short fields all overflow, built by hand."""
    name, data = b"big.warc", b"0123456789"
    local = warc.LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 0, zlib.crc32(data), warc.ALL32, warc.ALL32, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    entry = warc.ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 0, zlib.crc32(data), warc.ALL32, warc.ALL32, len(name), len(extra), 0, 0, 0, 0, warc.ALL32) + name + extra
    at = len(local) + len(data)
    end64 = warc.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = warc.LOCATOR64 + struct.pack("<IQI", 0, at + len(entry), 1)
    end = warc.END + struct.pack("<HHHHIIH", 0, 0, warc.ALL16, warc.ALL16, warc.ALL32, warc.ALL32, 0)
    package = local + data + entry + end64 + locator + end
    assert zipfile.ZipFile(io.BytesIO(package)).read("big.warc") == data
    assert warc.ZipDirectory(io.BytesIO(package), len(package)).read("big.warc", 3, 4) == b"3456"


def test_a_broken_payload_is_noticed():
    raw = warc.record(1, "u", b"payload", None).replace(b"payload\r\n", b"pAyload\r\n")
    package = io.BytesIO()
    with zipfile.ZipFile(package, "w") as z:
        z.writestr(warc.ARCHIVE_MEMBER, zlib.compress(raw, wbits=31))
    d = warc.ZipDirectory(package, len(package.getvalue()))
    with pytest.raises(ValueError):
        warc._row(d, {"url": "u", "offset": 0, "length": d.members[warc.ARCHIVE_MEMBER].size})


def test_pipeline_stage_by_stage(spark, tmp_path):
    rows, labels = corpus(7, 300)
    rows += [(1000 + k, rows[0][1], "en", "s", 0.0, 1) for k in range(5)] + [(2000, None, "en", None, 0.0, 1), (1, rows[1][1], "en", "s", 0.0, 1)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, texts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), SCHEMA)
        assert docs.columns == columns, name
        texts.append([r.text or "" for r in docs.collect()])
    assert len(texts[0]) >= len(texts[1]) >= len(texts[2]) and len(set(texts[0])) == len(texts[1]) == len(set(texts[1]))
    result = corpus_pipeline.run(spark, folder).collect()
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, folder).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in result) == sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed)
