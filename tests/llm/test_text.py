"""Encoding, mixing, chat, quality rules: against libraries, brute force and round trips."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexweave.llm import bpe, chat, mixing, quality_rules

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
RANKS = "byte_bpe_multi_50k.tiktoken"
SCHEMA = "doc_id long, text string, lang string, source string, size long, words string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 9, "clash") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(P.path(RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(P.path(RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_leaves_no_place_free(vocabulary):
    assert sorted(vocabulary.slots.tolist()) == list(range(len(vocabulary.tokens)))
    codec = bpe.Codec(vocabulary)
    assert all(codec.whole(t) == i for t, i in list(zip(vocabulary.tokens, vocabulary.ids))[::97])
    assert codec.whole(b"surely not a token of this vocabulary") == -1


def test_ids_are_those_of_the_library(vocabulary, reference):
    codec, rng = bpe.Codec(vocabulary), random.Random(1)
    letters = list("abc the 's 'll 12³Ⅳ½é ü\n\n\t\r  \x1c\x1f\x85\xa0 　中文ا😀'_.,!--​\x0b\x0c ß")
    for n in list(range(20)) * 60 + [3000]:
        text = "".join(rng.choice(letters) for _ in range(n))
        assert codec.encode(text) == reference.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_forgetting_changes_nothing(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    text = " ".join(f"xq{i % 11}z" for i in range(200))
    assert bpe.Codec(vocabulary).encode(text) == reference.encode_ordinary(text)


def test_round_trip_of_awkward_rows(spark, vocabulary, reference):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "  two  blanks ", "en", None), (3, "  two  blanks ", "en", None), (None, "zażółć", None, "b"), (5, "word " * 50_000, "en", "b")]
    found = bpe.round_trip(table(spark, rows), vocabulary).collect()
    expected = Counter()
    for i, t, *_ in rows:
        ids = reference.encode_ordinary(t or "")
        expected[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, found)) == expected
    encoded = bpe.encode(table(spark, rows), vocabulary)
    raw = {r.id: bytes(r.raw) for r in bpe.decode(encoded, vocabulary).collect()}
    assert raw[3] == b"  two  blanks " and raw[1] == b""
    assert bpe.round_trip(table(spark, []), vocabulary).count() == 0


def water(sizes, weights, share, most):
    """Targets by sharing the excess again and again."""
    targets = {s: 0.0 for s in sizes}
    left, open_ = share * sum(sizes.values()), {s for s in sizes if sizes[s] > 0}
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        for s in open_:
            targets[s] += left * weights[s] / total
        left = sum(max(0.0, targets[s] - most * sizes[s]) for s in open_)
        for s in list(open_):
            if targets[s] >= most * sizes[s]:
                targets[s] = most * sizes[s]
                open_.discard(s)
    return targets


def test_mix_reaches_every_target(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 30), "en", rng.choice(["a", "a", "a", "a", "b", "é", "z", None])) for i in range(300)]
    rows += [(400, None, "en", "a"), (401, "", "en", "only-empty"), (7, "again a row", "en", "b"), (None, "no id", "en", "b")]
    found = mixing.mix(table(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = water(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    taken = defaultdict(int)
    for r in found:
        taken[r.source] += r["__mix_taken"]
        assert abs(r["__mix_target"] - targets[r.source]) < 1e-6 and 0 <= r["__mix_taken"] <= 2 * r["__mix_size"]
        assert r["__mix_source_size"] == sizes[r.source]
    assert {s: taken[s] for s in sizes} == {s: int(t + 1e-9) for s, t in targets.items()}
    assert sorted(map(str, mixing.mix(table(spark, rows).repartition(3)).collect())) == sorted(map(str, found))


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(i % 7 + 1)), "en", "ab"[i % 2]) for i in range(40)]
    docs = table(spark, rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
        assert (" " + dict((i, t) for i, t, *_ in rows)[r.doc_id]).startswith(" " + r.text.strip())
    total = mixing.mix(docs).groupBy("source").agg(F.sum("__mix_taken").alias("n")).collect()
    assert words == {r.source: r.n for r in total}
    assert mixing.mixed_documents(table(spark, [])).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(3)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "[ROLE]", "[TEXT]", "[NEXT]", "[END]</s>", "~", "~1", "~01", "\n", "hé", "", "\\"]
    rows = [(c, k, rng.choice(["user", "user", "assistant", "[TEXT]"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))) for c in range(12) for k in range(rng.randint(1, 6))]
    rows += [(50, 0, None, None), (50, None, "assistant", "first"), (50, 0, "assistant", "tie"), (None, 1, "assistant", "nobody's"), (51, 0, "assistant", "same"), (51, 0, "assistant", "same")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_conversations(turns).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss_text", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    by = defaultdict(list)
    for c, k, role, text in rows:
        by[c].append((k is not None, k or 0, role or "", text or ""))
    assert len(done) == len(by)
    for r in done:
        expected = [(role, text) for _, _, role, text in sorted(by[r.conv_id])]
        assert [(t.role, t.text) for t in r.back] == expected
        assert r.loss_text == "".join(text for role, text in expected if role == "assistant")
        raw = r.formatted.encode()
        assert all(r.loss_spans[k].start + r.loss_spans[k].length <= r.loss_spans[k + 1].start for k in range(len(r.loss_spans) - 1))
        assert not any(c in raw[x.start : x.start + x.length] for x in r.loss_spans for c in (b"[", b"<"))  # no control string under the mask
        assert r.formatted.count(chat.OPEN) == sum(1 for i, (role, _) in enumerate(expected) if i == 0 or expected[i - 1][0] != role)
    assert chat.format_conversations(turns.where("false")).count() == 0


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["a", "b", "the", " ", " ", "\n", "#", "é", "\x85"]) for _ in range(rng.randint(0, 120))), rng.choice(["en", "xx", None]), "s") for i in range(120)]
    rows += [(200, None, "en", "s"), (201, "", None, "s"), (202, "same same same same same same same same same same same", "en", "s"), (202, "same same same same same same same same same same same", "en", "s"), (None, "w " * 5000, "en", "s")]
    found = {r.id: r for r in quality_rules.quality_rules(table(spark, rows)).collect()}
    for i, text, *_ in rows:
        r = found[i]
        expected = base_counts(text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(table(spark, [])).count() == 0


def test_divergence_fails_symbols_and_spares_prose(spark):
    rng = random.Random(5)
    common, rare = ["the", "of", "and", "to", "in", "a"], [f"word{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.35 else rng.choice(rare) for _ in range(n))
    rows = [(i, prose(300), "en", "s") for i in range(60)]
    rows += [(100, " ".join(w + "***" for w in prose(300).split()), "en", "s"), (101, " ".join(rng.choice(rare) for _ in range(300)), "en", "s"), (102, "*** " + " ".join(rng.sample(rare, 11)), "en", "s")]
    kept = {r.id: r.kept for r in quality_rules.quality_rules(table(spark, rows)).collect()}
    assert all(kept[i] for i in range(60)) and not kept[100] and not kept[101] and kept[102]


def test_places_of_many_pieces(spark):
    lengths = [k * 7 % 11 for k in range(1000)]
    (row,) = spark.createDataFrame([(lengths,)], "x array<int>").select(chat.starts_of(F.col("x")).alias("at")).collect()
    assert row["at"] == [sum(lengths[:k]) for k in range(1000)]


def test_a_long_conversation_reads_back(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"[é<{k}") for k in range(900)]
    done = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    r = done.select(chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t.role, t.text) for t in r.back] == [(x[2], x[3]) for x in rows] and r.loss == "".join(x[3] for x in rows if x[2] == "assistant")
