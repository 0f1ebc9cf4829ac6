"""Disguises of any length reach the lattice: spaced sentences, long words, lookalikes at the end, doubled letters."""

import random
import time
from itertools import product

import numpy as np
import pytest

from lexweave.llm import toxicity


@pytest.fixture(scope="module")
def decoder(spark):
    rng = random.Random(3)
    words = ["blorkface", "snarfhead", "grubnut", "ass", "kaly", "kator", "lodis", "miment", "you", "are"]
    text = " ".join(rng.choice(words) for _ in range(3000))
    return toxicity.Decoder(toxicity.language_model(toxicity.trigram_counts(spark.createDataFrame([(1, text)], "id long, text string"))))


def test_a_spaced_sentence_of_any_length_gives_its_words(decoder):
    words = ["you", "are", "kator", "grubnut", "lodis", "miment", "kaly", "kator", "snarfhead", "you", "are", "blorkface", "kaly"]
    assert sum(map(len, words)) > 64
    for gap in ("  ", " "):
        found = decoder.words(gap.join(" ".join(w) for w in words))
        assert {"grubnut", "snarfhead", "blorkface"} <= set(found), gap
    assert "grubnut" in decoder.words("y o u  g r u b n u t")


def test_words_of_any_length_and_few_letters_are_decoded(decoder):
    assert decoder.restore("bl0rkf4ce" + "e" * 80) == "blorkface"
    assert "ass" in decoder.forms("4$$") and "2024" in decoder.forms("2024")
    assert "ass" in decoder.forms("a$$") and "ass" in decoder.forms("as$!") | decoder.forms("as$")
    assert "grubnut" in decoder.forms("gruubnut") and "grubnut" in decoder.forms("grubnu+")
    assert decoder.forms("kator!") >= {"kator"}


def test_decoding_is_linear_in_length(decoder):
    began = time.process_time()
    assert len(decoder.restore("k4tor" * 20_000)) == 100_000
    assert time.process_time() - began < 20


@pytest.mark.parametrize("text", ["x " + "-" * 10**6 + "heading", "a " + ". " * 10**5 + "b", "* " * 10**5 + "word", "a- " * 10**5 + "zz", "-.*" * 10**5 + "w", "a-b" + "-c" * 10**5])
def test_no_text_is_slow_to_search_for_spaced_letters(text):
    began = time.process_time()
    for _ in toxicity._SPACED.finditer(text):
        pass
    assert time.process_time() - began < 1


def test_spaced_letters_glued_to_a_word_stay(decoder):
    assert decoder.words("xx-y-o-u are") == ["xx-y-o-u", "are"]
    assert "you" in decoder.words("say y.o.u are") and "you" in decoder.words("y_o_u") and "you" in decoder.words("end. y o u\nare")
    assert decoder.words("a b") == ["a", "b"] and decoder.words("") == []


def test_viterbi_equals_the_best_of_all_paths(decoder):
    """Every choice for every run of one mark, scored from the model's table."""
    model = np.array(decoder.model)
    rng = random.Random(8)
    for _ in range(150):
        word = "".join(rng.choice("aglru04$1t.n") for _ in range(rng.randint(1, 7)))
        runs = [(m[1], len(m[0])) for m in toxicity._RUN.finditer(word)]
        best = -np.inf
        for path in product(*(decoder.options(c, n) for c, n in runs)):
            letters = "".join(o for o, _ in path)
            codes = [0, 0, *(toxicity._INDEX[c] for c in letters), 0]
            best = max(best, sum(model[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:])) - sum(c for _, c in path))
        spelled = decoder.viterbi(word)
        codes = [0, 0, *(toxicity._INDEX[c] for c in spelled), 0]
        own = sum(model[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:]))
        cost = min(sum(c for _, c in path) for path in product(*(decoder.options(c, n) for c, n in runs)) if "".join(o for o, _ in path) == spelled)
        assert abs(own - cost - best) < 1e-3


def test_fit_finds_the_minimum_of_the_penalised_loss():
    rng = np.random.default_rng(2)
    dense = (rng.random((400, 6)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(dense @ np.array([2, -1, 0.5, 0, 1, -2]) - 0.3)))).astype(np.int8)
    rows = [np.flatnonzero(r).astype(np.int32) for r in dense]
    w, bias = toxicity._fit(y, np.array([len(r) for r in rows], np.int32), np.concatenate(rows), 6, rounds=5000)
    theta = np.zeros(7)
    full = np.c_[dense, np.ones(400)]
    for _ in range(50):  # Newton's method on the same loss
        p = 1 / (1 + np.exp(-full @ theta))
        penalty = np.diag([0.3] * 6 + [0])
        theta -= np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) + penalty, full.T @ (p - y) + penalty @ theta)
    assert np.abs(np.r_[w, bias] - theta).max() < 0.01


def test_scores_equal_a_brute_force_of_the_model(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["kaly", "kator", "lodis", "grubnut", "gr0bnut", "m e e t"]) for _ in range(rng.randint(0, 9)))) for i in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    labels = spark.createDataFrame([(i, int("grubnut" in (t or ""))) for i, t in rows], "id long, label int")
    model = toxicity.train(docs, labels)
    decoder = toxicity.Decoder(model.language)
    assert model.features and len(toxicity.train(docs, labels, max_features=2).features) == 2
    for r in toxicity.score(docs, model).collect():
        text = dict(rows)[r.id]
        present = {f for w in decoder.words(text or "") for f in decoder.features(w)}
        z = model.bias + sum(model.weights[i] for f, i in model.features.items() if f in present)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-5
