"""Near duplicates of the pipeline: every pair with five-word shingle similarity 0.8 or more, against brute force."""

import hashlib
import random

import pytest

import corpus_pipeline
from lexweave.llm import simhash

SCHEMA = "doc_id long, text string, lang string, id string, keep_id long"
WORDS = [f"w{i}" for i in range(300)]


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    sets, reach = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                reach[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def rows():
    """Bases with copies from similarity 1 down to below 0.8, sets at the very bound, a common passage, awkward rows."""
    rng = random.Random(11)
    common = [rng.choice(WORDS) for _ in range(30)]
    out = []
    for base in range(6):
        words = [rng.choice(WORDS) for _ in range(rng.choice([40, 150, 400]))] + common
        for copy in range(25):
            mine = list(words)
            for _ in range(rng.randint(0, len(words) // 30)):
                mine[rng.randrange(len(mine))] = f"x{rng.randrange(10**6)}"
            if copy % 5 == 0:
                mine = mine[rng.randint(0, 12) :]
            out.append((len(out), " ".join(mine)))
    out += [(500 + i, " ".join([f"q{k}" for k in range(k)])) for i, k in enumerate((12, 14, 84, 104, 105))]  # 8 of 10, 80 of 100, 80 of 101 shingles
    rng.shuffle(out)
    return out + [(900, None), (901, ""), (902, "  \n"), (903, "one"), (904, "One"), (905, "one two"), (None, out[0][1] + " more"), (3, "another text of the same id with words enough")]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("tile_bytes", [simhash.TILE_BYTES, 4 << 10])
def test_groups_equal_brute_force(spark, rows, tile_bytes, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_BYTES", tile_bytes)
    monkeypatch.setattr(simhash, "VISIT_BYTES", tile_bytes)
    found = simhash.similar_groups(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    wanted, got = {}, {}
    for k, ((i, t), g) in enumerate(zip(rows, brute_components([t for _, t in rows]))):
        wanted.setdefault(g, []).append((str(i), hashlib.sha256((t or "").encode()).hexdigest()))
    for r in found:
        got.setdefault(r.component, []).append((str(r.id), r.sha.hex()))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_no_similar_pair_is_missed_among_many_sizes(spark):
    """Pairs at similarities from 0.8 up for sets of 5 to 400 shingles, beside texts of no one."""
    rng, out, similar = random.Random(3), [], 0
    for base in range(150):
        words = [f"b{base}w{k}" for k in range(rng.choice([8, 9, 12, 30, 100, 404]))]
        other = words[: len(words) - rng.randint(0, max(1, len(words) // 5))]
        out += [(2 * base, " ".join(words)), (2 * base + 1, " ".join(other))]
        a, b = shingle_set(" ".join(words)), shingle_set(" ".join(other))
        similar += 5 * len(a & b) >= 4 * len(a | b)
    found = simhash.similar_groups(documents(spark, out)).collect()
    component = {r.id: r.component for r in found}
    assert similar > 50 and sum(component[2 * b] == component[2 * b + 1] for b in range(150)) == similar


def test_an_id_on_two_texts_loses_only_the_copy(spark):
    one, two = " ".join(WORDS[:60]), " ".join(WORDS[100:160])
    kept = simhash.keep_one_per_group(documents(spark, [(1, one), (2, two), (2, one), (None, one), (5, two), (5, two)])).collect()
    assert sorted((r.doc_id, r.text == one) for r in kept) == [(1, True), (2, False)]
    assert [r.doc_id for r in simhash.keep_one_per_group(documents(spark, [(None, None), (None, "")])).collect()].count(None) == 2


def test_stage_drops_copies_at_similarity_above_four_fifths(spark):
    words = [f"w{i}" for i in range(150)]
    near = [*words[:60], "other", *words[61:120], "else", *words[121:]]  # 136 of 156 shingles: 0.87
    far = [("y" if i % 30 == 7 else w) for i, w in enumerate(words)]  # 121 of 171: 0.71
    docs = documents(spark, enumerate(map(" ".join, (words, near, far))))
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_a_very_long_text(spark):
    long = " ".join(str(k) for k in range(300_000))
    found = simhash.similar_groups(documents(spark, [(1, long), (2, long + " more"), (3, "short")])).collect()
    component = {r.id: r.component for r in found}
    assert component[1] == component[2] != component[3]


def test_empty_table(spark):
    assert simhash.similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.keep_one_per_group(spark.createDataFrame([], SCHEMA)).count() == 0
