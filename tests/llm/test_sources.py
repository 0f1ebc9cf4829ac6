"""Target resampling, MinHash groups and the source audit, each against a brute force written anew here."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexweave.llm import divergence, minhash, target_resampling

#: Columns beside the four read, with names that operators like to use.
SCHEMA = "doc_id long, text string, lang string, source string, id string, n long, node long, rank int, key string, bucket long"


def frame(spark, rows):
    """Rows ``(doc_id, text, lang, source)`` with the clashing columns filled."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "k", 4) for r in rows], SCHEMA)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéñ漢XY9-") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    out = []
    for i in range(160):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s10", None, ""])
        usual = words[:60] if source == "s1" else words[30:]
        out.append((i, rng.choice([" ", "\n", ", "]).join(rng.choice(usual) for _ in range(rng.choice([3, 19, 20, 21, 60, 200])))[: rng.choice([90, 5000])], lang, source))
    out += [(200, None, "en", "s1"), (201, "", "en", "void"), (202, " .,!\n", "de", "s1"), (203, "lone", "de", "s2"), (None, out[3][1], "en", "s2"), out[7], out[7], (204, "KK İ ß \x00 ab", "en", "s1")]
    return out + [(205, " ".join(["many words"] * 40_000), "fr", "s2")]


# ---- target resampling ------------------------------------------------------------------------------------------------


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return words, [zlib.crc32(w.encode()) % 10_000 for w in [*words, *map(" ".join, zip(words, words[1:]))]]


def brute_resampling(rows, target):
    s, t = (Counter(b for x in texts for b in features(x)[1]) for texts in ([r[1] for r in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, text, *_ in rows:
        words, own = features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    drawn = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(drawn[: len(drawn) * 25 // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def key(r):
    return tuple((x is None, x) for x in r)


def test_resampling_equals_brute_force(spark, rows):
    target = [lowered(r[1]) for r in rows[:30]] + [None, ""]
    found = target_resampling.target_resample(frame(spark, rows), spark.createDataFrame([(x,) for x in target], "text string"))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute_resampling(rows, target), key=key)


def test_the_ring_holds_every_run_that_ends_at_a_word():
    rng = random.Random(1)
    for longest in (1, 2, 3, 5):
        words = [str(rng.randrange(30)).encode() for _ in range(rng.choice([0, 1, 2, 40]))]
        runs = [b" ".join(words[i:j]) for j in range(len(words) + 1) for i in range(max(0, j - longest), j)]
        n, own = target_resampling.text_buckets(b" ".join(words), longest, 97)
        assert n == len(words) and own.tolist() == [zlib.crc32(r) % 97 for r in runs]


def test_ranks_run_over_all_ranges_and_split_ties_by_id(spark):
    rows = spark.range(3000).selectExpr("2999 - id AS id", "20L AS n_words", "1L AS n_features", "0L AS weight", "id DIV 1000 AS score")
    found = target_resampling.ranked(rows, 50).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 1501)) and [r.id for r in found] == [*range(1000), *range(1000, 1500)]


def test_drawn_rows_keep_their_columns(spark, rows):
    docs = frame(spark, rows)
    target = docs.select("text")
    drawn = {r.id for r in target_resampling.target_resample(docs, target).where("rank IS NOT NULL").collect()}
    kept = target_resampling.keep_drawn(docs, target)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == drawn - {None}


# ---- MinHash ----------------------------------------------------------------------------------------------------------


def shingles(text, words=2):
    own = lowered(text).encode().split()
    return frozenset(tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))) if own else frozenset()


def brute_groups(rows, percent=80):
    sets, reach = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and (a == b or rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b)):
                reach[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return [(r[0], len(sets[k]), c := least.get(find(k)) if sets[k] else r[0], r[0] is not None and r[0] == c) for k, r in enumerate(rows)]


def family(rng, n, size, changes, start):
    """Copies of one text, each with some words changed."""
    base = [f"b{start}w{k}" for k in range(size)]
    out = []
    for k in range(n):
        mine = list(base)
        for _ in range(rng.randint(*changes) if k else 0):
            mine[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append((start + k, " ".join(mine), "en", "s"))
    return out


@pytest.fixture(scope="module")
def copies(rows):
    rng = random.Random(8)
    out = list(rows)
    for k, (n, size, changes) in enumerate([(40, 200, (5, 18)), (60, 60, (1, 5)), (30, 9, (0, 2)), (80, 150, (14, 24)), (12, 3000, (100, 200))]):
        out += family(rng, n, size, changes, 1000 * (k + 1))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("bounds", [{}, {"star_rows": 3, "tile_rows": 8, "tile_bytes": 1 << 14}])
def test_groups_equal_brute_force(spark, copies, bounds):
    found = minhash.minhash_groups(frame(spark, copies), **bounds)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute_groups(copies), key=key)


def test_tiles_find_what_stars_leave_open(spark):
    """Rows at 70 percent of each other share buckets without links; pairs of them are linked beside the centre."""
    rng, rows = random.Random(2), []
    base = [f"w{k}" for k in range(120)]
    for k in range(60):
        mine = list(base)
        for at in rng.sample(range(0, 120, 4), 9):
            mine[at] = f"x{k}y{at}"
        rows.append((2 * k, " ".join(mine), "en", "s"))
        if k % 3 == 0:
            rows.append((2 * k + 1, " ".join([*mine[:-3], "other", "end", str(k)]), "en", "s"))
    wanted = brute_groups(rows)
    assert len({c for _, _, c, _ in wanted}) > 30
    for bounds in ({}, {"tile_rows": 10}):
        assert sorted(map(tuple, minhash.minhash_groups(frame(spark, rows), **bounds).collect())) == sorted(wanted)


def test_bins_of_two_sketches_are_equal_as_often_as_their_sets_are_alike():
    rng = np.random.default_rng(4)
    for size in (5, 30, 400, 5000):
        both = []
        for _ in range(40):
            pool = np.sort(rng.integers(0, 2**64, size, dtype=np.uint64))
            both.append((minhash.sketch(pool) == minhash.sketch(pool[rng.permutation(size) >= size // 5 if size > 5 else np.arange(5) != 2])).mean())
        assert abs(np.mean(both) - 0.8) < 0.03, size


def test_a_single_element_fills_every_bin():
    assert (minhash.sketch(np.array([12345], np.uint64)) == 12345).all()


# ---- source audit -----------------------------------------------------------------------------------------------------


def brute_audit(rows, least=10, top=10):
    rows = [(r[1] or "", r[2] or "", r[3] or "") for r in rows]
    docs, counts = {}, {}
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        docs.setdefault(lang, Counter()).update(set(terms))
        counts.setdefault((lang, source), Counter()).update(terms)
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = sum(groups.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in groups:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            for part, found in (("pair", pairs), ("term", terms[:top])):
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("held", [divergence.HELD_TERMS, 7])
def test_audit_equals_brute_force(spark, rows, held, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    found = divergence.source_divergence(frame(spark, rows))
    assert sorted(map(tuple, found.collect())) == brute_audit(rows)


def test_terms_whose_bound_is_too_low_are_not_evaluated(spark, monkeypatch):
    """Many terms, few of which set a source apart: only some are evaluated, ties at the k-th value among them."""
    rows = [(i, " ".join(f"t{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]}" for k in range(1000)), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100 + i, " ".join(["rare" + "abcdefghijklmnop"[i % 16]] * 9), "en", "s1") for i in range(160)]
    seen, evaluate = [], divergence.ranked

    def counting(rows, top):
        seen.append(rows.count())
        return evaluate(rows, top)

    monkeypatch.setattr(divergence, "ranked", counting)
    found = divergence.source_divergence(frame(spark, rows))
    assert sorted(map(tuple, found.collect())) == brute_audit(rows)
    assert seen[-1] < 2100  # of 3016 postings


def test_counts_beyond_64_bits_stay_exact(spark):
    row = spark.range(1).select(divergence.share(divergence.F.lit(3 * 10**17), divergence.F.lit(10**18), divergence.F.lit(10**6)).alias("p")).first()
    assert row.p == 1 + 10**9 * (3 * 10**17 + 2) // (10**18 + 2 * 10**6)


def test_empty_tables(spark):
    none, one = frame(spark, []), frame(spark, [(1, "a b c d e", "en", "s")])
    assert target_resampling.target_resample(none, none).count() == 0 and minhash.minhash_groups(none).count() == 0 and divergence.source_divergence(none).count() == 0
    assert [tuple(r) for r in minhash.minhash_groups(one).collect()] == [(1, 4, 1, True)]
    assert target_resampling.target_resample(one, none).first().n_features == 9 and divergence.source_divergence(one).count() == 0
