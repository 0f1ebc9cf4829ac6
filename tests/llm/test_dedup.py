"""Exact and near duplicates, repeated passages: against brute force on small tables with every awkward row."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexweave.llm import exact, simhash, substrings

SCHEMA = "doc_id long, text string, lang string, id string, keep_id long"


def table(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], SCHEMA)


WORDS = [f"w{i}" for i in range(200)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randint(1, 120))) for i in range(80)]
    out += [(100 + i, out[3][1]) for i in range(25)]  # a large group of copies
    long = prose(rng, 400)
    out += [(200 + i, long.replace("w7 ", f"v{i} ", 1)) for i in range(20)]  # near copies
    out += [(300, None), (301, ""), (302, "   \n\t"), (303, "one"), (304, "one TWO"), (None, "null id text"), (305, "One two")]
    return out


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    reach = {i: i for i in range(len(prints))}

    def find(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                reach[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("tile_rows,visit_rows", [(4, 3), (8192, 8192)])
def test_simhash_equals_brute_force(spark, rows, tile_rows, visit_rows):
    found = simhash.near_duplicate_groups(table(spark, rows), tile_rows=tile_rows, visit_rows=visit_rows).collect()
    assert len(found) == len(rows)
    prints = [brute_fingerprint(t) for _, t in rows]
    by_id = {r.id: r for r in found}
    groups = brute_components(prints)
    for (i, _), fp, g in zip(rows, prints, groups):
        assert by_id[i].fp & (2**64 - 1) == fp
        members = [d for (d, _), h in zip(rows, groups) if h == g and d is not None]
        assert by_id[i].component_id == (min(members) if members else None)


def test_tile_keeps_a_forest_of_a_dense_group():
    base = np.uint64(0x0F0F0F0F0F0F0F0F)
    near = np.array([base ^ np.uint64(1 << a) for a in range(64)], dtype=np.uint64)  # all within two bits
    tile = simhash._Tile(near, 3)
    tile.meet(near, inside=True)
    assert len(tile.links) == 63 and len(set(tile.label.tolist())) == 1


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicate_groups(table(spark, [])).count() == 0


def test_near_dedup_keeps_columns_and_one_of_each_group(spark, rows):
    docs = table(spark, [r for r in rows if r[0] is not None])
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & set(range(200, 220))) == 1 and 300 in ids and not ids & {301, 302}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates(spark, rows, keep):
    rows = rows + [(303, "one"), (303, "other")]  # a repeated row, and an id with another text
    found = exact.exact_duplicates(table(spark, rows), keep=keep).collect()
    assert len(found) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    best = min if keep == "smallest" else max
    for r in found:
        members = groups[r.sha]
        known = [i for i in members if i is not None]
        assert r.group_size == len(members) and r.keep_id == (best(known) if known else None)
    assert sum(r.kept for r in found) == len(groups)


def test_drop_duplicates_keeps_one_row_of_each_text(spark, rows):
    rows = rows + [(303, "one"), (303, "other")]
    docs = table(spark, rows)
    kept = exact.drop_duplicates(docs).collect()
    texts = [r.text or "" for r in kept]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in rows})


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_runs_merge_over_several_rounds_and_ranges(spark, keep, monkeypatch):
    monkeypatch.setattr(exact, "RUN_KEYS", 16)
    rows = [(k, f"t{k % 37 if k % 3 else 0}") for k in range(600)] + [(None, "t0"), (None, "own")]
    found = exact.exact_duplicates(table(spark, rows).repartition(40), keep=keep).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
    for r in found:
        known = [i for i in groups[r.sha] if i is not None]
        assert r.group_size == len(groups[r.sha]) and r.keep_id == ((min if keep == "smallest" else max)(known) if known else None)
    assert len(found) == len(rows) and sum(r.kept for r in found) == len(groups)


def test_a_merged_run_is_sorted_and_has_each_key_once(spark):
    rows = exact.digests(table(spark, [(k, f"t{k % 5}") for k in range(60)]).repartition(7))
    merged = exact.merge_runs(rows).collect()
    assert len(merged) == 5 and sum(r.group_size for r in merged) == 60 and sorted(r.keep_id for r in merged) == [0, 1, 2, 3, 4]


def test_exact_on_an_empty_table(spark):
    assert exact.exact_duplicates(table(spark, [])).count() == 0 and exact.drop_duplicates(table(spark, [])).count() == 0


def brute_removed(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            for p in range(len(t) - 49):
                first[t[p : p + 50]] = min(i, first.get(t[p : p + 50], i))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if i is not None and first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    """Copies, passages at the very start and end, passages of just under and just fifty bytes, periodic texts."""
    rng = random.Random(seed)
    letters = "abcdeé"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 80, 300)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cut = rng.randint(0, 20)
            parts += [s[cut:] if rng.random() < 0.3 else s, text(rng.randint(0, 60))]
        rows.append((i, "".join(parts)))
    rows += [(70, rows[5][1]), (71, rows[5][1]), (72, "ab" * 90), (73, "ba" * 60), (74, "a" * 200), (75, "a" * 49), (76, "a" * 50), (77, None), (78, ""), (72, "ab" * 90), (None, rows[5][1]), (5, shared[4])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rows = passages(seed)
    found = substrings.remove_repeats(table(spark, rows).repartition(5), with_text=True).collect()
    expected = brute_removed([(i, (t or "").encode()) for i, t in rows])
    assert sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=str) == expected
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in found)


@pytest.mark.parametrize(("sort_rows", "task_rows"), [(4, 10), (7, 100_000), (3, 3)])
def test_repeats_of_groups_beyond_the_bounds(spark, sort_rows, task_rows):
    """One string stands in all texts amid bytes that differ, agree in part or agree in whole; texts repeat themselves."""
    rng = random.Random(sort_rows)
    short = lambda n: "".join(rng.choice("abc") for _ in range(n))
    hot, halves = "=" * 16 + "common" * 3, [short(30) for _ in range(3)]
    rows = [(i, short(rng.randint(0, 60)) + rng.choice(halves) + hot + rng.choice(halves) + short(rng.randint(0, 60))) for i in range(90)]
    rows += [(200 + i, short(20) + ("-" * 70 + short(1)) * rng.randint(1, 6)) for i in range(15)]
    rows += [(300 + i, (halves[0] + hot + halves[1] + " ") * 8) for i in range(3)] + [(400, (short(55) + " ") * 9)] * 2
    rows += [(500, "own " + "only-here-" * 30), (500, "only-here-" * 20), (None, hot * 4), (-3, None), (-4, "")]
    rng.shuffle(rows)
    found = substrings.remove_repeats(table(spark, rows).repartition(7), with_text=True, sort_rows=sort_rows, task_rows=task_rows).collect()
    expected = brute_removed([(i, (t or "").encode()) for i, t in rows])
    assert sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=str) == expected


def test_repeats_of_a_text_that_fills_many_pieces(spark):
    """A text of megabytes with itself shifted: what its second copy has goes, wherever pieces are cut."""
    rng = np.random.default_rng(8)
    long = rng.integers(97, 123, 3 << 20).astype(np.uint8).tobytes().decode()
    found = {r.id: r for r in substrings.remove_repeats(table(spark, [(1, long), (2, "x" * 40 + long[100:] + "y" * 60), (3, None)])).collect()}
    assert (found[1].n_removed, found[2].n_removed, found[2].n_spans) == (0, len(long) - 100, 1)


def test_repeats_of_an_empty_table(spark):
    assert substrings.remove_repeats(table(spark, [])).count() == 0


def test_anchors_meet_in_equal_windows_wherever_they_stand():
    rng = np.random.default_rng(3)
    window = rng.integers(97, 100, 50).astype(np.uint8)
    found = set()
    for before in (0, 7, 400):
        data = np.concatenate([rng.integers(97, 100, before).astype(np.uint8), window, rng.integers(97, 100, 90).astype(np.uint8)])
        place, hashes = substrings.anchors(data, np.array([len(data)]))
        inside = (place >= before) & (place <= before + 34)
        found.add(frozenset(zip((place[inside] - before).tolist(), hashes[inside].tolist())))
    assert frozenset.intersection(*found)


def test_suffix_sort_orders_like_bytes():
    rng = np.random.default_rng(4)
    rows = rng.integers(97, 99, (40, substrings.WIDTH)).astype(np.uint8)
    rows[7] = rows[3]
    right = rng.integers(16, 51, 40)
    for r, n in zip(rows, right):
        r[substrings.LEFT + n :] = 0
    group = np.sort(rng.integers(0, 3, 40)).astype(np.uint64)
    order = substrings.SuffixSort(group, rows, np.full(40, 34), right).order
    text = lambda i: rows[i, substrings.LEFT : substrings.LEFT + right[i]].tobytes()
    assert [(group[i], text(i)) for i in order] == sorted((group[i], text(i)) for i in range(40))


def test_hash_collisions_are_settled_by_bytes(monkeypatch):
    monkeypatch.setattr(substrings, "_prefix_hashes", lambda c: np.zeros((len(c), c.shape[1] + 1), np.uint64))
    rng = np.random.default_rng(6)
    rows = rng.integers(97, 123, (6, substrings.WIDTH)).astype(np.uint8)
    rows[4, 10:70] = rows[1, 10:70]
    full = np.full(6, 50), np.full(6, 34)
    mask = substrings.match_rows(np.zeros(6, np.uint64), np.arange(6), full[1].astype(np.uint8), full[0].astype(np.uint8), rows)
    assert [int(m) for m in np.flatnonzero(mask)] == [4]


def test_crc_fold_is_that_of_zlib(spark):
    row = spark.range(1).select(F.crc32(F.lit(12345).cast("string")).alias("x")).first()
    assert row.x == zlib.crc32(b"12345")
