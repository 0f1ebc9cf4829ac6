"""The whole pipeline against a brute force written anew here, clashing column names, empty tables and stage contracts."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexweave.llm import exact, mixing, resampling, simhash, target_resampling

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
#: Names that operators like to give, and some that need quoting.
CLASHING = ["id", "sha", "row", "hash", "node", "component", "gone_id", "gone_sha", "gone_id_", "__id", "__sha", "__hash", "__row", "__mix_taken", "__mix_size", "__mix_part", "__mix_target", "taken", "part", "size", "target", "row_id", "row_sha", "stays", "key", "a.b", "with blank", "drawn_id", "rank"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASHING)


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), *range(len(CLASHING))) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = [a + b for a in ("ka", "lo", "mi", "ter", "sun", "bel", "no") for b in ("ran", "dis", "ment", "tor", "ly", "ful", "ness", "é")]
    out, labels = [], []
    for i in range(260):
        junk = rng.random() < 0.25
        text = [rng.choice(words) + (rng.choice(["$$", "%%"]) if junk else "") for _ in range(rng.randint(12, 90))]
        out.append([i, rng.choice([" ", "  ", "\n"]).join(text), "en", rng.choice(["a", "a", "a", "b", None])])
        labels.append((i, int(not junk), 0))
    for k in range(20):  # near copies: some of similarity 0.8 or more, some below
        own = out[3 * k][1].split()
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(len(own))] = f"other{k}"
        out.append([300 + k, " ".join(own), "en", "b"])
    out += [[400 + k, out[5][1], "en", "c"] for k in range(6)] + [[500, None, "en", None], [501, "", None, "c"], [502, " \n", "en", "a"], [1, out[1][1], "en", "a"], [None, out[9][1], "en", "b"], [2, out[11][1] + " twice", "en", "b"]]
    rng.shuffle(out)
    return [tuple(r) for r in out], labels


def word_list(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def brute(rows, labels, fits, noise):
    """All five stages in plain Python; ``fits`` and ``noise`` are functions of the id."""

    # 1: importance of hashed n-grams
    def grams(text):
        h = [zlib.crc32(w.lower()) for w in word_list(text)]
        mix = lambda x: x * 0x9E3779B97F4A7C15 % 2**64 >> 49
        return [mix(x + 1) for x in h] + [mix((a << 32 | b) ^ 0xA5A5) for a, b in zip(h, h[1:])]

    good = {i: q == 1 for i, q, _ in labels}
    raw, target = Counter(), Counter()
    for i, text, *_ in rows:
        raw.update(grams(text))
        if good.get(i) and fits(i):
            target.update(grams(text))
    n = 1 << 15
    s, t = sum(raw.values()), sum(target.values())

    def ratio(b):
        prior = (raw[b] + 1) / (s + n)
        return math.log((target[b] + 4 * n * prior) / (t + 4 * n)) - math.log(prior)

    weight = [round(sum(ratio(b) for b in grams(text)), 6) for _, text, *_ in rows]
    least = {}
    for r, w in zip(rows, weight):
        if r[0] in good and not fits(r[0]):
            least[r[0]] = min(w, least.get(r[0], w))
    fine, bad = sorted(w for i, w in least.items() if good[i]), [w for i, w in least.items() if not good[i]]
    at = 0.01 * (len(fine) - 1)
    floor = fine[int(at)] + (fine[min(int(at) + 1, len(fine) - 1)] - fine[int(at)]) * (at - int(at))
    levels = sorted({w for w in least.values() if w <= floor} | {floor})
    gains = [sum(w < x for w in bad) / len(bad) - sum(w < x for w in fine) / len(fine) for x in levels]
    level = next(x for x, g in zip(levels, gains) if g >= max(gains) - 0.01)
    k = sum(w >= level for w in weight)
    keys = [w + noise(r[0]) for r, w in zip(rows, weight)]
    cut = sorted(keys, reverse=True)[k - 1]
    gone = {(r[0], r[1] or "") for r, x in zip(rows, keys) if x < cut - 1e-9}
    rows = [r for r in rows if (r[0], r[1] or "") not in gone]

    # 2: one row of each text, that of the smallest id
    best = {}
    for r in rows:
        held = best.get(r[1] or "")
        if held is None or (r[0] is None, r[0] or 0) < (held[0] is None, held[0] or 0):
            best[r[1] or ""] = r
    rows = list(best.values())

    # 3: one text of each group of like sets of five-word shingles
    def shingles(text):
        w = [x.lower() for x in word_list(text)]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, reach = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or a and b and 5 * len(a & b) >= 4 * len(a | b):
                reach[find(i)] = find(j)
    stays = {}
    for i, r in enumerate(rows):
        rank = (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())
        stays[find(i)] = min(stays.get(find(i), (rank, r)), (rank, r), key=lambda x: x[0])
    rows = [r for _, r in stays.values()]

    # 4: sources in proportion 3, 1, 2, 150 percent of all words, two epochs at most
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(word_list(r[1]))
    order = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weights = {x: (3, 1, 2)[i % 3] for i, x in enumerate(order)}
    left, open_, goal = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weights[x] for x in open_)
        full = {x for x in open_ if level * weights[x] >= 2 * sizes[x]}
        goal |= {x: 2 * sizes[x] for x in full} if full else {x: level * weights[x] for x in open_}
        left -= sum(2 * sizes[x] for x in full)
        open_ = open_ - full if full else set()
    mixed = []
    for source in order:
        before, budget = 0, int(goal[source])
        for r in sorted((r for r in rows if r[3] == source), key=lambda r: (hashlib.md5(f"17:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0])):
            size = len(word_list(r[1]))
            epochs = budget // sizes[source] if sizes[source] else 0
            taken = epochs * size + min(size, max(0, budget - epochs * sizes[source] - before))
            before += size
            while taken > 0:
                pieces = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r[1])
                mixed.append((r[0], r[1] if taken >= size else "".join(pieces[:taken])))
                taken -= size
    return mixed


def test_run_equals_a_brute_force_of_all_stages(spark, rows, tmp_path):
    docs, labels = rows
    docs = [(*r, len(r[1] or "")) for r in docs]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    ids = spark.createDataFrame([(i,) for i in {r[0] for r in docs}], "doc_id long")
    known = {r.doc_id: (r.fits, r.noise) for r in ids.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(resampling.SEED)), F.lit(2)) == 0).alias("fits"), resampling.gumbel(F.col("doc_id"), resampling.SEED).alias("noise")).collect()}
    mixed = brute(docs, labels, lambda i: known[i][0], lambda i: known[i][1])
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = Counter()
    for i, text in mixed:
        tokens = library.encode_ordinary(text)
        wanted[i, len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    found = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    assert found == wanted and 200 < sum(wanted.values()) and len({i for i, _ in mixed}) < len(docs) - 60


def test_columns_of_any_name_pass_through(spark, rows):
    docs, labels = rows
    table, marks = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = table.select("doc_id", "text", "lang", "source", "n_chars")
    key = lambda f: Counter((r.doc_id, r.text) for r in f.collect())
    for keep in (lambda f: resampling.keep_selected(f, marks), exact.drop_duplicates, simhash.keep_one_per_group, mixing.mixed_documents, lambda f: target_resampling.keep_drawn(f, plain.limit(40))):
        kept = keep(table)
        assert kept.columns == table.columns and key(kept) == key(keep(plain))
        assert all(tuple(r)[5:] == tuple(range(len(CLASHING))) for r in kept.collect())
    mixed = mixing.mix(table)
    assert len(set(mixed.columns)) == len(mixed.columns) and mixed.count() == len(docs)
    again = [tuple(r) for r in mixing.mix(plain).select("doc_id", "__mix_taken", "__mix_size").collect()]
    assert Counter(again) == Counter(tuple(r) for r in mixed.select("doc_id", "__mix_taken", "__mix_size").collect())


def test_every_stage_on_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
    result = corpus_pipeline.run(spark, folder)
    assert result.count() == 0 and result.columns[0] == "doc_id"
