"""Pre-tokens merged side by side get what the heap of each alone and the library give, and new ones don't go one by one."""

import base64
import random

import pytest

from lexweave.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
RANKS = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_vocabulary(P.path(RANKS), P.PATTERN))


@pytest.fixture(scope="module")
def library():
    with open(P.path(RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def as_ids(joined):
    return [[int(x) for x in j.split(",")] if j else [] for j in joined]


def test_side_by_side_is_one_by_one(codec):
    rng = random.Random(3)
    for width in bpe.WIDTHS:
        raws = [bytes(rng.choice(b"aaabehnt r\xc3\xa9\xff") for _ in range(rng.randint(1, width - 1))) for _ in range(3000)]
        raws += [b"a" * n for n in range(1, width)]
        assert as_ids(codec.merge_beside(raws, width)) == [codec.merge(raw) for raw in raws]


def test_ties_and_merges_that_come_back_to_lower_ranks():
    tokens = [bytes([b]) for b in range(256)]
    rng = random.Random(5)
    for _ in range(20):
        more = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(40)})
        rng.shuffle(more)  # a token may rank before its parts
        ranks = rng.sample(range(1000), 256 + len(more))
        seeds, slots = bpe.perfect_hash(tokens + more)
        one = bpe.Codec(bpe.Vocabulary(tuple(tokens + more), tuple(ranks), P.PATTERN, seeds, slots, ""))
        other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(zip(tokens + more, ranks)), special_tokens={})
        texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(300))]
        assert as_ids(one.encode_joined(texts)) == [other.encode_ordinary(t) for t in texts]


def test_texts_of_a_batch_are_those_of_the_library(codec, library):
    rng = random.Random(1)
    letters = list("abc the 's 'll 12³½é ü\n\n\t  \x85\xa0　中文ا😀'_.,!ß") + ["lang" * 9]
    texts = ["".join(rng.choice(letters) for _ in range(n % 90)) for n in range(1500)] + ["", " ", "a ", "a\n ", "\n", "x" * 5000]
    assert as_ids(codec.encode_joined(texts)) == [library.encode_ordinary(t) for t in texts]


def test_new_pre_tokens_are_not_merged_one_by_one(monkeypatch, library):
    one = bpe.Codec(bpe.load_vocabulary(P.path(RANKS), P.PATTERN))
    calls = []
    monkeypatch.setattr(bpe.Codec, "merge", lambda self, raw, merge=bpe.Codec.merge: calls.append(raw) or merge(self, raw))
    rng = random.Random(2)
    words = ["".join(rng.choices("zqxwvk", k=rng.randint(6, 12))) for _ in range(2000)]
    texts = [" ".join(f"{w}{end}" for w in words) for end in ("", ".", "\nZqx")]
    assert as_ids(one.encode_joined(texts)) == [library.encode_ordinary(t) for t in texts]
    assert len(calls) < 2 * bpe.FEW


def test_a_pattern_with_empty_matches(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)))
    assert bpe.Codec(bpe.load_vocabulary(str(path), r"\w*| ")).encode("ab c") == list(b"ab c")
