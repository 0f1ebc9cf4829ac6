"""The cut at blanks gives what the pattern gives, also for tokens of white space and for other patterns."""

import base64

import pytest

from lexweave.llm import bpe

P = pytest.importorskip("public_tokenizers")


def codec(folder, pattern):
    tokens = [bytes([b]) for b in range(256)] + [b"\n ", b"\t ", b"a ", b"a b"]
    path = folder / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    return bpe.Codec(bpe.load_vocabulary(str(path), pattern))


def test_white_space_and_a_blank_at_the_end(tmp_path):
    assert P.PATTERN in bpe.CUT_AT_BLANKS
    c = codec(tmp_path, P.PATTERN)
    for text, last in (("x\n ", 256), ("x\t ", 257), ("x y\n ", 256)):
        assert c.encode(text) == c.encode_chunk(text) and c.encode(text)[-1] == last
    assert c.encode("x\n y") == c.encode_chunk("x\n y")


def test_another_pattern_is_not_cut_at_blanks(tmp_path):
    c = codec(tmp_path, r"[^\n]+|\n")
    assert c.encode("a b") == c.encode_chunk("a b") == [259]
