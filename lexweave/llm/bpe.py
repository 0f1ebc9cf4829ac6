"""Byte-level BPE: a minimal perfect hash finds whole pre-tokens, a heap over linked bytes merges the others.

New pre-tokens of a batch are merged side by side: each has its own heap and links, a column of arrays, and all take their
next merge in the same step.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lexweave.llm.common import text_slices

#: Chunks, and pre-tokens, whose ids a worker remembers, twice over; a bound on memory alone, since the others are encoded again.
REMEMBERED = 150_000
#: Texts whose new chunks are encoded together hold about this many bytes at most.
TOGETHER_BYTES = 2 << 20
#: Pre-tokens shorter than a width are merged side by side, so many at a time; fewer than ``FEW``, or longer ones, one by one.
WIDTHS, BESIDE, FEW = (16, 32), 8192, 64
_NONE = np.int32(2**31 - 1)
#: A vocabulary larger than this is not broadcast but refused.
MAX_VOCAB_BYTES = 64 << 20
_SEED_SPACE = 1 << 16
#: Patterns under which a text may be cut at blanks (see ``Codec.encode_joined``); under others the pattern alone cuts.
CUT_AT_BLANKS = frozenset({r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"})


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of a byte-level BPE and the pattern that cuts pre-tokens; with the perfect hash ready to be broadcast."""

    tokens: tuple[bytes, ...]
    ids: tuple[int, ...]
    pattern: str
    seeds: np.ndarray
    slots: np.ndarray
    digest: str


def perfect_hash(keys: list[bytes], load: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hash and displace: ``seeds`` of each first-level bucket, and ``slots``: the key at every place, none left free.

    A bucket of one key needs no search: it gets a place that is still free, kept as ``-1 - place``.
    """
    n = len(keys)
    buckets: list[list[int]] = [[] for _ in range(max(1, n // load))]
    for i, key in enumerate(keys):
        buckets[xxhash.xxh64_intdigest(key, 0) % len(buckets)].append(i)
    seeds, slots = np.zeros(len(buckets), np.int32), np.full(n, -1, np.int32)
    free = set(range(n))
    for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
        members = buckets[b]
        if not members:
            break
        if len(members) == 1:
            place = free.pop()
            seeds[b], slots[place] = -1 - place, members[0]
            continue
        seed = 1
        while True:
            places = [xxhash.xxh64_intdigest(keys[i], seed) % n for i in members]
            if len(set(places)) == len(places) and all(p in free for p in places):
                break
            seed += 1
        seeds[b] = seed
        for i, p in zip(members, places):
            slots[p] = i
            free.discard(p)
    return seeds, slots


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read a rank file (base64 token, rank per line) on the driver."""
    with open(path, "rb") as file:
        pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, file) if a]
    if sum(len(t) + 8 for t, _ in pairs) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    tokens = [t for t, _ in pairs]
    seeds, slots = perfect_hash(tokens)
    digest = hashlib.sha256(pattern.encode() + b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in pairs)).hexdigest()
    return Vocabulary(tuple(tokens), tuple(i for _, i in pairs), pattern, seeds, slots, digest)


class _Known(dict):
    """Ids of short strings as ``make`` gives them, made when first asked for; only the latest are remembered."""

    def __init__(self, make: Callable[[list[str]], list[str]]):
        super().__init__()
        self.make, self.older = make, {}

    def turn_over(self) -> None:
        """The older half is still looked up, so what is frequent moves over."""
        self.older = dict(self)
        self.clear()

    def learn(self, wanted: set[str]) -> None:
        """Make at one go what is wanted and not known, as far as it can be remembered. The empty string is never among them."""
        new = wanted.difference(self)
        if len(self) + len(new) > REMEMBERED:
            self.turn_over()
            new = wanted
        new = [x for x in islice(new, REMEMBERED) if 0 < len(x) <= 64]
        found = list(map(self.older.get, new))
        unknown = [x for x, ids in zip(new, found) if ids is None]
        self.update((x, ids) for x, ids in zip(new, found) if ids is not None)
        self.update(zip(unknown, self.make(unknown)))

    def __missing__(self, x: str) -> str:
        if len(self) >= REMEMBERED:
            self.turn_over()
        if (ids := self.older.get(x)) is None:
            ids = self.make([x])[0]
        if len(x) <= 64:
            self[x] = ids
        return ids


class PairTable:
    """Which token two neighbours make, looked up for arrays: open addressing over ``left << 32 | right``."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        keys = left.astype(np.int64) << 32 | right
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at = self.start(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.made[at[mine]] = made[mine]
            keys, made, at = keys[~mine], made[~mine], (at[~mine] + 1) & self.mask

    def start(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair makes, else -1."""
        keys = left.astype(np.int64) << 32 | right
        at = self.start(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.made[at], np.int32(-1))
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            there = self.keys[at[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.made[at[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.find_all = regex.compile(v.pattern).findall
        self.keys = v.tokens
        self.ids = v.ids
        self.seeds, self.slots = v.seeds.tolist(), v.slots.tolist()
        #: Merges work on places in the order of ranks: ``follow[a](b)`` is the place of the token that a and b make, if any.
        self.ranked = sorted(v.ids)
        place = {t: k for k, (_, t) in enumerate(sorted(zip(v.ids, v.tokens)))}
        made: dict[int, dict[int, int]] = {}
        for t, i in place.items():
            for k in range(1, len(t)):
                if (x := place.get(t[:k])) is not None and (y := place.get(t[k:])) is not None:
                    made.setdefault(x, {})[y] = i
        self.follow = [made.get(x, {}).get for x in range(len(place))]
        self.pairs = PairTable(*(np.array(x, np.int32) for x in zip(*((x, y, i) for x, ys in made.items() for y, i in ys.items())))) if made else None
        self.byte = [place[bytes([b])] for b in range(256)]
        self.byte_places = np.array(self.byte, np.int32)
        self.names = ["," + str(i) for i in self.ranked] + [" " + str(i) for i in self.ranked]
        self.text = {str(i): t for t, i in zip(v.tokens, v.ids)}
        self.pieces = _Known(self.mark_pieces)
        self.inner = _Known(self.join_chunks)
        self.blank_run = regex.compile(r" \s").search
        self.cut_at_blanks = v.pattern in CUT_AT_BLANKS

    def whole(self, piece: bytes) -> int:
        """Id of a piece that is a token itself, else -1. Two hashes and one comparison."""
        seed = self.seeds[xxhash.xxh64_intdigest(piece, 0) % len(self.seeds)]
        at = self.slots[xxhash.xxh64_intdigest(piece, seed) % len(self.slots) if seed >= 0 else -1 - seed]
        return self.ids[at] if self.keys[at] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Merge neighbours of lowest rank first, leftmost on ties: a heap of pairs over a doubly linked list.

        ``part[i]`` is the token that starts at byte i and ``made[i]`` what it makes with the next one, or None. A heap
        entry is rank and place in one number; it is stale unless the pair at its place still makes that rank.
        """
        follow, n = self.follow, len(piece)
        part = list(map(self.byte.__getitem__, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        made = [follow[a](b) for a, b in zip(part, part[1:])]
        made.append(None)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        heap = [r << shift | i for i, r in enumerate(made) if r is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & mask, top >> shift
            if made[i] != r:
                continue
            j = after[i]
            part[i], part[j] = r, None
            made[i] = made[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := follow[r](part[k])) is not None:
                    made[i] = s
                    heappush(heap, s << shift | i)
            if i:
                h = before[i]
                made[h] = s = follow[part[h]](r)
                if s is not None:
                    heappush(heap, s << shift | h)
        ranked = self.ranked
        return [ranked[x] for x in part if x is not None]

    def merge_beside(self, raws: list[bytes], width: int) -> list[str]:
        """What ``merge`` gives, joined by commas, for many pieces of fewer than ``width`` bytes, a power of two.

        Column c holds piece c: links between its bytes, and a heap whose leaf i is the pair that starts at byte i, as rank
        and place in one number. A leaf is overwritten when its pair changes, so nothing is stale. The row behind the last
        byte stands for the end, and the last row for what is before the first.
        """
        n, end, shift = len(raws), len(self.ranked), width.bit_length() - 1
        sizes = np.fromiter(map(len, raws), np.int64, n)
        column = np.repeat(np.arange(n), sizes)
        row = np.arange(len(column)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        part = np.full(width * n, end, np.int32)
        part[row * n + column] = self.byte_places[np.frombuffer(b"".join(raws), np.uint8)]
        after = np.repeat(np.arange(1, width + 1), n)
        before = np.repeat(np.arange(-1, width - 1) % width, n)
        heap = np.full((2 * width, n), _NONE, np.int32)
        leaves = heap[width:].reshape(-1)

        def pair_up(at: np.ndarray, right: np.ndarray, place: np.ndarray) -> None:
            made = self.pairs.find(part[at], part[right])
            leaves[at] = np.where(made < 0, _NONE, made << shift | place.astype(np.int32))

        inner = row < sizes[column] - 1
        at = (row * n + column)[inner]
        pair_up(at, at + n, row[inner])
        while True:
            level = width
            while level > 1:
                np.minimum(heap[level : 2 * level : 2], heap[level + 1 : 2 * level : 2], out=heap[level // 2 : level])
                level //= 2
            c = np.flatnonzero(heap[1] != _NONE)
            if not len(c):
                break
            top = heap[1][c]
            i = (top & (width - 1)).astype(np.int64)
            at = i * n + c
            gone = after[at] * n + c
            k, h = after[gone], before[at]
            behind, ahead = k * n + c, h * n + c
            part[at], part[gone] = top >> shift, -1
            after[at], before[behind], leaves[gone] = k, i, _NONE
            pair_up(np.concatenate((at, ahead)), np.concatenate((behind, at)), np.concatenate((i, h)))
        rows = part.reshape(width, n)
        live = (rows >= 0) & (rows < end)
        rows[0] += end  # names of first tokens begin with a blank
        tokens = rows.T[live.T]
        return "".join(map(self.names.__getitem__, tokens.tolist())).split(" ")[1:]

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        return [found] if (found := self.whole(raw)) >= 0 else self.merge(raw)

    def encode_chunk(self, chunk: str) -> list[int]:
        return [i for piece in self.find_all(chunk) for i in self.encode_piece(piece)]

    def mark_pieces(self, pieces: list[str]) -> list[str]:
        """Ids joined by commas of each pre-token, led by a blank if the pre-token begins with one, else by a comma."""
        raws = [p.encode() for p in pieces]
        joined = [str(i) if i >= 0 else "" for i in map(self.whole, raws)]
        least = 1
        for width in WIDTHS:
            places = [x for x, (raw, ids) in enumerate(zip(raws, joined)) if not ids and least <= len(raw) < width]
            least = width
            for start in range(0, len(places) if self.pairs else 0, BESIDE):
                block = places[start : start + BESIDE]
                if len(block) >= FEW:
                    for x, ids in zip(block, self.merge_beside([raws[x] for x in block], width)):
                        joined[x] = ids
        return [p and (" " if p[0] == " " else ",") + (ids or ",".join(map(str, self.merge(raw)))) for p, raw, ids in zip(pieces, raws, joined)]

    def join_chunks(self, chunks: list[str]) -> list[str]:
        """Ids joined by commas of each chunk, a blank before it; cut by the pattern at one go, since a blank opens each."""
        pieces = self.find_all(" " + " ".join(chunks)) if chunks else []
        if len(chunks) > 1:
            self.pieces.learn(set(pieces))
        return "".join(map(self.pieces.__getitem__, pieces)).split(" ")[1:]

    def encode_joined(self, texts: list[str]) -> Iterator[str]:
        """Ids of each text, joined by commas.

        Under a pattern of ``CUT_AT_BLANKS``, where no blank is followed by white space or ends a text after other white
        space, every blank opens a new pre-token and what follows it up to the next blank is cut the same way wherever it
        stands, so chunks are looked up as wholes. Any other text or pattern is cut by the pattern alone. Chunks that are
        new to the worker are encoded together, before the texts that hold them.
        """
        parts = [[] if not self.cut_at_blanks or self.blank_run(t) or (t[-1:] == " " and t[-2:-1].isspace()) else t.split(" ") for t in texts]
        self.inner.learn(set().union(*(p[1:] for p in parts)))
        for text, part in zip(texts, parts):
            head = "".join(map(self.pieces.__getitem__, self.find_all(part[0] if part else text))).replace(" ", ",")[1:]
            tail = ",".join(map(self.inner.__getitem__, islice(part, 1, None)))
            yield f"{head},{tail}" if head and tail else head or tail

    def encode(self, text: str) -> list[int]:
        (joined,) = self.encode_joined([text])
        return [int(x) for x in joined.split(",")] if joined else []

    def decode_joined(self, joined: str) -> bytes:
        return b"".join(map(self.text.__getitem__, joined.split(","))) if joined else b""

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.text[str(i)] for i in ids)


_CODECS: dict[str, Codec] = {}


def codec_for(vocabulary: Vocabulary) -> Codec:
    """The worker's codec; what it remembers outlives a task."""
    if vocabulary.digest not in _CODECS:
        _CODECS.clear()
        _CODECS[vocabulary.digest] = Codec(vocabulary)
    return _CODECS[vocabulary.digest]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` for every row, in the order of the rows of a partition; null counts as empty (no ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(shared.value)
        for batch in batches:
            for part in text_slices(batch, "text", TOGETHER_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [[int(x) for x in joined.split(",")] if joined else [] for joined in codec.encode_joined(texts)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, rows.select("id").schema.add("ids", ArrayType(IntegerType())))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(id, raw binary)`` from ``(id, ids)``; null ids give empty bytes. An id outside the vocabulary is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(shared.value)
        for batch in batches:
            raw = [codec.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], names=["id", "raw"])

    rows = encoded.select("id", "ids")
    return rows.mapInArrow(run, rows.select("id").schema.add("raw", "binary"))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids, and give digests: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.

    Same codec as ``encode`` and ``decode``, in one pass over each text, so ids never leave the worker. Null and empty
    texts have no tokens and the digest of nothing. Texts are taken whole, whatever their length; repeated rows and
    null ids give a row each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(shared.value)
        for batch in batches:
            for part in text_slices(batch, "text", TOGETHER_BYTES):
                counts, ids_digest, raw_digest = [], [], []
                for joined in codec.encode_joined([t or "" for t in part.column("text").to_pylist()]):
                    counts.append(joined.count(",") + 1 if joined else 0)
                    ids_digest.append(hashlib.sha256(joined.encode()).hexdigest())
                    raw_digest.append(hashlib.sha256(codec.decode_joined(joined)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(raw_digest, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
