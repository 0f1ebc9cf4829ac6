"""Repeated passages: a hash-compared sort of sampled suffixes finds every 50-byte string that an earlier document has.

How it is dealt out. Every window of ``LENGTH`` bytes holds one anchor: the ``GRAM``-byte string of smallest hash among
those in it, the leftmost on ties. Equal windows hold equal anchors at equal places, so they are found by comparing the
surroundings of equal anchors only, about one place in eighteen.

1. ``_tag_batches``, ``_shared_tags``: each task gives the hashes of its anchors, one row of a batch per hash with the
   smallest document that has it. They meet by hash; those that two documents or more have are shared.
2. ``_gather``: each document meets its shared hashes, and the bytes around these anchors are taken. Surroundings that are
   equal as a whole within a batch are settled there: the smallest document stands for all of them from then on.
3. ``_sorted_matches``: by anchor, the suffixes that start at the anchors are merge-sorted; two suffixes are compared
   by binary search over the polynomial hashes of their prefixes. Where the sorted suffixes share enough on the right
   and equal bytes on the left, windows are equal; all but those of the smallest document are matched, byte by byte.
   A task holds ``TASK_ROWS`` surroundings and sorts groups of ``SORT_ROWS``. What is larger is settled in parts, and
   the windows still open are dealt anew by a longer string than the anchor: by the bytes that all windows of the
   lower half of its places share, and by those of the upper half (``_refined``). Equal windows share that string, so
   they meet again; after six halvings a whole window is the string. The number of buckets follows the rows still open
   in each round. Single windows are not sorted at all: the smallest document of each is a minimum over all rows that
   have its bytes, summed up in every task before it is exchanged (``_single``). So no group is ever taken whole.
4. ``_apply``: each document loses what its matched windows cover.

What travels are packed, compressed arrays keyed by a hash bucket or a bucket of document ids; their numbers follow the
size of the input and each bucket is a task of its own, so a task holds about the same at any scale. A passage that very many documents share enters each
round once per batch, not once per document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import as_bytes, materialize, partitions_for, release, text_slices

LENGTH, GRAM = 50, 16
#: Places of a window's anchor, counted from the window's start: 0 to LENGTH - GRAM.
PLACES = LENGTH - GRAM + 1
LEFT = PLACES - 1
WIDTH = LEFT + LENGTH
#: Bytes of text per bucket of documents, rows that are sorted in one go.
BUCKET_BYTES, SORT_ROWS = 24 << 20, 1 << 16
#: Surroundings that a task holds at a time, those of a bucket on average, and those that are cut out of texts in one go.
TASK_ROWS, CUT_ROWS = 1 << 20, 1 << 19
BUCKET_ANCHORS = TASK_ROWS // 2
#: Halvings after which every open window is single, and buckets that open windows are packed by until their number is known.
ROUNDS, PACKED = (PLACES - 1).bit_length(), 61
_BLOCK = 1 << 21
_POSITION = np.uint64((1 << 24) - 1)
_M1, _M2, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x5851F42D4C957F2D)


def _u64_at_every_byte(data: np.ndarray) -> np.ndarray:
    windows = np.lib.stride_tricks.sliding_window_view(data, 8)
    return np.ascontiguousarray(windows).view(np.uint64).ravel()


def anchors(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows within one text; texts follow each other and end at ``limits``.

    The lowest 24 bits of a hash name its bucket only; the others are what is compared, and a place in the block
    takes the low bits' room so that one minimum gives hash and leftmost place together.
    """
    starts = np.concatenate([[0], limits[:-1]]).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    some = limits - starts >= LENGTH
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, limits[some] - LENGTH + 1, -1)
    inside = np.cumsum(inside, dtype=np.int32) > 0  # whether a window that starts here stays in its text
    places, hashes = [], []
    for at in range(0, max(0, len(data) - LENGTH + 1), _BLOCK):
        part = data[at : at + _BLOCK + LENGTH - 1]
        words = _u64_at_every_byte(part)
        h = (words[: len(words) - 8] * _M1) ^ (words[8:] * _M2)
        h ^= h >> np.uint64(31)
        h *= _M1
        h ^= h >> np.uint64(29)
        h *= _M2
        h ^= h >> np.uint64(32)
        low, span = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64), 1
        while span * 2 <= PLACES:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        low = np.minimum(low[: len(h) - PLACES + 1], low[PLACES - span :][: len(h) - PLACES + 1])
        low = low[inside[at : at + len(low)]]
        found = np.zeros(len(h), bool)
        found[(low & _POSITION).astype(np.int64)] = True
        found = np.flatnonzero(found)
        places.append(found + at)
        hashes.append(h[found])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def _codes(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """What is compared of a hash (its upper 40 bits and its bucket), and the bucket."""
    bucket = (hashes & _POSITION) % np.uint64(buckets)
    return (hashes & ~_POSITION) | bucket, bucket.astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed; each array's own type and shape are written before it."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.reshape(len(a), -1).view(np.uint8) if a.ndim > 1 else a.view(np.uint8).reshape(len(a), a.itemsize).T
        head = f"{a.dtype.str},{','.join(map(str, a.shape))};".encode()
        out.append(len(head).to_bytes(2, "little") + head + np.ascontiguousarray(planes).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 2], "little")
        kind, *shape = data[at + 2 : at + 1 + n].decode().split(",")
        dtype, shape = np.dtype(kind), tuple(map(int, shape))
        at += 2 + n
        size = dtype.itemsize * math.prod(shape)
        raw = np.frombuffer(data, np.uint8, size, at)
        out.append(raw.view(dtype).reshape(shape) if len(shape) > 1 else np.ascontiguousarray(raw.reshape(dtype.itemsize, shape[0]).T).view(dtype).ravel())
        at += size
    return out


def _stack(blobs: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*blobs)]


def _drained(blobs: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The blobs stacked; the list lets go of them."""
    out = _stack(blobs)
    blobs.clear()
    return out


def _by_bucket(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """The arrays cut by bucket and packed: bucket, number of rows, blob."""
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else []
    for s, e in zip(cuts, [*cuts[1:], len(ordered)]):
        part = order[s:e]
        yield int(ordered[s]), len(part), _pack(*[a[part] for a in arrays])


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


_ROUTED = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])
_ROUTED_SPARK = "kind int, bucket long, n long, blob binary"


def _routed(kind: int, packed: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    rows = list(packed)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)), pa.array([r[2] for r in rows], pa.binary())], schema=_ROUTED)


def _tag_batches(batches: Iterator[pa.RecordBatch], buckets: int, doc_buckets: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: (code, smallest id, whether others of the batch have it) by hash bucket. Kind 1: (id, code) by bucket
    of ids, for hashes that two documents of the batch have."""
    for batch in batches:
        for part in text_slices(batch, "text"):
            texts = as_bytes(part.column("text"))
            ids = part.column("id").to_numpy()
            data, limits = _joined(texts)
            place, hashes = anchors(data, limits)
            code, _ = _codes(hashes, buckets)
            owner = ids[np.searchsorted(limits, place, side="right")]
            order = np.lexsort((owner, code))
            code, owner = code[order], owner[order]
            if not len(code):
                continue
            fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])])
            code, owner = code[fresh], owner[fresh]
            first = np.concatenate([[True], code[1:] != code[:-1]])
            sizes = np.diff(np.append(np.flatnonzero(first), len(code)))
            several = np.repeat(sizes > 1, sizes)
            some = code[first]
            yield from _routed(0, _by_bucket((some & _POSITION).astype(np.int64), some, owner[first], (sizes > 1).astype(np.uint8)))
            if several.any():
                yield from _routed(1, _by_bucket(np.mod(owner[several], doc_buckets), owner[several], code[several]))


def _per_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The arrays of one bucket at a time; rows arrive sorted by bucket."""
    key, blobs = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
            if bucket != key and blobs:
                yield _stack(blobs)
                blobs = []
            key = bucket
            blobs.append(_unpack(blob.as_py()))
    if blobs:
        yield _stack(blobs)


def _shared_tags(batches: Iterator[pa.RecordBatch], doc_buckets: int) -> Iterator[pa.RecordBatch]:
    """(id, code) by bucket of ids, for hashes that documents of different batches have."""
    for code, owner, several in _per_bucket(batches):
        order = np.lexsort((owner, code))
        code, owner, several = code[order], owner[order], several[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sizes = np.diff(np.append(first, len(code)))
        # two batches may hold one document only if its row is repeated; then there is no smaller document
        last = np.append(first[1:], len(code)) - 1
        wanted = np.repeat(owner[first] != owner[last], sizes) & (several == 0)
        yield from _routed(1, _by_bucket(np.mod(owner[wanted], doc_buckets), owner[wanted], code[wanted]))


def _full_mask(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits of all windows around an anchor that stay in the text; bit k is the window that starts k bytes before."""
    one = np.uint64(1)
    upper = (one << (left.astype(np.uint64) + one)) - one
    lower = (one << np.maximum(LENGTH - right.astype(np.int64), 0).astype(np.uint64)) - one
    return upper & ~lower


def _row_hashes(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(rows), -(-WIDTH // 8) * 8), np.uint8)
    padded[:, :WIDTH] = rows
    h = left.astype(np.uint64) * _M1 + right.astype(np.uint64) * _M2
    for word in padded.view(np.uint64).T:
        h = (h ^ word) * _M1
        h ^= h >> np.uint64(29)
    return h


def _classes(code: np.ndarray, ids: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each row the row that stands for it: of equal surroundings (compared byte by byte) that of the smallest id.

    A row whose hash agrees with its class but whose bytes do not stands for itself.
    """
    h = _row_hashes(rows, left, right) ^ (code * _M2)
    order = np.lexsort((ids, h))
    first = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    leader = np.empty(len(order), np.int64)
    leader[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    same = (rows == rows[leader]).all(1) & (left == left[leader]) & (right == right[leader]) & (code == code[leader])
    return np.where(same, leader, np.arange(len(order)))


def _doc_blobs(batches: Iterator[pa.RecordBatch], doc_buckets: int) -> Iterator[pa.RecordBatch]:
    """Kind 4: documents (id, whether it is null, uid, length; text) by bucket of ids, packed for the exchange."""
    for batch in batches:
        for part in text_slices(batch, "text"):
            texts = as_bytes(part.column("text"))
            none = part.column("id").is_null().to_numpy(zero_copy_only=False)
            ids, uids = part.column("id").fill_null(0).to_numpy(), part.column("uid").to_numpy()
            buckets = np.mod(ids, doc_buckets)
            blobs = []
            for bucket in np.unique(buckets).tolist():
                rows = np.flatnonzero(buckets == bucket)
                data, _ = _joined([texts[i] for i in rows])
                blobs.append((bucket, len(rows), _pack(ids[rows], none[rows].astype(np.uint8), uids[rows], np.array([len(texts[i]) for i in rows], np.int64), data)))
            yield from _routed(4, iter(blobs))


def _documents(blob: bytes) -> Iterator[tuple[int, bool, int, bytes]]:
    ids, none, uids, sizes, data = _unpack(blob)
    ends = np.cumsum(sizes)
    for doc, null, uid, size, end in zip(ids.tolist(), none.tolist(), uids.tolist(), sizes.tolist(), ends.tolist()):
        yield doc, bool(null), uid, data[end - size : end].tobytes()


def _with_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray] | None, bytes]]:
    """For each blob of documents what its bucket has of the other kind; rows arrive by bucket, documents last."""
    key, parts, other = None, [], None
    for batch in batches:
        for kind, bucket, blob in zip(batch.column("kind").to_pylist(), batch.column("bucket").to_pylist(), batch.column("blob")):
            if bucket != key:
                key, parts, other = bucket, [], None
            if kind < 4:
                parts.append(_unpack(blob.as_py()))
            else:
                if parts:
                    other, parts = _stack(parts), []
                yield other, blob.as_py()


def _surroundings(part: list[tuple[int, int, bytes, np.ndarray]], buckets: int, doc_buckets: int) -> Iterator[pa.RecordBatch]:
    """Of documents (id, uid, text, shared codes): kind 2, surroundings of shared anchors by hash bucket; kind 3,
    windows that are settled here (see ``_matched``). The last arrays of kind 2 are the windows still open and, per
    row, the first and last place of those windows that its hash stands for."""
    data, limits = _joined([t for _, _, t, _ in part])
    place, hashes = anchors(data, limits)
    code, _ = _codes(hashes, buckets)
    cuts = np.searchsorted(place, limits)
    shared = np.zeros(len(place), bool)
    for (_, _, _, tags), s, e in zip(part, [0, *cuts[:-1]], cuts):
        shared[s:e] = np.isin(code[s:e], tags)
    place, code = place[shared], code[shared]
    starts = np.concatenate([[0], limits[:-1]])
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    windows, column = np.lib.stride_tricks.sliding_window_view(padded, WIDTH), np.arange(WIDTH)
    all_ids, all_uids = np.array([p[0] for p in part], np.int64), np.array([p[1] for p in part], np.int64)
    for cut in range(0, len(place), CUT_ROWS):
        spot, tag = place[cut : cut + CUT_ROWS], code[cut : cut + CUT_ROWS]
        owner = np.searchsorted(limits, spot, side="right")
        left, right = np.minimum(spot - starts[owner], LEFT).astype(np.uint8), np.minimum(limits[owner] - spot, LENGTH).astype(np.uint8)
        rows = windows[spot]
        edge = np.flatnonzero((left < LEFT) | (right < LENGTH))
        rows[edge] *= (column >= LEFT - left[edge, None].astype(np.int64)) & (column < LEFT + right[edge, None].astype(np.int64))
        ids, uids, at = all_ids[owner], all_uids[owner], spot - starts[owner]
        leader = _classes(tag, ids, rows, left, right)
        settled = ids > ids[leader]
        if settled.any():
            yield from _matched(ids[settled], uids[settled], at[settled], _full_mask(left[settled], right[settled]), np.zeros(int(settled.sum()), np.uint8), doc_buckets)
        rest = ~settled
        whole = (0, LEFT)
        yield from _routed(2, _by_bucket((tag[rest] & _POSITION).astype(np.int64), tag[rest], ids[rest], uids[rest], at[rest], left[rest], right[rest], rows[rest], _full_mask(left[rest], right[rest]), np.full((int(rest.sum()), 2), whole, np.uint8)))


def _matched(ids: np.ndarray, uids: np.ndarray, at: np.ndarray, mask: np.ndarray, again: np.ndarray, doc_buckets: int) -> Iterator[pa.RecordBatch]:
    """Kind 3: windows that go (id, uid, place, mask, whether their like in the same text go too) by bucket of ids."""
    yield from _routed(3, _by_bucket(np.mod(ids, doc_buckets), ids, uids, at, mask, again))


def _gather(batches: Iterator[pa.RecordBatch], buckets: int, doc_buckets: int, step: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Documents with their shared hashes, some megabytes of text at a time; see ``_surroundings`` for what comes out."""
    last, owner, code = None, np.empty(0, np.int64), np.empty(0, np.uint64)
    part, size = [], 0
    for tags, blob in _with_documents(batches):
        if tags is None:
            continue
        if tags is not last:
            last = tags
            order = np.argsort(tags[0], kind="stable")
            owner, code = tags[0][order], tags[1][order]
        for doc, null, uid, text in _documents(blob):
            s, e = np.searchsorted(owner, doc), np.searchsorted(owner, doc, side="right")
            if s == e or null:
                continue
            part.append((doc, uid, text, code[s:e]))
            size += len(text)
            if size >= step:
                yield from _surroundings(part, buckets, doc_buckets)
                part, size = [], 0
    if part:
        yield from _surroundings(part, buckets, doc_buckets)


def _prefix_hashes(columns: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of each row; column k is the hash of the first k bytes."""
    out = np.zeros((len(columns), columns.shape[1] + 1), np.uint64)
    for k in range(columns.shape[1]):
        out[:, k + 1] = out[:, k] * _BASE + columns[:, k].astype(np.uint64) + np.uint64(1)
    return out


class SuffixSort:
    """Suffixes that start at anchors, sorted within each group of equal anchors."""

    def __init__(self, group: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray):
        """``group`` is ascending."""
        self.group, self.rows, self.left, self.right = group, rows, left.astype(np.int64), right.astype(np.int64)
        self.ahead = _prefix_hashes(rows[:, LEFT:])
        self.behind = _prefix_hashes(rows[:, LEFT - 1 :: -1])
        self.order = self._merge_sort()
        following = self.group[self.order[1:]] == self.group[self.order[:-1]]
        self.common = np.where(following, self.extension(self.order[:-1], self.order[1:]), -1)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes of rows i and j have in common, by binary search over prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.right[i], self.right[j])
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            equal = self.ahead[i, middle] == self.ahead[j, middle]
            low = np.where(open_ & equal, middle, low)
            high = np.where(open_ & ~equal, middle - 1, high)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before suffix j; a suffix comes before those it opens."""
        n = self.extension(i, j)
        ended = (n >= self.right[i]) | (n >= self.right[j])
        at = np.minimum(LEFT + n, WIDTH - 1)
        return np.where(ended, self.right[i] < self.right[j], self.rows[i, at] < self.rows[j, at])

    def _merge_sort(self) -> np.ndarray:
        """Bottom-up mergesort of all groups at once: each element finds its place among the other run by binary search."""
        n = len(self.group)
        order = np.arange(n)
        first = np.searchsorted(self.group, self.group)
        last = np.searchsorted(self.group, self.group, side="right")
        width, longest = 1, int((last - first).max(initial=0))
        while width < longest:
            slot = np.flatnonzero(last - first > width)
            start, stop = first[slot], last[slot]
            run = (slot - start) // width
            base = start + (run & ~1) * width
            other = start + (run ^ 1) * width
            low = np.minimum(other, stop)
            high = np.minimum(other + width, stop)
            begin, mine, is_left = low.copy(), order[slot], (run & 1) == 0
            while (open_ := low < high).any():
                middle = np.minimum((low + high) // 2, n - 1)
                facing = order[middle]
                before = np.zeros(len(slot), bool)  # whether the facing element goes before mine
                a = np.flatnonzero(open_ & is_left)
                before[a] = self.less(facing[a], mine[a])
                b = np.flatnonzero(open_ & ~is_left)
                before[b] = ~self.less(mine[b], facing[b])
                low = np.where(open_ & before, middle + 1, low)
                high = np.where(open_ & ~before, middle, high)
            target = base + (slot - start - run * width) + (low - begin)
            moved = order.copy()
            moved[target] = mine
            order, width = moved, width * 2
        return order

    def matches(self, ids: np.ndarray) -> np.ndarray:
        """Mask of windows per row that a row of a smaller id has too; every match is verified byte by byte."""
        mask = np.zeros(len(ids), np.uint64)
        for k in range(PLACES):
            need = LENGTH - k
            run = np.concatenate([[0], np.cumsum(self.common < need)])
            at = np.flatnonzero((self.left[self.order] >= k) & (self.right[self.order] >= need))
            if len(at) < 2:
                continue
            row = self.order[at]
            key = (run[at].astype(np.uint64) * _M2) ^ (self.behind[row, k] * _M1)
            found = self._later(key, ids[row], row, k)
            mask[found] |= np.uint64(1 << k)
        return mask

    def _later(self, key: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
        """Rows that are not those of the smallest id among the rows with their key."""
        by = np.lexsort((ids, key))
        first = np.concatenate([[True], key[by][1:] != key[by][:-1]])
        chief = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
        later = np.flatnonzero(ids[by] > ids[chief])
        a, b = row[by[later]], row[chief[later]]
        window = slice(LEFT - k, LEFT - k + LENGTH)
        equal = (self.rows[a, window] == self.rows[b, window]).all(1)
        if equal.all():
            return a
        least: dict[tuple[int, bytes], int] = {}  # a hash collision: compare these windows by their bytes
        for r, i in zip(row.tolist(), ids.tolist()):
            own = (int(self.group[r]), self.rows[r, window].tobytes())
            least[own] = min(i, least.get(own, i))
        return np.array([r for r, i in zip(row.tolist(), ids.tolist()) if i > least[int(self.group[r]), self.rows[r, window].tobytes()]], np.int64)


def match_rows(code: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Mask of matched windows of every row; equal surroundings are settled first, what differs is sorted."""
    leader = _classes(code, ids, rows, left, right)
    mask = np.where(ids > ids[leader], _full_mask(left, right), np.uint64(0))
    chiefs = np.flatnonzero(leader == np.arange(len(leader)))
    chiefs = chiefs[np.argsort(code[chiefs], kind="stable")]
    group = code[chiefs]
    size = np.searchsorted(group, group, side="right") - np.searchsorted(group, group)
    chiefs, group = chiefs[size > 1], group[size > 1]
    if len(chiefs):
        own = np.zeros(len(code), np.uint64)
        own[chiefs] = SuffixSort(group, rows[chiefs], left[chiefs], right[chiefs]).matches(ids[chiefs])
        mask |= np.where(ids == ids[leader], own[leader], np.uint64(0))
    return mask


def _interval_mask(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    return (one << (last.astype(np.uint64) + one)) - (one << first.astype(np.uint64))


def _halves(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Kind 2 rows whose open windows are dealt by halves of their places: the hash is that of the string which all
    windows of a half share. Where a half is one place the window itself goes on as kind 5."""
    _, ids, uids, at, left, right, rows, wanted, span = arrays
    first, last = span[:, 0].astype(np.int64), span[:, 1].astype(np.int64)
    middle = (first + last) // 2
    column = np.arange(WIDTH)
    for low, high, some in ((first, middle, np.ones(len(ids), bool)), (middle + 1, last, first < last)):
        keep = wanted & _interval_mask(low, np.maximum(low, high))
        open_ = some & (keep > 0)
        single = np.flatnonzero(open_ & (low == high))
        yield from _windows(ids[single], uids[single], at[single], rows[single], low[single])
        x = np.flatnonzero(open_ & (low < high))
        if not len(x):
            continue
        a, b = low[x], high[x]
        string = rows[x] * ((column >= (LEFT - a)[:, None]) & (column < (LEFT + LENGTH - b)[:, None]))
        h = _row_hashes(string, a.astype(np.uint8), b.astype(np.uint8))
        h = (h ^ (h >> np.uint64(32))) * _M2
        h ^= h >> np.uint64(29)
        packed = ((h & _POSITION) % np.uint64(PACKED)).astype(np.int64)
        yield from _routed(2, _by_bucket(packed, h, ids[x], uids[x], at[x], left[x], right[x], rows[x], keep[x], np.stack([a, b], 1).astype(np.uint8)))


def _windows(ids: np.ndarray, uids: np.ndarray, at: np.ndarray, rows: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Kind 5: open single windows (id, uid, place of the anchor, place of the window before it, its bytes); of a text's
    like windows the first stands for all."""
    if not len(ids):
        return
    start = LEFT - place
    window = np.take_along_axis(rows, start[:, None] + np.arange(LENGTH), 1)
    h = _row_hashes(np.pad(window, ((0, 0), (0, WIDTH - LENGTH))), np.zeros(len(ids), np.uint8), np.zeros(len(ids), np.uint8))
    order = np.lexsort((at, h, uids, ids))
    own = [a[order] for a in (ids, uids, h)]
    like = np.logical_and.reduce([a[1:] == a[:-1] for a in own]) & (window[order][1:] == window[order][:-1]).all(1)
    stays = order[np.concatenate([[True], ~like])]
    yield from _routed(5, iter([(0, len(stays), _pack(ids[stays], uids[stays], at[stays], place[stays].astype(np.uint8), window[stays]))]))


def _dealt_anew(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed kind 2 rows cut by the buckets of their round."""
    for batch in batches:
        for blob in batch.column("blob"):
            arrays = _unpack(blob.as_py())
            yield from _routed(2, _by_bucket(((arrays[0] & _POSITION) % np.uint64(buckets)).astype(np.int64), *arrays))


def _bounded(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[tuple[list[np.ndarray], bool]]:
    """The arrays of one bucket, and whether they are whole: a bucket of more than ``limit`` rows comes in pieces."""
    key, blobs, rows, whole = None, [], 0, True
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
            if bucket != key:
                if blobs:
                    yield _drained(blobs), whole
                key, rows, whole = bucket, 0, True
            arrays = _unpack(blob.as_py())
            if limit is not None and rows + len(arrays[0]) > limit and blobs:
                whole, rows = False, 0
                yield _drained(blobs), whole
            rows += len(arrays[0])
            blobs.append(arrays)
    if blobs:
        yield _drained(blobs), whole


def _sorted_matches(batches: Iterator[pa.RecordBatch], doc_buckets: int, sort_rows: int, task_rows: int) -> Iterator[pa.RecordBatch]:
    """Kind 3 for the windows that are matched here, kinds 2 and 5 for the open windows of groups that are too large.

    Whether a group is too large hangs on its rows alone, so all its pieces agree: its bucket has more than
    ``task_rows`` rows, which buckets of half as many on average have only where a group is large, or the group itself
    more than ``sort_rows``.
    """
    for arrays, whole in _bounded(batches, task_rows):
        order = np.argsort(arrays[0], kind="stable")
        code, ids, uids, at, left, right, rows, wanted, span = arrays = [a[order] for a in arrays]
        begin, end = np.searchsorted(code, code), np.searchsorted(code, code, side="right")
        large = np.full(len(code), not whole) | (end - begin > sort_rows)
        s = 0
        while s < len(code):
            e = min(s + sort_rows, len(code))
            if not large[e - 1]:
                e = int(end[e - 1])  # a group is cut only if it is dealt anew
            found = match_rows(code[s:e], ids[s:e], left[s:e], right[s:e], rows[s:e]) & wanted[s:e]
            hit = s + np.flatnonzero(found)
            yield from _matched(ids[hit], uids[hit], at[hit], found[hit - s], np.zeros(len(hit), np.uint8), doc_buckets)
            wanted[s:e] &= ~found
            s = e
        if large.any():
            yield from _halves([a[large] for a in arrays])


def _single(open_: DataFrame, doc_buckets: int) -> DataFrame:
    """Kind 3 for the single windows of kind 5 that a smaller document has too.

    The smallest document of a window is a minimum by its bytes, which tasks take before the exchange; it goes back by an
    ordinary join, whose hot keys Spark splits.
    """

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                ids, uids, at, place, window = _unpack(blob.as_py())
                held = pa.Array.from_buffers(pa.binary(LENGTH), len(window), [None, pa.py_buffer(np.ascontiguousarray(window))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(uids), pa.array(at), pa.array(place.astype(np.int64)), held], names=["id", "uid", "at", "place", "window"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, uids, at, place = (batch.column(c).to_numpy() for c in ("id", "uid", "at", "place"))
            yield from _matched(ids, uids, at, np.uint64(1) << place.astype(np.uint64), np.ones(len(ids), np.uint8), doc_buckets)

    rows = open_.mapInArrow(flat, "id long, uid long, at long, place long, window binary")
    least = rows.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(F.col("window").alias("w"), "least")
    later = rows.join(least, (F.col("window") == F.col("w")) & (F.col("id") > F.col("least"))).select("id", "uid", "at", "place")
    return later.mapInArrow(packed, _ROUTED_SPARK)


def _window_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``LENGTH`` bytes from each place on."""
    words = _u64_at_every_byte(data)
    n = len(data) - LENGTH + 1
    h = np.zeros(n, np.uint64)
    for k, offset in enumerate((*range(0, LENGTH - 8, 8), LENGTH - 8)):
        h = (h ^ words[offset : offset + n]) * (_M1 + np.uint64(2 * k))
        h ^= h >> np.uint64(31)
    return h


def like_windows(text: bytes, place: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and masks of all windows of a text that equal one of these, each window a place with the first bit.

    One pass over the text however many windows there are; what the hashes find is held against the bytes."""
    wanted = {text[p - k : p - k + LENGTH] for p, m in zip(place.tolist(), mask.tolist()) for k in range(PLACES) if m >> k & 1}
    if not wanted:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    data, found = np.frombuffer(text, np.uint8), []
    known = np.unique(_window_hashes(np.frombuffer(b"".join(wanted), np.uint8))[::LENGTH])
    for at in range(0, len(data) - LENGTH + 1, _BLOCK):
        part = data[at : at + _BLOCK + LENGTH - 1]
        near = at + np.flatnonzero(np.isin(_window_hashes(part), known))
        found += [p for p in near.tolist() if text[p : p + LENGTH] in wanted]
    return np.array(found, np.int64), np.ones(len(found), np.uint64)


def covered(n: int, place: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of ``n`` bytes the matched windows cover."""
    before = np.arange(PLACES)
    hit = (mask[:, None] >> before.astype(np.uint64)) & np.uint64(1) == 1
    starts = np.unique((place[:, None] - before)[hit])
    edges = np.zeros(n + 1, np.int32)
    edges[starts] += 1
    np.subtract.at(edges, starts + LENGTH, 1)
    return np.cumsum(edges[:n]) > 0


_RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _apply(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Remove from every document what its matched windows cover."""
    last, ids, uids, place, mask, again = None, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint8)
    for found, blob in _with_documents(batches):
        if found is None:
            ids = ids[:0]
        elif found is not last:
            order = np.lexsort((found[1], found[0]))
            ids, uids, place, mask, again = (a[order] for a in found)
        last, out = found, []
        for doc, null, uid, text in _documents(blob):
            s, e = np.searchsorted(ids, doc), np.searchsorted(ids, doc, side="right")
            s, e = s + np.searchsorted(uids[s:e], uid), s + np.searchsorted(uids[s:e], uid, side="right")
            removed = spans = 0
            rest = text
            if e > s and not null:
                data = np.frombuffer(text, np.uint8)
                more = s + np.flatnonzero(again[s:e])
                at, bits = like_windows(text, place[more], mask[more])
                gone = covered(len(data), np.concatenate([place[s:e], at]), np.concatenate([mask[s:e], bits]))
                rest, removed = data[~gone].tobytes(), int(gone.sum())
                spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
            out.append({"id": None if null else doc, "n_bytes": len(text), "n_removed": removed, "n_spans": spans, "kept_sha256": hashlib.sha256(rest).hexdigest(), "kept": rest if with_text else None})
        yield pa.RecordBatch.from_pylist(out, schema=_RESULT)


def _prime_from(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, sort_rows: int = SORT_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` per row of ``docs``; ``kept`` is null unless asked for.

    Every byte goes that lies in a 50-byte string which also starts in a document of smaller id; strings are judged on
    the input. Texts are UTF-8 bytes, null counts as empty. A row with a null id loses nothing and counts for no
    other; rows of one id do not count against each other, whether their texts are equal or not; an empty table gives
    an empty result; other columns are not read. ``sort_rows`` and ``task_rows`` bound what a task sorts and holds;
    the result does not depend on them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("uid", F.xxhash64("id", "text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fewest = partitions_for(spark)
    buckets = _prime_from(max(fewest, total // 18 // BUCKET_ANCHORS + 1))
    doc_buckets = _prime_from(max(fewest, total // BUCKET_BYTES + 1))
    named = rows.where("id IS NOT NULL AND octet_length(text) >= 50")
    tags = materialize(named.select("id", "text").mapInArrow(lambda it: _tag_batches(it, buckets, doc_buckets), _ROUTED_SPARK), "tags")
    dealt = tags.where("kind = 0").repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    across = dealt.mapInArrow(lambda it: _shared_tags(it, doc_buckets), _ROUTED_SPARK)
    wanted = materialize(tags.where("kind = 1").union(across), "shared-tags", free=True)
    release(tags)
    docs = rows.mapInArrow(lambda it: _doc_blobs(it, doc_buckets), _ROUTED_SPARK)
    met = wanted.union(docs).repartitionById(doc_buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "kind")
    met = met.mapInArrow(lambda it: _gather(it, buckets, doc_buckets), _ROUTED_SPARK)
    met = materialize(met, "surroundings", free=True)
    release(wanted)
    settled, open_ = [materialize(met.where("kind = 3"), "settled")], met.where("kind = 2")
    for k in range(ROUNDS + 1):
        dealt = open_.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
        found = materialize(dealt.mapInArrow(lambda it: _sorted_matches(it, doc_buckets, sort_rows, task_rows), _ROUTED_SPARK), "matches", free=not k)
        settled.append(found.where("kind = 3"))
        if not k:
            release(met)
        left = {r.kind: r.n for r in found.where("kind <> 3").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        if 5 in left:
            settled.append(_single(found.where("kind = 5"), doc_buckets))
        if 2 not in left:
            break
        buckets = _prime_from(max(fewest, left[2] // BUCKET_ANCHORS + 1))
        open_ = found.where("kind = 2").mapInArrow(lambda it, n=buckets: _dealt_anew(it, n), _ROUTED_SPARK)
    met = settled[0]
    for more in settled[1:]:
        met = met.union(more)
    cut = met.union(docs).repartitionById(doc_buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "kind")
    return cut.mapInArrow(lambda it: _apply(it, with_text), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
