"""SimHash near-duplicates: 64-bit fingerprints, exact tiled comparison, connected groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import as_bytes, connected_components, materialize, partitions_for, quoted, release, text_digest, text_slices, without_rows

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: Rows of a tile that are held in memory while other tiles stream past, and visiting rows that one task meets.
TILE_ROWS, VISIT_ROWS = 8192, 16384
#: A group's key holds tile, chunk of visitors and bit counts, each in bits of its own.
_COUNT_BITS, _CHUNK_BITS = 13, 32
_CHUNK = 1 << 15


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of one text given in UTF-8: bit set where over half of the shingle hashes set it; zero without words."""
    tokens = text.lower().split()  # on bytes: only A-Z change, only blanks and controls 9-13 separate
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles: Iterator[bytes] | list[bytes] = [b" ".join(tokens)]
        count = 1
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
        count = len(tokens) - words + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=count)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, count, _CHUNK):
        bits = np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            prints = np.array([fingerprint(t) for t in as_bytes(part.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints.view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` per row; a null text counts as empty (fingerprint zero)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "id long, fp long")


def _near_offsets(radius: int) -> list[tuple[int, int]]:
    """Steps between the popcount pairs of two tiles that can hold rows within the radius; one of each opposite pair."""
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if abs(a) + abs(b) <= radius and (a, b) > (0, 0)]


class _Tile:
    """One tile in memory, with a union-find over its rows; keeps a spanning forest of links only."""

    def __init__(self, rows: np.ndarray, radius: int):
        self.rows, self.radius = rows, np.uint8(radius)
        self.label = np.arange(len(rows))
        self.links: list[tuple[int, int]] = []

    def _merge(self, pairs: np.ndarray) -> None:
        """Unite the labels in each row of ``pairs``."""
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for x, y in pairs.tolist():
            x, y = sorted((find(x), find(y)))
            if x != y:
                parent[y] = x
                self.links.append((int(self.rows[x]), int(self.rows[y])))
        if parent:
            table = np.arange(len(self.rows))
            for x in parent:
                table[x] = find(x)
            self.label = table[self.label]

    def meet(self, visitors: np.ndarray, inside: bool = False, step: int = 256) -> None:
        """Compare visiting rows with the tile. ``inside``: the visitors are the tile's own rows."""
        for i in range(0, len(visitors), step):
            part = visitors[i : i + step]
            close = np.bitwise_count(part[:, None] ^ self.rows[None, :]) <= self.radius
            own, mate = np.nonzero(close)
            if not len(own):
                continue
            if inside:
                keep = (own + i) < mate
                own, mate = own[keep], mate[keep]
                if not len(own):
                    continue
            first = np.unique(own, return_index=True)[1]
            anchor = np.full(len(part), -1)
            anchor[own[first]] = mate[first]
            if inside:
                self._merge(np.unique(np.stack([self.label[own[first] + i], self.label[mate[first]]], 1), axis=0))
            else:
                self.links += list(zip(part[own[first]].view(np.int64).tolist(), self.rows[mate[first]].tolist()))
            a, b = self.label[anchor[own]], self.label[mate]
            split = a != b
            if split.any():
                self._merge(np.unique(np.stack([a[split], b[split]], 1), axis=0))


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by tile, the tile's own rows first; only the tile's rows are held."""
    key, own, tile = None, [], None

    def emit(links: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(links, dtype=object).reshape(-1, 2)
        as_long = [np.array([int(x) for x in pairs[:, k]], dtype=np.int64) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in as_long], names=["a", "b"])

    def close_tile() -> list[tuple[int, int]]:
        nonlocal tile, own
        if tile is None and own:
            start_tile()
        links = [(int(np.uint64(a & (2**64 - 1)).view(np.int64)), int(np.uint64(b & (2**64 - 1)).view(np.int64))) for a, b in tile.links] if tile else []
        tile, own = None, []
        return links

    def start_tile() -> None:
        nonlocal tile
        tile = _Tile(np.concatenate(own) if own else np.empty(0, np.uint64), radius)
        if len(tile.rows) and not int(key) >> _COUNT_BITS & (1 << _CHUNK_BITS) - 1:  # once, not per chunk of visitors
            tile.meet(tile.rows, inside=True)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        roles = batch.column("role").to_numpy()
        rows = batch.column("fp").to_numpy().view(np.uint64)
        mark = keys * 2 + roles
        cuts = np.flatnonzero(np.diff(mark)) + 1
        for s, e in zip([0, *cuts], [*cuts, len(mark)]):
            if keys[s] != key:
                if links := close_tile():
                    yield emit(links)
                key = keys[s]
            if roles[s] == 0:
                own.append(rows[s:e])
            else:
                if tile is None:
                    start_tile()
                if len(tile.rows):
                    tile.meet(rows[s:e])
    if links := close_tile():
        yield emit(links)


def _dealt(rows: DataFrame, steps: list[tuple[int, int]], tile_rows: Column, visit_rows: Column) -> DataFrame:
    """``rows(node, u, v, ...)`` with ``key`` and ``role``, dealt to tasks and sorted: per key a tile (role 0) and its visitors.

    Rows of one cell ``(u, v)`` are split by hash into tiles of about ``tile_rows``. Each row lives in its own tile and
    visits the tiles of its cell that follow and those of the cells ``steps`` away; a tile with many visitors gets them in
    chunks of about ``visit_rows``, and its rows go to each. Cells are few whatever the input, so their table may be broadcast.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("u", "v").agg(F.count("*").alias("n"))
    tiles = counts.select(F.col("u").alias("t_u"), F.col("v").alias("t_v"), F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles"), visit_rows.alias("most"))
    offsets = F.array(*[F.struct(F.lit(a).alias("da"), F.lit(b).alias("db")) for a, b in [(0, 0), *steps]])
    expected = counts.select("n", "u", "v", F.explode(offsets).alias("s")).groupBy((F.col("u") + F.col("s.da")).alias("t_u"), (F.col("v") + F.col("s.db")).alias("t_v")).agg(F.sum("n").alias("visitors"))
    tiles = tiles.join(expected, ["t_u", "t_v"]).withColumn("chunks", F.ceil(F.col("visitors") / F.col("most")).cast("int"))
    visits = rows.select("*", F.explode(offsets).alias("s")).withColumn("home", (F.col("s.da") == 0) & (F.col("s.db") == 0)).withColumn("t_u", F.col("u") + F.col("s.da")).withColumn("t_v", F.col("v") + F.col("s.db"))
    visits = visits.join(F.broadcast(tiles), ["t_u", "t_v"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    visits = visits.withColumn("tile", F.explode(F.expr("sequence(IF(home, mine, 0), tiles - 1)")))
    visits = visits.withColumn("role", F.when(F.col("home") & (F.col("tile") == F.col("mine")), 0).otherwise(1).cast("long")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
    visits = visits.withColumn("chunk", F.explode(F.expr("sequence(IF(role = 0, 0, own), IF(role = 0, chunks - 1, own))")))
    key = (F.shiftleft(F.col("tile").cast("long"), _CHUNK_BITS) + F.col("chunk")) * (1 << _COUNT_BITS) + F.col("t_u") * 64 + F.col("t_v")
    keyed = visits.select(*[c for c in rows.columns if c not in ("u", "v")], key.alias("key"), "role")
    return keyed.repartition(partitions_for(spark), "key").sortWithinPartitions("key", "role")


def near_links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, visit_rows: int = VISIT_ROWS) -> DataFrame:
    """Spanning links ``(a, b)`` between the distinct values of ``prints.fp`` that differ in at most ``radius`` bits.

    The cell of a fingerprint are the bit counts of its halves. Two rows within the radius differ in these counts by at
    most the radius in sum, so every other pair of tiles is skipped. A task holds one tile and streams its visitors
    through exclusive-or and bit counts. Of the links in a tile only a spanning forest leaves the task: at most one per
    row, whatever the size of a group.
    """
    high, low = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    rows = prints.select(F.col("fp").alias("node"), "fp", high.cast("int").alias("u"), low.cast("int").alias("v"))
    dealt = _dealt(rows, _near_offsets(radius), F.lit(tile_rows), F.lit(visit_rows)).select("fp", "key", "role")
    return dealt.mapInArrow(lambda it: _compare(it, radius), "a long, b long")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile_rows: int = TILE_ROWS, visit_rows: int = VISIT_ROWS) -> DataFrame:
    """``(id, fp, component_id)`` per row of ``docs``.

    Equal fingerprints are one class; links are searched between classes only, and membership joins back, so a
    group of many copies never becomes pairs. ``component_id`` is the smallest id reachable over links. Null and
    empty texts, and texts of blanks only, share fingerprint zero and hence a group; a row with a null id gets the
    component of its fingerprint (null where the group has no other id); repeated rows stay repeated; an empty
    table gives an empty result. Other columns of ``docs`` are not read.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    links = materialize(near_links(classes, radius, tile_rows, visit_rows), "links")
    labels = connected_components(links)
    linked = labels.join(classes, labels["node"] == classes["fp"]).select("fp", "label", "rep")
    least = linked.groupBy("label").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "label").select("fp", "least")
    found = classes.join(linked, "fp", "left").select(F.col("fp").alias("class_fp"), F.coalesce("least", "rep").alias("component_id"))
    return prints.join(found, prints["fp"] == found["class_fp"]).select("id", "fp", "component_id")


# ---- texts of similarity 0.8 or more -------------------------------------------------------------------------------

#: A link joins texts whose sets of five-word shingles have Jaccard similarity of at least 4/5.
SIMILAR_WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Fingerprints of 1024 bits; pairs further apart than ``NEAR`` in the first 128 are not looked at again. At similarity 4/5
#: a bit differs with probability 0.15, for the smallest sets (4 of 5 shingles) 0.19: 40 bits are 4.9 and 3.6 standard
#: deviations above the mean. The whole fingerprint is held against the bounds below, 4.5 deviations above the mean.
WIDTH, FIRST, NEAR = 16, 2, 40
SMALL_SET, FAR_SMALL, FAR = 32, 248, 208
#: Bytes of shingle sets that a tile's rows, and a chunk of its visitors, may come to.
TILE_BYTES, VISIT_BYTES = 24 << 20, 48 << 20
#: Rows of a tile, and of a chunk of its visitors, where pairs are decided by their sets.
DECIDED_ROWS = 1024
_STEP = 128
_PAIRS = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("d", pa.int32())])


def shingle_set(text: bytes, words: int = SIMILAR_WORDS, seed: int = SEED) -> np.ndarray:
    """Distinct shingles of one text in UTF-8 as sorted 64-bit hashes; a text of fewer words is one shingle, one without words has none."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)))) if len(tokens) >= words else [b" ".join(tokens)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64))


def set_name(shingles: np.ndarray) -> int:
    """64-bit name of a shingle set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of 64-bit mixes; the first are the hashes themselves."""
    if not k:
        return hashes
    h = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of 1024 bits over a set of shingles: each word of it from another mix of the same hashes."""
    ones = np.zeros((WIDTH, 64), np.int64)
    for i in range(0, len(shingles), _CHUNK):
        for k in range(WIDTH):
            mixed = _mixed(shingles[i : i + _CHUNK], k)
            ones[k] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles), axis=1, bitorder="little").view(np.uint64).ravel()


def _similar(one: np.ndarray, two: np.ndarray) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return (NUMERATOR + DENOMINATOR) * both >= NUMERATOR * (len(one) + len(two))


def _named(rows: DataFrame) -> DataFrame:
    """``(id, sha, node, n, ones, fp)`` per row: the name of its shingle set, the set's size, the wide fingerprint and the bit
    count of its first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                sets = [shingle_set(t) for t in as_bytes(part.column("text"))]
                prints = [wide_fingerprint(s) for s in sets]
                ones = [int(np.bitwise_count(f[:FIRST]).sum()) for f in prints]
                arrays = [pa.array(map(set_name, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(ones, pa.int32()), pa.array([f.tobytes() for f in prints], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("sha"), *arrays], names=["id", "sha", "node", "n", "ones", "fp"])

    return rows.mapInArrow(run, "id long, sha binary, node long, n int, ones int, fp binary")


class _Near:
    """A tile and its visitors: which of them may be similar and are not in one component yet.

    Without sets it tells pairs, of each row only the nearest and the foremost; with sets it decides all of them here, nearest
    first, and tells the links that join components: at most one for each row, however many of them are alike.
    """

    def __init__(self, key: int, node: np.ndarray, n: np.ndarray, comp: np.ndarray, fp: np.ndarray, sets: np.ndarray | None):
        self.key, self.node, self.n, self.comp, self.fp, self.sets = key, node, n, comp, fp, sets
        self.best = np.full(len(node), 1 << 30, np.int64)
        self.mate = np.zeros(len(node), np.int64)
        self.parent: dict[int, int] = {}

    def meet(self, node: np.ndarray, n: np.ndarray, comp: np.ndarray, fp: np.ndarray, sets: np.ndarray | None, inside: bool = False) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(node), _STEP):
            part = slice(at, at + _STEP)
            near = np.bitwise_count(fp[part, None, 0] ^ self.fp[None, :, 0])
            for k in range(1, FIRST):
                near += np.bitwise_count(fp[part, None, k] ^ self.fp[None, :, k])
            x, y = np.nonzero(near <= NEAR)
            x = x + at
            small, large = np.minimum(n[x], self.n[y]), np.maximum(n[x], self.n[y])
            keep = (DENOMINATOR * small >= NUMERATOR * large) & (comp[x] != self.comp[y])
            if inside:
                keep &= x < y
            x, y, small = x[keep], y[keep], small[keep]
            d = np.zeros(len(x), np.int64)
            for k in range(WIDTH):
                d += np.bitwise_count(fp[x, k] ^ self.fp[y, k])
            keep = d <= np.where(small < SMALL_SET, FAR_SMALL, FAR)
            x, y, d = x[keep], y[keep], d[keep]
            if not len(x):
                continue
            if sets is not None:
                x, y, d = self._decide(x, y, d, comp, sets)
            else:
                order = np.lexsort((d, y))  # for each row of the tile the nearest visitor so far
                first = order[np.unique(y[order], return_index=True)[1]]
                nearer = first[d[first] < self.best[y[first]]]
                self.best[y[nearer]], self.mate[y[nearer]] = d[nearer], node[x[nearer]]
                order = np.lexsort((d, x))  # for each visitor the nearest row and the foremost
                first = np.r_[order[np.unique(x[order], return_index=True)[1]], np.unique(x, return_index=True)[1]]
                x, y, d = x[first], y[first], d[first]
            if len(x):
                yield self._told(node[x], self.node[y], d)

    def _find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def _decide(self, x: np.ndarray, y: np.ndarray, d: np.ndarray, comp: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, ...]:
        keep = []
        for i in np.argsort(d, kind="stable").tolist():
            one, two = self._find(int(comp[x[i]])), self._find(int(self.comp[y[i]]))
            if one != two and _similar(np.frombuffer(sets[x[i]], np.uint64), np.frombuffer(self.sets[y[i]], np.uint64)):
                self.parent[max(one, two)] = min(one, two)
                keep.append(i)
        return x[keep], y[keep], d[keep]

    def done(self) -> Iterator[pa.RecordBatch]:
        some = self.best < 1 << 30
        if some.any():
            yield self._told(self.mate[some], self.node[some], self.best[some])

    def _told(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), self.key)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d.astype(np.int32))], schema=_PAIRS)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by tile, the tile's own rows first; only the tile's rows are held."""
    key, own, tile = None, [], None

    def columns(rows: pa.RecordBatch) -> tuple[np.ndarray | None, ...]:
        prints = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(-1, WIDTH)
        sets = np.array([*rows.column("shingles").to_pylist(), None], object)[:-1] if "shingles" in rows.schema.names else None
        return (*(rows.column(c).to_numpy() for c in ("node", "n", "comp")), prints, sets)

    def start() -> Iterator[pa.RecordBatch]:
        nonlocal tile
        held = [np.concatenate(c) if c[0] is not None else None for c in zip(*own)]
        tile = _Near(key, *held)
        if not key >> _COUNT_BITS & (1 << _CHUNK_BITS) - 1:  # once, not per chunk of visitors
            yield from tile.meet(*held, inside=True)

    def end() -> Iterator[pa.RecordBatch]:
        nonlocal tile, own
        if tile is None and own:
            yield from start()
        if tile is not None:
            yield from tile.done()
        tile, own = None, []

    for batch in batches:
        mark = batch.column("key").to_numpy() * 2 + batch.column("role").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
        for s, e in zip(cuts, cuts[1:]):
            if e == s:
                continue
            here, role = divmod(int(mark[s]), 2)
            if here != key:
                yield from end()
                key = here
            rows = columns(batch.slice(s, e - s))
            if role == 0:
                own.append(rows)
            elif own:
                if tile is None:
                    yield from start()
                yield from tile.meet(*rows)
    yield from end()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: the sets that stand in the key's pairs, then the pairs by distance. A pair is decided by its sets;
    one whose texts are linked already is left out, for it joins nothing."""
    key, sets, parent = None, {}, {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for batch in batches:
        links = []
        for here, a, b, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b", "shingles"))):
            if here != key:
                key, sets, parent = here, {}, {}
            if raw is not None:
                sets[a] = np.frombuffer(raw, np.uint64)
            elif (x := find(a)) != (y := find(b)) and _similar(sets[a], sets[b]):
                parent[max(x, y)] = min(x, y)
                links.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _round(classes: DataFrame, tile_rows: int = TILE_ROWS, visit_rows: int = VISIT_ROWS) -> DataFrame:
    """``(key, a, b, d)`` among ``classes(node, n, ones, fp, comp)`` of different components: candidates, or links where the
    classes bring their ``shingles``."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DENOMINATOR / NUMERATOR))).cast("int")  # similar sets are at most one band apart
    carried = [c for c in ("node", "n", "fp", "comp", "shingles") if c in classes.columns]
    rows = classes.select(*carried, band.alias("u"), F.floor(F.col("ones") / NEAR).cast("int").alias("v"))
    bytes_each = 8 * F.pow(F.lit(DENOMINATOR / NUMERATOR), F.col("u") + 1)
    fitting = lambda limit, most: F.greatest(F.lit(16), F.least(F.lit(most), F.floor(F.lit(limit) / bytes_each))).cast("int")
    steps = [(a, b) for a in (0, 1) for b in (-1, 0, 1) if (a, b) > (0, 0)]
    dealt = _dealt(rows, steps, fitting(TILE_BYTES, tile_rows), fitting(VISIT_BYTES, visit_rows))
    return materialize(dealt.select(*carried, "key", "role").mapInArrow(_candidates, "key long, a long, b long, d int"), "candidates")


def _decided(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links ``(a, b)`` among candidate pairs; each tile's sets meet its pairs."""
    nodes = pairs.select("key", F.col("a").alias("node")).union(pairs.select("key", "b")).distinct()
    held = nodes.join(sets, "node").select("key", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(-1).alias("d"), "shingles")
    both = held.unionByName(pairs.select("key", "a", "b", "d", F.lit(None).cast("binary").alias("shingles")))
    dealt = both.repartition(partitions_for(pairs.sparkSession), "key").sortWithinPartitions("key", "d")
    return materialize(dealt.select("key", "a", "b", "shingles").mapInArrow(_verified, "a long, b long"), "links")


def _sets_of(rows: DataFrame, named: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, shingles)`` of the named sets, read again from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                sets = [shingle_set(t) for t in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array(map(set_name, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    shas = named.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("sha").alias("sha")).select(F.col("sha").alias("of")).distinct()
    texts = rows.join(shas, rows["sha"] == shas["of"], "left_semi").select("text")
    return materialize(texts.mapInArrow(run, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, sha, node, component)`` per row of ``docs``: texts linked where their shingle sets have similarity 0.8 or more.

    Wide fingerprints are compared in tiles as in ``near_links``; the cell of a text is the band of its set's size and a
    band of its bit count, so tiles whose sizes or bit counts rule out a link are skipped. Every pair that is left is
    decided by the sets themselves, so no link is wrong; a pair is missed only where its fingerprints differ by some four
    standard deviations more than the mean. Equal sets are one class.

    A first round tells, for each text in each tile, its nearest and foremost candidate; the second the same between the
    components found. The third decides every candidate that is left between components, within the tiles, which hold the
    sets of the texts concerned; only links leave a task. So a large group gives few rows, and no pair is left out.

    Null and empty texts, and texts of blanks only, are one class; repeated rows stay repeated; a null id is a row like
    any other; an empty table gives an empty result; other columns are not read. A text of any length is read whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_digest(F.col(quoted(text_col))).alias("sha"))
    named = materialize(_named(rows), "named")
    classes = named.groupBy("node").agg(F.first("n").alias("n"), F.first("ones").alias("ones"), F.first("fp").alias("fp")).where("n > 0")
    classes = materialize(classes.withColumn("comp", F.col("node")), "classes")
    pairs = _round(classes)
    nodes = _nodes(pairs)
    sets = _sets_of(rows, named, nodes)
    rest = materialize(classes.join(nodes, "node", "left_semi"), "rest")
    release(classes)
    links = _decided(pairs, sets)
    labels = connected_components(links)
    release(pairs)
    pairs = _round(_labelled(rest, labels))
    found, last = _decided(pairs, sets), _nodes(pairs)  # every text with a candidate outside its component stands in a pair
    release(pairs), release(labels), release(nodes)
    both = materialize(links.union(found), "links")
    release(links), release(found)
    labels = connected_components(both)
    left = _labelled(rest.join(last, "node", "left_semi"), labels).join(sets, "node")
    found = _round(left, DECIDED_ROWS, DECIDED_ROWS).select("a", "b")
    release(labels)
    labels = connected_components(both.union(found))
    for gone in (sets, rest, last, both):
        release(gone)
    known = labels.select(F.col("node").alias("l_node"), "label")
    return named.join(known, named["node"] == F.col("l_node"), "left").select("id", "sha", "node", F.coalesce("label", "node").alias("component"))


def _nodes(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "nodes")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows(node, n, ones, fp)`` with their component so far."""
    known = labels.select(F.col("node").alias("l_node"), "label")
    return rows.join(known, rows["node"] == F.col("l_node"), "left").select("node", "n", "ones", "fp", F.coalesce("label", "node").alias("comp"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of ``similar_groups``, that with the smallest id; columns unchanged.

    A null id stays only where its group has no other; of an id that stands on several texts of a group one text stays,
    and an id that is dropped with one text stays with another. Rows equal in id and text share their fate: exact
    deduplication is the step that removes repeats.
    """
    groups = materialize(similar_groups(docs, id_col, text_col), "groups")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "sha")
    least = groups.groupBy("component").agg(F.min(rank).alias("least"))
    gone = groups.join(least, "component").where(~rank.eqNullSafe(F.col("least"))).select("id", "sha").distinct()
    gone = materialize(gone, "gone")
    release(groups)
    return without_rows(docs, gone, id_col, text_col)
