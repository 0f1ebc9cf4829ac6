"""MinHash near-duplicates: one-permutation sketches with optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import as_bytes, connected_components, materialize, partitions_for, scratch, text_slices
from lexweave.llm.simhash import shingle_set

#: Sets of distinct shingles of so many words; a link joins sets whose intersection is at least so many percent of their union.
SHINGLE_WORDS, PERCENT = 2, 80
#: Bins of a sketch and bins of a band. A pair at 80 percent shares a band with probability 0.8 ** 7 = 0.21, and none of the 64
#: with probability 3e-7; a pair at 20 percent shares one with probability 8e-4, one at 2 percent with 8e-11.
BINS, BAND = 448, 7
#: Sets smaller than this reach 80 percent with equal sets only and need no sketch: 4 of 5 is the first such pair.
LEAST_SET = 4
#: Rows of a star that one task compares with its centre, and rows and bytes of a tile of what the stars leave open.
STAR_ROWS, TILE_ROWS, TILE_BYTES = 1024, 1024, 16 << 20
_SEED = 42


@functools.cache
def _probes(bins: int, block: int) -> np.ndarray:
    """A block of bins that each empty bin asks in turn: (attempt, bin) -> bin, a fixed random table for all sets."""
    return np.random.default_rng([_SEED, bins, block]).integers(0, bins, (64 if block else 8, bins))


def set_name(shingles: np.ndarray) -> bytes:
    """Name of a set in 128 bits."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One minimum for each bin, of a set of at least one sorted 64-bit hash.

    The high part of a hash names its bin: one permutation stands for all. An empty bin takes the minimum of the first bin it
    asks that is not empty; which bins it asks depends on itself alone, so each bin of two sketches is equal with the
    probability of the sets' similarity, independent of other empty bins (optimal densification).
    """
    home = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.r_[True, home[1:] != home[:-1]]  # hashes are sorted, so the first of a bin is its minimum
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    at = home[first].astype(np.int64)
    out[at], full[at] = shingles[first], True
    empty = np.flatnonzero(~full)
    block = 0
    while len(empty):
        asked = _probes(bins, block)[:, empty]
        hit = full[asked]
        found = hit.any(0)
        out[empty[found]] = out[asked[hit.argmax(0)[found], np.flatnonzero(found)]]
        empty = empty[~found]
        block += 1
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def band_keys(shingles: np.ndarray, bins: int = BINS, band: int = BAND) -> np.ndarray:
    """Bucket of each band of a set's sketch, as 64-bit hashes; none for sets below ``LEAST_SET``."""
    if len(shingles) < LEAST_SET:
        return np.empty(0, np.uint64)
    rows = _mixed(sketch(shingles, bins) + np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1, band)
    with np.errstate(over="ignore"):
        keys = np.zeros(len(rows), np.uint64)
        for k in range(band):
            keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return keys


def alike(one: np.ndarray, two: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether the intersection of two sets is at least ``percent`` of their union."""
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def _sets_of(part: pa.RecordBatch, words: int) -> list[np.ndarray]:
    return [shingle_set(t, words) for t in as_bytes(part.column("text"))]


def sketched(docs: DataFrame, id_col: str, text_col: str, words: int = SHINGLE_WORDS, bins: int = BINS, band: int = BAND) -> DataFrame:
    """``(id, name, n, keys)`` per row: name and size of its shingle set and its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                sets = _sets_of(part, words)
                columns = [pa.array([set_name(s) for s in sets], pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array([band_keys(s, bins, band).view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", "name", "n", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, name binary, n long, keys array<long>")


def _whole_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``(node, bytes)`` of ``nodes(node, name)``: the whole set of each, formed anew from its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                sets = _sets_of(part, words)
                same = np.array([set_name(s) == name for s, name in zip(sets, part.column("name").to_pylist())], bool)
                whole = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), whole], names=["node", "bytes"]).filter(pa.array(same))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(nodes, F.col("id") == F.col("node")).select("node", "name", "text")
    return rows.mapInArrow(run, "node long, bytes binary").dropDuplicates(["node"])


def _star_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` of ``rows(star, part, role, node, bytes)``, sorted by star: its centre (role 0) against each row that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centre = None, None
        for batch in batches:
            a, b = [], []
            for s, part, role, node, whole in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column("node").to_pylist(), batch.column("bytes")):
                own = np.frombuffer(whole.as_buffer(), np.uint64)
                if role == 0:
                    star, centre = (s, part), own.copy()
                elif star == (s, part) and alike(centre, own, percent):
                    a.append(s)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.repartition(partitions_for(rows.sparkSession), "star", "part").sortWithinPartitions("star", "part", "role")
    return dealt.mapInArrow(run, "a long, b long")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int = PERCENT, star_rows: int = STAR_ROWS) -> DataFrame:
    """The ``edges(star, node)`` whose whole sets are alike, as ``(a, b)``.

    The centre's set travels once for each part of about ``star_rows`` of its star, so a large star is many tasks' work.
    """
    parts = edges.groupBy("star").agg(F.ceil(F.count("*") / star_rows).cast("int").alias("parts"))
    own = edges.join(parts, "star").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("star", "part", F.lit(1).alias("role"), "node")
    heads = parts.select("star", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(0).alias("role"), F.col("star").alias("node"))
    return _star_links(own.union(heads).join(sets, "node").select("star", "part", "role", "node", "bytes"), percent)


def _tile_links(key: tuple, table: pa.Table, percent: int) -> pa.Table:
    """Links inside one pair of tiles: rows of different components that share a bucket, whole sets compared; a spanning forest only."""
    table = table.sort_by([("tile", "ascending"), ("node", "ascending")])
    node, comp, n, tile = (table.column(c).to_numpy() for c in ("node", "comp", "n", "tile"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("bytes")]
    keys = np.array(table.column("keys").to_pylist(), np.int64)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    links: list[tuple[int, int]] = []
    within = key[1].as_py() == key[2].as_py()
    for i in range(len(node)):
        if not within and tile[i] != key[1].as_py():
            break  # the rows of the second tile have been met by those of the first
        rest = np.arange(i + 1, len(node)) if within else np.flatnonzero(tile != tile[i])
        near = rest[(comp[rest] != comp[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))]
        near = near[(keys[near] == keys[i]).any(1)]
        for j in near.tolist():
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y and alike(sets[i], sets[j], percent):
                parent[max(x, y)] = min(x, y)
                links.append((int(node[i]), int(node[j])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _contract(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(node, label)`` after ``links`` join the components that ``labels`` has so far."""
    if labels is None:
        return connected_components(links)
    merged = connected_components(_at_labels(links, labels, "a", "b"))
    up = merged.select(F.col("node").alias("old"), F.col("label").alias("up"))
    moved = labels.join(up, labels["label"] == up["old"], "left").select("node", F.coalesce("up", "label").alias("label"))
    return moved.union(merged.join(moved.select("node"), "node", "left_anti"))


def _at_labels(rows: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the nodes in ``columns`` replaced by their components."""
    for c in columns:
        here = labels.select(F.col("node").alias("of"), "label")
        rows = rows.join(here, rows[c] == here["of"], "left").withColumn(c, F.coalesce("label", c)).drop("of", "label")
    return rows


def linked_components(docs: DataFrame, rows: DataFrame, named: DataFrame, id_col: str, text_col: str, words: int, percent: int, star_rows: int = STAR_ROWS, tile_rows: int = TILE_ROWS, tile_bytes: int = TILE_BYTES) -> DataFrame | None:
    """``(node, label)`` for the nodes of ``named(name, node, n)`` that have links; None where no bucket is shared.

    ``rows(id, name, n, keys)`` has the buckets. Where one id has several sets, that of the smallest name stands for it.

    1. A bucket's centre is its most popular node: the one whose buckets hold most nodes in all, which is what a text that
       many copies derive from looks like. Candidates are the edges between a centre and its bucket: never more than
       nodes times bands. Whole sets confirm, for each node the edge to its most popular centre first, then those that
       still lead between components.
    2. Components that still meet in a bucket, beside its centre, are joined to families. Tiles of a family
       are compared pair by pair inside tasks, rows that share a bucket only, and tell a spanning forest of links. So no
       pair that shares a bucket stays undecided, and none but links leaves a task.
    """
    nodes = named.where(F.col("n") >= LEAST_SET).groupBy("node").agg(F.min(F.struct("name", "n")).alias("set")).select("node", "set.name", "set.n")
    nodes = materialize(nodes, "nodes")
    of_node = rows.withColumnRenamed("id", "node").join(nodes.select("node", "name"), ["node", "name"]).select("node", "keys")
    keyed = of_node.select(F.explode("keys").alias("key"), "node")
    full = keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    shared = materialize(keyed.join(full, "key"), "shared")
    if shared.isEmpty():
        return None
    popular = shared.groupBy("node").agg(F.struct(F.sum("held").alias("met"), (-F.col("node")).alias("least")).alias("popular"))
    centres = shared.join(popular, "node").groupBy("key").agg(F.max("popular").alias("popular"))
    spokes = materialize(shared.join(centres, "key").select("key", "node", F.col("popular.met").alias("met"), (-F.col("popular.least")).alias("star")), "spokes")
    sets = materialize(_whole_sets(docs, nodes.join(spokes.select("node").distinct(), "node", "left_semi").select("node", "name"), id_col, text_col, words), "sets")
    sizes = nodes.select("node", "n")
    edges = spokes.where("node <> star").groupBy("star", "node").agg(F.max("met").alias("met"))
    star_sizes = sizes.select(F.col("node").alias("star"), F.col("n").alias("star_n"))
    edges = edges.join(sizes, "node").join(star_sizes, "star").where(100 * F.least("n", "star_n") >= percent * F.greatest("n", "star_n")).select("star", "node", "met")
    edges = materialize(edges, "edges")
    best = edges.groupBy("node").agg(F.max(F.struct("met", "star")).alias("best")).select(F.col("best.star").alias("star"), "node")
    labels = connected_components(materialize(confirmed(best, sets, percent, star_rows), "links"))
    apart = _at_labels(_at_labels(edges.select("star", "node", F.col("star").alias("x"), F.col("node").alias("y")), labels, "x"), labels, "y").where("x <> y").select("star", "node")
    labels = materialize(_contract(labels, materialize(confirmed(apart, sets, percent, star_rows), "links")), "labels")

    left = _at_labels(spokes.where("node <> star").select("key", "node", F.col("node").alias("comp")), labels, "comp")
    open_ = left.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    left = materialize(left.join(open_.select("key", "low"), "key"), "left")
    if left.isEmpty():
        return labels
    family = connected_components(left.where("low <> comp").select(F.col("low").alias("a"), F.col("comp").alias("b")).distinct())
    family = family.select(F.col("node").alias("of_comp"), F.col("label").alias("family"))
    members = left.select("node", "comp").distinct().join(family, F.col("comp") == F.col("of_comp")).drop("of_comp").join(sizes, "node")
    tiles = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / tile_rows), F.ceil(F.sum("n") * 8 / tile_bytes)).cast("int").alias("tiles"))
    members = members.join(tiles, "family").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    members = members.join(of_node.dropDuplicates(["node"]), "node").join(sets, "node").withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    pairs = members.select("family", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "node", "comp", "n", "tile", "keys", "bytes")
    links = pairs.groupBy("family", "one", "two").applyInArrow(lambda key, table: _tile_links(key, table, percent), "a long, b long")
    return _contract(labels, materialize(links, "links"))


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT, bins: int = BINS, band: int = BAND, **bounds: int) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` per row of ``docs``.

    Rows of equal shingle sets are one class, so copies never become pairs; links are searched between classes and
    membership joins back. Sets are of 64-bit hashes of shingles. ``component_id`` is the smallest id reachable over links.

    Null and empty texts, and texts of blanks only, have no shingle and are linked with nothing. A row with a null id gets
    the component of its set and is not kept; rows of one id are one node; repeated rows stay repeated; an empty table
    gives an empty result. Texts of any length are read whole, one set of a long text at a time. Other columns are not read.
    """
    with scratch() as tables:
        rows = materialize(sketched(docs, id_col, text_col, words, bins, band), "sketched")
        named = materialize(rows.where("n > 0").groupBy("name").agg(F.min("id").alias("node"), F.max("n").alias("n")), "named")
        found = linked_components(docs, rows, named, id_col, text_col, words, percent, **bounds)
        of_set = named
        if found is not None:
            of_set = named.join(found, "node", "left").select("name", F.coalesce("label", "node").alias("node"))
        own = rows.select("id", "name", "n").join(of_set.select("name", "node"), "name", "left")
        component = F.when(F.col("n") > 0, F.col("node")).otherwise(F.col("id"))
        done = own.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        return tables.keep(done.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))), "groups")
