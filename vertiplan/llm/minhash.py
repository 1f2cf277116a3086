"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its word shingles. Two permutations give its whole signature: one places
every shingle in a ring of ``RING`` slots, the other ranks the slots, and coordinate i is the least
rank after shifting the ring by i. So one shingle contributes one contiguous slice of the rank
table, and a signature costs one vectorised minimum over slices.

Steps: equal sets (equal 128-bit digests) become one class. In every bucket of a band each class is
compared with the bucket's first one on full sets. What is confirmed is joined into parts; only where
a bucket then still holds classes apart from its first one's part are these compared with all others
of the bucket that belong to other parts, block against block. So a large group of near copies costs one
comparison each, no stage emits pairs of a group, and every pair that shares a bucket is either in one
part or compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import keep, shuffled_anew, small_batches
from ._words import mix, words
from .components import connected_components

RING = 1 << 20
ROWS = 5
#: Classes in one block of a bucket; a larger bucket is split into blocks by hash.
BLOCK = 256
_MISS = 1e-6
_SIDES = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)


def bands_for(percent: int, rows: int = ROWS) -> int:
    """Bands such that a pair at exactly the threshold shares none with a probability under 1e-6."""
    return math.ceil(math.log(_MISS) / math.log(1 - (percent / 100) ** rows))


@lru_cache(maxsize=2)
def _tables(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    place = rng.permutation(RING).astype(np.int32)
    rank = rng.permutation(RING).astype(np.uint32)
    ring = np.concatenate([rank, rank[:coordinates]])
    return place, np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """All coordinates of a non-empty set of 64-bit shingle hashes."""
    place, windows = _tables(coordinates)
    at = place[(shingles >> np.uint64(44)).astype(np.int64)]
    out = windows[at[:512]].min(axis=0)
    for i in range(512, len(at), 512):
        np.minimum(out, windows[at[i : i + 512]].min(axis=0), out=out)
    return out


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for row, to, w in words(column):
        h, ok = w.shingles(k)
        for d in range(to - row):
            a, b = w.first[d], w.first[d + 1]
            x = np.sort(h[a:b][ok[a:b]])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _digest(x: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a set given as sorted distinct hashes."""
    size = np.uint64(len(x))
    both = np.array([np.bitwise_xor.reduce(mix(x)), mix(~x).sum()], np.uint64)
    return tuple(mix(mix(both + size) + mix(both[::-1] ^ _SIDES)).view(np.int64).tolist())


def signatures(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, row_hash, n, d1, d2, bands): hash of the text, set size, both halves of the set's
    digest and the hash of each band; the last three are null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            n, digest, keys = [], [], []
            for x in _sets(batch.column("text"), k):
                n.append(len(x))
                if not len(x):
                    digest.append((None, None))
                    keys.append(None)
                    continue
                digest.append(_digest(x))
                acc = salt.copy()
                for column in signature(x, bands * ROWS).reshape(bands, ROWS).T:
                    acc = mix(acc + column.astype(np.uint64))
                keys.append(acc.view(np.int64))
            halves = [pa.array([d[i] for d in digest], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), pa.array(n, pa.int64()), *halves, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "row_hash", "n", "d1", "d2", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash("text").alias("row_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_hash long, n long, d1 long, d2 long, bands array<long>")


def row_hash(text: str) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.col(text).cast("string"))


def _as_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, text) -> (node, shingles), once per node of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = [n not in seen and not seen.add(n) for n in batch.column("node").to_pylist()]
            batch = batch.filter(pa.array(new, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in _sets(batch.column("text"), k)], pa.binary())], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles binary")


def _like(head: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are linked with ``head``."""
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(head, flat), len(head) - 1)
    common = np.bincount(np.repeat(np.arange(len(sets)), size)[head[at] == flat], minlength=len(sets))
    return 100 * common >= percent * (size + len(head) - common)


def _joined(parts: list[int], sets: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join two parts, as pairs of parts; if both sides occur, only pairs across count."""
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    kinds, code = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(code, minlength=len(kinds)) > 1
    column = np.cumsum(shared) - 1
    use = shared[code]
    owner, code, width = owner[use], column[code[use]], int(shared.sum())
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(sets)),) * 2
    if not len(left) or not len(right):
        return
    common = np.zeros((len(left), len(right)), np.int64)
    for a in range(0, width, 4096):
        here = (code >= a) & (code < a + 4096)
        m = np.zeros((len(sets), min(4096, width - a)), np.float32)
        m[owner[here], code[here] - a] = 1
        common += (m[left] @ m[right].T).astype(np.int64)
    linked = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
    parent = {p: p for p in parts}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, row in zip(left.tolist(), linked, strict=True):
        for j in right[np.flatnonzero(row)].tolist():
            if (a := find(parts[i])) != (b := find(parts[j])):
                parent[max(a, b)] = min(a, b)
                yield parts[i], parts[j]


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in keys:
            v = batch.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        at = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:]):
            key = tuple(batch.column(c)[a].as_py() for c in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], pa.int64()) for n in (0, 1)], ["a", "b"])


def _by_hash(blocks: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")


def _upto(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def links_with_heads(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """buckets (head, node), sets (node, shingles) -> (a, b): the nodes that are linked with the head of a bucket of
    theirs. The members of a head are split over blocks, each of which has the head's set once."""
    stars = buckets.where("node <> head").select("head", "node").distinct()
    sizes = shuffled_anew(stars.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "head")
    members = stars.join(sizes, "head").select("head", _by_hash("blocks").alias("block"), "node")
    heads = sizes.select("head", _upto("blocks").alias("block"), F.col("head").alias("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["head", "block"]):
            head, nodes = t.column("head")[0].as_py(), t.column("node").to_pylist()
            own = dict(zip(nodes, (np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()), strict=True))
            first = own.pop(head)
            if own:
                yield _pairs([(n, head) for n, ok in zip(own, _like(first, list(own.values()), percent), strict=True) if ok])

    units = members.union(heads).join(sets, "node").select("head", "block", "node", "shingles")
    return units.repartition("head", "block").sortWithinPartitions("head", "block").mapInArrow(run, "a long, b long")


def _apart(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """buckets (band, head, node), parts (node, component) -> (band, node, part, away, aways, others), without the buckets
    that have nothing more to compare: away tells that a node is not in its head's part, aways and others are
    the numbers of blocks of such nodes and of the rest. Of buckets with equal members one is left."""
    heads = buckets.select("head").distinct().join(parts.select(F.col("node").alias("head"), F.col("component").alias("of_head")), "head", "left")
    rows = buckets.join(parts, "node", "left").join(shuffled_anew(heads, "head"), "head").select("band", "head", "node", F.coalesce("component", "node").alias("part"), F.coalesce("of_head", "head").alias("of_head"))
    rows = rows.withColumn("away", (F.col("part") != F.col("of_head")).cast("int"))
    whole = rows.groupBy("band").agg(F.min("head").alias("head"), F.count("*").alias("c"), F.sum("away").alias("r"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).bitwiseAND(F.lit((1 << 31) - 1))).alias("s"))
    # the nodes away have been compared with the head already
    whole = whole.where("r >= 2 or r = 1 and c >= 3").groupBy("head", "c", "r", "x", "s").agg(F.min("band").alias("band"))
    whole = whole.select("band", F.ceil(F.col("r") / BLOCK).cast("int").alias("aways"), F.ceil((F.col("c") - F.col("r")) / BLOCK).cast("int").alias("others"))
    return rows.join(shuffled_anew(whole, "band"), "band").select("band", "node", "part", "away", "aways", "others")


def links_between_parts(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """apart as from _apart, sets (node, shingles) -> (a, b): parts that are linked, as far as that joins parts. Nodes
    that are away are compared with each other and with the others of their bucket, block against block."""
    away, rest = apart.where("away = 1").withColumn("own", _by_hash("aways")), apart.where("away = 0").withColumn("own", _by_hash("others"))
    key = ["band", "kind", "i", "j"]
    same = away.withColumn("k", _upto("aways")).select("band", F.lit(0).alias("kind"), F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("own") > F.col("k")).cast("int").alias("side"), "node", "part")
    mixed = away.withColumn("k", _upto("others")).select("band", F.lit(1), F.col("own"), F.col("k"), F.lit(0), "node", "part")
    mixed = mixed.union(rest.withColumn("k", _upto("aways")).select("band", F.lit(1), F.col("k"), F.col("own"), F.lit(1), "node", "part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, key):
            if t.num_rows > 1:
                sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
                yield _pairs(list(_joined(t.column("part").to_pylist(), sets, t.column("side").to_numpy(), percent)))

    units = same.union(mixed).join(sets, "node").select(*key, "side", "node", "part", "shingles")
    return units.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def judged(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, row_hash, n, component, component_id), one row per row of docs: component tells
    groups apart also where one doc_id stands for several texts, null where a row takes part in none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    signed = keep(signatures(docs, k, bands_for(percent)).withColumn("node", F.monotonically_increasing_id()), "signatures")
    first = F.row_number().over(Window.partitionBy("d1", "d2").orderBy("doc_id", "node"))
    classes = keep(signed.where("d1 is not null and doc_id is not null").withColumn("first", first).where("first = 1").drop("first"), "classes")
    rows = classes.select("node", F.explode("bands").alias("band"))
    heads = shuffled_anew(rows.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("c")).where("c > 1").select("band", "head"), "band")
    buckets = keep(rows.join(heads, "band"), "buckets")
    texts = buckets.select("node").distinct().join(classes.select("node", "doc_id", "row_hash"), "node").join(docs.withColumn("row_hash", row_hash("text")), ["doc_id", "row_hash"])
    sets = keep(_as_sets(texts, k), "sets")
    parts = connected_components(links_with_heads(buckets, sets, percent), "links")
    apart, count = keep(_apart(buckets, parts), "apart", n=F.count("*"))
    if count["n"]:
        more = connected_components(links_between_parts(apart, sets, percent), "links").select(F.col("node").alias("part"), F.col("component").alias("further"))
        loose = more.join(parts.select(F.col("node").alias("part")), "part", "left_anti").select(F.col("part").alias("node"), "part")
        parts = parts.withColumnRenamed("component", "part").union(loose).join(more, "part", "left").select("node", F.coalesce("further", "part").alias("component"))
    named = parts.join(classes.select("node", "doc_id"), "node")
    named = named.join(shuffled_anew(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component"), "component").select("node", "component", "component_id")
    of_class = classes.select("node", "d1", "d2", F.col("doc_id").alias("least")).join(named, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "least").alias("component_id"))
    out = signed.select("doc_id", "row_hash", "n", F.when(F.col("doc_id").isNotNull(), F.col("d1")).alias("d1"), "d2").join(of_class, ["d1", "d2"], "left")
    return out.select("doc_id", "row_hash", "n", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id, kept), one row per row of docs.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; a set holds a
    document's distinct k-word shingles, or its whole sequence if it has fewer words. Two documents
    are linked if 100 * intersection >= percent * union. component_id is the least doc_id reachable.
    Null and empty texts have an empty set and no links. Rows with a null doc_id take part in
    nothing: component_id is null and kept is true. Repeated rows are equal sets, hence one
    component; rows that share a doc_id but not the text are judged each on its own. Columns other
    than doc_id and text are not read.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return judged(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
