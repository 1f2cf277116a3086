"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a run of ``SEED`` words are candidates. Running Karp-Rabin
hashes tell whether the two still share a run of any given length among their unmarked words; a search over the
length finds the longest, all runs of that length are marked as tiles, and the search goes on below it until no run
of ``SEED`` unmarked words is left. The share of an item's words under tiles does not depend on the
order of the tiles, so reordered passages are caught. Memory is a few arrays as long as the two texts,
however often their words repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches
from ._words import powers, words
from .toxicity import _WORD

SEED = 5
COVERAGE = 0.5
#: Bytes of benchmark text up to which every task receives the items; above, seeds meet in a join.
BROADCAST_BYTES = 32_000_000

_OUT = "doc_id long, item_id long, coverage double, n_tiles int, n_words long"


class _Side:
    """Words of one text, which of them are unmarked, and running hashes of their windows."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        up, self.down = powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=self.total[1:])
        self.marked = np.zeros(n, bool)
        self.free()

    def free(self) -> None:
        """Unmarked words in a row from each word on."""
        n = len(self.marked)
        after = np.minimum.accumulate(np.where(self.marked, np.arange(n), n)[::-1])[::-1]
        self.run = after - np.arange(n)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of unmarked windows, and their hashes: each from the one of the words before it."""
        at = np.flatnonzero(self.run >= size)
        return at, (self.total[at + size] - self.total[at]) * self.down[at]


def tiles(left: np.ndarray, right: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of word hashes: (left, right, length), longest first, ties to
    the leftmost in ``left``, then in ``right``."""
    p, t = _Side(left), _Side(right)
    out: list[tuple[int, int, int]] = []

    def shared(size: int) -> bool:
        return bool(np.isin(p.windows(size)[1], t.windows(size)[1]).any())

    most = min(int(p.run.max(initial=0)), int(t.run.max(initial=0)))
    while most >= least and shared(least):
        low = least
        while low < most:
            middle = (low + most + 1) // 2
            low, most = (middle, most) if shared(middle) else (low, middle - 1)
        (at, own), (places, others) = p.windows(low), t.windows(low)
        order = np.argsort(others, kind="stable")
        others, places = others[order], places[order].tolist()
        first, past = np.searchsorted(others, own, "left").tolist(), np.searchsorted(others, own, "right").tolist()
        next_free: dict[int, int] = {}
        for i, x, y in zip(at.tolist(), first, past, strict=True):
            if x == y or p.marked[i] or p.marked[i + low - 1]:
                continue
            k = next_free.get(x, x)
            # a window of the length that is marked next is free if its ends are
            while k < y and (t.marked[places[k]] or t.marked[places[k] + low - 1]):
                k += 1
            next_free[x] = k
            if k < y:
                j = places[k]
                out.append((i, j, low))
                p.marked[i : i + low] = t.marked[j : j + low] = True
        p.free()
        t.free()
        most = min(low - 1, int(p.run.max(initial=0)), int(t.run.max(initial=0)))
    return out


class _Items:
    """Benchmark items by id, and an index from seeds to items."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        self.ids, self.words, self.runs = np.array(ids, np.int64), [], []
        for row, to, w in words(pa.array(texts, pa.large_string()), word_bytes=_WORD):
            h, _ = w.shingles(SEED)
            for d in range(to - row):
                a, b = w.first[d], w.first[d + 1]
                self.words.append(w.hash[a:b])
                self.runs.append(h[a : max(a, b - SEED + 1)])
        seeds = np.concatenate([*self.runs, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in self.runs])
        order = np.lexsort((owner, seeds))
        self.seeds, self.owner = seeds[order], owner[order]


def _tiled(items: _Items, column: pa.Array, ids: list[int | None], threshold: float) -> Iterator[tuple]:
    for row, to, w in words(column, word_bytes=_WORD):
        if not len(items.seeds) or not len(w.hash):
            continue
        h, ok = w.shingles(SEED)
        low = np.searchsorted(items.seeds, h, "left")
        hit = np.flatnonzero(ok & (low < len(items.seeds)) & (items.seeds[np.minimum(low, len(items.seeds) - 1)] == h))
        doc = np.searchsorted(w.first, hit, "right") - 1
        for d in np.unique(doc).tolist():
            a, b = w.first[d], w.first[d + 1]
            if b - a < SEED:
                continue
            own = hit[doc == d]
            past = np.searchsorted(items.seeds, h[own], "right")
            for item in np.unique(np.concatenate([items.owner[x:y] for x, y in zip(low[own], past)])).tolist():
                found = tiles(items.words[item], w.hash[a:b], SEED)
                n = sum(x[2] for x in found)
                if n >= threshold * len(items.words[item]):
                    yield ids[row + d], int(items.ids[item]), n / len(items.words[item]), len(found), n


def _batch(found: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], t) for n, t in enumerate(types)], ["doc_id", "item_id", "coverage", "n_tiles", "n_words"])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> (doc_id, item_id, coverage, n_tiles, n_words): every
    pair whose tiles cover at least ``threshold`` of the item's words.

    Words are runs of ASCII letters and digits and of other non-ASCII characters, A-Z lower-cased. Null or
    empty texts and items of fewer than SEED words match nothing; an item with a null id is left
    out, a document with a null id is reported under it. Repeated rows repeat their pairs. Other
    columns are not read. A benchmark of up to ``broadcast_bytes`` goes to every task; a larger one is joined on
    seeds, and each candidate pair then tiled on its own.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = bench.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size <= broadcast_bytes:
        rows = bench.orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _Items(*shared.value)
            for batch in batches:
                yield _batch(list(_tiled(items, batch.column("text"), batch.column("doc_id").to_pylist(), threshold)))

        return docs.mapInArrow(run, _OUT)
    docs, bench = docs.withColumn("row", F.xxhash64("doc_id", "text")), bench.withColumn("key", F.xxhash64("item_id", "text"))
    left = _seeds(docs.select("row", "text"), "row").distinct()
    right = _seeds(bench.select("key", "text"), "key").distinct()
    pairs = left.join(right, "seed").select("row", "key").distinct()
    both = pairs.join(bench.withColumnRenamed("text", "item"), "key").join(docs, "row")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for i in range(batch.num_rows):
                items = _Items([batch.column("item_id")[i].as_py()], [batch.column("item")[i].as_py()])
                found += _tiled(items, batch.column("text").slice(i, 1), [batch.column("doc_id")[i].as_py()], threshold)
            yield _batch(found)

    return both.select("doc_id", "text", "item_id", "item").mapInArrow(tile, _OUT)


def _seeds(texts: DataFrame, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(key).to_numpy()
            for row, to, w in words(batch.column("text"), word_bytes=_WORD):
                h, _ = w.shingles(SEED)
                owner = np.repeat(np.arange(row, to), np.diff(w.first))
                full = np.flatnonzero(np.repeat(w.first[1:], np.diff(w.first)) - np.arange(len(h)) >= SEED)
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner[full]]), pa.array(h[full].view(np.int64))], [key, "seed"])

    return texts.mapInArrow(run, f"{key} long, seed long")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """docs without those that hold a benchmark item; documents with a null id stay, null and empty texts too. Where a
    doc_id repeats, all its rows go if one holds an item."""
    bad = contaminated(docs, benchmark, threshold).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
