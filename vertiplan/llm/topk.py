"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are laid out in descending length, so a bucket is a run of rows of similar length. For a
query with running k-th score t and a bucket of greatest length L, no row can reach t unless its
cosine is at least t / (|q| L), the bucket's local threshold. Over 1 the bucket is skipped; near 1
one coordinate of the unit vectors narrows the candidates; below that rows are cut by their own
length. What is left is verified by exact integer products. The longest rows of all give every
query its first lower bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import keep

#: Queries taken to all rows at once: what the driver holds and each task receives.
QUERY_BLOCK = 4096
BUCKET = 1024
#: Longest rows that give the first bounds.
SEED_ROWS = 2048
#: Least local cosine threshold at which a bucket is cut by coordinates rather than by length.
BY_COORDINATE = 0.8
_EXACT = float(1 << 52)


class _Best:
    """The best k (score, smaller id) of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        self.ids, self.ints, self.k = ids, vectors, k
        self.vectors = vectors.astype(np.float64)
        self.norm = np.sqrt((self.vectors**2).sum(axis=1))
        self.floor = np.full(len(ids), -math.inf) if floor is None else floor.copy()
        self.found: dict[int, list[tuple[int, float, int]]] = {}

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = (scores >= self.floor[q]) & (ids != self.ids[q])
        if ok.any():
            own = self.found.setdefault(q, [])
            own += [(-int(s), math.inf if i == _NO_ID else int(i), int(i)) for s, i in zip(scores[ok].tolist(), ids[ok].tolist(), strict=True)]
            own.sort()
            del own[self.k :]
            if len(own) == self.k:
                self.floor[q] = max(self.floor[q], -own[-1][0])

    def bucket(self, ids: np.ndarray, rows: np.ndarray, norms: np.ndarray) -> None:
        """rows: integer vectors by descending length."""
        longest = norms[0] * (1 + 1e-9) + 1e-9
        reach = self.norm * longest
        live = np.flatnonzero(reach >= self.floor)
        if not len(live):
            return
        if reach[live].max() >= _EXACT:
            for q in live.tolist():
                self.add(q, rows @ self.ints[q], ids)
            return
        points = rows.astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach[live] > 0, self.floor[live] / reach[live], -1)
        narrow = local >= BY_COORDINATE
        for q, t in zip(live[narrow].tolist(), local[narrow].tolist(), strict=True):
            self._by_coordinate(q, t, ids, points, norms)
        wide = live[~narrow]
        if len(wide):
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(self.norm[wide] > 0, self.floor[wide] / self.norm[wide], -math.inf)
            # rows whose own length can reach the bound of any of these queries
            upto = int(np.searchsorted(-norms, -(need.min() * (1 - 1e-9) - 1e-9), "right")) if np.isfinite(need.min()) else len(norms)
            scores = self.vectors[wide] @ points[:upto].T
            best = scores.max(axis=1, initial=-math.inf)
            for i in np.flatnonzero(best >= self.floor[wide]).tolist():
                q = int(wide[i])
                row = scores[i]
                at = np.flatnonzero(row >= self.floor[q])
                if len(at) > 4 * self.k:
                    cut = np.partition(row[at], len(at) - self.k - 1)[len(at) - self.k - 1]
                    at = at[row[at] >= cut]
                self.add(q, row[at], ids[:upto][at])

    def _by_coordinate(self, q: int, t: float, ids: np.ndarray, points: np.ndarray, norms: np.ndarray) -> None:
        unit = self.vectors[q] / self.norm[q]
        f = int(np.abs(unit).argmax())
        spread = math.sqrt(max(0.0, 1 - t * t)) * math.sqrt(max(0.0, 1 - unit[f] ** 2)) + 1e-9
        with np.errstate(divide="ignore", invalid="ignore"):
            own = points[:, f] / norms
        # a unit vector with cosine of at least t to the query has this coordinate near the query's;
        # beyond the query's own value only the cone's edge bounds it
        low = unit[f] * t - spread if unit[f] > 0 else -1.0
        high = 1.0 if unit[f] > 0 else unit[f] * t + spread
        at = np.flatnonzero((own >= low) & (own <= high))
        if len(at):
            self.add(q, points[at] @ self.vectors[q], ids[at])


_NO_ID = -(1 << 63)


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, lengths) of the rows of each dimension."""
    vectors = batch.column("v")
    values, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    ids = batch.column("vec_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
    norms = batch.column("norm").to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield ids[rows], values[offsets[rows][:, None] + np.arange(d)], norms[rows]


def _scan(best: dict[int, _Best], batch: pa.RecordBatch) -> None:
    for ids, rows, norms in _columns(batch):
        if (own := best.get(rows.shape[1])) is None:
            continue
        order = np.argsort(-norms, kind="stable")
        for a in range(0, len(order), BUCKET):
            at = order[a : a + BUCKET]
            own.bucket(ids[at], rows[at], norms[at])


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, v array<long>, norm): floor(256 * component), without vectors
    that are null or hold a null or non-finite component."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(ok).select("vec_id", v.alias("v"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): the k greatest integer inner products of
    every row whose vec_id is divisible by ``every`` with all other rows, ties to the smaller vec_id.

    A row with a query's own vec_id is never its candidate; equal rows under one vec_id count once
    as queries. Vectors of another dimension have no product with a query. Rows with a null vec_id are
    candidates, last among ties. Queries with fewer candidates have fewer rows, those with none have none. Empty vectors have the
    product 0. Products must fit a long.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors)
    # equal lengths are told apart by vec_id, so one very common vector spreads over partitions
    laid = keep(rows.repartitionByRange(F.desc("norm"), F.asc("vec_id")).sortWithinPartitions(F.desc("norm"), F.asc("vec_id")), "vectors")
    asked = keep(laid.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct(), "queries")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    seed = [pa.RecordBatch.from_pylist([{"vec_id": r["vec_id"], "v": r["v"], "norm": r["norm"]}], pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("norm", pa.float64())])) for r in laid.orderBy(F.desc("norm"), "vec_id").limit(SEED_ROWS).collect()]
    seed_rows = pa.Table.from_batches(seed).combine_chunks().to_batches() if seed else []
    parts = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        best: dict[int, _Best] = {}
        for d in {len(r["v"]) for r in own}:
            same = [r for r in own if len(r["v"]) == d]
            best[d] = _Best(np.array([r["vec_id"] for r in same], np.int64), np.array([r["v"] for r in same], np.int64).reshape(len(same), d), k)
        for batch in seed_rows:
            _scan(best, batch)
        shared = spark.sparkContext.broadcast({d: (b.ids, b.ints, b.floor) for d, b in best.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {d: _Best(ids, ints, k, floor) for d, (ids, ints, floor) in shared.value.items()}
            for batch in batches:
                _scan(best, batch)
            out = [(int(b.ids[q]), None if i == _NO_ID else i, -s, d, q) for d, b in best.items() for q, found in b.found.items() for s, _, i in found]
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], pa.int64()) for n in range(5)], ["query_id", "vec_id", "score", "d", "q"])

        parts.append(keep(laid.mapInArrow(run, "query_id long, vec_id long, score long, d long, q long"), "found"))
        shared.unpersist()
    found = parts[0].withColumn("block", F.lit(0))
    for n, part in enumerate(parts[1:], 1):
        found = found.union(part.withColumn("block", F.lit(n)))
    best = Window.partitionBy("query_id", "block", "d", "q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
