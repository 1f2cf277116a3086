"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their prefixes, hashed into ``BUCKETS``. The terms that tell the
classes apart best on the training sample become the machine's inputs; it learns a weight and a
small vector for each, so the score of a pair (an insult beside a group's name) is not the sum of
its parts. The model is a few arrays of fixed size, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import keep, small_batches
from ._words import mix, powers, words

BUCKETS = 1 << 22
PREFIXES = (4, 5, 6, 7, 8)
#: Most labelled rows of each class that the model is fitted on, those with the least hash of doc_id.
SAMPLE = 4000
TERMS = 3000
#: Least log-likelihood ratio of a term and the toxic class.
LEAST_GAIN = 5.0
FACTORS = 4
STEPS = 600

_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD[_c] = True


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past, text of each term from the first row on, bucket of each term)"""
    for row, to, w in words(column, word_bytes=_WORD):
        owner = np.repeat(np.arange(to - row), np.diff(w.first))
        found, owners = [w.hash], [owner]
        up, down = powers(len(w.data) + 1)
        total = np.zeros(len(w.data) + 1, np.uint64)
        np.cumsum((w.data.astype(np.uint64) + np.uint64(1)) * up[: len(w.data)], out=total[1:])
        for n in PREFIXES:
            at = np.flatnonzero(w.end - w.start >= n)
            start = w.start[at]
            found.append(mix((total[start + n] - total[start]) * down[start] + np.uint64(n * 0x10001)))
            owners.append(owner[at])
        yield row, to, np.concatenate(owners), (np.concatenate(found) >> np.uint64(42)).astype(np.int64)


@dataclass
class Machine:
    terms: np.ndarray  # sorted buckets of the inputs
    bias: float
    weight: np.ndarray
    factor: np.ndarray  # inputs x FACTORS

    def raw(self, owner: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Log odds of each of ``rows`` rows with distinct (owner, input) pairs."""
        out = self.bias + np.bincount(owner, self.weight[term], rows)
        for f in range(self.factor.shape[1]):
            v = self.factor[term, f]
            out += 0.5 * (np.bincount(owner, v, rows) ** 2 - np.bincount(owner, v * v, rows))
        return out


def fit(owner: np.ndarray, bucket: np.ndarray, label: np.ndarray, prior: float, inputs: np.ndarray) -> Machine:
    """owner, bucket: distinct pairs of a training row and a bucket; label: 0/1 of each row;
    prior: share of label 1 among all labelled rows, for rows sampled by class; inputs: sorted buckets to
    learn from, all others are left out."""
    rows, ones = len(label), int(label.sum())
    if ones == 0 or ones == rows:
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return Machine(np.zeros(0, np.int64), float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, FACTORS)))
    at = np.minimum(np.searchsorted(inputs, bucket), max(0, len(inputs) - 1))
    use = inputs[at] == bucket if len(inputs) else np.zeros(len(bucket), bool)
    owner, at = owner[use], at[use]
    n = len(inputs)
    m = Machine(inputs, 0.0, np.zeros(n), np.random.Generator(np.random.PCG64(11)).normal(0, 0.02, (n, FACTORS)))
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    # sums over each row's pairs, and over each input's: both are runs after a sort
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    own, of = owner[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
    by_input = np.argsort(at, kind="stable")
    begins = np.flatnonzero(np.diff(at[by_input], prepend=-1))
    inputs_seen = at[by_input][begins]

    def of_inputs(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(begins):
            out[inputs_seen] = np.add.reduceat(x[by_input], begins)
        return out

    def of_rows(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, first) if len(first) else x

    balance = np.where(label == 1, 0.5 / ones, 0.5 / (rows - ones))
    theta = np.concatenate([[0.0], m.weight, m.factor.ravel()])
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        bias, weight, factor = theta[0], theta[1 : n + 1], theta[n + 1 :].reshape(n, FACTORS)
        raw = np.full(rows, bias)
        raw[own] += of_rows(weight[at])
        pairs = step > STEPS // 2  # single terms first: pairs then learn only what those leave over
        v = [factor[at, f] for f in range(FACTORS)] if pairs else []
        sums = [of_rows(x) for x in v]
        for x, s in zip(v, sums, strict=True):
            raw[own] += 0.5 * (s * s - of_rows(x * x))
        error = balance * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label)
        pull = error[own][of]
        grad_v = np.zeros_like(factor)
        for f, (x, s) in enumerate(zip(v, sums, strict=True)):
            grad_v[:, f] = of_inputs(pull * (s[of] - x)) + 2e-5 * factor[:, f]
        grad = np.concatenate([[error.sum()], of_inputs(pull) + 2e-6 * weight, grad_v.ravel()])
        one, two = 0.9 * one + 0.1 * grad, 0.999 * two + 0.001 * grad * grad
        theta = theta - 0.05 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
        np.maximum(theta[1 : n + 1], 0, out=theta[1 : n + 1])  # the inputs were chosen as evidence for the class
    p = min(max(prior, 1e-3), 1 - 1e-3)
    return Machine(m.terms, float(theta[0] + np.log(p / (1 - p))), theta[1 : n + 1].copy(), theta[n + 1 :].reshape(n, FACTORS).copy())


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _gain(rows: int, ones: int) -> Column:
    """Log-likelihood ratio of the 2 x 2 table of a term (in ``seen`` rows, ``hit`` of them of class 1) and the class; 0
    for terms that do not speak for the class: what is merely usual in clean texts must not outweigh an insult."""
    seen, hit, q = F.col("seen").cast("double"), F.col("hit").cast("double"), ones / rows

    def part(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

    total = part(hit, seen * q) + part(seen - hit, seen * (1 - q)) + part(ones - hit, (rows - seen) * q) + part(rows - ones - seen + hit, (rows - seen) * (1 - q))
    return F.when(hit * rows > seen * ones, total).otherwise(0.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled documents of each class, those with the least hash of doc_id, among those that
    are not held out. labels (doc_id, toxic); rows with another label than 0 or 1, or with a null id, don't count.
    Where a doc_id repeats in docs, the text with the least hash is the one learned from. What comes to the driver
    are the inputs, at most TERMS, and for each document of the sample which of them it has."""
    small_batches(docs.sparkSession)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    rows = rows.where(~held_out()).distinct()
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = rows.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).union(rows.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most 2 * sample ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    texts = keep(texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "sample")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("toxic").to_numpy()
            for row, to, owner, bucket in _terms(batch.column("text")):
                both = np.unique(owner << 22 | bucket)
                kinds, code = np.unique(both & (BUCKETS - 1), return_inverse=True)
                hit = np.bincount(code, label[row:to][both >> 22], len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kinds, np.bincount(code, minlength=len(kinds)), hit)], ["bucket", "seen", "hit"])

    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    size, ones = sum(sizes.values()), sizes.get(1, 0)
    inputs = np.zeros(0, np.int64)
    if 0 < ones < size:
        tallied = texts.mapInArrow(tally, "bucket long, seen long, hit long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("hit").alias("hit"))
        best = tallied.where("hit > 0").withColumn("gain", _gain(size, ones)).where(F.col("gain") > LEAST_GAIN).orderBy(F.desc("gain"), "bucket").limit(TERMS)
        inputs = np.array(sorted(r["bucket"] for r in best.select("bucket").collect()), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int16)
        place[inputs] = np.arange(len(inputs))
        for batch in batches:
            found = []
            for row, to, owner, bucket in _terms(batch.column("text")):
                at = place[bucket]
                both = np.unique(owner[at >= 0] << 16 | at[at >= 0])
                cut = np.searchsorted(both >> 16, np.arange(to - row + 1))
                found += [(both[a:b] & 0xFFFF).astype("<u2").tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "terms"])

    bags = texts.mapInArrow(run, "doc_id long, toxic int, terms binary").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    label = np.array(bags.column("toxic").to_pylist(), np.int64)
    terms = [np.frombuffer(x, "<u2") for x in bags.column("terms").to_pylist()]
    owner = np.repeat(np.arange(len(terms), dtype=np.int32), [len(x) for x in terms])
    return fit(owner, inputs[np.concatenate([*terms, np.zeros(0, np.uint16)])], label, counts.get(1, 0) / max(1, sum(counts.values())), inputs)


def score(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """docs with a column ``name`` (0 to 1), which it must not have yet, after its own; only ``text`` is looked at."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs have a column {name} already")
    small_batches(docs.sparkSession)
    schema = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = np.full(BUCKETS, -1, np.int16)
        place[m.terms] = np.arange(len(m.terms))
        for batch in batches:
            out = np.full(batch.num_rows, m.bias)
            for row, to, owner, bucket in _terms(batch.column("text").cast(pa.string())):
                at = place[bucket]
                both = np.unique(owner[at >= 0] << 16 | at[at >= 0])
                out[row:to] = m.raw(both >> 16, both & 0xFFFF, to - row)
            p = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> (doc_id, held_out, score, predicted), one row per row.

    Null and empty texts have the score of a text without known terms. A null doc_id is not held
    out. Without labels of both classes every score is the share of toxic labels, within 0.001 and
    0.999. Columns other than text never enter a score.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
