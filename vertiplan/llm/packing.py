"""Best-fit packing of token sequences, planned on the histogram of lengths.

The plan needs only how many pieces have each length: at most ``size`` numbers, however many
documents there are. Best fit decreasing runs over groups of equal bins instead of single ones;
every length's pieces then take the slots planned for it by their rank within the length.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import keep, small_batches

SIZE = 4096
#: Pieces that a part of a length holds at most on average, and least parts, by which ranks are dealt.
PART_PIECES, PARTS = 100_000, 64
#: Entries of a worker's cache from white-space-separated chunks of text to their tokens.
CACHE = 300_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts: slots (length, first, past, sequence, offset, each).

    Pieces of a length with ranks first <= r < past go to sequence ``sequence + (r - first) // each``
    at ``offset + (r - first) % each * length``. Bins are kept as runs of consecutive sequences with
    equal free room; a run splits only where a length runs out, so the plan stays a few rows per length.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def put(room: int, run: tuple[int, int]) -> None:
        if room and run[1]:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append(run)

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
            else:
                room, first, n = size, opened, -(-left // (size // length))
                opened += n
            each = room // length
            full, rest = min(n, left // each), 0
            if full:
                slots.append((length, rank, rank + full * each, first, size - room, each))
                put(room - each * length, (first, full))
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                rest = left
                slots.append((length, rank, rank + rest, first + full, size - room, each))
                put(room - rest * length, (first + full, 1))
                rank, left = rank + rest, 0
            used = full + bool(rest)
            put(room, (first + used, n - used))
    return slots


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = 1) -> DataFrame:
    """docs (doc_id, text) -> pieces of at most ``size`` tokens, with the CRC-32 of their ids.

    ``tokenizer`` is the path of a vocabulary file for the tokenizers library on every machine.
    ``end`` closes each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (encoder := _encoders.get(tokenizer)) is None:
            encoder = _encoders[tokenizer] = _Encoder(tokenizer)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            doc_id, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = memoryview(encoder.ids(text.as_py() or "") + last)
                for k, a in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[a : a + 4 * size]
                    doc_id.append(doc)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself where it is
    printable in Latin-1, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The vocabulary's own splitting rule, written out for Latin-1 text.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \\t\\n\x0b\x0c\\r\x85\xa0{_LETTERS}{_NUMBERS}]+")


class _Encoder:
    """Token ids of texts as little-endian bytes, equal to those of the vocabulary file.

    Under the splitting that is written out here no token spans a space, and normalisation does not reach across one, so
    texts are split there and each distinct chunk is encoded once as long as the cache holds it; under any other
    a text goes through the tokenizer as a whole. Latin-1 text is stable under
    NFC and lower-cases by character, so its chunks are split into words here and only the words go
    through the vocabulary's merges; any other text, and any that could hold a special token, goes
    through the whole tokenizer chunk by chunk.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = self._is_known(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        letters = _byte_letters()
        self.table = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}

    @staticmethod
    def _is_known(spec: dict) -> bool:
        """Whether the file's normaliser and splitting are those that the short way writes out."""
        normal = [(n["type"], n.get("pattern", {}).get("Regex"), n.get("content")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return normal == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)] and split.get("pattern", {}).get("Regex") == pattern and all(t["content"].startswith("<|") for t in spec["added_tokens"])

    def _word(self, word: str) -> bytes:
        if (out := self.words.get(word)) is None:
            out = self.words[word] = array("I", [t.id for t in self.model.tokenize(word.translate(self.table))]).tobytes()
        return out

    def ids(self, text: str) -> bytes:
        if self.plain:
            text = text.replace("\n", " ")
        short = self.plain and "<|" not in text
        if short:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                short = False
        if short:
            parts, cache = text.lower().split(" "), self.chunks
            try:
                return b"".join([cache[p] for p in parts])
            except KeyError:
                pass
            new = {p for p in parts if p not in cache}
            if len(cache) + len(new) > CACHE or len(self.words) + len(new) > CACHE:
                cache.clear()
                self.words.clear()
                new = set(parts)
            word = self._word
            for p in new:
                cache[p] = b"".join([word(w) for w in _SPLIT.findall(p)])
        elif not self.plain:  # its tokens may span spaces
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        else:
            parts, cache = text.split(" "), self.others
            new = [p for p in set(parts) if p not in cache]
            if len(cache) + len(new) > CACHE // 4:
                cache.clear()
                new = list(set(parts))
            for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                cache[p] = array("I", e.ids).tobytes()
        return b"".join([cache[p] for p in parts])


_encoders: dict[str, _Encoder] = {}


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = 1) -> DataFrame:
    """docs (doc_id, text) -> one row per piece: PIECES, sequence_id, offset.

    Only documents longer than ``size`` tokens are cut, into pieces of ``size`` and a last one. A
    null or empty text is the end token alone. Pieces of equal length are interchangeable; their
    ranks follow (doc_id, piece, crc), nulls first, within a part chosen by hash, so repeated rows
    and a third of all rows in one length are dealt over as many parts as their number asks for. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    pieces = keep(token_pieces(docs, tokenizer, size, end), "pieces")
    parts = max(PARTS, -(-pieces.count() // PART_PIECES))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        [tuple(map(int, x)) for x in plan(histogram, size)],
        T.StructType([T.StructField(c, T.LongType()) for c in ("length", "first", "past", "sequence", "at", "each")]),
    )
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("own", own).join(offsets, ["length", "part"]).withColumn("rank", F.col("own") + F.col("before"))
    # the plan has at most a few rows for each of ``size`` lengths
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past"))).drop(slots["length"])
    step = F.col("rank") - F.col("first")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + step % F.col("each") * F.col("length")).cast("long").alias("offset"))
