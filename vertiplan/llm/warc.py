"""Deterministic sharded WARC writer and its reader.

Records are sorted by page_id over shards whose borders follow from the ids and bytes
alone, so a rerun writes the same files byte for byte. A task rolls its shard's files by compressed
size, writes each under a temporary name of its attempt, and renames it when it is whole, unless another
attempt has done so. The files that count are those in the manifest, which is written last.
"""

from __future__ import annotations

import hashlib
import math
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import keep, new_path, small_batches

DATE = "2024-01-01T00:00:00Z"
LEAST_REVISIT = 100
#: Payload bytes of a shard, and compressed bytes at which a file is closed.
SHARD_BYTES = 32_000_000
FILE_BYTES = 8_000_000
#: Ranges of ids at most, and rows a range that their borders are taken from.
_RANGES, _SAMPLE = 4096, 16
_MANIFEST = "file string, shard int, part int, records long, bytes long, sha256 string"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str) -> str:
    """The url without what would break a header line."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)


def record_id(page_id: int | None, digest: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}"))


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    headers = [("WARC-Target-URI", _uri(url))] if url else []
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is None:
        return _record("response", record_id(page_id, digest), headers, http + payload)
    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:uuid:{record_id(refers_to, digest)}>"), ("X-Refers-To-Page", str(refers_to))]
    return _record("revisit", str(uuid.uuid5(uuid.NAMESPACE_URL, f"revisit:{page_id}:{digest}")), headers, http)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _Roller:
    """Files of one shard, each whole under its final name or absent."""

    def __init__(self, folder: str, shard: int, attempt: int) -> None:
        self.fs, self.root = _filesystem(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.shard, self.attempt, self.part, self.out = shard, attempt, 0, None

    def write(self, data: bytes) -> dict | None:
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temporary = posixpath.join(self.root, f".{self.name}.{self.attempt}")
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            block = f"software: vertiplan\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {self.shard}\r\n".encode()
            self._put(_member(_record("warcinfo", str(uuid.uuid5(uuid.NAMESPACE_URL, self.name)), [("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], block)))
        self._put(_member(data))
        self.records += 1
        return self.close() if self.size >= FILE_BYTES else None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        final = posixpath.join(self.root, self.name)
        from pyarrow import fs

        def is_there() -> bool:
            return self.fs.get_file_info(final).type != fs.FileType.NotFound

        # a file's bytes depend on its records alone: what another attempt has put there whole is the same file
        if not is_there():
            try:
                self.fs.move(self.temporary, final)
            except OSError:
                if not is_there():
                    raise
        if self.fs.get_file_info(self.temporary).type != fs.FileType.NotFound:
            self.fs.delete_file(self.temporary)
        self.part += 1
        return {"file": self.name, "shard": self.shard, "part": self.part - 1, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()}


def _upto(borders: list[int], column: str) -> str:
    """SQL: how many of the sorted borders are at most the column; two steps over their square root each."""
    if not borders:
        return "0"
    n = max(1, math.isqrt(len(borders)))
    rows = [borders[i : i + n] for i in range(0, len(borders), n)]

    def count(values: str) -> str:
        return f"size(filter({values}, b -> b <= {column}))"

    fine = f"array({', '.join('array(' + ', '.join(f'{b}L' for b in row) + ')' for row in rows)})"
    coarse = f"array({', '.join(f'{row[0]}L' for row in rows)})"
    return f"coalesce(case when {count(coarse)} = 0 then 0 else ({count(coarse)} - 1) * {n} + {count(f'element_at({fine}, {count(coarse)})')} end, 0)"


def _shards(sizes: DataFrame, shard_bytes: int):
    """Column expression for the shard of a row by its page_id and digest, and the number of shards.

    Ranges of ids hold about as many rows each: their borders come from the rows with the least hashes, _SAMPLE a
    range. A range with more bytes than a shard, as where one id repeats or there are more shards than ranges, is dealt to several by digest. Null ids come first."""
    total = sizes.agg(F.sum("payload_bytes")).first()[0] or 0
    ranges = min(_RANGES, -(-total // shard_bytes))
    order = F.xxhash64("page_id", "digest")
    ids = sorted(r["page_id"] for r in sizes.where("page_id is not null").orderBy(order, "page_id").limit(_SAMPLE * ranges).select("page_id").collect()) if ranges > 1 else []
    borders = sorted({ids[len(ids) * i // ranges] for i in range(1, ranges)} - {ids[0]}) if ids else []
    cell = F.expr(_upto(borders, "page_id"))
    held = {r["cell"]: r["b"] for r in sizes.groupBy(cell.alias("cell")).agg(F.sum("payload_bytes").alias("b")).collect()}
    parts = [max(1, -(-(held.get(c) or 0) // (2 * shard_bytes))) for c in range(len(borders) + 1)]
    first = [sum(parts[:c]) for c in range(len(parts))]
    start, many = (F.element_at(F.array(*map(F.lit, x)), cell + 1) for x in (first, parts))
    return (start + F.pmod(F.xxhash64("digest"), many)).cast("int"), sum(parts)


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) under ``folder``, a URI that executors and driver share, and
    return the committed manifest (file, shard, part, records, bytes, sha256).

    One record per row; the payload is the html in UTF-8, empty for a null. Of rows with equal
    payloads of at least LEAST_REVISIT bytes, one with the smallest page_id is a response and the rest
    are revisits of it, its own repetitions included. Rows with a null page_id are responses. A null
    url leaves out the target header. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha2("html", 256).alias("digest"))
    sizes = keep(rows.select("page_id", "payload_bytes", "digest"), "sizes")
    firsts = sizes.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("c")).where("c > 1 and first_id is not null").select("digest", "first_id")
    shard, count = _shards(sizes, shard_bytes)
    # who revisits whom travels as rows of its own, sorted before the page's: only one shuffle moves payloads
    notes = sizes.join(firsts, "digest").where("page_id is not null").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first_id").distinct()
    rows = notes.union(rows.select("page_id", "url", "html", "digest", F.lit(None).cast("long")))
    rows = rows.withColumn("shard", shard)
    dealt = rows.repartitionById(count, "shard").sortWithinPartitions("shard", "page_id", "digest", F.col("html").isNotNull(), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, last, noted = None, None, (None, None)
        names = ["file", "shard", "part", "records", "bytes", "sha256"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

        def told(x: dict | None) -> Iterator[pa.RecordBatch]:
            if x:
                yield pa.RecordBatch.from_arrays([pa.array([x[n]], t) for n, t in zip(names, types, strict=True)], names)

        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "page_id", "url", "html", "digest", "first_id")]
            for i in range(batch.num_rows):
                shard, page_id, url, text, digest, first = (c[i].as_py() for c in columns)
                if text is None:
                    noted = ((page_id, digest), first)
                    continue
                if roller is None or roller.shard != shard:
                    if roller:
                        yield from told(roller.close())
                    roller = _Roller(folder, shard, TaskContext.get().taskAttemptId())
                first = noted[1] if noted[0] == (page_id, digest) else None
                revisits = first is not None and (page_id != first or last == (page_id, digest))
                last = (page_id, digest)
                yield from told(roller.write(page_record(page_id, url, text.encode("utf-8"), digest, first if revisits else None)))
        if roller:
            yield from told(roller.close())

    manifest = keep(dealt.select("shard", "page_id", "url", "html", "digest", "first_id").mapInArrow(run, _MANIFEST), "manifest")
    _sweep(folder)
    return manifest


def _sweep(folder: str) -> None:
    """Delete what failed attempts have left, now that the manifest is written."""
    from pyarrow import fs as pafs

    fs, root = _filesystem(folder)
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.base_name.startswith(".") and f.type == pafs.FileType.File:
            fs.delete_file(f.path)


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data if z.eof else b""
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the file ends within a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers with lower-case names, and the block; raises ValueError where length or digest is wrong."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block, end = rest[: int(headers["content-length"])], rest[int(headers["content-length"]) :]
    if lines[0] != "WARC/1.1" or end != b"\r\n\r\n" or headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"broken record {headers.get('warc-record-id')}")
    return headers, block


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, file) of every page record in
    the manifest's files. Block digests, payload digests and the files' own digests are checked."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                out: list[tuple] = []
                with fs.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    for record in members(stream):
                        h, block = parse(record)
                        if h["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = h["warc-payload-digest"].removeprefix("sha256:")
                        if h["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"broken payload of {h['warc-record-id']}")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        page, refers = h.get("x-page-id"), h.get("x-refers-to-page")
                        out.append((page and int(page), size, digest, h["warc-type"], refers and int(refers), h.get("warc-target-uri"), name))
                        if len(out) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    files = manifest.select("file")
    return files.repartition(max(1, manifest.count())).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string")


def archived(pages: DataFrame) -> DataFrame:
    """Write pages to a new folder beside the checkpoints and read the archives back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder), folder)
