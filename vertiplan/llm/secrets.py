"""Secret scan: Aho-Corasick keywords, regular expressions anchored at their hits, checksums.

One automaton over the ASCII-lower-cased text finds every place where a secret can start; only
there are the patterns tried, each anchored at the hit. Tokens that carry a checksum or a structure
(CRC-32 of GitHub and npm tokens, JSON header of a JWT) count only if it holds. Runs of hexadecimal
digits have no keyword and are found by one linear pattern.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "google", "jwt", "npm", "pem", "slack", "stripe")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_EXTRA = {
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "google": re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    "jwt": re.compile(r"(eyJ[0-9A-Za-z_-]{8,})\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[0-9A-Za-z+/=\s]+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    "slack": re.compile(r"xox[abprs]-[0-9]{8,}-[0-9A-Za-z-]{16,}"),
    "stripe": re.compile(r"[rs]k_live_[0-9A-Za-z]{24,}"),
}
#: Where no JWT begins, none begins in the rest of the same run: it would have to end where this one failed to.
_JWT_RUN = re.compile(r"[0-9A-Za-z_-]+")
_KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "google": ("aiza",),
    "jwt": ("eyj",),
    "npm": ("npm_",),
    "pem": ("-----begin",),
    "slack": ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"),
    "stripe": ("rk_live_", "sk_live_"),
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc32(text: str) -> str:
    """CRC-32 of an ASCII text as six base-62 digits."""
    n, out = zlib.crc32(text.encode("ascii")), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return out


def _holds(kind: str, match: re.Match[str]) -> bool:
    if kind in ("github", "npm"):
        return base62_crc32(match[1]) == match[2]
    if kind == "jwt":
        try:
            header = json.loads(base64.urlsafe_b64decode(match[1] + "=" * (-len(match[1]) % 4)))
        except (ValueError, RecursionError, binascii.Error):  # not JSON, or nested beyond any header
            return False
        return isinstance(header, dict) and "alg" in header
    return True


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in _KEYWORDS.items():
        for word in words:
            a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def scan(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points by start, then kind as listed; per kind leftmost and
    non-overlapping. The base kinds are exactly their patterns' matches of the required length. Every kind takes
    time in proportion to the text."""
    spans: list[tuple[int, int, str]] = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    hits = [(end - size + 1, kind) for end, (kind, size) in _automaton().iter(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))]
    if hits:
        hits.sort()
        past: dict[str, int] = {}
        for at, kind in hits:
            if at < past.get(kind, 0):
                continue
            if m := (_ASSIGN if kind == "assign" else _ACCESS if kind == "access" else _EXTRA[kind]).match(text, at):
                past[kind] = m.end()
                if (len(m[2]) >= 8 if kind == "assign" else m.end() - at >= 16 if kind == "access" else _holds(kind, m)):
                    spans.append((at, m.end(), kind))
            elif kind == "jwt":
                past[kind] = _JWT_RUN.match(text, at).end()
    spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return spans


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each maximal run of overlapping spans replaced by ``[kind]`` of its first span."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secret_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row per row.

    Whole texts are scanned. A null text is an empty one: no spans, the digest of the empty string.
    doc_id may be null or repeat. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[list[int], ...] = ([], [], [])
            digests, spans = [], []
            for text in batch.column("text").to_pylist():
                found = scan(text or "")
                base = [x for x in found if x[2] in BASE_KINDS]
                for kind, n in zip(BASE_KINDS, counts, strict=True):
                    n.append(sum(x[2] == kind for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret in ``text`` replaced by its kind in brackets; all columns and rows stay.
    Null and empty texts stay as they are; repeated rows are each redacted."""

    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            clean = [t and (redacted(t, s) if (s := scan(t)) else t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)
