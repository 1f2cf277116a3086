"""Allow or block urls by rules, else by naive Bayes over segmented names.

Words joined in a host name (``cheappills``) are split by a unigram Viterbi search whose counts come
from all urls: words that stand alone between hyphens or in paths. Multinomial naive Bayes over the
words of host and path then gives the verdict. Its training classes are weak labels: a host that
holds one of the ``UNWANTED`` words, against all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import keep

# Seeds of the unwanted class, and common words of host names.
UNWANTED = frozenset("adult ads adserver adware bet bets betting bingo casino cialis click clickbait dating doubleclick drugs escort farm-link gambling hack jackpot keygen lottery malware nude phishing pharmacy pill pills poker porn popunder roulette scam sex slots spam spyware torrent track tracker viagra warez xxx".split())
COMMON = tuple("about academy api app archive art auto bank best big blog board book books box business buy cdn center central city cloud club code com community data day design dev digital direct doc docs edu en energy express family farm fast film finance fit food forum free fun game games garden global go gold good green group guide health help home hotel house info insurance jobs kids lab law learn legal life line link list live local love mail map market media mobile money music my net network news now office old one online open org page park people pet photo pizza place play plus post power pro project property radio real school science search secure service shop shopping site smart social sport sports star store stream studio support tax team tech the time top town travel tube tv university video wiki win world www zone cheap".split())
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LONGEST = 20
BUCKETS = 1 << 18
_COMMON_COUNT = 50
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^(?:.*?)://([^/?#]*)([^?#]*)"


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _path_words(path: str) -> Column:
    """Runs of letters of any script in a path, lower-cased."""
    return F.regexp_extract_all(F.lower(path), F.lit(r"([\p{L}\p{M}]+)"))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict); null if none fits. For rule lists that are
    parameters of a query, not tables: one comparison each."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segment(label: str, counts: dict[tuple[int, int], int], total: int) -> list[str]:
    """The most probable split of a label into words; counts: of the known words at (start, end).
    Of an unknown word each further character costs a factor of ten."""
    n = len(label)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        # an unknown word longer than LONGEST continues the one before it
        for start in range(max(0, end - LONGEST), end):
            c = counts.get((start, end))
            p = math.log(c / total) if c else math.log(10 / total) - (end - start) * math.log(10)
            if best[start] + p > best[end]:
                best[end], back[end] = best[start] + p, start
    out = []
    while n:
        out.append(label[back[n] : n])
        n = back[n]
    return out[::-1]


def _segmented(pieces: DataFrame, unigrams: DataFrame, total: int) -> DataFrame:
    """(piece) -> (piece, words): every substring of a piece meets the unigram table in a join."""
    ends = F.expr(f"flatten(transform(sequence(0, length(piece) - 1), i -> transform(sequence(i + 1, least(i + {LONGEST}, length(piece))), j -> named_struct('start', i, 'end', j, 'word', substring(piece, i + 1, j - i)))))")
    parts = pieces.select("piece", F.explode(ends).alias("x")).select("piece", "x.*")
    known = parts.join(unigrams, "word").groupBy("piece").agg(F.collect_list(F.struct("start", "end", "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [segment(p, {(k["start"], k["end"]): k["n"] for k in known or ()}, total) for p, known in zip(batch.column("piece").to_pylist(), batch.column("known").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(words, pa.list_(pa.string()))], ["piece", "words"])

    return pieces.join(known, "piece", "left").mapInArrow(run, "piece string, words array<string>")


def url_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (page_id, url) -> (page_id, host, path, rule, verdict, words, log_odds), one row per row.

    A null url, or one without ``://``, has an empty host and path, no words and the prior's verdict
    by the method. Among rules of equal length the greatest wins. log_odds is naive Bayes' for
    block; ties are allowed. Without any host of one of the classes nothing is blocked by the method.
    Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    counted = keep(rows.groupBy("host", _path_words("path").alias("path_words")).agg(F.count("*").alias("n")), "urls")
    # words that stand alone: in paths, and in host labels that hyphens divide
    labels = F.filter(F.split("host", r"\."), lambda x: x.contains("-"))
    alone = F.concat("path_words", F.flatten(F.transform(labels, lambda x: F.regexp_extract_all(x, F.lit("([a-z]+)")))))
    unigrams = counted.select(F.explode(alone).alias("word"), "n").where(F.length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n"))
    common = counted.sparkSession.createDataFrame([(w, _COMMON_COUNT) for w in sorted(UNWANTED | set(COMMON))], "word string, n long")
    unigrams = keep(unigrams.union(common).groupBy("word").agg(F.sum("n").alias("n")), "unigrams")
    total = unigrams.agg(F.sum("n")).first()[0]
    hosts = counted.select("host").distinct()
    pieces = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit("([a-z]+)"))).alias("at", "piece"))
    split = _segmented(pieces.select("piece").distinct(), unigrams, total)
    host_words = pieces.join(split, "piece").groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("host_words"))
    seeds = F.array(*[F.lit(w) for w in sorted(UNWANTED)])
    labelled = keep(hosts.join(host_words, "host", "left").select("host", F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words")).withColumn("unwanted", F.arrays_overlap("host_words", seeds).cast("int")), "hosts")
    words = counted.join(labelled, "host").withColumn("words", F.concat("host_words", "path_words"))
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")
    # each host counts once for its own words: its number of pages says nothing about them
    tokens = labelled.select("unwanted", F.explode("host_words").alias("word"), F.lit(1).cast("long").alias("n")).union(words.select("unwanted", F.explode("path_words").alias("word"), "n"))
    tallies = np.zeros((2, BUCKETS))
    for r in tokens.groupBy(bucket.alias("b"), "unwanted").agg(F.sum("n").alias("n")).toLocalIterator():
        tallies[r["unwanted"], r["b"]] = r["n"]
    sizes = {r["unwanted"]: r["n"] for r in labelled.groupBy("unwanted").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        prior, weight = -1.0, np.zeros(BUCKETS)
    else:
        prior = math.log(sizes[1] / sizes[0])
        vocabulary = int((tallies.sum(axis=0) > 0).sum())
        smooth = (tallies + 0.1) / (tallies.sum(axis=1, keepdims=True) + 0.1 * vocabulary)
        weight = np.where(tallies.sum(axis=0) > 0, np.log(smooth[1] / smooth[0]), 0.0)
    shared = rows.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            odds = [prior + float(w[b].sum()) for b in batch.column("buckets").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), batch.column("words"), pa.array(odds, pa.float64())], ["page_id", "host", "path", "words", "log_odds"])

    own = rows.join(labelled.select("host", "host_words"), "host")
    own = own.withColumn("words", F.concat("host_words", _path_words("path")))
    own = own.withColumn("buckets", F.transform("words", lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")))
    scored = own.select("page_id", "host", "path", "words", "buckets").mapInArrow(run, "page_id long, host string, path string, words array<string>, log_odds double")
    fits = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return scored.withColumn("fits", fits).select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce(F.col("fits.verdict"), method).alias("verdict"), "words", "log_odds")
