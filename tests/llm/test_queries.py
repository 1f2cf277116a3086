"""Operators through Spark: brute force on small tables, and odd inputs."""

import bisect
import collections
import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from vertiplan.llm import components, decontaminate, extract, minhash, packing, queries, secrets, substrings, topk, toxicity, urlfilter, warc

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def _words(n, rng):
    return [rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + str(rng.randint(0, 99)) for _ in range(n)]


def _documents(rng, n=40):
    out = []
    for i in range(n):
        w = _words(rng.randint(20, 80), rng)
        out.append(w)
        if i % 3 == 0:
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = "new" + str(rng.randint(0, 999))
            out += [v, list(w)]
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


ODD = [(None, "x y z w v u"), (1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1005, "one two"), (1006, "long " * 30000)]


def _brute_components(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    p = {i: i for i in sets}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            p[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark):
    docs = _documents(random.Random(1)) + ODD
    df = spark.createDataFrame([(*r, "src", 1) for r in docs], DOC + ", digest string, component int")
    rows = minhash.near_duplicates(df, 3, 85).collect()
    assert len(rows) == len(docs)
    brute = _brute_components([d for d in docs if d[0] is not None], 3, 85)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == brute[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    docs = _documents(random.Random(8), 30)
    base = docs[0][1].split()
    docs += [(500 + i, " ".join(base[:-1] + [f"tail{i}"])) for i in range(20)]
    rows = minhash.near_duplicates(spark.createDataFrame(docs, DOC), 3, 85).collect()
    brute = _brute_components(docs, 3, 85)
    assert {r.doc_id: r.component_id for r in rows} == {i: c for i, (_, c) in brute.items()}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in edges:
        p[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(i, " ".join(_words(30, rng))) for i in range(6)] + [(6, None), (None, "q w e r t y u i"), (7, "too short"), (8, "")]
    docs = [(i, " ".join(_words(50, rng) + (items[i % 6][1].upper().split() if i % 2 else []) + _words(20, rng))) for i in range(12)] + ODD
    d, b = spark.createDataFrame([(*r, 5) for r in docs], DOC + ", item_id int"), spark.createDataFrame([(*r, 1.0) for r in items], "item_id long, text string, doc_id double")
    got = sorted(tuple(r) for r in decontaminate.contaminated(d, b).collect())
    assert [x[:2] for x in got] == [(i, i % 6) for i in range(12) if i % 2] and all(x[2] == 1.0 for x in got)
    assert sorted(tuple(r) for r in decontaminate.contaminated(d, b, broadcast_bytes=0).collect()) == got
    left = decontaminate.clean(d, b)
    assert left.columns == d.columns and left.count() == len(docs) - 6


def test_url_filter(spark):
    urls = ["http://a.net/x", "http://example.net/en/1?q", "https://www.Example.COM/de/2", "https://EXAMPLE.org/fr/3#f", "ftp://x.org/fr", "nothing", None, "http://cheappills.example.com/en/9", "http://cheap-pills.example.com", "http://good-book.example.com/en/", "http://good-news.example.com/en/", "http://notexample.com/de/", "a://b://c/d", "http://?x"]
    rows = {r.page_id: r for r in urlfilter.url_verdicts(spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, n int")).collect()}
    assert len(rows) == len(urls)
    assert [(rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) for i in range(4)] == [("a.net", "/x", "net/", "block"), ("example.net", "/en/1", "example.net/en/", "allow"), ("www.example.com", "/de/2", "example.com/de/", "block"), ("example.org", "/fr/3", "org/fr/", "allow")]
    assert [rows[i].rule for i in (4, 5, 6)] == [None] * 3 and (rows[5].host, rows[6].path) == ("", "")
    assert "pills" in rows[7].words and [rows[i].verdict for i in (7, 8, 9, 10, 11)] == ["block", "block", "allow", "allow", "allow"]
    assert (rows[12].host, rows[12].path, rows[13].host) == ("b:", "//c/d", "")


def test_url_verdicts_on_labelled_urls(spark):
    """Held-out urls labelled by hand: no host of theirs holds a word of the list that the classes are learned from."""
    clean = ["dailynews", "citylibrary", "greengarden", "schoolproject", "travelguide", "musicschool", "farmmarket", "homekitchen", "artmuseum", "sciencecenter"]
    bad = ["royalcasino", "bigpoker", "freeslots", "onlinepills", "hotdating", "sportsbetting", "bestviagra", "livecam-sex", "jackpotcity", "cheappharmacy"]
    good_paths = ["news/city/council/meeting", "books/history/novel", "garden/roses/spring/planting", "travel/mountain/railway/trip", "recipe/bread/flour/oven", "museum/painting/exhibition", "science/physics/lecture/notes", "school/teacher/lesson/plan"]
    bad_paths = ["free/spins/bonus/code", "win/cash/prize/now", "order/cheap/meds/discreet", "hot/singles/chat/tonight", "deposit/bonus/roulette/table", "no/prescription/order/now", "lucky/wheel/spins/cash"]
    rng = random.Random(21)
    rows = [(i, f"https://{h}.example.org/{rng.choice(paths)}/{i}") for i, (h, paths) in enumerate([(f"{rng.choice(clean)}{k % 7}", good_paths) for k in range(300)] + [(f"{rng.choice(bad)}{k % 7}", bad_paths) for k in range(60)])]
    labelled = [
        ("luckyspins.example.biz/free/spins/bonus", 1), ("mega-cash.example.biz/win/cash/prize/today", 1), ("goldreels.example.biz/deposit/bonus/code", 1), ("quick-meds.example.biz/order/cheap/meds", 1),
        ("tonightchat.example.biz/hot/singles/chat", 1), ("wheel777.example.biz/lucky/wheel/cash", 1), ("discreetshop.example.biz/no/prescription/order", 1), ("vipclub.example.biz/bonus/roulette/table", 1),
        ("cityhall.example.biz/council/meeting/news", 0), ("oldnovels.example.biz/books/history", 0), ("rosegarden.example.biz/garden/spring/roses", 0), ("railtrips.example.biz/travel/railway", 0),
        ("breadbaker.example.biz/recipe/flour/bread", 0), ("openpainting.example.biz/exhibition/painting", 0), ("lecturenotes.example.biz/physics/lecture", 0), ("planteacher.example.biz/school/lesson", 0),
        ("freebooks.example.biz/books/novel", 0), ("cheaptravel.example.biz/travel/mountain/trip", 0), ("hotbread.example.biz/recipe/oven", 0), ("winterchat.example.biz/news/city", 0),
    ]
    pages = spark.createDataFrame(rows + [(1000 + i, f"http://{u}") for i, (u, _) in enumerate(labelled)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.url_verdicts(pages).collect()}
    missed = [u for i, (u, y) in enumerate(labelled) if y and got[1000 + i] == "allow"]
    wrong = [u for i, (u, y) in enumerate(labelled) if not y and got[1000 + i] == "block"]
    assert len(missed) <= 2 and len(wrong) <= 1, (missed, wrong)


def _check_packing(rows, size):
    seq = collections.defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for own in seq.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= size
    return len(seq)


def test_packing(spark):
    docs = [(i, " ".join(["word"] * (i % 50))) for i in range(300)] + ODD
    rows = packing.pack(spark.createDataFrame([(*r, 9) for r in docs], DOC + ", length int"), TOKENIZER, 64).collect()
    total = sum(r.length for r in rows)
    assert _check_packing(rows, 64) <= total / 64 * 1.02 + 1
    assert sum(r.length for r in rows if r.doc_id == 1006) == 30001 and sum(r.doc_id == 1000 for r in rows) == 1


def test_extraction_rows(spark):
    html = ["<article><p>a %d</p></article>" % i for i in range(4)] + [None, "", "<script>x</script>"]
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.org/{i}" if i else None, h, "t") for i, h in enumerate(html)], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in extract.main_text(pages).collect()}
    assert [rows[i].text for i in range(7)] == ["a 0", "a 1", "a 2", "a 3", "", "", ""] and rows[0].n_chars == 3


def test_extraction_of_copies_and_hot_hosts(spark, monkeypatch):
    monkeypatch.setattr(extract, "PARTS", 3)
    plain = "<div class=top>Welcome to the site</div><div class=body><p>%s</p></div>" + "<div class=x>%s</div>"
    rows = [(i, "http://a.org/", plain % (f"story number {i} of many", "")) for i in range(30)]
    rows += [(40, "http://copies.org/1", plain % ("the only story", ""))] * 4  # repeated rows are one page
    rows += [(50 + i, "http://a.org/x", plain % (f"another {i} story <b>is told here</b>", f"<section><p>and {i} goes on</p></section>" * (i % 3))) for i in range(12)]
    rows += [(70, "http://a.org/y", plain.replace("top", 'story social-history') % ("z", ""))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = collections.defaultdict(set)
    for r in extract.main_text(pages).collect():
        got[r.page_id].add(r.text)
    assert all(len(x) == 1 for x in got.values()) and len(got) == 44
    assert all(got[i] == {f"story number {i} of many"} for i in range(30))
    assert "the only story" in min(got[40])
    assert got[51] == {"another 1 story is told here\nand 1 goes on"} and got[52] == {"another 2 story is told here\nand 2 goes on\nand 2 goes on"}


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        docs.append((i, " ".join(_words(40, rng) + ([rng.choice(["scumbag", "moronic", "idiocy"])] if toxic else [])), "en"))
        labels.append((i, int(toxic), 1))
    docs += [(None, None, "en"), (700, "", "de")]
    rows = toxicity.toxicity(spark.createDataFrame(docs, DOC + ", lang string"), spark.createDataFrame(labels + [(None, 1, 1), (5, None, 0)], "doc_id long, toxic int, quality int")).collect()
    assert len(rows) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and all(r.predicted == (r.doc_id % 4 == 0) for r in held if r.doc_id < 600)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    docs = spark.createDataFrame([(i, f"word{i} same") for i in range(40)], DOC)
    import zlib

    base = [(i, i % 2) for i in range(40)]
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in base]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (base, flipped))
    assert a == b


def test_warc_round_trip(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    big, small = "<p>" + "x" * 200 + "é</p>", "tiny"
    pages = [(5, "http://a/ b\r\nX: y", big), (3, None, big), (9, "u", small), (1, "u", small), (2, "u", None), (None, "u", big), (3, None, big), (8, "u", "z" * 100), (7, "u", "z" * 100)] + [(100 + i, "u", hashlib.sha256(b"%d" % i).hexdigest() * 20) for i in range(30)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    folders = [f"file://{tmp_path}/{n}" for n in "ab"]
    manifests = [warc.write_warc(df, f, shard_bytes=5000) for f in folders]
    rows = warc.read_warc(manifests[0], folders[0]).collect()
    assert len(rows) == len(pages) and len({r.file for r in rows}) > 3
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in rows)
    assert kinds[3, "response", None] == 1 and kinds[3, "revisit", 3] == 1 and kinds[5, "revisit", 3] == 1 and kinds[None, "response", None] == 1
    assert kinds[9, "response", None] == kinds[1, "response", None] == 1 and kinds[8, "revisit", 7] == 1
    want = sorted(hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in pages)
    assert sorted(r.payload_digest for r in rows) == want
    assert [sorted(tuple(r) for r in m.collect()) for m in manifests][0] == [sorted(tuple(r) for r in m.collect()) for m in manifests][1]
    assert not list(tmp_path.glob("a/.*"))


def test_shards_of_skewed_ids(spark, monkeypatch, tmp_path):
    borders = sorted(random.Random(3).sample(range(-50, 500), 40))
    ids = [(i,) for i in range(-60, 510)] + [(None,)]
    got = spark.createDataFrame(ids, "x long").selectExpr("x", f"{warc._upto(borders, 'x')} as n").collect()
    assert all(r.n == (0 if r.x is None else bisect.bisect_right(borders, r.x)) for r in got)
    # one id far off and one that holds a third of all rows
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    pages = [(i, "u", hashlib.sha256(b"%d" % i).hexdigest() * 10) for i in range(200)] + [(10**15, "u", "far " * 99)] + [(7, "u", hashlib.sha256(b"x%d" % i).hexdigest() * 10) for i in range(100)]
    manifest = warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/s", shard_bytes=10_000)
    shards = collections.Counter()
    for r in manifest.collect():
        shards[r.shard] += r.records
    assert sum(shards.values()) == len(pages) and len(shards) >= 10 and max(shards.values()) < 60
    rows = warc.read_warc(manifest, f"file://{tmp_path}/s").collect()
    assert sorted(r.payload_digest for r in rows) == sorted(hashlib.sha256(h.encode()).hexdigest() for _, _, h in pages)


def test_secret_rows(spark):
    docs = ODD + [(2, 'api_key="abcd1234efgh"'), (3, "passwd = x")]
    rows = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame([(*r, "z") for r in docs], DOC + ", spans string")).collect()}
    assert rows[2].n_assign == 1 and rows[2].spans == "assign:0:21" and rows[3].spans == "" and rows[1000].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[2].base_sha256 == hashlib.sha256(b"assign:0:21").hexdigest()
    clean = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(docs, DOC)).collect()}
    assert clean[2] == '[assign]"' and clean[3] == "passwd = x" and clean[1000] is None


def test_repeated_passages(spark):
    rng = random.Random(11)
    passage, other = _words(70, rng), _words(60, rng)
    fuzzy = list(passage)
    for i in (12, 34, 55):
        fuzzy[i] = "changed"
    docs = [(1, _words(40, rng) + passage), (2, passage + _words(30, rng)), (3, _words(10, rng) + fuzzy + _words(10, rng)), (4, other[:45] + _words(60, rng)), (5, other), (6, _words(90, rng)), (7, _words(50, rng))]
    docs = [(i, " ".join(w)) for i, w in docs] + ODD
    rows = {(r.doc_id, r.source_id): r for r in substrings.repeated_passages(spark.createDataFrame([(*r, 3) for r in docs], DOC + ", start int")).collect()}
    assert set(rows) == {(2, 1), (3, 1)}
    assert (rows[2, 1].start, rows[2, 1].end, rows[2, 1].source_start, rows[2, 1].identity) == (0, 70, 40, 1.0)
    assert rows[3, 1].n_words == 70 and 0.95 < rows[3, 1].identity < 0.96


def test_changed_passage_whose_seeds_other_documents_have(spark):
    """Neither the first nor the next smaller document with a seed is the source, but one between, of many."""
    rng = random.Random(37)
    passage = _words(60, rng)
    changed = ["changed" if i % 10 == 9 else x for i, x in enumerate(passage)]
    parts = [passage[i : i + 9] for i in range(0, 60, 10)][::-1]
    docs = [(i, [x for part in parts for x in _words(50, rng) + part]) for i in (1, 2, 3, 5, 6, 8)] + [(4, _words(30, rng) + passage + _words(20, rng)), (7, _words(12, rng) + changed + _words(40, rng))]
    docs += [(9, _words(9, rng) + changed[:30] + _words(200, rng) + passage), (10, parts[2] + _words(3, rng))]
    rows = substrings.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs] + ODD, DOC)).collect()
    assert {(r.doc_id, r.source_id, r.start, r.end, r.source_start, r.source_end) for r in rows} == {(7, 4, 12, 71, 30, 89), (9, 4, 239, 299, 30, 90)}
    # the second of two places of a line goes with the first
    line, around = _words(9, rng), _words(60, rng)
    texts = [(1, around[:25] + line + around[25:] + _words(70, rng) + line + _words(5, rng)), (2, _words(70, rng) + line + _words(70, rng) + ["x" if i % 8 == 5 else w for i, w in enumerate(around[:25])] + line + ["x" if i % 8 == 5 else w for i, w in enumerate(around[25:])])]
    rows = substrings.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts], DOC)).collect()
    assert len(rows) == 1 and rows[0].start >= 149 and rows[0].source_start <= 5 and rows[0].n_words >= 60


def _runs(text, n=50):
    w = [x.lower() for x in re.findall(rb"[0-9a-zA-Z\x80-\xff]+", text.encode())]
    return [(a, hash(tuple(w[a : a + n]))) for a in range(len(w) - n + 1)]


def test_repeated_passages_like_brute_force(spark):
    """Every run of 50 words that a smaller document has lies in a reported passage, on a whole given table."""
    found = collections.defaultdict(list)
    for r in queries.queries()["op9_substring_dedup"](spark, SMALL).collect():
        found[r.doc_id].append((r.start, r.end))
        assert r.source_id < r.doc_id and r.n_words >= 50 and r.identity >= 0.8 - 1e-9
    seen, shared = set(), 0
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect():
        own = _runs(r.text or "")
        for a, run in own:
            if run in seen:
                shared += 1
                assert any(x <= a and a + 50 <= y for x, y in found[r.doc_id])
        seen.update(run for _, run in own)
    assert shared


def test_part_of_a_kept_table_is_dropped(spark):
    from vertiplan.llm import _store

    kept = _store.keep(spark.range(6).withColumn("rest", F.col("id") % 2 == 0), "parts", "rest")
    _store.drop(kept, part="rest=true")
    assert sorted(r.id for r in kept.where("not rest").collect()) == [1, 3, 5]
    assert spark.read.parquet(kept.kept_path).count() == 3
    _store.drop(kept)


def test_passages_over_many_buckets(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    few = sorted(map(tuple, substrings.repeated_passages(docs).collect()))
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 10)
    assert few and sorted(map(tuple, substrings.repeated_passages(docs).collect())) == few


def test_passages_of_repeated_ids(spark):
    rng = random.Random(31)
    long, other = _words(120, rng), _words(80, rng)
    rows = [(1, " ".join(long)), (2, " ".join(other[:30])), (2, " ".join(long[10:100])), (3, " ".join(long)), (3, " ".join(long)), (4, "short"), (4, " ".join(other + long[:70]))]
    got = substrings.repeated_passages(spark.createDataFrame([(*r, 7) for r in rows], DOC + ", source_id int")).collect()
    assert {(r.doc_id, r.source_id) for r in got} >= {(2, 1), (3, 1), (4, 1)}
    assert len(got) == len({tuple(r) for r in got})


def test_top_k(spark):
    rng = random.Random(12)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 420)] + [(420, None), (421, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (422, [float("nan")] * 6), (450, [float("inf")] * 6), (None, [1.0] * 6), (500, [0.5, 0.5]), (50, rows[50][1]), (600, [0.0] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, norm int")
    got = collections.defaultdict(list)
    for r in topk.top_k(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    import math

    import numpy as np

    good = {}
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = [math.floor(float(np.float32(x)) * 256) for x in v]
    for q in [i for i in good if i is not None and i % 50 == 0]:
        s = sorted((-sum(a * b for a, b in zip(good[q], v)), math.inf if i is None else i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
        assert [(n, None if i == math.inf else i, -x) for n, (x, i) in enumerate(s, 1)] == sorted(got[q])


def test_empty_tables(spark):
    docs, pages = spark.createDataFrame([], DOC), spark.createDataFrame([], "page_id long, url string, html string")
    assert minhash.near_duplicates(docs).count() == 0 and substrings.repeated_passages(docs).count() == 0
    assert decontaminate.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert urlfilter.url_verdicts(pages).count() == 0 and extract.main_text(pages).count() == 0 and warc.archived(pages).count() == 0
    assert packing.pack(docs, TOKENIZER).count() == 0 and secrets.secret_spans(docs).count() == 0
    assert toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in con.description]
    want = sorted(map(repr, con.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in queries.queries()[name](spark, SMALL).collect()) == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(20)
    item = " ".join(_words(30, rng))
    docs = [(i, " ".join(_words(50, rng)), "en", "s", 0, 1) for i in range(80)]
    docs[10] = (10, docs[9][1], "en", "s", 0, 1)
    docs[20] = (20, docs[20][1] + " " + item, "en", "s", 0, 1)
    docs[30] = (30, docs[30][1] + " token = abcdef123456", "en", "s", 0, 1)
    docs += [(i, " ".join(_words(30, rng)) + " moronic scumbag", "en", "s", 0, 1) for i in range(100, 140)]
    docs += [(300, "repeated row of some words here", "en", "s", 0, 1)] * 2 + [(301, None, None, None, None, None), (None, "no id at all for this one", None, None, None, 2), (302, "", "en", "s", 0, 1)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, toxicity_score int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 100)) for i in [*range(80), *range(100, 140)]], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, d)
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars", "toxicity_score"]
        seen.append(sorted((r.doc_id is None, r.doc_id or 0) for r in now.select("doc_id").collect()))
    clean = {(False, i) for i in [*range(80), 300, 301, 302]} | {(True, 0)}
    assert set(seen[0]) == clean
    assert seen[1] == sorted(clean - {(False, 10)})
    assert seen[2] == seen[3] == sorted(clean - {(False, 10), (False, 20)})
    assert now.where("doc_id = 30").first().text.endswith(" [assign]")
    rows = corpus_pipeline.run(spark, d).collect()
    assert _check_packing(rows, 4096) == -(-sum(r.length for r in rows) // 4096) and len(rows) == len(seen[3])


def test_rows_that_share_an_id(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(40)
    texts = [" ".join(_words(60, rng)) for _ in range(6)]
    schema = "doc_id long, text string, lang string, n_chars long"
    rows = [(1, texts[0]), (2, texts[1]), (7, texts[0]), (7, texts[2]), (8, texts[3]), (8, texts[3]), (9, texts[4]), (9, texts[4] + " more"), (None, texts[0]), (10, None), (10, ""), (11, "x"), (11, "x")]
    docs = spark.createDataFrame([(i, t, "en", 0) for i, t in rows], schema)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert collections.Counter((r.doc_id, r.text) for r in left if r.doc_id != 9) == collections.Counter([(1, texts[0]), (2, texts[1]), (7, texts[2]), (8, texts[3]), (None, texts[0]), (10, None), (10, ""), (11, "x")])
    assert sum(r.doc_id == 9 for r in left) == 1  # two near copies under one id are one group
    item = spark.createDataFrame([(1, texts[2])], "item_id long, text string")
    assert [tuple(r)[:3] for r in decontaminate.contaminated(docs, item).collect()] == [(7, 1, 1.0)]
    pieces = packing.pack(docs, TOKENIZER, 64).collect()
    assert sum(r.doc_id == 7 and r.piece == 0 for r in pieces) == 2 and sum(r.doc_id is None and r.piece == 0 for r in pieces) == 1
    _check_packing(pieces, 64)
    vectors = spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    assert sorted((r.rank, r.vec_id, r.score) for r in topk.top_k(vectors, 50, 1).collect()) == [(1, 1, 2 * 256 * 256), (1, 2, 3 * 256 * 256)]


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_stage_tables_go(spark, tmp_path):
    """What a stage has kept is deleted with its scope, what is taken off its list is not."""
    import os

    from vertiplan.llm import _store

    with _store.scope(spark) as inner:
        gone, (stays, seen) = _store.keep(spark.range(5), "gone"), _store.keep(spark.range(7), "stays", n=F.count("*"))
        inner.remove(stays.kept_path)
    assert seen["n"] == 7 and stays.count() == 7
    assert not os.path.exists(gone.kept_path.removeprefix("file://")) and os.path.exists(stays.kept_path.removeprefix("file://"))
    _store.drop(stays)
