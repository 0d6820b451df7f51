"""Ranked lexical search, Zstandard WARC archives and VA-file clustering on small tables."""

import hashlib
import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
import zstandard

from supplyloom.llm import lexical, va_clusters, warc
from supplyloom.llm.files import qualified

# ---- ranked lexical search -----------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 50 + (50 * sum(c.values()) * n) // words
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(plain_terms(text))
                if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture
def corpus():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "naïve", "ÀB", "x1y"]
    share = 1 / np.arange(1, len(vocabulary) + 1)
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=share / share.sum()))
    docs = [(i, draw(int(rng.integers(1, 60)))) for i in range(300)]
    docs += [(900, docs[5][1]), (901, docs[5][1]), (902, docs[5][1]), (901, docs[5][1]), (None, docs[5][1])]
    docs += [(400, None), (401, ""), (402, "... !?"), (403, "w7 " * 400 + draw(2_000))]
    items = [(i, draw(12)) for i in range(25)] + [(3, docs[5][1]), (None, "W1 w2"), (50, None), (51, "nowhere"), (52, "")]
    return docs, items


@pytest.mark.parametrize("k, block_terms", [(5, 60_000), (50, 40)])
def test_search_agrees_with_scoring_everything(spark, corpus, k, block_terms):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "'x' AS item", "'y' AS n", "'z' AS row")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS term")
    got = lexical.search(d, q, k, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, items, k)


def test_search_of_empty_tables(spark, corpus):
    docs, items = corpus
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(d.limit(0), q).count() == 0
    assert lexical.search(d, q.limit(0)).count() == 0


def test_sketch_bounds_hold_and_leave_documents_out():
    rng = np.random.default_rng(1)
    words = [f"t{i}".encode() for i in range(2_000)]
    known, docs = lexical._Slots(), []
    for _ in range(400):
        chosen = rng.choice(2_000, int(rng.integers(1, 200)), replace=False)
        counts = rng.integers(1, 9, len(chosen)).astype(np.uint32)
        counts[0] = rng.choice([1, 5, 255, 256, 10_000])
        slots = np.array([known[words[i]] for i in chosen], dtype=np.uint32)
        docs.append((b" ".join(words[i] for i in chosen), counts, lexical.fold(slots, counts).tobytes()))
    weights = np.zeros((6, 2_000), dtype=np.int64)
    for row in weights:
        row[rng.choice(2_000, 15, replace=False)] = rng.integers(0, 9_000, 15)
    total = np.array([int(c.sum()) for _, c, _ in docs])
    block = lexical.Block(list(range(6)), {w: i for i, w in enumerate(words)}, weights, len(docs), int(total.sum()))
    bound = block.bounds([s for _, _, s in docs], total)
    exact = np.array([block.exact(t, c.tobytes(), int(n), np.arange(6)) for (t, c, _), n in zip(docs, total)])
    assert (bound >= exact).all()
    tenth = np.sort(exact, axis=0)[-10]
    assert (bound >= tenth).mean() < 0.5


def test_terms_follow_the_pattern():
    for text in ("", "Ab_C\x7fd é~È2", "ÄA b C", "\x00a\nb\tZ9", "naïve—Été"):
        assert [t.decode() for t in lexical.terms_of(text.encode())] == plain_terms(text)
    assert lexical.terms_of(None) == []


# ---- WARC archives -------------------------------------------------------------

LONG = "<p>long page</p>" * 40_000
PAGES = [
    (5, "http://a/", "x" * 100), (3, "http://b/?q=1 2", "x" * 100), (9, None, "x" * 100), (1, "http://c/", "x" * 99), (2, "u", "x" * 99),
    (7, "http://d/\r\nWARC-Type: x", "é" * 50), (6, "ü", "é" * 50), (4, "e", None), (10, "f", ""), (11, "g", LONG), (12, "h", LONG),
    (None, "i", "y" * 200), (13, "j", "y" * 200), (14, "k", "z" * 200), (14, "k", "z" * 200), (None, "l", "v" * 200), (None, "l", "v" * 200),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).selectExpr("*", "1 AS row", "'d' AS digest", "'p' AS payload")


def plain_pages():
    groups = {}
    for page, _, html in PAGES:
        groups.setdefault(html or "", []).append(page)
    out = []
    for body, ids in groups.items():
        raw = body.encode()
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for k, page in enumerate(ids):
            again = len(raw) >= 100 and k > 0
            out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


def test_archives_give_back_every_page(spark, pages):
    assert sorted(map(tuple, warc.warc_digest(pages).collect()), key=str) == plain_pages()
    small = warc.warc_digest(pages, bytes_per_archive=500)
    assert sorted(map(tuple, small.collect()), key=str) == plain_pages()
    assert warc.warc_digest(pages.limit(0)).count() == 0


def test_archives_hold_the_payloads_once(spark, pages, tmp_path):
    folder = str(tmp_path / "warc")
    manifest = warc.write_archives(pages, folder)
    assert manifest.groupBy().sum("records").first()[0] == len(PAGES)
    records = warc.read_archives(spark, folder)
    bodies = Counter(bytes(r.payload).decode() for r in records.collect() if r.record_type == "response")
    assert bodies[LONG] == bodies["z" * 200] == bodies["x" * 100] == 1 and bodies["x" * 99] == 2
    assert warc.dangling_revisits(records).count() == 0
    lost = records.filter("record_type = 'revisit' OR payload_bytes <> 100")
    assert warc.dangling_revisits(lost).count() == 3
    assert {r.target_uri for r in records.collect() if r.target_uri and "http://d" in r.target_uri} == {"http://d/%0D%0AWARC-Type:%20x"}


def test_archives_of_lost_tasks_are_passed_over_and_damaged_ones_raise(spark, pages, tmp_path):
    folder = tmp_path / "warc"
    name = warc.write_archives(pages, str(folder)).first()["file"]
    whole = (folder / name).read_bytes()
    (folder / f"lost{warc.SUFFIX}").write_bytes(whole[: len(whole) // 2])
    assert warc.read_archives(spark, str(folder)).count() == len(PAGES)
    (folder / name).write_bytes(whole[:-3])
    (folder / f".{name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="DamagedArchive"):
        warc.read_archives(spark, str(folder)).count()


def sample_archive(dictionary=b""):
    made = warc.ArchiveWriter(dictionary)
    body = b"<html>" + b"word " * 50
    digest = hashlib.sha256(body).hexdigest()
    made.page(1, 0, "http://a/", body, digest, None)
    made.page(2, 1, "http://a/", body, digest, warc.record_uri(1, 0))
    return made.data(), body


def test_reader_loads_the_leading_dictionary():
    texts = [(f"<html><title>page {i}</title><p>the same words on every page {i * 7}</p>" * 3).encode() for i in range(400)]
    dictionary = warc.train(texts, 2_000)
    assert dictionary and warc.train(texts[:1]) == b""
    data, body = sample_archive(dictionary)
    kinds = [(r.kind, r.payload) for r in warc.read_archive(data)]
    assert kinds == [("warcinfo", None), ("response", body), ("revisit", None)]
    # The dictionary may be compressed, and other frames may do without any.
    packed = zstandard.ZstdCompressor().compress(dictionary)
    again = struct.pack("<II", warc.SKIPPABLE_DICTIONARY, len(packed)) + packed + data[8 + len(dictionary) :]
    assert [r.kind for r in warc.read_archive(again)] == ["warcinfo", "response", "revisit"]
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_archive(data[8 + len(dictionary) :]))
    bare, _ = sample_archive()
    assert [r.kind for r in warc.read_archive(bare[8:])] == ["warcinfo", "response", "revisit"]


def test_reader_checks_headers_and_lengths():
    data, _ = sample_archive()
    for cut in range(1, len(data) - 8, 37):
        with pytest.raises(warc.DamagedArchive):
            list(warc.read_archive(data[:-cut])) if data[:-cut] not in _whole_prefixes(data) else _raise()
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    good = {"WARC-Type": "response", "WARC-Record-ID": "<urn:a>", "WARC-Date": warc.DATE, "WARC-Payload-Digest": "sha256:" + hashlib.sha256(b"abc").hexdigest()}
    assert warc.parse_record(warc.record_bytes(good, body), 0).payload == b"abc"
    bad = [good | {"WARC-Payload-Digest": "sha256:" + "0" * 64}, {k: v for k, v in good.items() if k != "WARC-Date"}, good | {"WARC-Type": "revisit"}, good | {"warc-date": "twice"}]
    for fields in bad:
        with pytest.raises(warc.DamagedArchive):
            warc.parse_record(warc.record_bytes(fields, body), 0)
    whole = warc.record_bytes(good, body)
    for raw in (whole[:-1], whole + b"x", whole.replace(b"WARC/1.1", b"WARC/9"), whole.replace(b"Content-Length: 3", b"Content-Length: 2"), whole.replace(b"WARC-Type: ", b"WARC-Type ")):
        with pytest.raises(warc.DamagedArchive):
            warc.parse_record(raw, 0)
    silent = zstandard.ZstdCompressor(write_content_size=False).compress(whole)
    with pytest.raises(warc.DamagedArchive, match="state its length"):
        list(warc.read_archive(silent))


def _whole_prefixes(data):
    ends, at = [], 8
    while at < len(data):
        ends.append(data[:at])
        at = warc.frame_end(memoryview(data), at)
    return ends


def _raise():
    raise warc.DamagedArchive("a whole prefix")


def test_folders_without_a_scheme_belong_to_the_default_store(spark, tmp_path):
    assert qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    assert qualified(spark, f"file://{tmp_path}").startswith("file:/")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://shared/")
    conf.set("fs.viewfs.mounttable.shared.link./data", f"file://{tmp_path}")
    try:
        assert qualified(spark, "/data/x") == "viewfs://shared/data/x"
    finally:
        conf.set("fs.defaultFS", before)


# ---- VA-file clustering --------------------------------------------------------


def plain_clusters(rows, k, rounds, d):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in kept]
    named = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(ints, key=named)[:k]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))

    def assign():
        return [min((gap(v, c), j) for j, c in enumerate(centroids)) for _, v in ints]

    for _ in range(rounds):
        got = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, at) in zip(ints, got) if at == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = assign()
    inertia = Counter()
    for dist, j in got:
        inertia[j] += dist
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, j, dist, inertia[j], sum(inertia.values()), names[j]) for (i, _), (dist, j) in zip(ints, got)], key=str)


def vectors(seed=3, n=400, d=64, groups=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (groups, d))
    made = [(i, (centre[i % groups] + rng.normal(0, 0.3, d)).tolist()) for i in range(n)]
    made += [(1_000 + i, made[0][1]) for i in range(30)] + [(7, made[7][1]), (7, made[8][1]), (None, made[9][1])]
    made += [(2_000, None), (2_001, [0.0] * d), (2_002, [1.0] * (d - 1)), (2_003, [float("nan")] + [0.0] * (d - 1)), (2_004, [float("inf")] * d), (2_005, [None] + [0.0] * (d - 1)), (2_006, [])]
    return made


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("bits, k", [(6, 40), (2, 9)])
def test_clusters_agree_with_comparing_everything(spark, bits, k):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).selectExpr("*", "1 AS row", "2 AS v", "3 AS cluster")
    got = va_clusters.va_clusters(df, clusters=k, bits=bits, bucket_rows=100)
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=str) == plain_clusters(rows, k, 5, 64)
    if bits == 6:  # about as many as centroids share a group of vectors
        assert got.agg({"candidates": "avg"}).first()[0] < 10


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(1, [0.5] * 4), (2, [0.5] * 4), (3, [-0.25, 0.0, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = va_clusters.va_clusters(df, dimensions=4)
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=str) == plain_clusters(rows, 40, 5, 4)
    assert va_clusters.va_clusters(df.limit(0)).count() == 0
    assert va_clusters.va_clusters(df).count() == 0
    with pytest.raises(Exception, match="too large"):
        va_clusters.va_clusters(spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>"), dimensions=4).count()


def test_intervals_hold_the_exact_distances():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (500, 8))
    x[:, 3] = 4
    for bits in (1, 3, 6, 8):
        cells = va_clusters.Cells.laid_out(x[:50], x.min(axis=0), x.max(axis=0), bits)
        number = cells.unpack(cells.pack(x))
        at = np.arange(8)
        assert (cells.low[at, number] <= x).all() and (x <= cells.high[at, number]).all()
        c = x[:20]
        can = va_clusters.Intervals(cells, c).candidates(number)
        gap = ((x[:, None, :] - c) ** 2).sum(axis=2)
        assert can[np.arange(500), gap.argmin(axis=1)].all()
        best, least = va_clusters.nearest(x, c, can)
        assert (best == gap.argmin(axis=1)).all() and (least == gap.min(axis=1)).all()
