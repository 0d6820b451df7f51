"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from supplyloom.llm import ann, chat, exact_dedup, mixture, ngram_join, packing, quality, sharding, token_files, toxicity
from supplyloom.llm.tokens import WordEncoder, tokenizer_path
from supplyloom.sources.storage import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, source]) tuples."""

    def make(rows, extra=None):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in extra or ():
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


LONG = "word " * 30_000 + "end"
ROWS = [(1, "one two three"), (2, None), (3, ""), (4, "one two three"), (4, "one two three"), (None, "x y"), (7, LONG), (8, LONG + " more")]
CLASH = ["_id", "_text", "size", "kept", "label", "row", "piece", "block", "_digest", "position"]


@pytest.fixture(scope="module")
def encoder():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer_path())
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_token_files(docs, encoder):
    got = token_files.token_file_digest(docs(ROWS, CLASH), tokenizer_path()).collect()
    want, start = [], 0
    for doc, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encoder(text) + [2]
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_file_digest(docs([]), tokenizer_path()).collect() == []


def test_token_file_bytes_are_checked():
    import numpy as np

    data = token_files.pack_file([None, 5], [2, 1], np.array([7, 2, 2]))
    ids, lengths, _ = token_files.unpack_file(data)
    assert ids == [None, 5] and lengths.tolist() == [2, 1]
    with pytest.raises(ValueError):
        token_files.unpack_file(data[:-9] + bytes([data[-9] ^ 1]) + data[-8:])


def test_files_of_lost_tasks_are_passed_over_and_damaged_ones_raise(spark, docs, tmp_path):
    folder = str(tmp_path / "tokens")
    manifest = token_files.write_token_files(docs(ROWS), folder, tokenizer_path(), ids_per_file=5)
    before = sorted(map(str, token_files.read_token_files(spark, folder).collect()))
    listed = tmp_path / "tokens" / manifest.first()["file"]
    whole = listed.read_bytes()
    (tmp_path / "tokens" / "part-000000-00000-lost.s8b").write_bytes(whole)
    (tmp_path / "tokens" / "part-000000-00001-cut.s8b").write_bytes(whole[: len(whole) // 2])
    assert sorted(map(str, token_files.read_token_files(spark, folder).collect())) == before
    listed.write_bytes(whole[:-1])
    (tmp_path / "tokens" / f".{listed.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="damaged token file"):
        token_files.read_token_files(spark, folder).count()


def test_word_encoder_forgets_and_stays_right(encoder):
    small = WordEncoder(tokenizer_path(), kept_words=3)
    texts = ["a b c d e f", "a b\nc d", "g h a  b", "\tq", " a", "a ", "x\n\ny", "it's 12 ok", LONG, "", None, "a", "b\nb"]
    texts += ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|>x y", "a b<|endoftext|>", "a <|endoftext|>", "<|endoftext|> a", "a\n<|endoftext|>\nb", "<|endof text|>"]
    for text in texts:
        assert small.ids(text).tolist() == encoder(text)
    for some in (texts, texts[::-1], texts[:8], [None, ""], []):
        ids, lengths = small.batch(pa.array(some, pa.string()))
        assert [len(encoder(t)) for t in some] == lengths.tolist()
        assert [i for t in some for i in encoder(t)] == ids.tolist()


def test_word_encoder_agrees_on_random_strings(encoder):
    rng = np.random.default_rng(8)
    signs = list("abcXYZ019 '.,!-_()  \n\t\r") + [" "] * 9 + ["é", "È", "ß", "ж", "中", "\u0301", "\u00a0", "\u2003", "😀", "'s", "<|endoftext|>", "<|", "\x00", "\x1c", "…"]
    made = ["".join(rng.choice(signs, int(rng.integers(0, 25)))) for _ in range(4_000)]
    small = WordEncoder(tokenizer_path(), kept_words=500)
    for a in range(0, len(made), 500):
        ids, lengths = small.batch(pa.array(made[a : a + 500]))
        for text, got in zip(made[a : a + 500], np.split(ids, np.cumsum(lengths)[:-1])):
            assert got.tolist() == encoder(text), repr(text)


def test_a_hot_id_is_dealt_over_many_files(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 50).cast("string")).alias("text"))
    folder = f"{shared_dir(spark)}/hot-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = token_files.write_token_files(rows.repartition(6), folder, tokenizer_path()).groupBy("part").sum("docs").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r[1] for r in parts)
    assert len(sizes) > 2 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and len(got) == 3_000


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    model = quality.quality_model(docs(ROWS, CLASH), labels, steps=3)
    got = quality.score_quality(docs(ROWS, CLASH), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1) for r in got)
    empty = quality.quality_model(docs([]), labels.limit(0), steps=2)
    assert quality.score_quality(docs([]), empty).count() == 0


def test_quality_pools_the_whole_text():
    import numpy as np

    good = ["the cat sat on a mat and saw it was so " * 4] * 20
    bad = [g + "### !!! @@@ %%% ### !!! @@@ " * 6 for g in good]
    model = quality.fit(good + bad, np.array([1] * 20 + [0] * 20), steps=120)
    far = "the cat sat on a mat and saw it was so " * 400
    clean, spoilt = quality.scores(model, [far, far + bad[0]])
    assert clean > 0.5 > spoilt
    together = quality.scores(model, [far, "", None, bad[0]])
    alone = [quality.scores(model, [t])[0] for t in (far, "", None, bad[0])]
    assert np.allclose(together, alone, atol=1e-5)


def naive_score(p, text):
    """The network window by window and chunk by chunk, in double precision."""
    raw = (text or "").encode("utf-8", "replace")
    count = max(2, -(-(len(raw) + 8) // 128))
    raw = raw.ljust(count * 128, b"\0") + bytes(4)
    embed, near, far = (p[k].astype(np.float64) for k in ("embed", "near", "far"))
    windows = []
    for at in range(0, count * 128, 4):
        one, two = embed[list(raw[at : at + 4])].reshape(-1), embed[list(raw[at + 4 : at + 8])].reshape(-1)
        windows.append(np.maximum(one @ near + two @ far + p["bias"], 0))
    pooled = np.zeros(len(p["out"]))
    for k in range(count - 1):
        one, two = np.array(windows[k * 32 : k * 32 + 32]), np.array(windows[k * 32 + 32 : k * 32 + 64])
        features = np.concatenate([(one.mean(axis=0) + two.mean(axis=0)) / 2, np.maximum(one.max(axis=0), two.max(axis=0))])
        pooled = np.maximum(pooled, np.maximum(features @ p["hidden"] + p["hidden_bias"], 0))
    return 1 / (1 + np.exp(-(pooled @ p["out"] + p["out_bias"][0])))


MIXED = ["", None, "short", "é" * 500, "word " * 700, "x" * 1016, "y" * 1017, "z" * 1024, "ab " * 3_000, "\0 \0", "short"]


def test_quality_agrees_with_the_naive_network():
    p = quality.initial(5)
    p["bias"] += np.linspace(-0.2, 0.2, len(p["bias"]), dtype=np.float32)
    got = quality.scores(p, MIXED)
    assert np.allclose(got, [naive_score(p, t) for t in MIXED], atol=2e-6)


def test_quality_scores_do_not_depend_on_the_batch():
    p = quality.initial(6)
    rng = np.random.default_rng(2)
    texts = MIXED + ["w" * int(n) for n in rng.integers(0, 40_000, 60)]
    alone = [quality.scores(p, [t])[0] for t in texts]
    for _ in range(4):
        order = rng.permutation(len(texts))
        together = quality.scores(p, [texts[i] for i in order])
        assert all(together[k] == alone[i] for k, i in enumerate(order))


def test_quality_gradient_agrees_with_finite_differences():
    p = quality.initial(9)
    rng = np.random.default_rng(3)
    texts = ["the cat sat " * 30, "## !! " * 50, "a b c", "q" * 300]
    labels = np.array([1, 0, 1, 0], dtype=np.float32)
    grad = quality._gradient(p, texts, labels)

    def loss(q):
        s = np.array([naive_score(q, t) for t in texts])
        return -(labels * np.log(s) + (1 - labels) * np.log(1 - s)).mean()

    for name, g in grad.items():
        flat = np.abs(g).reshape(-1)
        for at in [int(flat.argmax()), *rng.choice(np.flatnonzero(flat), min(4, np.count_nonzero(flat)), replace=False).tolist()]:
            moved = []
            for step in (1e-4, -1e-4):
                q = {k: v.astype(np.float64) for k, v in p.items()}
                q[name].reshape(-1)[at] += step
                moved.append(loss(q))
            assert (moved[0] - moved[1]) / 2e-4 == pytest.approx(float(g.reshape(-1)[at]), rel=0.02, abs=2e-5), (name, at)


def test_toxicity(spark, docs):
    rows = [(k, f"calm words here number{k % 7} and so on") for k in range(60)]
    rows += [(100 + k, f"you rotten fool number{k % 7} go away") for k in range(60)]
    labels = spark.createDataFrame([(d, 1, int(d >= 100)) for d, _ in rows] + [(2, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.toxicity_model(docs(rows), labels)
    assert len(model.models) == 3 and [len(m.weights) - len(model.vocabulary) for m in model.models] == [0, 1, 2]
    probes = docs([(1, "so calm"), (2, "rotten fool go away you"), (3, None), (4, ""), (4, ""), (None, LONG)], CLASH)
    got = toxicity.score_toxicity(probes, model).collect()
    assert [r.toxic for r in got] == [0, 1, 0, 0, 0, 0] and all(r.kept == (r.toxic == 0) for r in got)
    kept = toxicity.drop_toxic(probes, model)
    assert kept.columns == probes.columns and kept.count() == 5
    nothing = toxicity.toxicity_model(docs([]), labels.limit(0))
    assert toxicity.score_toxicity(docs([]), nothing).count() == 0


@pytest.mark.parametrize("digest", ["sha256", "length"])
def test_exact_dedup(docs, digest):
    from pyspark.sql import functions as F

    options = {} if digest == "sha256" else {"digest": lambda t: F.length(t)}
    rows = [*ROWS, (9, "one two threE"), (10, "a"), (11, "b")]
    got = exact_dedup.exact_duplicates(docs(rows, CLASH), **options).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    want = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        free = [True]
        for d in ids:
            kept = d == keep and bool(free)
            free = [] if kept else free
            want.append((d, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    stays = exact_dedup.drop_exact_duplicates(docs(rows, CLASH), **options)
    assert stays.columns == docs(rows, CLASH).columns
    kept = [(r.doc_id, r.text or "") for r in stays.collect()]
    assert Counter(kept) == Counter((w[0], t) for t, ids in groups.items() for w in want if w[3] and w[4] == hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_duplicates(docs([])).count() == 0 and exact_dedup.drop_exact_duplicates(docs([])).count() == 0


def jaccard_classes(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    linked = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    links = [[j for j in range(len(rows)) if j != i and linked(sets[i], sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        for i, js in enumerate(links):
            for j in js:
                root[i] = min(root[i], root[j])
    ids = [min(rows[k][0] for k in range(len(rows)) if root[k] == root[i]) for i in range(len(rows))]
    return Counter((r[0], ids[i], len(links[i]), root.count(root[i])) for i, r in enumerate(rows))


def test_ngram_join_against_all_pairs(docs):
    import random

    random.seed(4)
    words = [f"w{k}" for k in range(400)]
    rows = [(1, None), (2, ""), (3, "few words"), (4, "Few  words"), (5, LONG), (5, LONG), (6, "few words more")]
    for g in range(12):
        base = random.choices(words, k=random.choice([6, 40, 120, 300]))
        for _ in range(6):
            own = list(base)
            for _ in range(random.randint(0, 4)):
                own[random.randrange(len(own))] = random.choice(words)
            rows.append((100 + len(rows), " ".join(own)))
    got = ngram_join.similarity_classes(docs(rows, CLASH), block_members=4)
    assert Counter((r.doc_id, r.class_id, r.links, r.class_size) for r in got.collect()) == jaccard_classes(rows)
    kept = ngram_join.drop_similar(docs(rows, CLASH))
    assert kept.columns == docs(rows, CLASH).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _, _ in jaccard_classes(rows)})
    assert ngram_join.similarity_classes(docs([])).count() == 0 and ngram_join.drop_similar(docs([])).count() == 0
    same = ngram_join.similarity_classes(docs([(None, "a b"), (None, "a b"), (3, "q")])).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.links) for r in same) == [(0, 0, 1), (0, 0, 1), (3, 3, 0)]


def test_prefix_is_shortened_to_the_target():
    assert ngram_join.prefix_length(0.8, 24, 8, 0.9) == 8
    assert ngram_join.prefix_length(0.8, 24, 8, 0.9999) == 5
    assert ngram_join.prefix_length(0.8, 2, 8, 0.999999) == 1


def _near_copies(changes, size=200):
    """80 texts of so many words, each with a copy in which some words differ."""
    import random

    random.seed(5)
    rows = []
    for g in range(80):
        base = [f"g{g}w{k}" for k in range(size)]
        own = list(base)
        for k in random.sample(range(0, size, 6), changes):
            own[k] = "other"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(own))]
    return rows


def _forest(docs, rows, monkeypatch):
    """Chosen prefix length, edges (u, v, levels) and signatures by class."""
    seen = {}
    matched = ngram_join.matched_length

    def keep(edges, classes, *rest):
        seen["edges"] = [tuple(r) for r in edges.collect()]
        seen["signatures"] = {r.cid: bytes(r.signature) for r in classes.collect() if r.signature is not None}
        seen["length"] = matched(edges, classes, *rest)
        return seen["length"]

    monkeypatch.setattr(ngram_join, "matched_length", keep)
    got = ngram_join.similarity_classes(docs(rows)).collect()
    monkeypatch.setattr(ngram_join, "matched_length", matched)
    return got, seen


def test_prefixes_are_shortened_by_the_matches(docs, monkeypatch):
    easy, hard = _near_copies(1, 600), _near_copies(4)
    got, seen = _forest(docs, easy, monkeypatch)
    deep = seen["length"]
    assert Counter((r.doc_id, r.class_id, r.links, r.class_size) for r in got) == jaccard_classes(easy)
    got, seen = _forest(docs, hard, monkeypatch)
    assert Counter((r.doc_id, r.class_id, r.links, r.class_size) for r in got) == jaccard_classes(hard)
    assert 5 == seen["length"] < deep
    # Nothing alike: the threshold sets the length.
    assert _forest(docs, [r for r in easy if r[0] % 2 == 0], monkeypatch)[1]["length"] == 5


def test_one_hard_match_among_many_easy_ones_sets_the_length(spark):
    from pyspark.sql import functions as F

    pairs = spark.range(45_000).select((2 * F.col("id")).alias("u"), (2 * F.col("id") + 1).alias("v"))
    # A draw of every second pair by hash would not see this one.
    hard = pairs.filter(F.pmod(F.xxhash64("u", "v"), F.lit(2)) == 1).first().v
    values = lambda same: F.unhex(F.concat(F.repeat(F.lit("0001"), F.lit(same)), F.repeat(F.lit("0002"), F.lit(192 - same))))
    classes = spark.range(90_000).select(F.col("id").alias("cid"), F.when(F.col("id") == hard, values(163)).otherwise(values(192)).alias("signature"))
    edges = pairs.withColumn("levels", F.lit(8))
    assert ngram_join.matched_length(edges, classes, 0.8, 24, 8, 0.9999) == 5
    assert ngram_join.matched_length(edges.filter(F.col("v") != hard), classes, 0.8, 24, 8, 0.9999) == 8


def test_edges_of_each_length_connect_the_trie_nodes(docs, monkeypatch):
    rows = _near_copies(1) + [(1000 + k, f"a b c d e f g h i j k l m n o p q r s t u v w x {k}") for k in range(30)]
    _, seen = _forest(docs, rows, monkeypatch)
    signs = seen["signatures"]
    width = ngram_join.DEPTH * ngram_join.LEVEL

    def parts(links):
        root = {c: c for c in signs}
        for _ in signs:
            for u, v in links:
                root[u] = root[v] = min(root[u], root[v])
        return root

    for length in range(5, 9):
        nodes = {}
        for cid, sign in signs.items():
            for tree in range(ngram_join.TREES):
                nodes.setdefault((tree, sign[tree * width : tree * width + length * ngram_join.LEVEL]), []).append(cid)
        wanted = parts([(held[0], c) for held in nodes.values() for c in held])
        assert parts([(u, v) for u, v, levels in seen["edges"] if levels >= length]) == wanted


def test_recall_of_the_similarity_join(spark):
    """All links of a table against brute force over shared shingles."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.links for r in ngram_join.similarity_classes(table).collect()}
    sets, holders, links = {}, {}, Counter()
    for r in table.select("doc_id", "text").collect():
        words = (r.text or "").lower().split()
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        meets = Counter(other for s in sets[r.doc_id] for other in holders.get(s, ()))
        for other, both in meets.items():
            if both >= 0.8 * (len(sets[r.doc_id]) + len(sets[other]) - both):
                links.update([r.doc_id, other])
        for s in sets[r.doc_id]:
            holders.setdefault(s, []).append(r.doc_id)
    empty = sum(not s for s in sets.values())
    assert sum(links.values()) > 0
    assert all(got[d] == (links[d] if s else empty - 1) for d, s in sets.items())


def test_components_of_a_long_chain_and_a_star(spark):
    from supplyloom.llm.components import connected

    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}}


def test_packing(docs, encoder):
    got = packing.pack_documents(docs(ROWS, CLASH), tokenizer_path(), capacity=512, per_group=3).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    want = Counter()
    for d, t in ROWS:
        want[d] += len(encoder(t)) + 1
    assert total == want
    full = {d: encoder(t) + [0] for d, t in ROWS}
    assert all(crc(full[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack_documents(docs([]), tokenizer_path()).count() == 0


def test_search_empties_bins_that_best_fit_leaves():
    bins = packing.Bins(10)
    bins.items = [[(6, 0), (2, 1)], [(7, 2), (2, 3)], [(3, 4)]]
    bins.fill = [8, 9, 3]
    before = sum(f * f for f in bins.fill)
    bins.improve()
    assert sum(map(bool, bins.items)) == 2 and sum(f * f for f in bins.fill) > before
    assert sorted(x for items in bins.items for x in items) == [(2, 1), (2, 3), (3, 4), (6, 0), (7, 2)]


def test_search_reaches_every_underfull_bin():
    # 300 bins lack one token each and are of no use; the last two make one.
    bins = packing.Bins(100)
    bins.items = [[(99, k)] for k in range(300)] + [[(30, 300), (30, 301)], [(40, 302)]]
    bins.fill = [99] * 300 + [60, 40]
    bins.improve()
    assert sum(map(bool, bins.items)) == 301 and sorted(bins.fill) == [0] + [99] * 300 + [100]


def test_search_gains_on_mid_sized_pieces():
    sizes = np.random.default_rng(1).integers(400, 1001, 5_000)
    bins = packing.Bins(2048)
    bins.best_fit([(int(size), k) for k, size in enumerate(sizes)])
    best_fit = len(bins.items)
    bins.improve()
    assert sum(map(bool, bins.items)) <= best_fit * 0.98
    assert sorted(x for items in bins.items for x in items) == sorted((int(size), k) for k, size in enumerate(sizes))


def test_leftovers_of_groups_meet(spark):
    # No bin of ten can be filled by sixes and threes: 226 bins if groups are packed once, 200 at best.
    sizes = [6, 3] * 200
    pieces = spark.createDataFrame([(k, 0, size) for k, size in enumerate(sizes)], "row long, piece int, length long")
    got = packing.pack_pieces(pieces, 10, per_group=8).collect()
    assert sorted(r.row for r in got) == list(range(400))
    held = Counter()
    for r in got:
        held[r.sequence_id] += sizes[r.row]
    assert max(held.values()) <= 10 and len(held) <= 215


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, note string"
    rows = [
        (1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nyes", "x"),
        (1, 1, "assistant", "<\\|im_end|> <|im_end|>", "x"),
        (1, None, "assistant", "last", "x"),
        (2, 0, None, None, "x"),
        (2, 0, "assistant", "", "x"),
        (None, 5, "a\nb\\c", LONG, "x"),
    ]
    got = {r.conv_id: r for r in chat.chat_digest(spark.createDataFrame(rows, schema)).collect()}
    order = {1: [0, 1, 2], 2: [3, 4], None: [5]}
    for conv, at in order.items():
        turns = [(rows[k][2] or "", rows[k][3] or "") for k in at]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(at) and got[conv].loss_chars == len(loss)
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert chat.chat_digest(spark.createDataFrame([], schema)).count() == 0


def test_chat_round_trip_of_any_text():
    import random

    random.seed(1)
    bits = ["<", "|", "\\", "\n", "im_end", "|>", "<|im_end|>", "<|im_start|>assistant", "n", "é"]
    for _ in range(3000):
        turns = [("".join(random.choices(bits, k=random.randint(0, 4))), "".join(random.choices(bits, k=random.randint(0, 9)))) for _ in range(3)]
        assert chat.parse("".join(chat.render_turn(*t)[0] for t in turns)) == turns
    assert chat.render_turn("user", "plain <\\| text") == ("<|im_start|>user\nplain <\\\\| text<|im_end|>\n", True)
    assert chat.render_turn("user", "plain <| text")[1] is False


def test_sharding(docs):
    import struct

    import numpy as np
    import xxhash

    def best(key, weights):
        scores = []
        for i, w in enumerate(weights):
            seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
            bits = xxhash.xxh64_intdigest(struct.pack("<i", i), seed=seed) >> 11
            scores.append((w / -np.log((bits + 0.5) / 2**53), -i))
        return -max(scores)[1]

    rows = [*ROWS, *((100 + k, f"t{k}") for k in range(200))]
    weights = [1.0, 3.0, 2.0]
    got = sharding.shard_documents(docs(rows, CLASH), weights, 4.0, rows_per_bucket=20).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows
    )
    assert all(r.shard == best(r.doc_id, weights) and r.grown_shard == best(r.doc_id, [*weights, 4.0]) for r in got)
    assert all(r.grown_shard in (r.shard, 3) and r.law == "key" for r in got)
    for shard in range(3):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert sharding.shard_documents(docs([]), weights).count() == 0


def test_mixture(spark, docs):
    rows = [(k, "w " * (k % 17 + 1), ["a", "b", None][k % 3]) for k in range(300)]
    rows += [(500, None, "a"), (501, "", "b"), (502, "x y", "z"), (502, "x y", "z"), (None, "q", "a")]
    df = docs(rows, CLASH)
    got = mixture.curriculum(df, mixture.ranked_schedule(df)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    weights = {"a": 1.0, "b": 2.0, "z": 3.0, None: 1.0}
    capped = {}
    while True:
        rest, share = sum(sizes.values()) - sum(capped.values()), sum(w for s, w in weights.items() if s not in capped)
        target = {s: capped.get(s, rest * w / share) for s, w in weights.items()}
        over = [s for s in weights if s not in capped and target[s] > 3 * sizes[s]]
        if not over:
            break
        capped |= {s: 3.0 * sizes[s] for s in over}
    taken = Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.passes <= 3
        assert r.passes == len(r.positions) and list(r.positions) == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.passes * r.size * r.copies
    assert all(abs(taken[s] - target[s]) <= 1 for s in weights)
    order = [r.position for r in mixture.training_order(mixture.curriculum(df, mixture.ranked_schedule(df))).collect()]
    assert order == sorted(order)
    mixed = mixture.mix_documents(df, mixture.ranked_schedule(df))
    assert mixed.columns == df.columns and mixed.count() == sum(r.passes * r.copies for r in got)
    empty = docs([])
    assert mixture.curriculum(empty, mixture.ranked_schedule(empty)).count() == 0


def test_schedule_is_inverted(spark):
    knots = spark.createDataFrame([("s", 0.0, 0.0), ("s", 0.5, 2.0), ("s", 1.0, 1.0)], "source string, t double, weight double")
    pieces = mixture.integrate_schedules(knots)
    from pyspark.sql import functions as F

    at = lambda y: mixture.invert_demand(F.col("pieces"), F.lit(y))
    r = pieces.select("integral", at(0.0).alias("a"), at(0.125).alias("b"), at(0.5).alias("c"), at(1.25).alias("d")).first()
    assert (r.integral, r.a, r.b, r.c) == (1.25, 0.0, 0.25, 0.5) and abs(r.d - 1) < 1e-12


def test_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 10))
    x[50:150] = x[50]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    rows += [(1000, None, 0), (1020, [0.0] * 10, 0), (1040, [float("nan")] * 10, 0), (1060, [1.0, None] + [0.0] * 8, 0), (1080, [1.0], 0), (None, [1.0] * 10, 0), (40, x[40].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, class int")
    got = ann.nearest(df, target=1.0, block_rows=64, query_rows=8).collect()
    score = x[::20] @ x.T
    for i, q in enumerate(range(0, 400, 20)):
        others = [k for k in range(400) if k != q]
        want = sorted(others, key=lambda k: (-round(score[i, k], 9), k))[:20]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [o[0] for o in own] == list(range(1, 21)) and [o[1] for o in own] == want
        assert np.allclose([o[2] for o in own], score[i, want])
    assert {r.query_id for r in got} == set(range(0, 400, 20))
    assert ann.nearest(df.limit(0)).collect() == []


def test_recall_is_measured_outside_the_calibration(spark, monkeypatch):
    monkeypatch.setattr(ann, "CALIBRATION_QUERIES", 20)
    monkeypatch.setattr(ann, "CHECK_QUERIES", 10_000)
    x = np.random.default_rng(4).normal(size=(1_200, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, query_step=5).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    hits = []
    for q in range(0, 1_200, 5):
        score = x @ x[q]
        score[q] = -np.inf
        hits += [(q, int(k)) in found for k in np.argsort(-score)[:20]]
    assert np.mean(hits) >= 0.9
    # By construction, the calibration queries alone reach the target.
    assert got[0].recall >= 0.9 and len({r.recall for r in got}) == 1
    monkeypatch.setattr(ann, "CALIBRATION_QUERIES", 1)
    low = ann.nearest(df, query_step=5, target=0.2).first()
    monkeypatch.setattr(ann, "CHECK_QUERIES", 0)
    assert ann.nearest(df, query_step=5, target=0.2).first().recall is None and low.recall is not None


def test_a_longer_vector_leaves_the_others_in(spark):
    x = np.random.default_rng(5).normal(size=(60, 6))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100, [1.0] * 9)] + [(k, [float(k), 1.0, 0.0]) for k in (200, 201, 202)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), target=1.0).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == {0, 20, 40, 200} and by[200] == [202, 201]
    for q in (0, 20, 40):
        score = x @ x[q]
        score[q] = -np.inf
        assert by[q] == np.argsort(-score)[:20].tolist()


def test_pigeonhole_finds_every_code():
    import numpy as np

    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, size=(3000, 4), dtype=np.uint8)
    index = ann.SubstringIndex(codes)
    for radius in (0, 3, 5, 9, 14):
        found = index.within(codes[7], radius)
        assert found.tolist() == np.flatnonzero(ann.hamming(codes, codes[7]) <= radius).tolist()


def test_simple8b_round_trip():
    import numpy as np

    from supplyloom.llm import simple8b

    rng = np.random.default_rng(0)
    for n in (0, 1, 59, 1024, 1025, 5000):
        for high in (1, 300, 50257, 2**40, 2**64 - 1):
            values = rng.integers(0, high, size=n, dtype=np.uint64, endpoint=True)
            values[::7] = 0
            values[100:290] = 1
            coded = simple8b.encode(values)
            assert (simple8b.decode(coded) == values).all()
            if n == 5000:
                assert (simple8b.decode(coded, 1, 3) == values[1024:3072]).all()
                assert (len(coded.escapes) > 0) == (high == 2**64 - 1)


def test_labels_of_absent_documents_take_no_place_in_the_sample(spark, docs):
    from supplyloom.llm.sampling import labelled_sample

    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(3_000)], "doc_id long, quality int, toxic int")
    some = docs([(k, f"text {k}") for k in range(0, 3_000, 97)] + [(97, None), (98, "x" * 50)], CLASH)
    drawn = labelled_sample(some, labels, "quality", 400, held_out_fold=None, longest=40)
    assert sorted(drawn.doc_id) == list(range(0, 3_000, 97)) and (drawn.label == drawn.doc_id % 2).all()
    few = labelled_sample(some, labels, "quality", 8, held_out_fold=None)
    assert few.label.tolist() == [0] * 4 + [1] * 4
    assert len(labelled_sample(docs([]), labels, "quality", 8)) == 0
    assert len(labelled_sample(some, labels.limit(0), "quality", 8)) == 0
