"""The pipeline's five decisions against plain Python, on planted copies, near copies and toxic texts."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from supplyloom.llm.tokens import tokenizer_path
from tests.llm.test_small_tables import jaccard_classes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = [(k, prose(rng.randint(40, 80)), "ab"[k % 2]) for k in range(60)]
    rows += [(100 + k, f"{prose(30)} you rotten fool go away", "ab"[k % 2]) for k in range(40)]
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(8)]
    rows += [(300 + k, f"{rows[k][1]} more", rows[k][2]) for k in range(20, 28)]
    return rows


def test_decisions(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = planted()
    full = [(d, t, "en", s, len(t)) for d, t, s in rows]
    spark.createDataFrame(full, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, 1, int("rotten" in t)) for d, t, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    clean = [r for r in rows if "rotten" not in r[1]]
    last = {}
    for d, t, s in clean:
        last[t] = max(last.get(t, d), d)
    once = [r for r in clean if last[r[1]] == r[0]]
    heads = {c[1] for c in jaccard_classes([(d, t) for d, t, _ in once])}
    apart = [r for r in once if r[0] in heads]
    assert (len(clean), len(once), len(apart)) == (76, 68, 60)

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path)).collect()
        docs = spark.createDataFrame(out, DOCS)
        seen.append(Counter((r.doc_id, r.text, r.source) for r in out))
    assert seen[:3] == [Counter(clean), Counter(once), Counter(apart)]
    mixed = seen[3]
    assert set(mixed) <= set(apart) and max(mixed.values()) <= 3
    words = Counter()
    for (_, t, s), n in mixed.items():
        words[s] += n * len(t.split())
    total, longest = sum(len(t.split()) for _, t, _ in apart), max(len(t.split()) for _, t, _ in apart)
    assert abs(words["a"] - total / 3) <= longest and abs(words["b"] - total * 2 / 3) <= longest

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encoder = Tokenizer.from_file(tokenizer_path())
    pieces, bins = Counter(), {}
    for (d, t, _), n in mixed.items():
        ids = encoder.encode(t, add_special_tokens=False).ids + [0]
        pieces[d, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))] += n
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in packed) == pieces
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r.length for r in packed) // 2048)


@pytest.mark.parametrize("rows", [[], [(i, None, None, None, None) for i in range(5)], [(None, "", "en", None, 0), (1, "a b c", None, "s", 5), (1, "a b c", "x", "t", 5), (1, "a b c", "w", "t", 5)]])
def test_pipeline_of_empty_and_null_tables(spark, rows, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Without labels nothing is toxic; equal texts are one; no document without words is read.
    assert [r.doc_id for r in got] == [1] * len({r[1] for r in rows if r[1]})


def test_rows_that_repeat_an_id_leave_the_least(spark):
    rows = [(1, "a b c d e f", lang, s, 5) for lang, s in (("x", "t"), ("b", "z"), (None, "q"), ("b", "y"))] + [(2, "other", "k", "k", 1)]
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        found = set()
        for n in (1, 3, 7):
            docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
            found.add(tuple(sorted(map(str, stage(spark, docs, "").collect()))))
        assert len(found) == 1 and len(next(iter(found))) == 2


def test_a_reused_worker_lets_go_of_the_words_it_encoded():
    import pyarrow as pa

    from supplyloom.llm import tokens, toxicity

    class Docs:
        columns, schema = ["doc_id", "text"], None

        def mapInArrow(self, run, schema):
            return run

    tokens.word_encoder(tokens.tokenizer_path()).ids("some words that stay")
    assert tokens.word_encoder.cache_info().currsize == 1
    chain = toxicity.Chain({}, [toxicity.Linear(np.zeros(0), -30.0)])
    run = toxicity.drop_toxic(Docs(), chain)
    (kept,) = run(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a text"]})]))
    assert kept.num_rows == 1
    assert tokens.word_encoder.cache_info().currsize == 0
