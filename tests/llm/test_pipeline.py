import random
from collections import defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from chronoloom.llm import decontam, neardup, shingles  # noqa: E402
from chronoloom.llm.simhash import shingle_digests  # noqa: E402

DATA = "/root/testdata/sf0.01"


def plain_groups(docs, words=5, similarity=0.8):
    """Smallest id of every group connected by exact similarity, through an inverted index of shingles."""
    sets = {d: frozenset(shingle_digests(t, words).view(">u8").ravel().tolist()) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        x, y = sorted((find(a), find(b)))
        root[y] = x

    holds, common, bare = defaultdict(list), defaultdict(int), [d for d in sets if not sets[d]]
    for d, s in sets.items():
        for h in s:
            for e in holds[h]:
                common[e, d] += 1
            holds[h].append(d)
    for (a, b), n in common.items():
        if n >= similarity * len(sets[a] | sets[b]):
            join(a, b)
    for d in bare[1:]:
        join(bare[0], d)
    return {d: find(d) for d in docs}


def test_near_duplicates_against_all_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = plain_groups(docs)
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.id: r.component for r in neardup.duplicate_ids(df).collect()}
    assert {d: got.get(d, d) for d in docs} == want and got


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(4000)]
    first = [rng.choice(vocab) for _ in range(150)]
    docs = {0: " ".join(first)}
    for i in range(1, 400):
        copy = list(first)
        for k in rng.sample(range(150), rng.choice([1, 2, 3, 6, 12])):
            copy[k] = rng.choice(vocab)
        docs[i] = " ".join(copy)
    docs |= {1000 + i: " ".join(rng.choice(vocab) for _ in range(80)) for i in range(300)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = plain_groups(docs)
    got = {r.id: r.component for r in neardup.duplicate_ids(df).collect()}
    assert [d for d in docs if got.get(d, d) != want[d]] == []
    assert not any(d >= 1000 for d in got)


def templated(n, pairs, seed=11):
    """``n`` documents on one template, below the threshold to each other, of which ``pairs`` have a near copy."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(10**9)}"
    common = [word() for _ in range(243)]
    texts = [common + [word() for _ in range(33)] for _ in range(n)]
    for i in range(pairs):
        copy = list(texts[i])
        for k in (40, 90, 140, 190, 255):
            copy[k] = word()
        texts.append(copy)
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_near_copies_among_unlike_documents_of_one_template(spark):
    docs = templated(600, 200)
    want = plain_groups(docs)
    assert sum(d != c for d, c in want.items()) == 200
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.id: r.component for r in neardup.duplicate_ids(df).collect()}
    assert {d: got.get(d, d) for d in docs} == want


def test_lines_that_documents_recombine(spark):
    """Frequent shingles alone: no rare one tells the documents apart."""
    rng = random.Random(29)
    lines = [" ".join(f"l{i}w{k}" for k in range(12)) for i in range(60)]
    docs = {i: "\n".join(rng.sample(lines, rng.choice([3, 6, 12]))) for i in range(150)}
    docs |= {200 + i: docs[i] + "\n" + rng.choice(lines) for i in range(60)}
    want = plain_groups(docs)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.id: r.component for r in neardup.duplicate_ids(df).collect()}
    assert {d: got.get(d, d) for d in docs} == want and len(set(want.values())) < len(docs)


def test_hot_shingles_are_dealt_without_loss(spark, monkeypatch):
    """Buckets beyond the limits: dealt to several tasks, compared in blocks."""
    monkeypatch.setattr(neardup, "HOT", 4)
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 16)
    docs = templated(200, 60, seed=5)
    rng = random.Random(2)
    first = [f"w{rng.randrange(400)}" for _ in range(120)]
    for i in range(1000, 1090):
        copy = list(first)
        for k in rng.sample(range(120), rng.choice([1, 2, 4])):
            copy[k] = f"z{rng.randrange(10**6)}"
        docs[i] = " ".join(copy)
    want = plain_groups(docs)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.id: r.component for r in neardup.duplicate_ids(df).collect()}
    assert {d: got.get(d, d) for d in docs} == want


def test_shingles_and_simhashes_one_by_one():
    texts = ["", "a", "A b", "one two three four five", "one two\tthree  four five six", " x" * 3000, "é ü É \u00a0 z " * 40]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    h, starts, digest = shingles.shingle_hashes(data, offs, 5)
    sets, edges = shingles.distinct_in_rows(h, starts)
    prints = shingles.simhashes(sets, edges)
    for i, t in enumerate(texts):
        alone = shingles.shingle_hashes(np.frombuffer(raw[i], np.uint8), np.array([0, len(raw[i])]), 5)
        assert (alone[0] == h[starts[i] : starts[i + 1]]).all() and alone[2][0] == digest[i]
        words = raw[i].lower().split()
        plain = [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
        assert len(plain) == starts[i + 1] - starts[i] and len(set(plain)) == edges[i + 1] - edges[i]
        own = sorted({int(x) for x in alone[0]})
        assert own == [int(x) for x in sets[edges[i] : edges[i + 1]]]
        assert int(prints[i]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own))
    same = shingles.shingle_hashes(np.frombuffer(b"ONE two three  four\nfive", np.uint8), np.array([0, 24]), 5)
    assert same[2][0] == digest[3] and (same[0] == h[starts[3] : starts[4]]).all()


def test_a_long_text_is_cut_at_white_space(monkeypatch):
    text = ("lorem ipsum " * 400 + "x" * 900 + " dolor\n" * 300).encode()
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = shingles.shingle_hashes(data, offs, 5)
    monkeypatch.setattr(shingles, "SLICE", 256)
    cut = shingles.shingle_hashes(data, offs, 5)
    assert all((x == y).all() for x, y in zip(whole, cut, strict=True))


def test_odd_rows_keep_one(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, "A b c\nd e f", 2), (3, None, 3), (4, " ", 4), (None, "a b c d e f", 5), (5, "zzz", 6), (6, "y " * 50_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep int")
    got = neardup.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, 1, 3, 5, 6]
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_stages_one_by_one(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    told = corpus_pipeline.language(spark, docs, DATA)
    assert told.columns == columns and told.count() >= 0.98 * docs.count()
    one = corpus_pipeline.near_dedup(spark, told, DATA).cache()
    texts = {r.doc_id: r.text for r in told.collect()}
    groups = plain_groups(texts)
    assert {r.doc_id for r in one.collect()} == set(groups.values())
    clean = corpus_pipeline.decontaminate(spark, one, DATA).cache()
    leaked = {r.doc_id for r in decontam.leaks(one, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaked and leaked
    mixed = corpus_pipeline.mixture(spark, clean, DATA).cache()
    assert mixed.columns == columns
    sharded = corpus_pipeline.shard(spark, mixed, DATA).collect()
    assert len(sharded) == mixed.count()
    sizes = [sum(r.shard == s for r in sharded) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
