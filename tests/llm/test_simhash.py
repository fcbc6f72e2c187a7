import random

import pytest
import xxhash

from chronoloom.llm import simhash
from chronoloom.llm.graphs import components
from chronoloom.llm.simhash import covering_links, covering_masks, fingerprint, near_groups, shingle_digests, signed

DATA = "/root/testdata/sf0.001"


def brute_fingerprint(text, k=3):
    toks = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        toks = toks.replace(c, " ")
    toks = [t for t in toks.split(" ") if t]
    if not toks:
        return 0
    grams = [" ".join(toks[i : i + k]) for i in range(max(1, len(toks) - k + 1))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(3)
    for _ in range(400):
        bits = rng.sample(range(64), radius)
        assert any(all(not m >> b & 1 for b in bits) for m in masks)


def test_fingerprints_match_a_plain_computation():
    words = [chr(97 + i) * (i % 4 + 1) for i in range(20)]
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 63, 66, 300):
        text = " \n".join(rng.choice(words).title() + rng.choice(["", "É", " x", " "]) for _ in range(n))
        assert fingerprint(shingle_digests(text, 3)) == brute_fingerprint(text)
    assert brute_fingerprint(None) == fingerprint(shingle_digests(None, 3)) == 0


def test_links_equal_all_pairs_in_a_dense_bucket(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 300:  # chains within the radius, many beyond it, around one centre
        f = rng.choice(list(fps))
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 5])):
            f ^= 1 << b
        fps.add(f)
    table = {i: f for i, f in enumerate(sorted(fps))}
    df = spark.createDataFrame([(signed(f), i) for i, f in table.items()], "fp long, rep long")
    got = {r.node: r.component for r in components(covering_links(df)).collect()}
    want = brute_components(table)
    assert {i: got.get(i, i) for i in table} == want


def test_groups_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(3, "a b c d", 1), (1, "A b\tc d", 2), (7, None, 3), (8, "", 4), (9, " \n", 5), (5, "one", 6), (5, "one", 7), (None, "a b c d", 8), (4, "x " * 30000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int").withColumnRenamed("fingerprint", "TEXT")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in near_groups(df).collect())
    hexed = lambda t: f"{brute_fingerprint(t):016x}"
    assert got == sorted([(3, hexed("a b c d"), 1), (1, hexed("a b c d"), 1), (-1, hexed("a b c d"), 1), (7, "0" * 16, 7), (8, "0" * 16, 7), (9, "0" * 16, 7), (5, hexed("one"), 5), (5, hexed("one"), 5), (4, hexed("x " * 30000), 4)])


def test_empty_table(spark):
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    fps = {d: brute_fingerprint(t) for d, t in docs.items()}
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash(spark, DATA).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in docs}


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (99, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}
