import zlib
from collections import Counter, defaultdict

from chronoloom.llm import mixing
from chronoloom.llm.mixing import mix, mix_report, source_targets
from chronoloom.llm.sharding import interleave

ROWS = [(i, None if i % 11 == 0 else ("word " * (i % 7 + 1)).strip() if i % 5 else "", None if i % 13 == 0 else f"s{i % 3}", i) for i in range(400)]
ROWS += [(900 + i, "copy of one text", "hot", i) for i in range(300)] + [(None, "x", "hot", 1), (5, "again", "s1", 2), (5, "again", "s1", 2), (950, "w " * 40000, "s0", 3)]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").withColumnRenamed("extra", "shard")


def test_shards_are_even_gapless_and_proportional(spark):
    got = interleave(docs(spark), 8).collect()
    assert len(got) == len(ROWS)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for src, n in Counter(r[2] for r in ROWS).items():
        for s in range(8):
            assert abs(sum(r.source == src for r in got if r.shard == s) - n / 8) <= 2
    for r in got:
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    again = interleave(docs(spark).repartition(7), 8).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_shards_of_an_empty_table(spark):
    assert interleave(docs(spark, []), 8).count() == 0


def plain_targets(sizes, share=1.5):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, free = share * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: w[s] * level for s in free}
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_targets_match_resharing_step_by_step(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 3}, {"a": 1, "b": 1, "c": 500, "d": 70, "e": 0, None: 9}, {"z": 4}, {f"s{i}": (i * 37) % 101 for i in range(30)}):
        got = {r.src: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "src string, s long")).collect()}
        want = plain_targets(sizes)
        assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want), (sizes, got, want)


def test_mix_takes_whole_documents_near_the_targets(spark):
    report = mix_report(docs(spark)).collect()
    assert len(report) == len(ROWS)
    sizes = Counter()
    for _, t, s, _ in ROWS:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    assert {r.taken // r["size"] for r in report if r["size"]} <= {0, 1, 2} and all(r.taken % max(1, r["size"]) == 0 for r in report)
    assert sum(r.taken for r in report) <= 1.5 * sum(sizes.values())
    copies = mix(docs(spark)).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in copies).total() == sum(r.taken // r["size"] for r in report if r["size"])
    taken = defaultdict(int)
    for r in copies:
        taken[r.source] += len(r.text.split())
    for s in sizes:
        longest = max(len((t or "").split()) for _, t, x, _ in ROWS if x == s)
        assert abs(taken[s] - want[s]) <= 2 * longest + 1, s
    assert copies[0].asDict().keys() == {"doc_id", "text", "source", "shard"}
    assert sorted(map(repr, mix_report(docs(spark).repartition(5)).collect())) == sorted(map(repr, report))


def test_mix_of_nothing(spark):
    assert mix_report(docs(spark, [])).count() == 0 and mix(docs(spark, [])).count() == 0
    empty = docs(spark, [(1, None, "a", 1), (2, "  ", None, 1)])
    assert [(r.taken, r.target) for r in mix_report(empty).collect()] == [(0, 0.0)] * 2
    assert mix(empty).count() == 0


def test_the_cut_is_found_by_dividing_the_bucket_that_holds_it(spark, monkeypatch):
    """Most times lie close together, so the first range buckets hold nearly all of them."""
    monkeypatch.setattr(mixing, "ORDERED", 3)
    times = sorted([0.001 + i * 1e-7 for i in range(500)] + [0.001] * 40 + [10.0**k for k in range(5)])
    rows = [(i % 5 + 1, v) for i, v in enumerate(times)]
    timed = spark.createDataFrame(rows, "sz long, v double")
    for budget in (0, 1, 3, 17, 119, 400, 1200.5, 1640, sum(z for z, _ in rows) - 3, 10**6):
        spent = {}
        for z, v in rows:
            spent[v] = spent.get(v, 0) + z
        want, total = -1.0, 0
        for v in sorted(spent):
            total += spent[v]
            want = v if total <= budget else want
        assert mixing.cut_time(timed, max(times), float(budget), 16) == want, budget


def test_repeated_ids_get_each_a_position(spark):
    rows = [(7, f"t{i % 3}", "a", i) for i in range(200)] + [(None, None, None, i) for i in range(50)] + [(i, "x", "a", i) for i in range(100)]
    got = interleave(docs(spark, rows), 8).collect()
    assert sorted(r.shard for r in got) == sorted(int(p * 8 // 350) for p in range(350))
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(r[:3] for r in rows)
