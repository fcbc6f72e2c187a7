"""Operators against hand-made cases and plain models."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import text as tx
from chronoloom.functions import vector as vx
from chronoloom.operators import community, dedup, filters, graph, ingest, search, store, telemetry, temporal
from chronoloom.sources import delimited


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).head().x


def test_cosine_table(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([1.0], [1.0, 0.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    for r in df.select(vx.cosine(F.col("a"), F.col("b")).alias("c"), vx.shifted_cosine(F.col("a"), F.col("b")).alias("s"), "want").collect():
        assert r.c == pytest.approx(r.want) and r.s == pytest.approx((1 + r.want) / 2)
    u = one(spark, vx.l2_normalise(F.array(F.lit(3.0), F.lit(4.0))))
    assert u == pytest.approx([0.6, 0.8])
    assert one(spark, vx.l2_normalise(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, vx.to_vector(F.array(F.lit("1.5"), F.lit("x"), F.lit("2")))) == [1.5, 2.0]


def test_rrf_counts_and_least_score(spark):
    lists = [spark.createDataFrame([(str(u), i, "m") for i, u in enumerate(x)], "uuid string, rank0 int, method string") for x in ([1, 2, 3], [2, 1, 4])]
    assert search.rrf(lists).count() == 4
    got = search.rrf(lists, least=0.02).collect()
    assert {r.uuid for r in got} == {"1", "2"} and got[0].score == pytest.approx(1 / 60 + 1 / 61)
    assert search.rrf([x.limit(0) for x in lists]).count() == 0


def test_mmr_one_shot_and_greedy(spark):
    vecs = {"a": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0], "c": [0.5, 0.5, 0.0], "d": [1.0, 0.1, 0.0]}
    df = spark.createDataFrame([(k, v) for k, v in vecs.items()], "uuid string, embedding array<double>")
    got = {r.uuid: r.score for r in search.mmr(df, [1.0, 0, 0]).collect()}
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in vecs.items()}
    for k in vecs:
        want = 0.5 * unit[k][0] - 0.5 * max(0, max(float(unit[k] @ unit[o]) for o in vecs if o != k))
        assert got[k] == pytest.approx(want)
    greedy = search.mmr_greedy(df.withColumn("query", F.lit(1)).withColumn("query_embedding", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))), 3).orderBy("pos").collect()
    assert [r.uuid for r in greedy] == ["a", "b", "c"]


def test_rerankers_give_sorted_bounded_scores(spark):
    df = spark.createDataFrame([("1", "the quick brown fox"), ("2", "quick quick thinking"), ("3", ""), ("4", None), ("5", "unrelated")], "uuid string, text string")
    local = {r.uuid: r.score for r in search.local_rerank(df, "quick fox").collect()}
    assert local["1"] == pytest.approx(2 / (math.sqrt(3) * math.sqrt(2))) and local["3"] == local["4"] == local["5"] == 0
    hashed = {r.uuid: r.score for r in search.hash_rerank(df, "quick brown").collect()}
    assert hashed["1"] == 0.9 and hashed["3"] == 0 and 0 <= hashed["5"] <= 0.1
    scaled = {r.uuid: r.score for r in search.min_max(spark.createDataFrame([("a", -1.0), ("b", 1.0), ("c", 3.0)], "uuid string, score double")).collect()}
    assert scaled == {"b": 0.0, "c": 1.0}
    assert one(spark, search.judged(F.lit("True."))) == 0.8 and one(spark, search.judged(F.lit("maybe"))) == 0.5
    assert one(spark, search.numeric_reply(F.lit("score: 0.75!"))) == 0.75 and one(spark, search.numeric_reply(F.lit("7"))) == 1.0


def test_query_guard():
    assert search.query_terms("  ") == [] and search.query_terms("w " * 200) == [] and search.query_terms("A a-b") == ["a", "b"]
    assert len(search.RECIPES) == 16 and all(p.limit > 0 for r in search.RECIPES.values() for p in (r.edge, r.node, r.episode, r.community) if p)


def test_blank_and_unknown_searches(spark):
    c = {"node": search.Corpus(spark.createDataFrame([("a", "red fox", [1.0])], "uuid string, text string, embedding array<double>"))}
    assert search.search(c, "node_hybrid_rrf", " ").count() == 0
    assert search.search(c, "node_hybrid_rrf", "fox", [1.0]).collect()[0].score == pytest.approx(2 / 60)
    with pytest.raises(KeyError):
        search.search(c, "nothing", "fox")
    with pytest.raises(ValueError):
        search.search(c, "edge_hybrid_rrf", "fox")


def test_text_helpers(spark):
    col = lambda e, s: one(spark, e(F.col("s")), s=s)
    assert col(tx.normalise_exact, "  A \n b ") == "a b" and col(tx.normalise_fuzzy, "O'Neil & Co.") == "o'neil co"
    assert col(tx.shingles, "ab") == [] and col(tx.shingles, "a") == ["a"] and col(tx.shingles, "") == [] and col(tx.shingles, "ab cd") == ["abc", "bcd"]
    assert col(tx.entropy, "aabb") == pytest.approx(1.0) and col(tx.entropy, "") == 0
    assert col(tx.high_entropy, "abcdef") and not col(tx.high_entropy, "aaaaaa") and not col(tx.high_entropy, "abc")
    assert col(tx.strip_think, "a<think>x\ny</think>b") == "ab" and col(tx.strip_html, "<p>x</p>") == "x"
    assert col(tx.fenced_json, 'so\n```json\n{"a": 1}\n```') == '{"a": 1}' and col(tx.fenced_json, 'x {"a": [1]} y') == '{"a": [1]}' and col(tx.fenced_json, "x [{}] y") == "[{}]" and col(tx.fenced_json, "none") is None
    assert col(tx.upto_last_brace, "a}b}c") == "a}b}" and col(tx.without_last_line, "a\nb\nc") == "a\nb" and col(tx.without_last_line, "a") == ""
    assert col(tx.last_line_empty, "a\n ") and not col(tx.last_line_empty, "a")
    assert col(tx.valid_group_id, "a-B_1") and col(tx.valid_group_id, "") and not col(tx.valid_group_id, "a b")
    assert col(tx.uuid_shape, "12345678-1234-1234-1234-123456789012") and not col(tx.uuid_shape, "1234")
    assert col(tx.escape_query, "a+b(c)") == "a\\+b\\(c\\)" and col(tx.escape_non_ascii, "é😀a") == "\\u00e9\\ud83d\\ude00a"
    assert one(spark, tx.append_overlap(F.col("a"), F.col("b")), a="abcde", b="cdefg") == "abcdefg"
    assert col(tx.token_estimate, "one two, three.") == 3 and col(tx.token_estimate, "") == 0
    assert one(spark, tx.jaccard(F.array(), F.array())) == 1.0
    assert one(spark, tx.word_overlap(F.lit("Red Fox"), F.lit("fox den")))


def test_chunks_cover_the_text_within_the_limit():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "é", ". ", "\n\n", "\n", "longerword", "! "]) for _ in range(rng.randrange(0, 300)))
        parts = tx.chunk(text, 100)
        assert all(len(p.encode()) <= 100 for p in parts)
        strip = lambda s: "".join(s.split())
        assert strip("".join(parts)) == strip(text)
    assert tx.chunk("", 10) == [""] and tx.chunk(None) == [""] and tx.chunk("a\n\nb", 2) == ["a", "b"]


EDGES = [("e1", "a", "b"), ("e2", "b", "c"), ("e3", "c", "a"), ("e4", "c", "d"), ("e5", "d", "e"), ("e6", "x", "y"), ("e7", "a", "b")]


def edge_table(spark, rows=EDGES):
    return spark.createDataFrame(rows, "uuid string, src string, dst string")


def test_traversals(spark):
    e = edge_table(spark)
    assert {r.uuid: r.depth for r in graph.neighbors_within(e, "a", 2).collect()} == {"b": 1, "c": 1, "d": 2}
    assert {r.uuid: r.depth for r in graph.reach(graph.directed(e, "out"), graph.one(spark, "a"), 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {(r.uuid, r.depth) for r in graph.edge_bfs(e, graph.one(spark, "a"), 2).collect()} == {("e1", 1), ("e7", 1), ("e2", 2)}
    long = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n0", "n2")], "src string, dst string")
    assert {r.uuid: r.depth for r in graph.neighbors_within(long, "n0", 7).collect()} == {"n1": 1} | {f"n{i}": i - 1 for i in range(2, 9)}
    assert {r.uuid: r.path for r in graph.shortest_paths(long, "n0", 7).collect()}["n8"] == ["n0", *[f"n{i}" for i in range(2, 9)]]
    assert graph.reach(graph.directed(long, "out"), graph.one(spark, "n7"), 10).count() == 3
    assert {r.uuid: r.path for r in graph.shortest_paths(e, "a", 4).collect()}["e"] == ["a", "b", "c", "d", "e"]
    assert sorted(r.path for r in graph.all_paths(e, "a", "c", 4).collect() if r.length == 2) == [["e1", "e2"], ["e7", "e2"]]
    counts = {(r.node, r.neighbor): r.edge_count for r in graph.neighbor_counts(e).collect()}
    assert counts["a", "b"] == 2 and counts["b", "a"] == 2 and counts["a", "c"] == 1
    with pytest.raises(ValueError):
        graph.directed(e, "sideways")


def test_mentions_take_a_step(spark):
    m = spark.createDataFrame([("ep", "a")], "src string, dst string")
    got = {r.uuid: r.depth for r in graph.node_bfs(edge_table(spark), m, graph.one(spark, "ep"), 2).collect()}
    assert got == {"a": 1, "b": 2}


def plain_propagation(adj, rounds):
    label = {n: n for n in adj}
    for _ in range(rounds):
        new = {}
        for n, near in adj.items():
            votes = Counter()
            for o, w in near.items():
                votes[label[o]] += w
            w, best = max((w, k) for k, w in votes.items())
            new[n] = best if w > 1 else max(best, label[n])
        if new == label:
            break
        label = new
    return label


def test_label_propagation_against_a_plain_loop(spark):
    rng = random.Random(8)
    adj = defaultdict(dict)
    for _ in range(120):
        a, b = rng.sample(range(40), 2)
        w = rng.randrange(1, 4)
        adj[f"n{a}"][f"n{b}"] = adj[f"n{b}"][f"n{a}"] = w
    df = spark.createDataFrame([(a, b, w) for a, m in adj.items() for b, w in m.items()], "node string, neighbor string, edge_count long")
    for rounds in (1, 2, 6):
        assert {r.node: r.label for r in community.label_propagation(df, rounds).collect()} == plain_propagation(adj, rounds)


def test_shared_items_are_counted_in_blocks_without_shuffling_pairs(spark, monkeypatch):
    """Copies of rows, nulls, lone members, an item that all share, a member of all items; many blocks, cuts inside an item and a member."""
    rng = random.Random(5)
    held = {(f"S{rng.randrange(60)}", rng.randrange(90)) for _ in range(500)} | {(f"S{i}", 7) for i in range(60)} | {("S9", i) for i in range(90)}
    rows = [*sorted(held), *sorted(held)[::3], ("lone", 1000), (None, 7), ("S1", None)]
    adj = defaultdict(Counter)
    for a, p in held:
        for b, q in held:
            if p == q and a != b:
                adj[a][b] += 1
    df = spark.createDataFrame(rows, "member string, item long")
    for name, value in (("BLOCK_ROWS", 100), ("DEALT", 40), ("SORTED", 50)):
        monkeypatch.setattr(community, name, value)
    names, lists = community.sharing(df)
    got = lists.collect()
    assert len(got) == len(adj) and {names[r.node].as_py(): {names[k].as_py(): w for k, w in zip(r.near, r.weight)} for r in got} == adj
    moved = []
    monkeypatch.setattr(community, "stored", lambda df: moved.append(df._jdf.queryExecution().optimizedPlan().toString()) or dedup.stored(df))
    for rounds in (1, 2, 100):
        assert {r.node: r.label for r in community.label_propagation_by_items(df, rounds).collect()} == plain_propagation(adj, rounds)
    assert moved and not any("Join" in plan for plan in moved)


def test_counted_pairs_leave_a_worker_part_by_part(spark, monkeypatch):
    """One block, parts far below its pairs: no row holds more than a part and what a member has; a hub's pairs span parts and are whole."""
    rng = random.Random(6)
    held = sorted({(f"S{rng.randrange(80)}", rng.randrange(60)) for _ in range(600)} | {("hub", i) for i in range(60)})
    adj = defaultdict(Counter)
    for a, p in held:
        for b, q in held:
            if p == q and a != b:
                adj[a][b] += 1
    monkeypatch.setattr(community, "SORTED", 200)
    assert max(sum(m.values()) for m in adj.values()) > 200
    names, lists = community.shared_lists(spark.createDataFrame(held, "member string, item long"))
    rows = lists.collect()
    assert sum(r.total for r in rows) == sum(map(len, adj.values())) > 10 * max(r.total for r in rows)
    assert max(r.total for r in rows) <= 200 + len(names) and Counter(x for r in rows for x in r.node) == Counter(range(len(names)))
    assert "FlatMapGroups" not in lists._jdf.queryExecution().toString()


def test_propagation_takes_odd_adjacencies(spark):
    """No rows; a neighbour that is no node; pairs given twice; a weight that is missing."""
    schema = "node string, neighbor string, edge_count long"
    assert community.label_propagation(spark.createDataFrame([], schema)).collect() == []
    assert community.label_propagation_by_items(spark.createDataFrame([], "member string, item long")).collect() == []
    df = spark.createDataFrame([("a", "b", 1), ("a", "b", 1), ("b", "x", 5), ("b", "a", None), ("c", "x", 3)], schema)
    assert {r.node: r.label for r in community.label_propagation(df, 1).collect()} == {"a": "b", "b": "b", "c": "c"}


def test_numbered_names_meet_only_where_they_are_alike(spark):
    """Names of one pattern share all but a digit's shingles: those found equal brute force, and few others are proposed."""
    from pyspark.sql import functions as F

    from chronoloom.functions import text as tx

    def shingled(n):
        s = n.replace(" ", "")
        return {s} if len(s) == 1 else {s[i : i + 3] for i in range(len(s) - 2)}

    rng = random.Random(4)
    names = [f"customer 000{i:06d}" for i in range(0, 1200)] + ["a", "ab", "abc", "customer 000111111", "customer 000011111"]
    names += ["".join(rng.choice("abcde") for _ in range(k)) for k in (17, 18, 19, 20, 21, 22, 30, 60)]
    names += [n[:-1] for n in names[-8:]] + [n[:-2] for n in names[-8:]] + [n + "z" for n in names[-8:]]
    sets = {n: shingled(n) for n in names}
    want = {(a, b) for a, x in sets.items() for b, y in sets.items() if x and y and len(x & y) >= 0.9 * len(x | y) - 1e-12}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {(r.a, r.b) for r in dedup.similar_names(df, df).collect()} == want
    short = df.distinct().withColumn("s", F.array_distinct(tx.shingles(F.col("n")))).filter(F.size("s").between(1, 18))
    assert dedup.one_apart(short, short).count() < 2 * len(want)
    named = df.distinct().withColumn("name", F.col("n")).filter(F.length("n") > 2)
    of = dedup.bands(dedup.minhash(named, "n"), "n").groupBy("n").agg(F.collect_list("value").alias("v")).join(dedup.band_keys(named.select(F.col("n").alias("uuid"), F.array_distinct(tx.shingles(F.col("n"))).alias("s"))).toDF("m", "k"), F.col("n") == F.col("m")).limit(200).collect()
    for p, q in zip(of, of[1:]):
        assert bool(set(p.v) & set(q.v)) == bool(set(p.k) & set(q.k))


def test_long_names_of_one_pattern_meet_only_where_they_are_alike(spark):
    """Names of 18 shingles or more that differ in a few places: those found equal brute force, and few others are proposed."""
    from pyspark.sql import functions as F

    from chronoloom.functions import text as tx

    rng = random.Random(9)
    names = [f"the customer {i:06d} copy {k}" for i in range(300) for k in (1, 7, 12)]
    long = ["".join(rng.choice("abcdefgh") for _ in range(k)) for k in (20, 22, 31, 45, 62, 90)]
    names += long + [n[:-c] for n in long for c in (1, 2, 3)] + [n[:i] + "z" + n[i + 1 :] for n in long for i in (0, len(n) // 2)]
    sets = {n: dedup.shingle_set(n) for n in names}
    df = spark.createDataFrame([(n,) for n in sets], "n string")
    shingled = df.withColumn("s", F.array_distinct(tx.shingles(F.col("n"))))
    assert {r.n: set(r.s) for r in shingled.collect()} == sets
    for least in (0.9, 0.6):
        want = {(a, b) for a, x in sets.items() for b, y in sets.items() if len(x & y) >= least * len(x | y) - 1e-12}
        got = dedup.similar_names(df, df, least)
        assert {(r.a, r.b) for r in got.collect()} == want
        if least == 0.9:
            held = shingled.filter(F.size("s") >= 18)
            assert dedup.shared_rare(held, held, least, 18).count() < 4 * len(want)
            keys = {r.uuid: set(r["keys"]) for r in dedup.band_keys(shingled.select(F.col("n").alias("uuid"), "s")).collect()}
            assert {(r.a, r.b) for r in dedup.sharing_bands(got).collect()} == {(a, b) for a, b in want if keys[a] & keys[b]}


def test_summaries_reduce_in_pairs():
    assert community.reduce_pairs(["a", "b", "c", "d"], lambda x, y: x + y) == "acbd"
    assert community.reduce_pairs(["a", "b", "c"], lambda x, y: x + y) == "abc"
    assert community.reduce_pairs([], None) == "" and community.reduce_pairs(["x"], None) == "x"


def test_maps_follow_components_and_chains(spark):
    pairs = spark.createDataFrame([(f"k{i:02d}", f"k{i + 1:02d}") for i in range(20)] + [("z", "y")], "a string, b string")
    got = {r.alias: r.canonical for r in dedup.undirected_map(pairs).collect()}
    assert got == {**{f"k{i:02d}": "k00" for i in range(21)}, "z": "y", "y": "y"}
    chain = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("c", "d", 2), ("d", "e", 3), ("p", "q", 4)], "alias string, parent string, pos int")
    assert {r.alias: r.canonical for r in dedup.directed_map(chain).collect()} == {"a": "e", "c": "e", "d": "e", "p": "q"}


def test_resolution(spark):
    have = spark.createDataFrame([("1", "Alice Johnson"), ("2", "Bob Stone"), ("3", "bob  stone"), ("4", "International Business Machines")], "uuid string, name string")
    new = spark.createDataFrame([("n1", "alice johnson"), ("n2", "Bob Stone"), ("n3", "International Business Machines!"), ("n4", "Zed"), ("n5", "Quite Different Name")], "uuid string, name string")
    got = {r.uuid: (r.match, r.how) for r in dedup.resolve(new, have).collect()}
    assert got == {"n1": ("1", "exact"), "n2": (None, "ambiguous"), "n3": ("4", "fuzzy")}


def test_upserts_are_idempotent(spark):
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("1", "A", "g", ["X"], t, "s")], "uuid string, name string, group_id string, labels array<string>, created_at timestamp, summary string")
    new = spark.createDataFrame([("1", "", "g", [], t, "new"), ("2", "B", "g", ["Y"], t, "")], "uuid string, name string, group_id string, labels array<string>, updated_at timestamp, summary string")
    cols = ["uuid", "name", "labels", "summary", "group_id", "created_at"]
    once = store.upsert_entities(old, new).select(cols)
    twice = store.upsert_entities(once, new).select(cols)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r.uuid: (r.name, r.labels, r.summary) for r in once.collect()} == {"1": ("A", [], "new"), "2": ("B", ["Y"], None)}
    m = spark.createDataFrame([("e-a", "e", "a", "g")], "uuid string, src string, dst string, group_id string")
    assert store.upsert_mentions(m, m).count() == 1


def test_deletes_take_incident_edges(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdexy"], "uuid string")
    left, rest = store.delete_nodes(nodes, edge_table(spark), spark.createDataFrame([("c",)], "uuid string"))
    assert left.count() == 6 and {r.uuid for r in rest.collect()} == {"e1", "e5", "e6", "e7"}


def test_validity(spark):
    h = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    rows = [("a", "s", "d", h(-2), h(2)), ("b", "s", "d", h(-2), h(-1.5)), ("c", "s", "d", h(-3), None)]
    e = spark.createDataFrame(rows, "uuid string, src string, dst string, valid_at timestamp, invalid_at timestamp").withColumn("created_at", F.col("valid_at")).withColumn("expired_at", F.col("invalid_at"))
    assert {r.uuid for r in temporal.active_at(e, "2024-01-01 00:00:00").collect()} == {"a", "c"}
    assert {r.uuid for r in temporal.active_at(e, "2024-01-01 02:00:00").collect()} == {"a", "c"}
    assert {r.uuid for r in temporal.known_at(e, "2024-01-01 02:00:00").collect()} == {"c"}
    new = spark.createDataFrame([("n", "s", "d", h(0), None)], "uuid string, src string, dst string, valid_at timestamp, invalid_at timestamp")
    got = {r.uuid: r.invalid_at for r in temporal.invalidate(e, new).collect()}
    assert got == {"a": h(0), "b": h(-1.5), "c": h(0)}
    assert one(spark, temporal.parse_time(F.lit('"2024-01-02T03:04:05Z"'))) == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, temporal.parse_time(F.lit(""))) is None


def test_date_filters(spark):
    D = filters.DateFilter
    e = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), None), ("b", dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1)), ("c", None, None)], "uuid string, valid_at timestamp, invalid_at timestamp")
    e = e.withColumn("name", F.lit("x")).withColumn("group_id", F.lit("g"))
    f = filters.SearchFilters(valid_at=[[D(">", "2024-01-15 00:00:00"), D("IS NOT NULL")], [D("IS NULL")]])
    assert {r.uuid for r in filters.filter_edges(e, f).collect()} == {"b", "c"}
    assert filters.filter_edges(e, filters.SearchFilters()).count() == 3


def test_ingestion_of_a_conversation(spark):
    t = dt.datetime(2024, 1, 1)
    ep = spark.createDataFrame([("e1", "x", "Alice visited Paris. Alice left.", "m", "g", t), ("e2", "x", "Paris hosted Alice", "m", "g", t + dt.timedelta(hours=1)), ("e3", "x", "nothing here", "m", "g", t)], "uuid string, name string, content string, source string, group_id string, reference timestamp")
    got = ingest.ingest(ep)
    assert {r.name for r in got.entities.collect()} == {"Alice", "Paris"}
    assert sorted((r.fact, r.episodes) for r in got.edges.collect()) == [("Alice followed_by Paris", ["e1"]), ("Paris followed_by Alice", ["e2"])]
    assert got.mentions.count() == 4
    assert ingest.ingest(ep, known=ep.filter("uuid = 'e1'")).mentions.count() == 2


def test_costs_and_progress(spark):
    cost = lambda m: one(spark, telemetry.cost_usd(F.lit(m), F.lit(1_000_000), F.lit(1_000_000)))
    assert cost("GPT-4o") == 12.5 and cost("gpt-4-32k") == 12.5 and cost("nothing") == 0 and cost("o1-mini") == 15
    assert one(spark, telemetry.progress(), step="completed") == "100% (completed)" and one(spark, telemetry.progress(), step="?") == "Unknown step"


def test_delimited_cells(spark):
    from pyspark.sql.types import StructType

    df = spark.createDataFrame([(1, "n\tk\n1\t[a, 'b']\nbad\n2\t[]\nx\t[c]")], "id int, r string")
    got = delimited.parse_delimited(df, "r", StructType.fromDDL("n int, k array<string>")).collect()
    assert [(r.id, r.n, r.k) for r in got] == [(1, 1, ["a", "b"]), (1, 2, []), (1, None, ["c"])]


def test_grouped_search_in_blocks(spark, monkeypatch):
    """Blocks of a hot group give what comparing every query with all items of its group gives; rows without a group find nothing."""
    import numpy as np

    from chronoloom.operators import search as se

    monkeypatch.setattr(se, "BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(f"v{i:02d}", "hot" if i < 40 else "few" if i < 44 else None, [float(x) for x in rng.normal(size=3)]) for i in range(46)]
    items = spark.createDataFrame(rows, "uuid string, group_id string, embedding array<double>")
    got = {(r.query, r.uuid): r.score for r in se.relevant_pairs(items.withColumnRenamed("uuid", "query"), items, 5, 0.1).collect()}
    want = {}
    for q, g, v in rows:
        near = [(-float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), u) for u, h, w in rows if g is not None and h == g and u != q]
        want |= {(q, u): -s for s, u in sorted(near)[:5] if -s >= 0.1}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def _pairs_one_by_one(queries, items, limit, least):
    """What ``relevant_pairs`` returns, with each pair of a group as a row of its own."""
    from pyspark.sql import Window as W

    x = items.select(F.col("uuid"), F.col("group_id").alias("h"), F.col("embedding").alias("e"))
    near = queries.join(x, F.col("group_id") == F.col("h")).select("query", "uuid", vx.cosine(F.col("embedding"), F.col("e")).alias("score"))
    near = near.filter((F.col("score") >= least) & (F.col("query") != F.col("uuid")))
    return near.withColumn("rn", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "uuid"))).filter(F.col("rn") <= limit).drop("rn")


def test_grouped_search_by_matrices(spark, monkeypatch):
    """Pairs are no rows of a join; copies, ties, odd vectors and repeated ids give what single pairs give, to the last bit."""
    from chronoloom.operators import near as nr
    from chronoloom.operators import search as se

    rng = np.random.default_rng(5)
    some = rng.normal(size=(30, 5)).astype(np.float32)
    vectors = [[float(x) for x in some[i % 30] * (3 if i % 4 == 0 else 1)] for i in range(300)]
    vectors += [[0.0] * 5, None, [], [1.0, None, 2.0, 0.0, 0.0], [1.0, 2.0], [2.0, 4.0], [1e-30, 0.0, 0.0, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0, 0.0]]
    rows = [(i * 7 % 311, "a" if i % 3 else "b", v) for i, v in enumerate(vectors)] + [(3, "a", vectors[4]), (3, "a", vectors[4]), (3, "a", vectors[5])]
    monkeypatch.setattr(nr, "ITEMS", 64)
    monkeypatch.setattr(nr, "QUERIES", 16)
    for kind, block, least, limit in (("float", 20_000, 0.6, 10), ("double", 90, 0.2, 3), ("float", 60, -0.5, 4)):
        monkeypatch.setattr(se, "BLOCK", block)
        items = spark.createDataFrame(rows, f"uuid long, group_id string, embedding array<{kind}>").localCheckpoint()
        queries = items.withColumnRenamed("uuid", "query")
        got, want = (sorted(map(str, f(queries, items, limit, least).collect())) for f in (se.relevant_pairs, _pairs_one_by_one))
        assert len(want) > 300 and got == want
    plan = se.relevant_pairs(queries, items)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(zip_with" not in plan
