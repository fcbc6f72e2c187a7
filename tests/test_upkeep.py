import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronoloom.client import Client
from chronoloom.functions.adapters import HashEmbedder
from chronoloom.operators import community as cm
from chronoloom.operators import dedup as dd
from chronoloom.operators import ingest as ing
from chronoloom.operators import resolve
from chronoloom.operators import store as st

T = dt.datetime(2024, 1, 1)
EP = "uuid string, name string, content string, source string, group_id string, reference timestamp"


def episode(spark, uuid, content, days=0):
    return spark.createDataFrame([(uuid, uuid, content, "chat", "g", T + dt.timedelta(days=days))], EP)


def test_a_restated_fact_stays_open_and_lists_both_episodes(spark):
    c = Client(spark)
    c.add(episode(spark, "e1", "Alice knows Robert well"), fuzzy=False)
    c.add(episode(spark, "e2", "Alice knows Robert well", 31), fuzzy=False)
    (edge,) = c.edges.collect()
    assert edge.invalid_at is None and edge.episodes == ["e1", "e2"] and edge.valid_at == T
    c.add(episode(spark, "e3", "Robert wrote to Alice", 60), fuzzy=False)  # another fact of the pair closes nothing
    assert c.edges.filter("invalid_at is null").count() == 2


def test_a_fact_said_again_after_its_end_begins_anew(spark):
    first = ing.ingest(episode(spark, "e1", "Alice knows Robert")).edges
    ended = first.withColumn("invalid_at", F.lit(T + dt.timedelta(days=3))).withColumn("expired_at", F.col("invalid_at"))
    got = {r.valid_at: r for r in ing.ingest(episode(spark, "e2", "Alice knows Robert", 9), known_edges=ended).edges.collect()}
    old, new = got[T], got[T + dt.timedelta(days=9)]
    assert old.episodes == ["e1"] and old.invalid_at == T + dt.timedelta(days=3)
    assert new.episodes == ["e2"] and new.invalid_at is None and new.uuid != old.uuid


def test_a_judge_closes_contradicted_facts_only(spark):
    link = lambda text, names: [("Alice", "Paris", text.split()[1].upper())]
    names = lambda text: [("Alice", "Entity"), ("Paris", "Entity")]
    first = ing.ingest(episode(spark, "e1", "Alice lives in Paris"), names, link).edges
    second = episode(spark, "e2", "Alice left Paris", 5)
    judge = lambda new, old: "contradicts" if "lives" in old and "left" in new else ""
    got = {r.name: r for r in ing.ingest(second, names, link, known_edges=first, judge=judge).edges.collect()}
    assert got["LIVES"].invalid_at == T + dt.timedelta(days=5) == got["LEFT"].valid_at and got["LEFT"].invalid_at is None
    kept = ing.ingest(second, names, link, known_edges=first).edges
    assert kept.filter("invalid_at is null").count() == 2


def test_like_names_are_one_node_within_their_group(spark):
    known = spark.createDataFrame([("k1", "Christopher Robinson Junior", "g"), ("k2", "Christopher Robinson Junior", "h")], "uuid string, name string, group_id string")
    pick = lambda text: [(n, "Entity") for n in text.split(";")]
    got = ing.ingest(episode(spark, "e1", "Christopher Robinson, Junior!;Maximilian Featherstone;Maximilian Featherstone.;Zed"), pick, lambda t, n: [(n[0], n[1], "KNOWS"), (n[1], n[2], "KNOWS")], known_entities=known, fuzzy=True)
    ids = {r.uuid for r in got.entities.collect()}
    assert len(ids) == 3 and "k1" in ids and "k2" not in ids
    (edge,) = got.edges.collect()  # the link between the two spellings is gone
    assert edge.src == "k1" and edge.dst in ids


def test_text_is_added_to_an_episode(spark):
    class Counting(HashEmbedder):
        pass

    c = Client(spark, Counting(8))
    c.add(episode(spark, "e1", "Alice knows Robert"))
    c.add_to_episode("e1", "Robert visited London")
    (e,) = c.episodes.collect()
    assert e.content == "Alice knows Robert\nRobert visited London" and len(e.embedding) == 8
    assert {r.name for r in c.entities.collect()} == {"Alice", "Robert", "London"}
    assert all(len(r.embedding) == 8 for t in (c.entities, c.edges) for r in t.collect())
    with pytest.raises(KeyError):
        c.add_to_episode("nothing", "x")
    c.add_entities(spark.createDataFrame([("g", "Wonderland", "Place", {"size": "big"}, T), ("", "Nowhere", "", {}, T), ("g", "", "", {}, T)], "group_id string, name string, entity_type string, attributes map<string,string>, reference timestamp"))
    assert c.entities.filter("name = 'Wonderland'").count() == 1 and c.episodes.count() == 2
    assert c.search("Wonderland").filter("kind = 'node'").orderBy("rank").head().fact.startswith("Wonderland")


def test_merges_keep_every_column_and_one_row_a_key(spark):
    cols = "uuid string, src string, dst string, group_id string, name string, fact string, valid_at timestamp, invalid_at timestamp, expired_at timestamp, created_at timestamp, episodes array<string>, embedding array<float>"
    old = spark.createDataFrame([(u, "a", "b", "g", "N", "f", T, None, None, T, ["e"], [1.0]) for u in ("x", "y")], cols)
    entity = spark.createDataFrame([("a",), ("b",)], "uuid string")
    new = spark.createDataFrame([("x", "a", "b", "g", "M", "new", T, T), ("x", "a", "b", "g", "M", "new", T, T), ("z", "a", "b", "g", "M", "z", T, None), ("q", "a", "gone", "g", "M", "q", T, None)], "uuid string, src string, dst string, group_id string, name string, fact string, valid_at timestamp, invalid_at timestamp")
    got = {r.uuid: r for r in st.upsert_edges(old, new, entity).collect()}
    assert set(got) == {"x", "y", "z"} and st.upsert_edges(old, new, entity).count() == 3
    assert got["y"] == old.filter("uuid = 'y'").head()
    assert (got["x"].name, got["x"].episodes, got["x"].embedding, got["x"].created_at, got["x"].expired_at) == ("M", ["e"], [1.0], T, T)


def plain_map(pairs):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in list(root)}


def test_components_of_long_chains_and_cycles(spark):
    rng = random.Random(3)
    ids = [f"n{i:04d}" for i in range(300)]
    rng.shuffle(ids)
    pairs = list(zip(ids, ids[1:], strict=False)) + [("a", "a"), ("p", "q"), ("q", "p"), ("r", "p")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert {r.alias: r.canonical for r in dd.undirected_map(df).collect()} == plain_map(pairs)
    chain = [(f"c{i}", f"c{i + 1}", 0) for i in range(40)] + [("x", "y", 0), ("y", "z", 0), ("z", "y", 0), ("w", "x", 0), ("s", "s", 0)]
    got = {r.alias: r.canonical for r in dd.directed_map(spark.createDataFrame(chain, "alias string, parent string, pos int")).collect()}
    assert got == {f"c{i}": "c40" for i in range(40)} | {"x": "y", "y": "y", "z": "y", "w": "y", "s": "s"}


def test_stars_connect_what_pairs_connect(spark):
    rng = random.Random(5)
    rows = [(f"e{i}", "s", rng.choice("xy"), " ".join(rng.sample(["red", "blue", "green", "old", "new", "far"], 2)), [1.0, float(i % 2)] if i % 3 == 0 else []) for i in range(40)]
    df = spark.createDataFrame(rows, "uuid string, src string, dst string, text string, embedding array<float>")
    whole = {r.alias: r.canonical for r in dd.undirected_map(dd.similar_edges(df)).collect()}
    assert {r.alias: r.canonical for r in dd.undirected_map(dd.similar_edge_links(df)).collect()} == whole and whole


def test_clusters_stay_within_their_group(spark):
    entity = spark.createDataFrame([(f"{g}{i}", g) for g in "gh" for i in range(6)], "uuid string, group_id string")
    edges = [(f"{g}{a}", f"{g}{b}") for g in "gh" for a, b in ((0, 1), (1, 2), (0, 2), (3, 4))] + [("g0", "h0")] * 9
    df = spark.createDataFrame(edges, "src string, dst string")
    both = {(r.group_id, r.node, r.label) for r in cm.clusters_by_group(df, entity).collect()}
    alone = {(r.group_id, r.node, r.label) for g in "gh" for r in cm.clusters_by_group(df, entity, [g]).collect()}
    assert both == alone and {n for _, n, _ in both} >= {"g0", "h3"} and all(label[0] == g == n[0] for g, n, label in both)


def test_large_communities_are_reduced_in_parts(spark, monkeypatch):
    monkeypatch.setattr(cm, "REDUCED", 4)
    rows = spark.createDataFrame([("a", f"n{i:03d}", f"t{i:03d}") for i in range(50)] + [("b", "n", "only")], "k string, node string, text string")
    got = {r.k: r.summary for r in cm.reduce_texts(rows, min).collect()}
    assert got == {"a": "t000", "b": "only"}


def test_entities_join_communities(spark):
    communities = spark.createDataFrame([("k1", "old name", "mmm"), ("k2", "other", "zzz")], "uuid string, name string, summary string")
    members = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k2", "c")], "src string, dst string")
    edges = spark.createDataFrame([("d", "a"), ("b", "d"), ("d", "c"), ("e", "e2")], "src string, dst string")
    added = spark.createDataFrame([("d", "bbb ccc"), ("e", "nobody"), ("a", "")], "uuid string, summary string")
    out, after = cm.update_communities(added, edges, communities, members, merge=min)
    got = {r.uuid: (r.name, r.summary) for r in out.collect()}
    assert got == {"k1": ("bbb ccc", "bbb ccc"), "k2": ("other", "zzz")}
    assert sorted(tuple(r) for r in after.collect()) == [("k1", "a"), ("k1", "b"), ("k1", "d"), ("k2", "c")]


def test_unknown_facts_change_nothing(spark):
    schema = "uuid string, src string, dst string, name string, fact string, valid_at timestamp, invalid_at timestamp, expired_at timestamp, episodes array<string>, group_id string, created_at timestamp"
    known = spark.createDataFrame([("k", "a", "b", "N", "f", T, None, None, None, "g", T)], schema)
    assert [(r.uuid, r.state, r.group_id, r.created_at) for r in resolve.resolve_edges(known.limit(0), known).collect()] == [("k", "kept", "g", T)]
    assert [(r.uuid, r.state) for r in resolve.resolve_edges(known, known.limit(0)).collect()] == [("k", "new")]


def test_links_of_a_hub_are_split(spark):
    """A hub that most links lead to: one component, and the join that its links meet in is split at run time."""
    from pyspark.sql import functions as F

    tiny = {"skewedPartitionThresholdInBytes": "1k", "skewedPartitionFactor": "1.0"}
    conf = {f"spark.sql.adaptive.skewJoin.{k}": v for k, v in tiny.items()} | {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        links = spark.range(0, 6000, 1, 6).select((F.col("id") + 1).alias("a"), F.lit(0).cast("long").alias("b"))
        both = links.union(links.select("b", "a"))
        low = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        joined = both.join(low, dd.split_key("a") == dd.split_key("k"))
        assert len(joined.collect()) == 12000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        assert {r.canonical for r in dd.undirected_map(links).collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
