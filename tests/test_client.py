import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronoloom.client import Client
from chronoloom.functions import adapters as ad
from chronoloom.operators import resolve

T = dt.datetime(2024, 1, 1)
EP = "uuid string, name string, content string, source string, group_id string, reference timestamp"


def episodes(spark, *rows):
    return spark.createDataFrame([(u, u, c, "chat", "g", T + dt.timedelta(hours=i)) for i, (u, c) in enumerate(rows)], EP)


def test_a_conversation_from_add_to_clear(spark, tmp_path):
    c = Client(spark)
    c.add(episodes(spark, ("e1", "Alice knows Robert. Robert likes Paris."), ("e2", "Carol visited Paris")))
    c.save(str(tmp_path), 1)
    c.load(str(tmp_path), 1)
    names = {r.name: r.uuid for r in c.entities.collect()}
    assert set(names) == {"Alice", "Robert", "Paris", "Carol"}
    c.add(episodes(spark, ("e1", "Zelda appears")))  # known already
    assert c.entities.count() == 4
    assert c.get_node(names["Alice"], "g").label == "entity"
    with pytest.raises(KeyError):
        c.get_node("nobody", "g")
    nodes, edges = c.get_nodes_and_edges_by_episode("e2")
    assert {r.name for r in nodes.collect()} == {"Carol", "Paris"} and edges.count() == 1
    assert c.get_edge(edges.head().uuid).src_name == "Carol"
    assert [r.uuid for r in c.get_episodes("g", "2024-01-02 00:00:00").collect()] == ["e1", "e2"]
    hits = c.search("who visited Paris", group_ids=["g"]).collect()
    assert {"node", "edge", "episode"} == {r.kind for r in hits} and all(r.fact for r in hits)
    assert any("Paris" in f for f in c.get_memory(["Paris?", " "])) and c.get_memory([" "]) == []
    c.add_triplet(spark.createDataFrame([("Alice", "Dora", "KNOWS", "Alice knows Dora", "g", T)], "src_name string, dst_name string, name string, fact string, group_id string, valid_at timestamp"))
    assert c.entities.count() == 5 and c.edges.filter("name = 'KNOWS'").count() == 1
    assert c.execute_query("select count(*) n from entities").head().n == 5
    assert {(r.kind, r.type): r.n for r in c.stats().collect()}["node", "entity"] == 5
    c.remove_episode("e2")
    assert {r.name for r in c.entities.collect()} == {"Alice", "Robert", "Paris", "Dora"}
    c.clear_graph()
    assert c.entities.count() == c.edges.count() == c.episodes.count() == 0


def test_facts_are_extended_closed_or_added(spark):
    schema = "uuid string, src string, dst string, name string, fact string, valid_at timestamp, invalid_at timestamp, expired_at timestamp, episodes array<string>"
    h = lambda n: T + dt.timedelta(hours=n)
    known = spark.createDataFrame([("k1", "a", "b", "LIKES", "a likes b", h(0), None, None, ["e0"]), ("k2", "a", "c", "AGE", "a is 4", h(0), None, None, ["e0"]), ("k3", "a", "c", "AGE", "a is 3", h(-9), h(-1), h(-1), ["e0"])], schema)
    new = spark.createDataFrame([("n1", "b", "a", "LIKES", "A  likes b", h(1), None, None, ["e1"]), ("n2", "a", "c", "AGE", "a is 5", h(2), None, None, ["e2"])], schema)
    got = {r.uuid: (r.state, r.invalid_at, r.episodes) for r in resolve.resolve_edges(new, known).collect()}
    assert got == {"k1": ("extended", None, ["e0", "e1"]), "k2": ("closed", h(2), ["e0"]), "k3": ("kept", h(-1), ["e0"]), "n2": ("new", None, ["e2"])}
    never = {r.uuid: r.state for r in resolve.resolve_edges(new, known, lambda a, b: "").collect()}
    assert never == {"k1": "kept", "k2": "kept", "k3": "kept", "n1": "new", "n2": "new"}
    told = resolve.dated(known, spark.createDataFrame([("k1", '"2023-05-06T07:08:09Z"', "no")], "uuid string, valid_text string, invalid_text string")).filter("uuid = 'k1'").head()
    assert told.valid_at == dt.datetime(2023, 5, 6, 7, 8, 9) and told.invalid_at is None


def test_embeddings_only_where_missing(spark):
    df = spark.createDataFrame([("a", "red fox", [9.0]), ("b", "red fox", None), ("c", "", [])], "uuid string, text string, vec array<float>")
    got = {r.uuid: r.vec for r in ad.with_missing_embeddings(df, "text", "vec", ad.HashEmbedder(8)).collect()}
    assert got["a"] == [9.0] and sum(x * x for x in got["b"]) == pytest.approx(1) and got["c"] == [0.0] * 8


def test_cross_scores_and_batches_fill_what_is_missing(spark):
    class Half:
        def score(self, query, passages):
            if "bad" in query:
                raise OSError
            return [float(len(p)) for p in passages][:1]

    df = spark.createDataFrame([("q", "aaa"), ("q", "b"), ("bad", "c")], "query string, passage string").coalesce(1)
    assert sorted(r.score for r in ad.cross_scores(df, Half()).collect()) == [0.5, 0.5, 3.0]
    out = ad.in_batches(df, lambda rows: [r["passage"].upper() for r in rows][:2], "summary", 2).orderBy(F.length("passage").desc()).collect()
    assert out[0].summary == "AAA" and len(out) == 3


def test_call_wrappers():
    seen, waits = [], []

    def flaky(x):
        seen.append(x)
        if len(seen) < 3:
            raise OSError
        return x

    assert ad.Retrying(flaky, sleep=waits.append)(7) == 7 and waits == [1.0, 2.0]
    now = [0.0]

    def broken():
        raise OSError

    b = ad.CircuitBreaker(broken, clock=lambda: now[0])
    for _ in range(3):
        with pytest.raises(OSError):
            b()
    with pytest.raises(ad.CircuitOpen):
        b()
    now[0], b.call = 61.0, lambda: 1
    assert b() == 1 and b() == 1
    r = ad.Router(lambda: "default", {"Extract": broken, "judge": lambda: "judge"})
    assert (r("EXTRACT"), r("Judge"), r(None)) == ("default", "judge", "default")
    cache = ad.TimedCache(10, clock=lambda: now[0])
    assert cache.get("k", lambda: 1) == 1 and cache.get("k", lambda: 2) == 1
    now[0] += 11
    assert cache.get("k", lambda: 2) == 2


def test_replies_are_asked_for_until_they_read():
    parts = iter(['<think>x</think>{"a": [1, 2', "2, 3]}"])
    assert ad.json_until_valid(lambda m: next(parts), []) == {"a": [1, 2, 3]}
    with pytest.raises(ValueError):
        ad.json_until_valid(lambda m: "nothing", [], 2)
    replies = iter(["no table", "name\tkind\nAlice\tperson\nBob"])
    assert ad.rows_until_valid(lambda m: next(replies), [], ["name"]) == [{"name": "Alice"}]
