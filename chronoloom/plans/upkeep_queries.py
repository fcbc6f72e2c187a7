"""Merges of whole rows, repeated ingestion, community upkeep, recipes with vectors and small helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx
from ..operators import community as cm
from ..operators import dedup as dd
from ..operators import ingest as ing
from ..operators import search as se
from ..operators import store as st
from ..operators import telemetry as tl
from ..sources import delimited as dl
from .registry import query, sql_stamp, stamp
from .search_queries import _bm25_sql

# ---- merges


@query("upsert_edges_whole", f"""
WITH ok AS (SELECT CASE WHEN quantity % 2 = 0 THEN uuid ELSE 'N' || uuid END AS uuid, src, dst, group_id, 'UPDATED' AS name, 'new fact' AS fact, valid_at FROM facts WHERE quantity <> 7)
SELECT coalesce(n.uuid, r.uuid) AS uuid, coalesce(n.src, r.src) AS src, coalesce(n.dst, r.dst) AS dst, coalesce(n.group_id, r.group_id) AS group_id, coalesce(n.name, r.name) AS name, coalesce(n.fact, r.fact) AS fact,
  array_to_string(r.episodes, ',') AS episodes, {sql_stamp("r.created_at", "created_at")}, {sql_stamp("coalesce(n.valid_at, r.valid_at)", "valid_at")},
  strftime(CASE WHEN n.uuid IS NULL THEN r.invalid_at END, '%Y-%m-%d %H:%M:%S') AS invalid_at, strftime(CASE WHEN n.uuid IS NULL THEN r.expired_at END, '%Y-%m-%d %H:%M:%S') AS expired_at
FROM relates_to r FULL JOIN ok n ON r.uuid = n.uuid AND r.group_id = n.group_id""")
def upsert_edges_whole(g, spark, d):
    """Every column after a merge; each new row comes a second time in an older state."""
    q = F.expr("cast(element_at(split(fact, ' '), -1) as int)")
    new = g.relates_to.withColumn("q", q).select(F.when(F.col("q") % 2 == 0, F.col("uuid")).otherwise(F.concat(F.lit("N"), "uuid")).alias("uuid"), "src", F.when(F.col("q") == 7, "missing").otherwise(F.col("dst")).alias("dst"), "group_id", F.lit("UPDATED").alias("name"), F.lit("new fact").alias("fact"), "valid_at", F.lit(None).cast("timestamp").alias("invalid_at"))
    older = new.withColumn("valid_at", F.expr("valid_at - interval 1 day")).withColumn("fact", F.lit("old fact"))
    out = st.upsert_edges(g.relates_to, new.unionByName(older), g.entity)
    return out.select("uuid", "src", "dst", "group_id", "name", "fact", F.array_join("episodes", ",").alias("episodes"), *[stamp(c) for c in ("created_at", "valid_at", "invalid_at", "expired_at")])


@query("upsert_entities_whole", f"""
WITH upd AS (SELECT uuid, group_id, name || '!' AS name, created_at + INTERVAL 1 DAY AS updated_at FROM entity WHERE label = 'Part'), n AS (SELECT * FROM upd UNION ALL SELECT 'X' || uuid, group_id, name, updated_at FROM upd)
SELECT coalesce(e.uuid, n.uuid) AS uuid, coalesce(n.name, e.name) AS name, e.label, e.summary, CASE WHEN e.uuid IS NOT NULL THEN length(e.name) END AS size, {sql_stamp("coalesce(e.created_at, n.updated_at)", "created_at")}, {sql_stamp("coalesce(n.updated_at, e.created_at)", "updated_at")}
FROM entity e FULL JOIN n ON e.uuid = n.uuid AND e.group_id = n.group_id""")
def upsert_entities_whole(g, spark, d):
    """Columns that the new rows lack (labels, summary, an embedding) and rows that they do not touch stay as they were."""
    old = g.entity.withColumn("updated_at", F.col("created_at")).withColumn("embedding", F.array(F.length("name").cast("float")))
    again = g.entity.filter("uuid LIKE 'P%'").select("uuid", "group_id", F.concat("name", F.lit("!")).alias("name"), F.expr("created_at + interval 1 day").alias("updated_at"))
    out = st.upsert_entities(old, again.unionByName(again.withColumn("uuid", F.concat(F.lit("X"), "uuid"))))
    return out.select("uuid", "name", F.get("labels", F.lit(0)).alias("label"), "summary", F.get("embedding", F.lit(0)).cast("long").alias("size"), stamp("created_at"), stamp("updated_at"))


def _memberships(g):
    """Nations over all entities of their own and other groups, regions over nations, and ids that are nowhere."""
    one = g.has_member.select("src", "dst", "group_id")
    up = g.entity.select(F.lit("N1").alias("src"), F.col("uuid").alias("dst"), F.lit("g0").alias("group_id"))
    over = g.community.select(F.lit("R1").alias("src"), F.col("uuid").alias("dst"), F.lit("g0").alias("group_id"))
    return one.unionByName(up).unionByName(over).unionByName(over.withColumn("src", F.lit("nobody")))


@query("upsert_community_edges", """
WITH fresh AS (SELECT 'N1' AS src, uuid AS dst, 'entity' AS dst_label FROM entity WHERE group_id = 'g0' UNION SELECT 'R1', uuid, 'community' FROM community)
SELECT src, dst_label, count(*) AS n, count(DISTINCT uuid) AS ids FROM (SELECT uuid, src, dst, dst_label FROM has_member UNION SELECT src || '-' || dst, src, dst, dst_label FROM fresh) GROUP BY ALL""")
def upsert_community_edges(g, spark, d):
    out = st.upsert_community_edges(st.upsert_community_edges(g.has_member, _memberships(g), g.entity, g.community), _memberships(g), g.entity, g.community)
    return out.groupBy("src", "dst_label").agg(F.count("*").alias("n"), F.countDistinct("uuid").alias("ids"))


# ---- ingestion


def _places(spark, d, prefix: str, at: str):
    n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    # Digits as letters: names are capitalised words of letters.
    said = F.concat_ws(" ", F.initcap(F.translate("n_name", "0123456789_", "abcdefghij")), F.lit("joins"), F.initcap("r_name"))
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit(prefix), "n_nationkey").alias("uuid"), F.lit("said").alias("name"), said.alias("content"), F.lit("text").alias("source"), F.lit("g").alias("group_id"), F.to_timestamp(F.lit(at)).alias("reference"))


_PLACES = """said AS (SELECT n_nationkey AS k, list_transform(string_split(translate(lower(n_name), '0123456789_', 'abcdefghij') || ' ' || lower(r_name), ' '), lambda x: upper(x[1]) || x[2:]) AS w FROM nation JOIN region ON n_regionkey = r_regionkey),
  names AS (SELECT k, list_filter(w, lambda x: length(x) >= 4) AS w FROM said), pairs AS (SELECT k, w[i] AS s, w[i + 1] AS t FROM names, range(1, 10) r(i) WHERE i < len(w))"""


@query("ingest_twice", f"""WITH {_PLACES}
SELECT s || ' followed_by ' || t AS fact, (2 * count(DISTINCT k))::INT AS episodes, true AS is_open, '2024-01-01 00:00:00' AS valid_at FROM pairs GROUP BY s, t""")
def ingest_twice(g, spark, d):
    """Facts said in January and again in February: each stays open, begins where it was first said and lists both episodes."""
    first = ing.ingest(_places(spark, d, "jan-", "2024-01-01 00:00:00"))
    again = ing.ingest(_places(spark, d, "feb-", "2024-02-01 00:00:00"), known_edges=first.edges)
    return again.edges.select("fact", F.size("episodes").alias("episodes"), F.col("invalid_at").isNull().alias("is_open"), stamp("valid_at"))


@query("ingest_places", f"""WITH {_PLACES} SELECT x AS name, count(DISTINCT k) AS episodes FROM (SELECT k, unnest(w) AS x FROM names) GROUP BY x""")
def ingest_places(g, spark, d):
    return ing.ingest(_places(spark, d, "jan-", "2024-01-01 00:00:00")).entities.select("name", "episodes")


@query("ingest_place_mentions", f"""WITH {_PLACES} SELECT DISTINCT 'jan-' || k AS episode, x AS name FROM (SELECT k, unnest(w) AS x FROM names)""")
def ingest_place_mentions(g, spark, d):
    got = ing.ingest(_places(spark, d, "jan-", "2024-01-01 00:00:00"))
    return got.mentions.join(got.entities.select(F.col("uuid").alias("e"), "name"), F.col("dst") == F.col("e")).select(F.col("src").alias("episode"), "name")


@query("sink_round_trip", f"""WITH {_PLACES}, e AS (SELECT DISTINCT x FROM (SELECT unnest(w) AS x FROM names)), f AS (SELECT DISTINCT s, t FROM pairs), m AS (SELECT DISTINCT k, x FROM (SELECT k, unnest(w) AS x FROM names))
SELECT 'episodes' AS name, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'entities', (SELECT count(*) FROM e) UNION ALL SELECT 'edges', (SELECT count(*) FROM f) UNION ALL SELECT 'mentions', (SELECT count(*) FROM m)""")
def sink_round_trip(g, spark, d):
    """The four sinks written to the session's shared folder and read again."""
    import uuid

    dd.ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/sink-{uuid.uuid4().hex}"
    got = ing.ingest(_places(spark, d, "jan-", "2024-01-01 00:00:00"))
    ing.write_tables(got, path)
    out = None
    for name in ("episodes", "entities", "edges", "mentions"):
        back = spark.read.parquet(f"{path}/{name}")
        same = back.select(*getattr(got, name).columns)
        one = same.agg(F.lit(name).alias("name"), F.count("*").alias("n")).select("name", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("add_to_episode", "SELECT uuid, CASE WHEN source = 'message' THEN content || chr(10) || 'first' || chr(10) || 'second' ELSE content END AS content FROM episodic")
def add_to_episode(g, spark, d):
    turns = g.episodic.filter("source = 'message'")
    more = turns.select("uuid", F.lit("second").alias("content")).unionByName(turns.select("uuid", F.lit("first").alias("content")))
    return ing.add_to_episode(g.episodic, more.unionByName(spark.createDataFrame([("nobody", "x")], "uuid string, content string"))).select("uuid", "content")


@query("entity_episodes", "SELECT 'g0-entity-' || epoch(created_at)::BIGINT AS uuid, 'Entity creation: ' || name AS name, 'New ' || CASE WHEN length(name) % 2 = 0 THEN 'Part' ELSE 'entity' END || ' entity: ' || name || CASE WHEN summary <> '' THEN ' with attributes: map[about:' || summary || ' kind:x]' ELSE '' END AS content FROM entity WHERE group_id = 'g0' AND uuid NOT LIKE 'P1%'")
def entity_episodes(g, spark, d):
    told = F.when(F.col("summary") != "", F.create_map(F.lit("kind"), F.lit("x"), F.lit("about"), F.col("summary"))).otherwise(F.create_map().cast("map<string,string>"))
    given = g.entity.select(F.when(F.col("group_id") == "g0", F.col("group_id")).alias("group_id"), F.when(~F.col("uuid").startswith("P1"), F.col("name")).otherwise("").alias("name"), F.when(F.length("name") % 2 == 0, "Part").alias("entity_type"), told.alias("attributes"), F.col("created_at").alias("reference"))
    return ing.entity_episodes(given).select("uuid", "name", "content")


@query("fit_to_persist", f"SELECT uuid, {sql_stamp('created_at')}, '2024-05-05 00:00:00' AS valid_from, 0 AS pairs FROM entity WHERE uuid NOT LIKE '%7' AND summary <> ''")
def fit_to_persist(g, spark, d):
    bare = F.lit(None).cast("timestamp")
    nodes = g.entity.select("uuid", F.when(~F.col("uuid").endswith("7"), F.col("name")).otherwise("").alias("name"), "group_id", F.col("summary").alias("type"), "created_at", bare.alias("updated_at"), bare.alias("valid_from"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return ing.fit_to_persist(nodes, F.to_timestamp(F.lit("2024-05-05 00:00:00"))).select("uuid", stamp("created_at"), stamp("valid_from"), F.size("metadata").alias("pairs"))


# ---- communities


@query("update_communities", """
WITH own AS (SELECT src AS k, min(dst) AS one FROM has_member WHERE dst LIKE 'S%' GROUP BY src), said AS (SELECT m.src AS k, min(e.name) AS s FROM has_member m JOIN entity e ON m.dst = e.uuid WHERE e.label = 'Supplier' AND substr(e.uuid, 2)::BIGINT % 2 = 0 GROUP BY m.src)
SELECT c.uuid, least(c.name, coalesce(s, c.name)) AS summary, (SELECT count(*) FROM has_member) AS members FROM community c LEFT JOIN said ON c.uuid = k""")
def update_communities(g, spark, d):
    """Suppliers of even number come in; the least text stands for a merged summary."""
    added = g.entity.filter("uuid LIKE 'S%' and cast(substring(uuid, 2) as bigint) % 2 = 0").select("uuid", F.col("name").alias("summary"))
    out, members = cm.update_communities(added, g.relates_to.limit(0), g.community.withColumn("summary", F.col("name")), g.has_member, merge=min)
    n = members.count()
    return out.select("uuid", "summary", F.lit(n).cast("long").alias("members"))


@query("communities_by_level", "SELECT uuid, name FROM community WHERE level = 1 AND group_id = 'g0'")
def communities_by_level(g, spark, d):
    return cm.at_level(g.community, 1, "g0").select("uuid", "name")


@query("remove_communities", "SELECT 'entity' AS label, count(*) AS n FROM entity UNION ALL SELECT 'episodic', count(*) FROM episodic")
def remove_communities(g, spark, d):
    nodes, links = cm.remove_communities(g.nodes(), g.has_member)
    return nodes.unionByName(links.select(*[F.lit(None).cast(t).alias(c) for c, t in nodes.dtypes])).groupBy("label").agg(F.count("*").alias("n"))


@query("community_components", """
WITH r AS (SELECT 'R' || r_regionkey AS c, 'R' || r_regionkey AS x FROM region UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation UNION ALL SELECT 'R' || n_regionkey, 'S' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'R' || n_regionkey, 'C' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT uuid, low AS community_id FROM community JOIN r ON uuid = x JOIN (SELECT c, min(x) AS low FROM r GROUP BY c) l ON r.c = l.c""")
def community_components(g, spark, d):
    return cm.component_ids(g.has_member, g.community)


@query("community_edge", "SELECT uuid, src, dst, dst_label FROM has_member WHERE src IN ('N1', 'R1')")
def community_edge(g, spark, d):
    return g.has_member.filter(F.col("src").isin("N1", "R1")).select("uuid", "src", "dst", "dst_label")


# ---- retrieval with vectors

#: Eight numbers from a text's MD5: a stand-in for an embedding that every engine can work out.
_MD5 = "[" + ", ".join(f"(('0x' || substr(md5({{0}}), {2 * i + 1}, 2))::INT - 127.5) / 128.0::DOUBLE" for i in range(8)) + "]::DOUBLE[]"


def md5_vector(c):
    return F.array(*[(F.conv(F.substring(F.md5(c), 2 * i + 1, 2), 16, 10).cast("double") - 127.5) / 128.0 for i in range(8)])


def _md5_of(text: str) -> list[float]:
    import hashlib

    h = hashlib.md5(text.encode()).digest()
    return [(x - 127.5) / 128.0 for x in h[:8]]


QUERY = "returned P10 S1 Asia"
_QV = "[" + ", ".join(repr(x) for x in _md5_of(QUERY)) + "]::DOUBLE[]"


def vector_corpora(g):
    items = lambda t, body: t.select("uuid", body.alias("text")).withColumn("embedding", md5_vector(F.col("text")))
    return {
        "node": se.Corpus(items(g.entity, F.concat_ws(" ", "name", "summary")), g.relates_to, g.mentions),
        "edge": se.Corpus(items(g.relates_to, F.concat_ws(" ", "name", "fact"))),
        "community": se.Corpus(items(g.community, F.col("name"))),
    }


def _found_sql(src: str, limit: int) -> str:
    near = f"(SELECT uuid, list_cosine_similarity({_MD5.format('text')}, {_QV}) AS score FROM {src})"
    return f"""text AS (SELECT uuid, row_number() OVER (ORDER BY score DESC, uuid) - 1 AS rank0 FROM ({_bm25_sql(src, ["returned", "p10", "s1", "asia"])}) ORDER BY score DESC, uuid LIMIT {limit}),
near AS (SELECT uuid, row_number() OVER (ORDER BY score DESC, uuid) - 1 AS rank0 FROM {near} WHERE score > 0 ORDER BY score DESC, uuid LIMIT {limit}),
fused AS (SELECT uuid, sum(1.0::DOUBLE / (rank0 + 60)) AS score FROM (SELECT * FROM text UNION ALL SELECT * FROM near) GROUP BY uuid)"""


_NODES = "(SELECT uuid, concat_ws(' ', name, summary) AS text FROM entity)"
_FACTS = "(SELECT uuid, concat_ws(' ', name, fact) AS text FROM relates_to)"
_PLACE = "(SELECT uuid, name AS text FROM community)"


def _recipe(g, kind: str, name: str):
    return se.search({kind: vector_corpora(g)[kind]}, name, QUERY, _md5_of(QUERY)).select("uuid", F.round("score", 6).alias("score"))


@query("recipe_nodes_rrf", f"WITH {_found_sql(_NODES, 20)} SELECT uuid, round(score, 6) AS score FROM fused ORDER BY fused.score DESC, uuid LIMIT 10")
def recipe_nodes_rrf(g, spark, d):
    return _recipe(g, "node", "node_hybrid_rrf")


@query("recipe_edges_rrf", f"WITH {_found_sql(_FACTS, 20)} SELECT uuid, round(score, 6) AS score FROM fused ORDER BY fused.score DESC, uuid LIMIT 10")
def recipe_edges_rrf(g, spark, d):
    return _recipe(g, "edge", "edge_hybrid_rrf")


@query("recipe_communities_rrf", f"WITH {_found_sql(_PLACE, 20)} SELECT uuid, round(score, 6) AS score FROM fused ORDER BY fused.score DESC, uuid LIMIT 10")
def recipe_communities_rrf(g, spark, d):
    return _recipe(g, "community", "community_hybrid_rrf")


def _mmr_sql(src: str, balance: str) -> str:
    return f"""WITH {_found_sql(src, 20)}, v AS (SELECT s.uuid, {_MD5.format("text")} AS v FROM {src} s JOIN fused USING (uuid)),
m AS (SELECT a.uuid, {balance}::DOUBLE * any_value(list_cosine_similarity(a.v, {_QV})) - (1 - {balance}::DOUBLE) * greatest(0, max(list_cosine_similarity(a.v, b.v))) AS score FROM v a JOIN v b ON a.uuid <> b.uuid GROUP BY a.uuid)
SELECT uuid, round(score, 6) + 0.0 AS score FROM m ORDER BY m.score DESC, uuid LIMIT 10"""


@query("recipe_nodes_mmr", _mmr_sql(_NODES, "0.5"))
def recipe_nodes_mmr(g, spark, d):
    return _recipe(g, "node", "node_hybrid_mmr").withColumn("score", F.col("score") + 0.0)


@query("recipe_communities_mmr", _mmr_sql(_PLACE, "0.5"))
def recipe_communities_mmr(g, spark, d):
    return _recipe(g, "community", "community_hybrid_mmr").withColumn("score", F.col("score") + 0.0)


@query("entities_by_embedding", f"SELECT uuid, round(score, 6) + 0.0 AS score FROM (SELECT uuid, list_cosine_similarity({_MD5.format('text')}, {_QV}) AS score FROM (SELECT uuid, concat_ws(' ', name, summary) AS text FROM entity WHERE label = 'Supplier')) WHERE score > 0 ORDER BY score DESC, uuid LIMIT 10")
def entities_by_embedding(g, spark, d):
    """Entities of one type, nearest to a query first."""
    own = vector_corpora(g)["node"].items.join(g.entity.filter(F.array_contains("labels", "Supplier")).select("uuid"), "uuid", "left_semi")
    return se.vector_top(own.select("uuid", "embedding"), _md5_of(QUERY), 10).select("uuid", (F.round("score", 6) + 0.0).alias("score"))


@query("community_similarity", f"SELECT uuid, round(score, 6) + 0.0 AS score FROM (SELECT uuid, list_cosine_similarity({_MD5.format('name')}, {_QV}) AS score FROM community) WHERE score >= 0.1")
def community_similarity(g, spark, d):
    return se.vector_top(vector_corpora(g)["community"].items.select("uuid", "embedding"), _md5_of(QUERY), None, 0.1, False).select("uuid", (F.round("score", 6) + 0.0).alias("score"))


@query("default_rerank", "SELECT DISTINCT uuid, 1.0::DOUBLE AS score FROM (SELECT dst AS uuid FROM mentions) ORDER BY uuid LIMIT 10")
def default_rerank(g, spark, d):
    return se.default_rerank(g.mentions.select(F.col("dst").alias("uuid")), 0)


@query("recipe_needs_embedding", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', true)" for n in sorted(se.RECIPES)) + ", ('text only', false)) t(recipe, needed)")
def recipe_needs_embedding(g, spark, d):
    rows = [(n, se.needs_embedding(n)) for n in se.RECIPES] + [("text only", se.needs_embedding(se.Recipe(node=se.Part(("bm25",)))))]
    return spark.createDataFrame(rows, "recipe string, needed boolean")


@query("boolean_rerank", "SELECT l_returnflag AS flag, l_linestatus AS status, (CASE WHEN l_returnflag = 'A' THEN 0.8 WHEN l_returnflag = 'N' THEN 0.2 ELSE 0.5 END)::DOUBLE AS said, (CASE WHEN l_linestatus = 'F' THEN 0.25 ELSE 1.0 END)::DOUBLE AS number FROM lineitem GROUP BY ALL")
def boolean_rerank(g, spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).distinct()
    said = F.when(F.col("flag") == "A", " TRUE, surely").when(F.col("flag") == "N", "False").otherwise("perhaps")
    number = F.when(F.col("status") == "F", "Score: .25 of 1").otherwise("7 points")
    return li.select("flag", "status", se.judged(said).alias("said"), se.numeric_reply(number).alias("number"))


@query("first_of_rows", "SELECT dst AS uuid, min(src) AS first FROM mentions GROUP BY dst")
def first_of_rows(g, spark, d):
    rows = g.mentions.select(F.col("dst").alias("uuid"), "src").unionByName(g.mentions.select(F.lit("").alias("uuid"), "src"))
    return dd.first_of(rows.unionByName(rows), "uuid", "src").select("uuid", F.col("src").alias("first"))


# ---- helpers


@query("text_shapes", """
SELECT uuid, regexp_full_match(name, '[a-zA-Z0-9_-]*') AS as_group, false AS as_uuid, name AS without_last, false AS last_empty, length(trim(summary)) > 0 AS present, length(name) BETWEEN 5 AND 12 AS in_range, len(string_split(name, ' ')) BETWEEN 1 AND 2 AS in_length FROM entity""")
def text_shapes(g, spark, d):
    lines = F.concat("name", F.lit("\n"), "uuid")
    return g.entity.select("uuid", tx.valid_group_id(F.col("name")).alias("as_group"), tx.uuid_shape(F.col("uuid")).alias("as_uuid"), tx.without_last_line(lines).alias("without_last"), tx.last_line_empty(lines).alias("last_empty"), tx.is_present(F.col("summary")).alias("present"), tx.is_between(F.length("name"), 5, 12).alias("in_range"), tx.is_of_length(F.split("name", " "), 1, 2).alias("in_length"))


@query("joined_with_overlap", "SELECT n_nationkey, n_name || ' end' AS joined, 'caf\u00e9'[:3] || '\\u00e9' AS escaped FROM nation")
def joined_with_overlap(g, spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    return n.select("n_nationkey", tx.append_overlap(F.col("n_name"), F.concat(F.substring("n_name", 2, 100), F.lit(" end"))).alias("joined"), tx.escape_non_ascii(F.lit("caf\u00e9")).alias("escaped"))


@query("ordered_distinct", "SELECT o_custkey, array_to_string(list(x ORDER BY k), ',') AS seen FROM (SELECT o_custkey, o_orderpriority AS x, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY o_custkey")
def ordered_distinct(g, spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    return o.groupBy("o_custkey").agg(rows.alias("r")).select("o_custkey", F.array_join(tx.distinct_in_order(F.transform("r", lambda x: x["o_orderpriority"])), ",").alias("seen"))


@query("vector_helpers", "SELECT vec_id, round((1 + s) / 2, 6) AS shifted, round(d / (aa * bb), 6) + 0.0 AS by_squares, true AS sized, 2 AS kept FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s, list_dot_product(embedding::DOUBLE[], q) AS d, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS aa, list_dot_product(q, q) AS bb FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1))")
def vector_helpers(g, spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    q = v.filter("vec_id = 1").select(F.col("embedding").alias("q"))
    a, b = F.col("embedding"), F.col("q")
    return v.join(F.broadcast(q)).select("vec_id", F.round(vx.shifted_cosine(a, b), 6).alias("shifted"), (F.round(vx.dot_over_square_norms(a, b), 6) + 0.0).alias("by_squares"), vx.has_dimensions(a, 64).alias("sized"), F.size(vx.to_vector(F.array(F.lit("1.5"), F.lit("x"), F.lit("-2")))).alias("kept"))


@query("json_rows", """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def json_rows(g, spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    return dl.to_json_rows(n, ["n_name", "n_regionkey"]).select(F.get_json_object("line", "$.n_name").alias("n_name"), "line").join(n.select("n_nationkey", F.col("n_name").alias("k")), F.col("n_name") == F.col("k")).select("n_nationkey", "line")


@query("stamped_json", """SELECT o_orderkey, '{"o":{"at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '"},"all":["' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '"],"none":null}' AS line FROM orders""")
def stamped_json(g, spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    deep = o.select("o_orderkey", F.struct("at").alias("o"), F.array("at").alias("all"), F.lit(None).cast("timestamp").alias("none"))
    line = dl.stamped_json(deep.select("o_orderkey", "o", "all", "none"), ["o_orderkey", "o", "all", "none"]).select(F.get_json_object("line", "$.o_orderkey").cast("long").alias("o_orderkey"), F.regexp_replace("line", '"o_orderkey":[0-9]+,', "").alias("line"))
    return line


@query("error_log", """SELECT event_id AS id, event_type AS level, 'e' || event_id AS message, 'u' || user_id AS user_id, '' AS session_id, '{"value":"' || event_id || '"}' AS attributes FROM (SELECT event_id, user_id, ['DEBUG', 'INFO', 'WARN', 'ERROR', 'ERROR+2', 'WARN+4'][event_id % 6 + 1] AS event_type FROM events) WHERE event_type IN ('ERROR', 'ERROR+2', 'WARN+4')""")
def error_log(g, spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    level = F.element_at(F.array(*[F.lit(x) for x in ("DEBUG", "INFO", "WARN", "ERROR", "ERROR+2", "WARN+4")]), (F.col("event_id") % 6 + 1).cast("int"))
    records = e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), level.alias("level"), F.concat(F.lit("e"), "event_id").alias("message"), F.create_map(F.lit("user_id"), F.concat(F.lit("u"), "user_id")).alias("context"), F.create_map(F.lit("value"), F.col("event_id").cast("string")).alias("attributes"), F.lit("x").alias("source_file"), F.lit(1).alias("line_number"))
    return tl.error_log(records).select("id", "level", "message", "user_id", "session_id", "attributes")
