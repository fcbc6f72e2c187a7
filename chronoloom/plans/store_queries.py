"""Lookups, merges, deletes, filters and temporal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as fl
from ..operators import graph as gr
from ..operators import store as st
from ..operators import temporal as tm
from .registry import query, sql_stamp, stamp

T0 = "1997-06-01 00:00:00"
T1 = "1997-12-31 00:00:00"
IDS = ["P7", "S3", "P1", "C9", "nobody"]


@query("get_node", "SELECT uuid, name, group_id, 'entity' AS label FROM entity WHERE uuid = 'P7' AND group_id = 'g0'")
def get_node(g, spark, d):
    return st.get_node(g.nodes(), "P7", "g0").select("uuid", "name", "group_id", "label")


@query("get_nodes", "SELECT pos::INT AS pos, uuid, name FROM entity JOIN (SELECT unnest(range(5)) AS pos, unnest(['P7', 'S3', 'P1', 'C9', 'nobody']) AS want) ON uuid = want WHERE group_id = 'g0'")
def get_nodes(g, spark, d):
    return st.get_nodes(g.nodes(), IDS, "g0").select("pos", "uuid", "name")


@query("node_exists", "SELECT count(*) > 0 AS found FROM entity WHERE uuid = 'S3' AND group_id = 'g0'")
def node_exists(g, spark, d):
    return st.exists(g.nodes(), "S3", "g0")


def edge_ids(g):
    """Ids of the facts of three orders, and one that does not exist."""
    rows = g.relates_to.filter(F.get("episodes", F.lit(0)).isin("O1", "O2", "O3")).select("uuid").collect()
    return [r.uuid for r in rows] + ["none"]


_ids = "SELECT uuid FROM relates_to WHERE episodes[1] IN ('O1', 'O2', 'O3')"


@query("edge_exists", f"SELECT count(*) > 0 AS found FROM ({_ids})")
def edge_exists(g, spark, d):
    return st.exists(g.relates_to, edge_ids(g)[0], "g0")



@query("get_edges", f"SELECT r.uuid, src, dst, r.name, fact, a.name AS src_name, b.name AS dst_name, {sql_stamp('valid_at')} FROM relates_to r JOIN entity a ON a.uuid = src JOIN entity b ON b.uuid = dst WHERE r.uuid IN ({_ids}) AND r.group_id = 'g0'")
def get_edges(g, spark, d):
    return st.get_edges(g.relates_to, g.entity, edge_ids(g), "g0").select("uuid", "src", "dst", "name", "fact", "src_name", "dst_name", stamp("valid_at"))


@query("get_episodic", f"SELECT uuid, name, source, content, {sql_stamp('valid_at')} FROM episodic WHERE uuid IN ('O1', 'O7', '3-0')")
def get_episodic(g, spark, d):
    return g.episodic.filter(F.col("uuid").isin("O1", "O7", "3-0")).select("uuid", "name", "source", "content", stamp("valid_at"))


@query("edges_between", "SELECT uuid, name, fact FROM relates_to WHERE src = 'S1' AND dst = 'P10'")
def edges_between(g, spark, d):
    return st.edges_between(g.relates_to, "S1", "P10").select("uuid", "name", "fact")


@query("get_between_nodes", "SELECT uuid, src, dst, fact FROM relates_to WHERE (src = 'S1' AND dst = 'P10') OR (src = 'P10' AND dst = 'S1')")
def get_between_nodes(g, spark, d):
    return st.get_between_nodes(g.relates_to.select("uuid", "src", "dst", "fact"), "S1", "P10")


@query("mention_edges", "SELECT uuid, src, dst FROM mentions WHERE src IN ('O1', 'O2', 'O3', 'O32')")
def mention_edges(g, spark, d):
    return g.mentions.filter(F.col("src").isin("O1", "O2", "O3", "O32")).select("uuid", "src", "dst")


@query("entities_by_group", "SELECT uuid, name, label, summary FROM entity WHERE group_id = 'g1'")
def entities_by_group(g, spark, d):
    return st.by_group(g.entity, "g1").select("uuid", "name", F.get("labels", F.lit(0)).alias("label"), "summary")


@query("group_ids", "SELECT DISTINCT group_id FROM (SELECT group_id FROM entity UNION ALL SELECT group_id FROM episodic) WHERE group_id IS NOT NULL")
def group_ids(g, spark, d):
    return st.group_ids(g.entity, g.episodic)


def _updates(g):
    """Every part in group g0 again, some with an empty name or summary, at a later time; and as many new entities."""
    key = F.expr("try_cast(substring(uuid, 2) AS bigint)")
    again = g.entity.filter("uuid LIKE 'P%'").select("uuid", "group_id", F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("new "), "name")).alias("name"), F.array(F.lit("Updated")).alias("labels"), F.when(key % 2 == 0, F.lit("")).otherwise(F.lit("changed")).alias("summary"), F.expr("created_at + interval 1 day").alias("updated_at"))
    return again.unionByName(again.withColumn("uuid", F.concat(F.lit("X"), "uuid")))


@query("upsert_entities", f"""
WITH upd AS (
  SELECT uuid, group_id, CASE WHEN substr(uuid, 2)::BIGINT % 3 = 0 THEN '' ELSE 'new ' || name END AS name, ['Updated'] AS labels,
    CASE WHEN substr(uuid, 2)::BIGINT % 2 = 0 THEN '' ELSE 'changed' END AS summary, created_at + INTERVAL 1 DAY AS updated_at FROM entity WHERE label = 'Part'
), n AS (SELECT * FROM upd UNION ALL SELECT 'X' || uuid, group_id, name, labels, summary, updated_at FROM upd)
SELECT coalesce(e.uuid, n.uuid) AS uuid, coalesce(e.group_id, n.group_id) AS group_id, coalesce(nullif(n.name, ''), e.name) AS name,
  CASE WHEN n.uuid IS NULL THEN e.label ELSE n.labels[1] END AS label, coalesce(nullif(n.summary, ''), e.summary) AS summary, {sql_stamp("coalesce(e.created_at, n.updated_at)", "created_at")}
FROM entity e FULL JOIN n ON e.uuid = n.uuid AND e.group_id = n.group_id""")
def upsert_entities(g, spark, d):
    out = st.upsert_entities(g.entity, _updates(g))
    return out.select("uuid", "group_id", "name", F.get("labels", F.lit(0)).alias("label"), "summary", stamp("created_at"))


@query("upsert_edges", """
WITH fresh AS (SELECT CASE WHEN quantity % 2 = 0 THEN uuid ELSE 'N' || uuid END AS uuid, src, CASE WHEN quantity = 7 THEN 'missing' ELSE dst END AS dst, group_id, 'UPDATED' AS name, 'new fact' AS fact FROM facts),
ok AS (SELECT * FROM fresh WHERE src IN (SELECT uuid FROM entity) AND dst IN (SELECT uuid FROM entity))
SELECT name, count(*) AS n, count(DISTINCT uuid) AS ids FROM (SELECT uuid, name FROM relates_to r WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.uuid = r.uuid AND ok.group_id = r.group_id) UNION ALL SELECT uuid, name FROM ok) GROUP BY name""")
def upsert_edges(g, spark, d):
    q = F.expr("cast(element_at(split(fact, ' '), -1) as int)")
    new = g.relates_to.withColumn("q", q).select(F.when(F.col("q") % 2 == 0, F.col("uuid")).otherwise(F.concat(F.lit("N"), "uuid")).alias("uuid"), "src", F.when(F.col("q") == 7, "missing").otherwise(F.col("dst")).alias("dst"), "group_id", F.lit("UPDATED").alias("name"), F.lit("new fact").alias("fact"), "valid_at", "invalid_at")
    return st.upsert_edges(g.relates_to, new, g.entity).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("uuid").alias("ids"))


@query("upsert_mentions", """
WITH more AS (SELECT DISTINCT 'O' || l_orderkey AS src, 'S' || l_suppkey AS dst, 'g0' AS group_id FROM lineitem)
SELECT substr(dst, 1, 1) AS kind, count(*) AS n FROM (SELECT src, dst, group_id FROM mentions UNION SELECT * FROM more) GROUP BY ALL""")
def upsert_mentions(g, spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    more = li.select(F.concat(F.lit("O"), "l_orderkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"), F.lit("g0").alias("group_id"))
    out = st.upsert_mentions(st.upsert_mentions(g.mentions, more), more.unionByName(g.mentions.select("src", "dst", "group_id")))
    return out.groupBy(F.substring("dst", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query("delete_nodes", "SELECT (SELECT count(*) FROM entity WHERE label <> 'Supplier') AS nodes, (SELECT count(*) FROM relates_to WHERE src NOT IN (SELECT uuid FROM entity WHERE label = 'Supplier') AND dst NOT IN (SELECT uuid FROM entity WHERE label = 'Supplier')) AS edges")
def delete_nodes(g, spark, d):
    left, rest = st.delete_nodes(g.entity, g.relates_to, g.entity.filter(F.array_contains("labels", "Supplier")))
    return left.agg(F.count("*").alias("nodes")).join(rest.agg(F.count("*").alias("edges")))


@query("delete_edges", f"SELECT count(*) AS n FROM relates_to WHERE NOT (uuid IN ({_ids}) AND group_id = 'g0')")
def delete_edges(g, spark, d):
    return st.delete_edges(g.relates_to, edge_ids(g), "g0").agg(F.count("*").alias("n"))


@query("clear_group", "SELECT group_id, count(*) AS n FROM entity WHERE group_id <> 'g1' GROUP BY 1")
def clear_group(g, spark, d):
    return st.clear_groups(g.entity, ["g1"]).groupBy("group_id").agg(F.count("*").alias("n"))


_stats = """
WITH parts AS (SELECT 'node' AS kind, 'entity' AS type, group_id FROM entity UNION ALL SELECT 'node', 'episodic', group_id FROM episodic UNION ALL SELECT 'node', 'community', group_id FROM community
  UNION ALL SELECT 'edge', 'relates_to', group_id FROM relates_to UNION ALL SELECT 'edge', 'mentions', group_id FROM mentions UNION ALL SELECT 'edge', 'has_member', group_id FROM has_member)
SELECT kind, type, count(*) AS n FROM parts {where} GROUP BY ALL UNION ALL SELECT kind, 'total', count(*) FROM parts {where} GROUP BY kind"""


def _stat(g, group):
    return st.graph_stats(g.nodes(), {"relates_to": g.relates_to, "mentions": g.mentions, "has_member": g.has_member}, group)


@query("graph_stats", _stats.format(where=""))
def graph_stats(g, spark, d):
    return _stat(g, None)


@query("graph_stats_of_group", _stats.format(where="WHERE group_id = 'g0'"))
def graph_stats_of_group(g, spark, d):
    return _stat(g, "g0")


_MAP = "SELECT uuid AS alias, first_value(uuid) OVER (PARTITION BY name ORDER BY uuid) AS canonical FROM entity"


@query("resolve_pointers", f"""WITH m AS ({_MAP}) SELECT coalesce(a.canonical, src) AS src, coalesce(b.canonical, dst) AS dst, count(*) AS n FROM relates_to LEFT JOIN m a ON src = a.alias LEFT JOIN m b ON dst = b.alias GROUP BY 1, 2""")
def resolve_pointers(g, spark, d):
    least = g.entity.groupBy("name").agg(F.min("uuid").alias("canonical")).withColumnRenamed("name", "n")
    m = g.entity.join(least, F.col("name") == F.col("n")).select(F.col("uuid").alias("alias"), "canonical")
    return st.resolve_pointers(g.relates_to, m).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("orphan_edges", "SELECT uuid, 'missing src' AS problem FROM relates_to WHERE src NOT IN (SELECT uuid FROM entity WHERE name NOT LIKE '%1') UNION ALL SELECT uuid, 'missing dst' FROM relates_to WHERE dst NOT IN (SELECT uuid FROM entity WHERE name NOT LIKE '%1')")
def orphan_edges(g, spark, d):
    return st.orphan_edges(g.relates_to, g.entity.filter("name NOT LIKE '%1'"))


@query("integrity_report", """
WITH n AS (SELECT uuid FROM entity WHERE label <> 'Supplier' OR uuid < 'S5')
SELECT problem, count(*) AS n FROM (SELECT 'missing src' AS problem FROM relates_to WHERE src NOT IN (SELECT uuid FROM n) UNION ALL SELECT 'missing dst' FROM relates_to WHERE dst NOT IN (SELECT uuid FROM n)
  UNION ALL SELECT 'node without embedding' FROM entity UNION ALL SELECT 'edge without embedding' FROM relates_to UNION ALL SELECT 'node without name' FROM entity WHERE trim(coalesce(name, '')) = '') GROUP BY problem""")
def integrity_report(g, spark, d):
    nodes = g.entity.filter(~F.array_contains("labels", "Supplier") | (F.col("uuid") < "S5"))
    return st.integrity_report(nodes, g.relates_to, g.entity)


@query("remove_episode", """
WITH once AS (SELECT dst FROM mentions GROUP BY dst HAVING count(*) = 1), gone AS (SELECT dst FROM mentions WHERE src = 'O1' AND dst IN (SELECT dst FROM once))
SELECT (SELECT count(*) FROM entity WHERE uuid NOT IN (SELECT dst FROM gone)) AS entities,
  (SELECT count(*) FROM relates_to WHERE episodes[1] <> 'O1' AND src NOT IN (SELECT dst FROM gone) AND dst NOT IN (SELECT dst FROM gone)) AS edges, (SELECT count(*) FROM mentions WHERE src <> 'O1') AS mentions""")
def remove_episode(g, spark, d):
    e, r, m = st.remove_episode("O1", g.entity, g.relates_to, g.mentions)
    return e.agg(F.count("*").alias("entities")).join(r.agg(F.count("*").alias("edges"))).join(m.agg(F.count("*").alias("mentions")))


@query("node_filter", "SELECT label, count(*) AS n FROM entity WHERE label IN ('Part', 'Customer') AND group_id IN ('g0', 'g1') GROUP BY 1")
def node_filter(g, spark, d):
    nodes = g.entity.withColumn("label", F.get("labels", F.lit(0)))
    return nodes.filter(fl.node_condition(fl.SearchFilters(labels=["Part", "Customer"], group_ids=["g0", "g1"]))).groupBy("label").agg(F.count("*").alias("n"))


@query("edge_filter", "SELECT name, count(*) AS n FROM relates_to WHERE name IN ('RETURNED', 'OFFERED') AND group_id = 'g0' AND src IN (SELECT uuid FROM entity WHERE label IN ('Part', 'Supplier')) AND dst IN (SELECT uuid FROM entity WHERE label IN ('Part', 'Supplier')) GROUP BY 1")
def edge_filter(g, spark, d):
    f = fl.SearchFilters(edge_types=["RETURNED", "OFFERED"], group_ids=["g0"], labels=["Part", "Supplier"])
    return fl.filter_edges(g.relates_to, f, g.entity.withColumn("label", F.get("labels", F.lit(0)))).groupBy("name").agg(F.count("*").alias("n"))


@query("date_filter_dnf", f"SELECT uuid, {sql_stamp('valid_at')} FROM relates_to WHERE ((valid_at >= TIMESTAMP '{T0}' AND valid_at < TIMESTAMP '{T1}') OR valid_at = TIMESTAMP '1995-01-01') AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{T1}')")
def date_filter_dnf(g, spark, d):
    D = fl.DateFilter
    f = fl.SearchFilters(valid_at=[[D(">=", T0), D("<", T1)], [D("=", "1995-01-01 00:00:00")]], invalid_at=[[D("IS NULL")], [D(">", T1)]])
    return fl.filter_edges(g.relates_to, f).select("uuid", stamp("valid_at"))


@query("nodes_in_time_range", f"SELECT uuid, {sql_stamp('created_at')} FROM entity WHERE created_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-12' AND group_id = 'g0'")
def nodes_in_time_range(g, spark, d):
    return fl.in_time_range(g.entity, "2024-01-02 00:00:00", "2024-01-12 00:00:00", "g0").select("uuid", stamp("created_at"))


@query("edges_in_time_range", f"SELECT DISTINCT uuid, src, dst, {sql_stamp('created_at')} FROM relates_to WHERE created_at BETWEEN TIMESTAMP '{T0}' AND TIMESTAMP '{T1}' AND src IN (SELECT uuid FROM entity) AND dst IN (SELECT uuid FROM entity)")
def edges_in_time_range(g, spark, d):
    return st.with_endpoints(fl.in_time_range(g.relates_to, T0, T1), g.entity).select("uuid", "src", "dst", stamp("created_at")).distinct()


@query("retrieve_episodes", f"SELECT (row_number() OVER (ORDER BY valid_at, uuid DESC) - 1)::INT AS pos, uuid, {sql_stamp('valid_at')} FROM (SELECT * FROM episodic WHERE valid_at <= TIMESTAMP '{T0}' AND group_id = 'g0' ORDER BY valid_at DESC, uuid LIMIT 10)")
def retrieve_episodes(g, spark, d):
    return fl.retrieve_episodes(g.episodic, T0, 0, ["g0"]).select("pos", "uuid", stamp("valid_at"))


@query("node_fact", "SELECT uuid, CASE WHEN summary <> '' THEN summary ELSE name || ' is a ' || label END AS fact FROM entity")
def node_fact(g, spark, d):
    nodes = g.entity.withColumn("content", F.lit(None).cast("string")).withColumn("label", F.get("labels", F.lit(0)))
    return nodes.select("uuid", fl.node_fact().alias("fact"))


@query("edge_fact", "SELECT uuid, fact || ' [' || strftime(valid_at, '%Y-%m-%dT%H:%M:%SZ') || ' - ' || coalesce(strftime(invalid_at, '%Y-%m-%dT%H:%M:%SZ'), 'present') || ']' AS line FROM relates_to")
def edge_fact(g, spark, d):
    return g.relates_to.select("uuid", F.concat(fl.edge_fact(), F.lit(" ["), fl.date_range_text(F.col("valid_at"), F.col("invalid_at")), F.lit("]")).alias("line"))


@query("active_edges_at", f"SELECT uuid FROM relates_to WHERE valid_at <= TIMESTAMP '{T0}' AND (invalid_at IS NULL OR invalid_at >= TIMESTAMP '{T0}')")
def active_edges_at(g, spark, d):
    return tm.active_at(g.relates_to, T0).select("uuid")


@query("known_edges_at", f"SELECT uuid FROM relates_to WHERE created_at <= TIMESTAMP '{T0}' AND (expired_at IS NULL OR expired_at > TIMESTAMP '{T0}')")
def known_edges_at(g, spark, d):
    return tm.known_at(g.relates_to, T0).select("uuid")


@query("edge_lifespan", "SELECT uuid, date_diff('second', valid_at, invalid_at) AS seconds FROM relates_to")
def edge_lifespan(g, spark, d):
    return g.relates_to.select("uuid", tm.lifespan_seconds().alias("seconds"))


@query("temporal_consistency", f"SELECT uuid, level, problem FROM (SELECT uuid, 'error' AS level, 'ends before it begins' AS problem FROM relates_to WHERE invalid_at < valid_at UNION ALL SELECT uuid, 'warning', 'expired at creation' FROM relates_to WHERE expired_at <= created_at UNION ALL SELECT uuid, 'warning', 'begins in the future' FROM relates_to WHERE valid_at > TIMESTAMP '{T1}' + INTERVAL 24 HOUR)")
def temporal_consistency(g, spark, d):
    return tm.consistency(g.relates_to, T1)


@query("temporal_invalidation", f"""
WITH cand AS (SELECT uuid, src, dst, valid_at, NULL::TIMESTAMP AS invalid_at FROM relates_to WHERE name <> 'RETURNED'), fresh AS (SELECT src, dst, valid_at AS f, invalid_at AS t FROM relates_to WHERE name = 'RETURNED'),
ends AS (SELECT c.uuid, min(f) AS e FROM cand c JOIN fresh n ON c.src = n.src AND c.dst = n.dst AND c.valid_at < n.f AND (c.invalid_at IS NULL OR c.invalid_at >= n.f) AND (n.t IS NULL OR n.t >= c.valid_at) GROUP BY c.uuid)
SELECT uuid, {sql_stamp('valid_at')}, {sql_stamp('e', 'invalid_at')} FROM cand LEFT JOIN ends USING (uuid)""")
def temporal_invalidation(g, spark, d):
    open_ = g.relates_to.filter("name <> 'RETURNED'").withColumn("invalid_at", F.lit(None).cast("timestamp")).withColumn("expired_at", F.lit(None).cast("timestamp"))
    return tm.invalidate(open_, g.relates_to.filter("name = 'RETURNED'")).select("uuid", stamp("valid_at"), stamp("invalid_at"))


@query("previous_episodes_24h", "SELECT a.uuid, count(b.uuid) AS previous FROM episodic a LEFT JOIN episodic b ON a.group_id = b.group_id AND b.valid_at < a.valid_at AND b.valid_at >= a.valid_at - INTERVAL 24 HOUR GROUP BY a.uuid")
def previous_episodes_24h(g, spark, d):
    return tm.previous_within(g.episodic)


@query("episode_context", "SELECT uuid, array_to_string(list(uuid) OVER (PARTITION BY group_id ORDER BY valid_at, uuid ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), ',') AS context FROM episodic")
def episode_context(g, spark, d):
    return tm.context_of(g.episodic).select("uuid", F.when(F.size("context") > 0, F.array_join("context", ",")).alias("context"))


@query("parse_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS back FROM events")
def parse_time(g, spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "'\"'yyyy-MM-dd'T'HH:mm:ss'Z\"'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return ev.select("event_id", F.date_format(tm.parse_time(text), "yyyy-MM-dd'T'HH:mm:ss").alias("back"))


_UND = "und AS (SELECT src AS a, dst AS b FROM relates_to UNION ALL SELECT dst, src FROM relates_to)"


@query("neighbors_k", f"WITH {_UND}, h1 AS (SELECT DISTINCT b AS uuid FROM und WHERE a = 'S1' AND b <> 'S1'), h2 AS (SELECT DISTINCT b AS uuid FROM und WHERE a IN (SELECT uuid FROM h1) AND b <> 'S1' AND b NOT IN (SELECT uuid FROM h1)) SELECT uuid, 1 AS depth FROM h1 UNION ALL SELECT uuid, 2 FROM h2")
def neighbors_k(g, spark, d):
    return gr.neighbors_within(g.relates_to, "S1", 2)


@query("neighbors_directed", "SELECT 'out' AS way, uuid FROM (SELECT DISTINCT dst AS uuid FROM relates_to WHERE src = 'S1') UNION ALL SELECT 'in', uuid FROM (SELECT DISTINCT src AS uuid FROM relates_to WHERE dst = 'S1') UNION ALL SELECT 'both', uuid FROM (SELECT dst AS uuid FROM relates_to WHERE src = 'S1' UNION SELECT src FROM relates_to WHERE dst = 'S1')")
def neighbors_directed(g, spark, d):
    parts = [gr.neighbors(g.relates_to, "S1", w).select(F.lit(w).alias("way"), "uuid") for w in ("out", "in", "both")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("temporal_neighbors", f"SELECT DISTINCT dst AS uuid FROM relates_to WHERE src = 'S1' AND created_at <= TIMESTAMP '{T0}' AND (expired_at IS NULL OR expired_at > TIMESTAMP '{T0}')")
def temporal_neighbors(g, spark, d):
    return gr.neighbors(tm.known_at(g.relates_to, T0), "S1", "out")


@query("related_nodes", "SELECT DISTINCT uuid FROM (SELECT dst AS uuid FROM relates_to WHERE src = 'P10' AND name = 'RETURNED' UNION ALL SELECT src FROM relates_to WHERE dst = 'P10' AND name = 'RETURNED')")
def related_nodes(g, spark, d):
    return gr.related_nodes(g.relates_to, "P10", "RETURNED")


@query("node_neighbors", f"WITH {_UND} SELECT a AS node, b AS neighbor, count(*) AS edge_count FROM und GROUP BY 1, 2")
def node_neighbors(g, spark, d):
    return gr.neighbor_counts(g.relates_to, g.entity)


@query("node_bfs", "WITH st AS (SELECT src AS a, dst AS b FROM relates_to UNION SELECT src, dst FROM mentions), h1 AS (SELECT DISTINCT b AS uuid FROM st WHERE a IN ('O1', 'S2')), h2 AS (SELECT DISTINCT b AS uuid FROM st WHERE a IN (SELECT uuid FROM h1) AND b NOT IN (SELECT uuid FROM h1) AND b NOT IN ('O1', 'S2')) SELECT uuid, 1 AS depth FROM h1 WHERE uuid NOT IN ('O1', 'S2') UNION ALL SELECT uuid, 2 FROM h2")
def node_bfs(g, spark, d):
    origins = spark.createDataFrame([("O1",), ("S2",)], "uuid string")
    return gr.node_bfs(g.relates_to, g.mentions, origins, 2, st.by_group(g.entity, "g0"))


@query("edge_bfs", "WITH h1 AS (SELECT DISTINCT dst AS uuid FROM relates_to WHERE src = 'S1') SELECT uuid, 1 AS depth FROM relates_to WHERE src = 'S1' UNION ALL SELECT uuid, 2 FROM relates_to WHERE src IN (SELECT uuid FROM h1) AND src <> 'S1'")
def edge_bfs(g, spark, d):
    return gr.edge_bfs(g.relates_to, gr.one(spark, "S1"), 2).select("uuid", "depth")


@query("edges_of_node", "SELECT uuid, src, dst FROM relates_to WHERE src = 'P10' OR dst = 'P10'")
def edges_of_node(g, spark, d):
    return gr.edges_of(g.relates_to, "P10").select("uuid", "src", "dst")


@query("shortest_paths", """
WITH s AS (SELECT DISTINCT src AS a, dst AS b FROM relates_to), h1 AS (SELECT b AS uuid, 'S1>' || b AS path FROM s WHERE a = 'S1' AND b <> 'S1'),
h2 AS (SELECT s.b AS uuid, 'S1>' || min(h1.uuid) || '>' || s.b AS path FROM s JOIN h1 ON s.a = h1.uuid WHERE s.b <> 'S1' AND s.b NOT IN (SELECT uuid FROM h1) GROUP BY s.b)
SELECT 'S1' AS uuid, 0 AS depth, 'S1' AS path UNION ALL SELECT uuid, 1, path FROM h1 UNION ALL SELECT uuid, 2, path FROM h2""")
def shortest_paths(g, spark, d):
    return gr.shortest_paths(g.relates_to, "S1", 2).select("uuid", "depth", F.array_join("path", ">").alias("path"))


@query("all_paths", "SELECT a.uuid || '>' || b.uuid AS path, 2 AS length FROM relates_to a JOIN relates_to b ON a.dst = b.src WHERE a.src = 'S1' AND b.dst = 'S2' UNION ALL SELECT uuid, 1 FROM relates_to WHERE src = 'S1' AND dst = 'S2'")
def all_paths(g, spark, d):
    return gr.all_paths(g.relates_to, "S1", "S2", 2).select(F.array_join("path", ">").alias("path"), "length")


@query("mentioned_nodes", "SELECT uuid, name FROM entity WHERE uuid IN (SELECT dst FROM mentions WHERE src IN ('O1', 'O2', 'O3'))")
def mentioned_nodes(g, spark, d):
    return gr.mentioned_nodes(g.mentions, g.entity, ["O1", "O2", "O3"]).select("uuid", "name")


@query("episode_nodes_and_edges", "SELECT 'node' AS kind, dst AS uuid FROM mentions WHERE src = 'O1' UNION ALL SELECT 'edge', uuid FROM relates_to WHERE list_contains(episodes, 'O1')")
def episode_nodes_and_edges(g, spark, d):
    nodes = gr.mentioned_nodes(g.mentions, g.entity, ["O1"]).select(F.lit("node").alias("kind"), "uuid")
    return nodes.unionByName(gr.edges_of_episode(g.relates_to, "O1").select(F.lit("edge").alias("kind"), "uuid"))


@query("mention_count", "SELECT dst AS uuid, count(*) AS mentions FROM mentions GROUP BY dst")
def mention_count(g, spark, d):
    return gr.mention_counts(g.mentions)


@query("community_members", "SELECT e.uuid, e.name FROM entity e JOIN has_member m ON e.uuid = m.dst WHERE m.src = 'N3'")
def community_members(g, spark, d):
    return gr.community_members(g.has_member, g.entity, "N3").select("uuid", "name")


@query("node_communities", "SELECT uuid, name FROM community WHERE uuid IN (SELECT src FROM has_member WHERE dst IN ('S1', 'C5', 'N3'))")
def node_communities(g, spark, d):
    return gr.communities_of(g.has_member, g.community, ["S1", "C5", "N3"]).select("uuid", "name")


_DEAL = "deal AS (SELECT l_orderkey || '-' || l_linenumber AS uuid, 'S' || l_suppkey AS src, 'C' || o_custkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def deals(spark, d):
    li, o = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("uuid"), F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("C"), "o_custkey").alias("dst"))


@query("inter_community_edges", f"WITH {_DEAL} SELECT a.src AS c1, b.src AS c2, count(DISTINCT deal.uuid) AS edges FROM deal JOIN has_member a ON a.dst = deal.src JOIN has_member b ON b.dst = deal.dst WHERE a.src <> b.src GROUP BY 1, 2")
def inter_community_edges(g, spark, d):
    return gr.inter_community_edges(deals(spark, d), g.has_member)


@query("without_duplicate_links", "SELECT DISTINCT src, dst FROM relates_to r WHERE NOT EXISTS (SELECT 1 FROM relates_to x WHERE x.name = 'RETURNED' AND x.src = r.src AND x.dst = r.dst)")
def without_duplicate_links(g, spark, d):
    return gr.without_duplicate_links(g.relates_to.select("src", "dst").distinct(), g.relates_to, "RETURNED")
