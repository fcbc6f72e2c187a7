"""Retrieval, reranking and community queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as vx
from ..operators import community as cm
from ..operators import graph as gr
from ..operators import search as se
from .registry import query

TEXT = "the nation and region of that"
TERMS = ["the", "nation", "and", "region", "of", "that"]
#: A fixed query vector of 64 dimensions.
VECTOR = [((i * 37) % 64 - 31.5) / 32 for i in range(64)]
_V = "[" + ", ".join(repr(x) for x in VECTOR) + "]::DOUBLE[]"


def _bm25_sql(src: str, terms: list[str], key: str = "uuid") -> str:
    """Okapi BM25 over a relation (key, text)."""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(terms))
    df = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""SELECT {key}, {part} AS score FROM (SELECT {key}, len(t) AS dl, {tf} FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM {src})) r,
      (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM (SELECT len(t) AS dl, {tf} FROM (SELECT list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM {src}))) s WHERE {hit}"""


_DOCS = "(SELECT doc_id AS uuid, text FROM documents)"
_EMB = "(SELECT vec_id AS uuid, list_cosine_similarity(embedding::DOUBLE[], " + _V + ") AS score FROM embeddings)"


def doc_items(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("uuid"), "text")


def vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("uuid"), "embedding", F.col("label").cast("string").alias("group_id"))


def rounded(df, name="score"):
    return df.withColumn(name, F.round(name, 6) + 0.0)


@query("bm25_docs", f"SELECT uuid, round(score, 6) + 0.0 AS score FROM ({_bm25_sql(_DOCS, TERMS)}) ORDER BY score DESC, uuid LIMIT 20")
def bm25_docs(g, spark, d):
    return rounded(se.bm25(doc_items(spark, d), TEXT, 20))


@query("bm25_scores", f"SELECT uuid, round(score, 6) + 0.0 AS score FROM ({_bm25_sql(_DOCS, TERMS)})")
def bm25_scores(g, spark, d):
    return rounded(se.bm25(doc_items(spark, d), TEXT, None))


@query("bm25_edges", f"SELECT uuid, round(score, 6) + 0.0 AS score FROM ({_bm25_sql('(SELECT uuid, fact AS text FROM relates_to)', ['returned', 'p10', 's1'])}) ORDER BY score DESC, uuid LIMIT 20")
def bm25_edges(g, spark, d):
    return rounded(se.bm25(g.relates_to.select("uuid", F.col("fact").alias("text")), "returned P10 S1", 20))


@query("bm25_episodes", f"SELECT uuid, round(score, 6) + 0.0 AS score FROM ({_bm25_sql('(SELECT uuid, content AS text FROM episodic)', TERMS)}) ORDER BY score DESC, uuid LIMIT 20")
def bm25_episodes(g, spark, d):
    return rounded(se.bm25(g.episodic.select("uuid", F.col("content").alias("text")), TEXT, 20))


@query("inverted_index", "SELECT term, uuid, count(*) AS tf, any_value(dl)::INT AS dl FROM (SELECT uuid, len(t) AS dl, unnest(t) AS term FROM (SELECT uuid, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, summary)), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM entity)) GROUP BY term, uuid")
def inverted_index(g, spark, d):
    return se.inverted_index(g.entity.select("uuid", F.concat_ws(" ", "name", "summary").alias("text"))).select("term", "uuid", "tf", "dl")


@query("contains_search", "SELECT uuid, name FROM entity WHERE contains(name, 'er') OR contains(summary, 'er') ORDER BY uuid LIMIT 25")
def contains_search(g, spark, d):
    return se.contains(g.entity, "er", ["name", "summary"], 25).select("uuid", "name")


@query("vector_topk", f"SELECT uuid, round(score, 6) + 0.0 AS score FROM {_EMB} WHERE score > 0 ORDER BY score DESC, uuid LIMIT 10")
def vector_topk(g, spark, d):
    return rounded(se.vector_top(vectors(spark, d), VECTOR, 0))


@query("vector_above", f"SELECT uuid, round(score, 6) + 0.0 AS score FROM {_EMB} WHERE score >= 0.1")
def vector_above(g, spark, d):
    return rounded(se.vector_top(vectors(spark, d), VECTOR, None, 0.1, False))


@query("relevant_nodes", """
WITH p AS (SELECT a.vec_id AS query, b.vec_id AS uuid, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT query, uuid, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, uuid) AS rn FROM p WHERE score >= 0.6) WHERE rn <= 10""")
def relevant_nodes(g, spark, d):
    v = vectors(spark, d)
    return rounded(se.relevant_pairs(v.withColumnRenamed("uuid", "query"), v)).select("query", "uuid", "score")


def _hybrid(spark, d, limit=20):
    text = se.ranked(se.bm25(doc_items(spark, d), TEXT, 2 * limit), "bm25")
    near = se.ranked(se.vector_top(vectors(spark, d), VECTOR, 2 * limit), "cosine")
    return se.rrf([text, near], limit)


_RANKED = f"""text AS (SELECT uuid, row_number() OVER (ORDER BY score DESC, uuid) - 1 AS rank0 FROM ({_bm25_sql(_DOCS, TERMS)}) ORDER BY score DESC, uuid LIMIT 40),
near AS (SELECT uuid, row_number() OVER (ORDER BY score DESC, uuid) - 1 AS rank0 FROM {_EMB} WHERE score > 0 ORDER BY score DESC, uuid LIMIT 40)"""


@query("hybrid_rrf", f"WITH {_RANKED} SELECT uuid, round(sum(1.0::DOUBLE / (rank0 + 60)), 9) AS score FROM (SELECT * FROM text UNION ALL SELECT * FROM near) GROUP BY uuid ORDER BY sum(1.0::DOUBLE / (rank0 + 60)) DESC, uuid LIMIT 20")
def hybrid_rrf(g, spark, d):
    return _hybrid(spark, d).withColumn("score", F.round("score", 9))


_CAND = f"cand AS (SELECT vec_id AS uuid, embedding::DOUBLE[] AS v FROM embeddings JOIN (SELECT uuid FROM {_EMB} WHERE score > 0 ORDER BY score DESC, uuid LIMIT 40) ON vec_id = uuid)"


def _candidates(spark, d):
    v = vectors(spark, d)
    return v.join(se.vector_top(v, VECTOR, 40), "uuid")


@query("mmr_oneshot", f"WITH {_CAND} SELECT a.uuid, round(0.5 * any_value(list_cosine_similarity(a.v, {_V})) - 0.5 * greatest(0, max(list_cosine_similarity(a.v, b.v))), 6) + 0.0 AS score FROM cand a JOIN cand b ON a.uuid <> b.uuid GROUP BY a.uuid")
def mmr_oneshot(g, spark, d):
    return rounded(se.mmr(_candidates(spark, d), VECTOR))


@query("mmr_greedy")
def mmr_greedy(g, spark, d):
    c = _candidates(spark, d).withColumn("query", F.lit("q")).withColumn("query_embedding", se.literal_vector(VECTOR))
    return rounded(se.mmr_greedy(c, 10))


_LOCAL = "nation region thehe that eded"
_STOP = ", ".join(f"'{w}'" for w in se.STOP_WORDS)


@query("local_rerank", f"""
WITH t AS (SELECT doc_id AS uuid, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: len(x) > 2)) AS w FROM documents), k AS (SELECT uuid, w, count(*) AS n FROM t WHERE w NOT IN ({_STOP}) GROUP BY ALL),
s AS (SELECT uuid, sqrt(sum(n * n)) AS size, sum(CASE WHEN w IN ('nation', 'region', 'thehe', 'eded') THEN n ELSE 0 END) AS hit FROM k GROUP BY uuid)
SELECT doc_id AS uuid, round(coalesce(hit / (size * 2), 0), 6) + 0.0 AS score FROM documents LEFT JOIN s ON doc_id = s.uuid""")
def local_rerank(g, spark, d):
    return rounded(se.local_rerank(doc_items(spark, d), _LOCAL))


@query("hash_rerank", """
WITH t AS (SELECT doc_id AS uuid, coalesce(text, '') AS p, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents), h AS (SELECT *, len(list_filter(w, lambda x: x IN ('the', 'and', 'of'))) AS hits FROM t)
SELECT uuid, round(CASE WHEN len(w) = 0 THEN 0 WHEN contains(lower(p), 'the and of') THEN 0.9 WHEN 3 + len(w) - hits = 0 THEN 0 ELSE hits / (3 + len(w) - hits) + ('0x' || substr(md5(p), 1, 2))::INT / 255.0::DOUBLE * 0.1 END, 6) + 0.0 AS score FROM h""")
def hash_rerank(g, spark, d):
    return rounded(se.hash_rerank(doc_items(spark, d), "the and of"))


@query("embedding_rerank", f"WITH s AS (SELECT uuid, score FROM {_EMB} WHERE score >= 0) SELECT uuid, round((score - (SELECT min(score) FROM s)) / ((SELECT max(score) FROM s) - (SELECT min(score) FROM s)), 6) + 0.0 AS score FROM s")
def embedding_rerank(g, spark, d):
    return rounded(se.min_max(vectors(spark, d).select("uuid", vx.cosine(F.col("embedding"), se.literal_vector(VECTOR)).alias("score"))))


@query("node_distance_rerank", """
WITH und AS (SELECT src AS a, dst AS b FROM relates_to UNION SELECT dst, src FROM relates_to), h1 AS (SELECT DISTINCT b AS uuid FROM und WHERE a = 'S1'), h2 AS (SELECT DISTINCT b AS uuid FROM und WHERE a IN (SELECT uuid FROM h1) AND b <> 'S1' AND b NOT IN (SELECT uuid FROM h1))
SELECT e.uuid, CASE WHEN e.uuid = 'S1' THEN 0.1 WHEN h1.uuid IS NOT NULL THEN 0.5 WHEN h2.uuid IS NOT NULL THEN round(1 / 3.0::DOUBLE, 6) ELSE 0 END + 0.0 AS score FROM entity e LEFT JOIN h1 ON e.uuid = h1.uuid LEFT JOIN h2 ON e.uuid = h2.uuid""")
def node_distance_rerank(g, spark, d):
    reach = gr.reach(gr.undirected(g.relates_to), gr.one(spark, "S1"), 2)
    return rounded(se.distance_rerank(g.entity, reach, "S1"))


@query("episode_mentions_rerank", "SELECT e.uuid, count(m.src)::DOUBLE AS score FROM entity e LEFT JOIN mentions m ON e.uuid = m.dst GROUP BY e.uuid")
def episode_mentions_rerank(g, spark, d):
    return se.mentions_rerank(g.entity, gr.mention_counts(g.mentions))


def corpora(g, spark, d):
    none = F.array().cast("array<float>")
    return {
        "node": se.Corpus(g.entity.select("uuid", F.concat_ws(" ", "name", "summary").alias("text"), none.alias("embedding")), g.relates_to, g.mentions),
        "edge": se.Corpus(g.relates_to.select("uuid", F.concat_ws(" ", "name", "fact").alias("text"), none.alias("embedding"))),
        "episode": se.Corpus(g.episodic.select("uuid", F.col("content").alias("text"), none.alias("embedding"))),
        "community": se.Corpus(g.community.select("uuid", F.col("name").alias("text"), none.alias("embedding"))),
    }


def _kind_sql(kind: str, src: str, terms: list[str]) -> str:
    return f"SELECT '{kind}' AS kind, uuid, round(1.0::DOUBLE / (row_number() OVER (ORDER BY score DESC, uuid) - 1 + 60), 9) AS score, (row_number() OVER (ORDER BY score DESC, uuid))::INT AS rank FROM ({_bm25_sql(src, terms)}) ORDER BY rank LIMIT 10"


_Q = ["asia", "returned", "urgent", "s1"]


@query("multi_modal_search", " UNION ALL ".join(f"(SELECT * FROM ({_kind_sql(k, s, _Q)}))" for k, s in (("node", "(SELECT uuid, concat_ws(' ', name, summary) AS text FROM entity)"), ("edge", "(SELECT uuid, concat_ws(' ', name, fact) AS text FROM relates_to)"), ("episode", "(SELECT uuid, content AS text FROM episodic)"), ("community", "(SELECT uuid, name AS text FROM community)"))))
def multi_modal_search(g, spark, d):
    return se.search(corpora(g, spark, d), "combined_hybrid_rrf", "Asia returned urgent S1").withColumn("score", F.round("score", 9))


@query("search_recipes")
def search_recipes(g, spark, d):
    """Every recipe that node and edge corpora can serve, side by side."""
    c = corpora(g, spark, d)
    out = None
    for name, r in se.RECIPES.items():
        if any(getattr(r, k) for k in c):
            one = se.search(c, r, "returned P10 S1", None, "S1").withColumn("recipe", F.lit(name))
            out = one if out is None else out.unionByName(one)
    return out


@query("context_string")
def context_string(g, spark, d):
    hits = se.search(corpora(g, spark, d), "combined_hybrid_rrf", "Asia returned urgent S1").select("kind", F.col("uuid").alias("id"), "rank")
    at = lambda kind, df: df.join(hits.filter(F.col("kind") == kind), F.col("uuid") == F.col("id"))
    facts = at("edge", g.relates_to).select("rank", "fact", F.col("valid_at").cast("string").alias("valid_at"), F.coalesce(F.col("invalid_at").cast("string"), F.lit("Present")).alias("invalid_at"))
    entities = at("node", g.entity).select("rank", F.col("name").alias("entity_name"), "summary")
    episodes = at("episode", g.episodic).select("rank", F.col("source").alias("source_description"), "content")
    communities = at("community", g.community).select("rank", F.col("name").alias("community_name"), F.lit("").alias("summary"))
    return se.context_string(facts, entities, episodes, communities)


#: Suppliers that share a part are neighbours (so the graph is not bipartite); weight: parts shared.
_ADJ = """sp AS (SELECT DISTINCT 'S' || l_suppkey AS s, l_partkey AS p FROM lineitem), adj AS (SELECT a.s AS node, b.s AS neighbor, count(*) AS edge_count FROM sp a JOIN sp b ON a.p = b.p AND a.s <> b.s GROUP BY 1, 2)"""


def _held(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("S"), "l_suppkey").alias("member"), F.col("l_partkey").alias("item"))


def _adjacency(spark, d):
    sp = _held(spark, d).toDF("s", "p").distinct()
    other = sp.withColumnsRenamed({"s": "t", "p": "q"})
    return sp.join(other, (F.col("p") == F.col("q")) & (F.col("s") != F.col("t"))).groupBy(F.col("s").alias("node"), F.col("t").alias("neighbor")).agg(F.count("*").alias("edge_count"))


@query("neighbor_projection", f"WITH {_ADJ} SELECT node, neighbor, edge_count FROM adj")
def neighbor_projection(g, spark, d):
    return _adjacency(spark, d)


#: Rounds until one changes nothing, a hundred at most; each row also says whether its round changed any label.
_ROUNDS = """l(k, node, label, moved) AS (SELECT 0, node, node, true FROM (SELECT DISTINCT node FROM adj) UNION ALL
      (SELECT k, node, new, bool_or(new <> label) OVER () FROM (SELECT l.k + 1 AS k, l.node, l.label, CASE WHEN top IS NULL THEN l.label WHEN top.w > 1 THEN top.label ELSE greatest(l.label, top.label) END AS new FROM l LEFT JOIN
        (SELECT node, max({'w': w, 'label': label}) AS top FROM (SELECT a.node, x.label, sum(edge_count) AS w FROM adj a JOIN l x ON a.neighbor = x.node GROUP BY ALL) GROUP BY node) t ON l.node = t.node WHERE l.moved AND l.k < 100)))"""


@query("label_propagation", f"WITH RECURSIVE {_ADJ}, {_ROUNDS} SELECT node, label FROM l WHERE k = (SELECT max(k) FROM l)")
def label_propagation(g, spark, d):
    return cm.label_propagation_by_items(_held(spark, d))


@query("community_clusters")
def community_clusters(g, spark, d):
    return cm.clusters(cm.label_propagation_by_items(_held(spark, d)))


@query("modal_community", "WITH und AS (SELECT src AS node, dst AS other FROM deal UNION ALL SELECT dst, src FROM deal), v AS (SELECT node, m.src AS community, count(*) AS weight FROM und JOIN has_member m ON other = m.dst GROUP BY ALL) SELECT node, community, weight FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, community) AS k FROM v) WHERE k = 1".replace("FROM deal", "FROM (SELECT 'S' || l_suppkey AS src, 'C' || o_custkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"))
def modal_community(g, spark, d):
    from .store_queries import deals

    return cm.modal_community(deals(spark, d), g.has_member)


@query("determine_community", "WITH r AS (SELECT src AS node, dst AS other FROM relates_to UNION ALL SELECT dst, src FROM relates_to), v AS (SELECT node, m.src AS community, count(*) AS w FROM r JOIN has_member m ON other = m.dst GROUP BY ALL), modal AS (SELECT node, community FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, community) AS k FROM v) WHERE k = 1), own AS (SELECT dst, min(src) AS e FROM has_member GROUP BY dst) SELECT uuid AS node, coalesce(e, community) AS community, e IS NULL AS is_new FROM entity LEFT JOIN own ON uuid = dst LEFT JOIN modal ON uuid = node WHERE coalesce(e, community) IS NOT NULL")
def determine_community(g, spark, d):
    return cm.determine_community(g.entity, g.relates_to, g.has_member)


@query("build_communities")
def build_communities(g, spark, d):
    made, _ = cm.build_communities(cm.label_propagation_by_items(_held(spark, d)), g.entity)
    return made


@query("community_edges")
def community_edges(g, spark, d):
    _, members = cm.build_communities(cm.label_propagation_by_items(_held(spark, d)), g.entity)
    return members


@query("event_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(g, spark, d):
    from ..streaming.ingest import windowed_counts

    ev = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(ev).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("event_sessions", "WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM s) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM k GROUP BY user_id, id")
def event_sessions(g, spark, d):
    from ..streaming.ingest import sessions

    ev = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    s = sessions(ev)
    return s.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("session_start", "session_end")], "n")
