"""Text functions, entity resolution and ingestion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx
from ..operators import dedup as dd
from ..operators import ingest as ing
from ..operators import telemetry as tl
from ..sources import delimited
from .registry import query, sql_stamp, stamp

_EXACT = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_FUZZY = "trim(regexp_replace(regexp_replace(" + _EXACT + ", '[^a-z0-9'' ]', ' ', 'g'), '\\s+', ' ', 'g'))"
#: Three-character shingles of an expression without blanks.
_SH = "CASE WHEN len({0}) = 1 THEN [{0}] WHEN len({0}) >= 3 THEN list_transform(range(1, len({0}) - 1), lambda i: substr({0}, i, 3)) ELSE []::VARCHAR[] END"


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


@query("normalize_names", f"SELECT doc_id, md5({_EXACT.format('text')}) AS exact, md5({_FUZZY.format('text')}) AS fuzzy FROM documents")
def normalize_names(g, spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", F.md5(tx.normalise_exact(t)).alias("exact"), F.md5(tx.normalise_fuzzy(t)).alias("fuzzy"))


@query("name_entropy", f"""
WITH n AS (SELECT uuid, {_FUZZY.format('name')} AS f FROM entity), c AS (SELECT uuid, unnest(string_split(replace(f, ' ', ''), '')) AS ch FROM n), k AS (SELECT uuid, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY ALL),
e AS (SELECT uuid, -sum(p * log2(p)) AS h FROM (SELECT uuid, k / sum(k) OVER (PARTITION BY uuid) AS p FROM k) GROUP BY uuid)
SELECT n.uuid, round(coalesce(h, 0), 6) + 0.0 AS entropy, (len(f) >= 6 OR len(list_filter(string_split(f, ' '), lambda x: x <> '')) >= 2) AND round(coalesce(h, 0), 9) >= 1.5 AS trusted FROM n LEFT JOIN e USING (uuid)""")
def name_entropy(g, spark, d):
    f = tx.normalise_fuzzy(F.col("name"))
    return g.entity.select("uuid", (F.round(tx.entropy(f), 6) + 0.0).alias("entropy"), tx.high_entropy(f).alias("trusted"))


@query("name_shingles", f"SELECT uuid, array_to_string({_SH.format('s')}, '|') AS shingles FROM (SELECT uuid, replace({_FUZZY.format('name')}, ' ', '') AS s FROM entity)")
def name_shingles(g, spark, d):
    return g.entity.select("uuid", F.array_join(tx.shingles(tx.normalise_fuzzy(F.col("name"))), "|").alias("shingles"))


_MINHASH = f"""sh AS (SELECT DISTINCT uuid, unnest({_SH.format('s')}) AS s FROM (SELECT uuid, replace({_FUZZY.format('name')}, ' ', '') AS s FROM entity)),
  sig AS (SELECT uuid, seed, min(substr(sha256(seed || ':' || s), 1, 16)) AS h FROM sh, range(32) r(seed) GROUP BY uuid, seed)"""


@query("minhash_signatures", f"WITH {_MINHASH} SELECT uuid, md5(string_agg(h, '' ORDER BY seed)) AS signature FROM sig GROUP BY uuid")
def minhash_signatures(g, spark, d):
    parts = F.sort_array(F.collect_list(F.struct("seed", "h")))
    return dd.minhash(g.entity).groupBy("uuid").agg(F.md5(F.concat_ws("", F.transform(parts, lambda x: x["h"]))).alias("signature"))


@query("lsh_bands", f"WITH {_MINHASH} SELECT uuid, (seed // 4)::BIGINT AS band, string_agg(h, '' ORDER BY seed) AS value FROM sig GROUP BY uuid, seed // 4")
def lsh_bands(g, spark, d):
    return dd.bands(dd.minhash(g.entity)).select("uuid", F.col("band").cast("long").alias("band"), "value")


def _extracted(g):
    """All entities as extracted names: some with an article, some with a suffix, some shouted; parts as they are, whose names recur."""
    n = F.regexp_extract("uuid", "(\\d+)", 1).cast("long")
    name = F.when(n % 3 == 0, F.upper("name")).when(n % 3 == 1, F.concat("name", F.lit("!"))).otherwise(F.concat(F.lit("The "), "name"))
    return g.entity.select(F.concat(F.lit("x"), "uuid").alias("uuid"), F.when(F.col("uuid").startswith("P"), F.col("name")).otherwise(name).alias("name"))


@query("resolve_names", f"""
WITH ext AS (SELECT 'x' || uuid AS uuid, CASE WHEN uuid LIKE 'P%' THEN name WHEN substr(uuid, 2)::BIGINT % 3 = 0 THEN upper(name) WHEN substr(uuid, 2)::BIGINT % 3 = 1 THEN name || '!' ELSE 'The ' || name END AS name FROM entity),
e AS (SELECT uuid, {_EXACT.format('name')} AS exact, {_FUZZY.format('name')} AS fuzzy FROM ext), x AS (SELECT uuid AS m, {_EXACT.format('name')} AS exact, {_FUZZY.format('name')} AS fuzzy FROM entity),
names AS (SELECT exact, count(*) AS n, min(m) AS one FROM x GROUP BY exact), done AS (SELECT e.uuid, CASE WHEN n = 1 THEN one END AS match, CASE WHEN n = 1 THEN 'exact' ELSE 'ambiguous' END AS how FROM e JOIN names USING (exact)),
rest AS (SELECT e.* FROM e WHERE exact NOT IN (SELECT exact FROM names)), every AS (SELECT fuzzy FROM rest UNION SELECT fuzzy FROM x),
sh AS (SELECT DISTINCT fuzzy, unnest({_SH.format("s")}) AS s FROM (SELECT fuzzy, replace(fuzzy, ' ', '') AS s FROM every)),
sig AS (SELECT fuzzy, seed, min(substr(sha256(seed || ':' || s), 1, 16)) AS h FROM sh, range(32) r(seed) GROUP BY fuzzy, seed), band AS (SELECT fuzzy, seed // 4 AS b, string_agg(h, '' ORDER BY seed) AS v FROM sig GROUP BY fuzzy, seed // 4),
cand AS (SELECT DISTINCT l.fuzzy AS a, r.fuzzy AS b FROM band l JOIN band r ON l.b = r.b AND l.v = r.v WHERE l.fuzzy IN (SELECT fuzzy FROM rest) AND r.fuzzy IN (SELECT fuzzy FROM x)),
sets AS (SELECT fuzzy, list(s) AS s FROM sh GROUP BY fuzzy), near AS (SELECT a, b, len(list_intersect(p.s, q.s)) / len(list_distinct(list_concat(p.s, q.s))) AS j FROM cand JOIN sets p ON p.fuzzy = a JOIN sets q ON q.fuzzy = b),
best AS (SELECT a, m FROM (SELECT a, m, row_number() OVER (PARTITION BY a ORDER BY j DESC, m) AS k FROM near JOIN x ON x.fuzzy = b WHERE j >= 0.9) WHERE k = 1)
SELECT * FROM done UNION ALL SELECT rest.uuid, m, 'fuzzy' FROM rest JOIN best ON fuzzy = a""")
def resolve_names(g, spark, d):
    return dd.resolve(_extracted(g), g.entity)


@query("word_overlap_pairs", "WITH w AS (SELECT DISTINCT name, unnest(list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda x: x <> '')) AS w FROM entity) SELECT DISTINCT p.name AS a, q.name AS b FROM w p JOIN w q ON p.w = q.w AND p.name < q.name")
def word_overlap_pairs(g, spark, d):
    return dd.word_overlap_pairs(g.entity.select("name"))


_EDGE = "edge AS (SELECT uuid, src, dst, 'quantity' || quantity || ' ' || lower(name) AS text FROM facts)"


def _texts(g):
    return g.relates_to.select("uuid", "src", "dst", "name", F.concat(F.lit("quantity"), F.element_at(F.split("fact", " "), -1), F.lit(" "), F.lower("name")).alias("text"), F.array().cast("array<float>").alias("embedding"))


@query("similar_edges", f"WITH {_EDGE} SELECT a.uuid AS a, b.uuid AS b FROM edge a JOIN edge b ON a.src = b.src AND a.dst = b.dst AND a.uuid < b.uuid WHERE list_has_any(string_split(a.text, ' '), string_split(b.text, ' '))")
def similar_edges(g, spark, d):
    return dd.similar_edges(_texts(g))


#: Least id by hand-written transitive closure: groups of similar edges lie within one (src, dst) pair.
@query("uuid_map", f"""WITH RECURSIVE {_EDGE}, pair AS (SELECT a.uuid AS a, b.uuid AS b FROM edge a JOIN edge b ON a.src = b.src AND a.dst = b.dst AND a.uuid <> b.uuid WHERE list_has_any(string_split(a.text, ' '), string_split(b.text, ' '))),
reach AS (SELECT DISTINCT a AS alias, a AS other FROM pair UNION SELECT r.alias, p.b FROM reach r JOIN pair p ON r.other = p.a) SELECT alias, min(other) AS canonical FROM reach GROUP BY alias""")
def uuid_map(g, spark, d):
    return dd.undirected_map(dd.similar_edge_links(_texts(g)))


@query("dedupe_edges", f"""WITH RECURSIVE {_EDGE}, pair AS (SELECT a.uuid AS a, b.uuid AS b FROM edge a JOIN edge b ON a.src = b.src AND a.dst = b.dst AND a.uuid <> b.uuid WHERE list_has_any(string_split(a.text, ' '), string_split(b.text, ' '))),
reach AS (SELECT DISTINCT a AS alias, a AS other FROM pair UNION SELECT r.alias, p.b FROM reach r JOIN pair p ON r.other = p.a), m AS (SELECT alias, min(other) AS canonical FROM reach GROUP BY alias)
SELECT coalesce(canonical, uuid) AS uuid, min(src) AS src, min(dst) AS dst, count(*) AS members FROM edge LEFT JOIN m ON uuid = alias GROUP BY 1""")
def dedupe_edges(g, spark, d):
    e = _texts(g)
    return dd.merge_edges(e, dd.undirected_map(dd.similar_edge_links(e))).select("uuid", "src", "dst", "members")


def _chain(g):
    """Each entity is an alias of the next one of its name in order of uuid."""
    from pyspark.sql import Window as W

    return g.entity.select(F.col("uuid").alias("alias"), F.lead("uuid").over(W.partitionBy("name").orderBy("uuid")).alias("parent"), F.lit(0).alias("pos")).filter("parent is not null")


@query("directed_uuid_map", "SELECT uuid AS alias, last AS canonical FROM (SELECT uuid, max(uuid) OVER (PARTITION BY name) AS last FROM entity) WHERE uuid <> last")
def directed_uuid_map(g, spark, d):
    return dd.directed_map(_chain(g))


@query("duplicate_edges", "SELECT uuid AS src, first AS dst, 'IS_DUPLICATE_OF' AS name, name || ' is a duplicate of ' || name AS fact FROM (SELECT uuid, name, min(uuid) OVER (PARTITION BY name) AS first FROM entity) WHERE uuid <> first")
def duplicate_edges(g, spark, d):
    p = g.entity
    first = p.groupBy(F.col("name").alias("dst_name")).agg(F.min("uuid").alias("dst"))
    return dd.duplicate_edges(p.select(F.col("uuid").alias("src"), F.col("name").alias("src_name")).join(first, F.col("src_name") == F.col("dst_name")))


@query("canonical_by_episode", "SELECT DISTINCT m.src AS episode, first AS uuid FROM mentions m JOIN (SELECT uuid, min(uuid) OVER (PARTITION BY name) AS first FROM entity) p ON m.dst = p.uuid")
def canonical_by_episode(g, spark, d):
    p = g.entity
    first = p.groupBy(F.col("name").alias("n")).agg(F.min("uuid").alias("canonical"))
    m = p.join(first, F.col("name") == F.col("n")).select(F.col("uuid").alias("alias"), "canonical")
    return dd.by_episode(g.mentions.select(F.col("src").alias("episode"), F.col("dst").alias("uuid")), m)


@query("strip_html", "SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS digest, len(regexp_replace(html, '<[^>]*>', '', 'g')) AS n FROM pages")
def strip_html(g, spark, d):
    t = tx.strip_html(F.col("html"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


@query("think_tags", "SELECT conv_id, turn, 'answer' || coalesce(text, '') AS answer FROM conversations")
def think_tags(g, spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    raw = F.concat(F.lit("<think>first\nthis</think>"), F.lit("answer"), F.coalesce("text", F.lit("")), F.lit("<think>then that</think>"))
    return c.select("conv_id", "turn", tx.strip_think(raw).alias("answer"))


@query("json_reply", "SELECT conv_id, turn, role FROM conversations")
def json_reply(g, spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    body = F.to_json(F.struct("role"))
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("So "), body, F.lit(" it is")))
    return c.select("conv_id", "turn", F.from_json(tx.fenced_json(raw), "role string")["role"].alias("role"))


@query("escape_query", "SELECT page_id, regexp_replace(url, '([+\\-&|!(){}\\[\\]^\"~*?:\\\\/])', '\\\\\\1', 'g') AS escaped FROM pages")
def escape_query(g, spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", tx.escape_query(F.col("url")).alias("escaped"))


@query("token_estimate", "SELECT doc_id, floor(len(list_filter(regexp_split_to_array(text, '[ \\n\\t.,!?;:]+'), lambda x: x <> '')) * 1.3)::INT AS tokens FROM documents")
def token_estimate(g, spark, d):
    return docs(spark, d).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("token_usage_cost", """
WITH u AS (SELECT ['gpt-4o', 'GPT-4o-mini', 'gpt-4-0613', 'claude-3-opus-2', 'o1-mini', 'nobody'][(user_id % 6 + 1)::INT] AS model, (event_id % 1000)::INT AS p, (event_id % 77)::INT AS c, event_type FROM events)
SELECT model, event_type, count(*) AS calls, sum(p + c)::BIGINT AS tokens, round(sum(p / 1e6 * CASE model WHEN 'gpt-4o' THEN 2.5 WHEN 'GPT-4o-mini' THEN 0.15 WHEN 'gpt-4-0613' THEN 2.5 WHEN 'claude-3-opus-2' THEN 15 WHEN 'o1-mini' THEN 3 ELSE 0 END
  + c / 1e6 * CASE model WHEN 'gpt-4o' THEN 10 WHEN 'GPT-4o-mini' THEN 0.6 WHEN 'gpt-4-0613' THEN 10 WHEN 'claude-3-opus-2' THEN 75 WHEN 'o1-mini' THEN 12 ELSE 0 END), 8) AS cost_usd FROM u GROUP BY model, event_type""")
def token_usage_cost(g, spark, d):
    models = F.array(*[F.lit(m) for m in ("gpt-4o", "GPT-4o-mini", "gpt-4-0613", "claude-3-opus-2", "o1-mini", "nobody")])
    u = spark.read.parquet(f"{d}/events.parquet").select(F.get(models, (F.col("user_id") % 6).cast("int")).alias("model"), (F.col("event_id") % 1000).cast("int").alias("prompt_tokens"), (F.col("event_id") % 77).cast("int").alias("completion_tokens"), "event_type")
    return tl.usage_report(u, "model", "event_type").withColumn("cost_usd", F.round("cost_usd", 8))


_STEPS = ", ".join(f"'{s}'" for s in tl.STEPS)
_NOW = "2024-02-01 00:00:00"


def _points(spark, d):
    """Orders as ingestion checkpoints: step, attempts and times by rule."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    at = F.expr(f"timestamp '{_NOW}' - make_interval(0, 0, 0, 0, 0, cast(o_orderkey % 90 as int), 0)")
    return o.select(F.concat(F.lit("O"), "o_orderkey").alias("episode_id"), F.lit("g0").alias("group_id"), F.get(F.array(*[F.lit(s) for s in tl.STEPS]), (F.col("o_custkey") % 13).cast("int")).alias("step"), at.alias("created_at"), at.alias("last_updated_at"), (F.col("o_orderkey") % 5).cast("int").alias("attempt_count"), F.lit(None).cast("string").alias("last_error"))


@query("checkpoint_statistics", f"""
WITH p AS (SELECT [{_STEPS}][(o_custkey % 13 + 1)::INT] AS step, o_orderkey % 5 AS a, o_orderkey % 90 AS age FROM orders)
SELECT CASE WHEN step = 'completed' THEN 'completed' WHEN a >= 3 THEN 'failed' WHEN age > 30 THEN 'stalled' ELSE 'in progress' END AS status, step, count(*) AS n FROM p GROUP BY 1, 2""")
def checkpoint_statistics(g, spark, d):
    return tl.checkpoint_statistics(_points(spark, d), F.to_timestamp(F.lit(_NOW)))


@query("checkpoint_progress", f"SELECT step, round((list_position([{_STEPS}], step) - 1) / 12.0 * 100)::INT || '% (' || step || ')' AS progress, count(*) AS n FROM (SELECT [{_STEPS}][(o_custkey % 13 + 1)::INT] AS step FROM orders) GROUP BY 1")
def checkpoint_progress(g, spark, d):
    return _points(spark, d).select("step", tl.progress().alias("progress")).groupBy("step", "progress").agg(F.count("*").alias("n"))


@query("save_checkpoints", f"SELECT count(*) AS n, sum(CASE WHEN o_orderkey % 2 = 0 THEN 9 ELSE o_orderkey % 5 END)::BIGINT AS attempts FROM orders")
def save_checkpoints(g, spark, d):
    old = _points(spark, d)
    new = old.filter("cast(substring(episode_id, 2) as bigint) % 2 = 0").withColumn("attempt_count", F.lit(9)).withColumn("last_updated_at", F.expr("last_updated_at + interval 1 hour"))
    return tl.save_checkpoints(old, new).agg(F.count("*").alias("n"), F.sum("attempt_count").alias("attempts"))


@query("backoff", "SELECT DISTINCT (o_orderkey % 9)::INT AS attempt, least(60.0, pow(2, o_orderkey % 9 - 1))::DOUBLE AS delay FROM orders")
def backoff(g, spark, d):
    a = (F.col("o_orderkey") % 9).cast("int")
    return spark.read.parquet(f"{d}/orders.parquet").select(a.alias("attempt"), vx.backoff_seconds(a).alias("delay")).distinct()


@query("delimited_reply", "SELECT c_custkey, c_name AS name, c_nationkey AS nation, array_to_string([c_mktsegment, 'x'], '/') AS tags FROM customer")
def delimited_reply(g, spark, d):
    from pyspark.sql.types import StructType

    c = spark.read.parquet(f"{d}/customer.parquet")
    reply = F.concat(F.lit("Name\tnation\ttags\tother\r\n"), F.concat_ws("\t", "c_name", "c_nationkey", F.concat(F.lit("[\""), "c_mktsegment", F.lit("\", x]")), F.lit("?")), F.lit("\nbroken row\n"))
    rows = delimited.parse_delimited(c.select("c_custkey", reply.alias("reply")), "reply", StructType.fromDDL("name string, nation int, tags array<string>"))
    return rows.select("c_custkey", "name", "nation", F.array_join("tags", "/").alias("tags"))


@query("prompt_rows", "SELECT s_suppkey || ',' || s_name || ',' || 'b' AS line FROM supplier")
def prompt_rows(g, spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").withColumn("tags", F.array(F.lit("a"), F.lit("b")))
    return delimited.to_prompt_rows(s, ["s_suppkey", "s_name", "tags"])


@query("chunk_text")
def chunk_text(g, spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(tx.chunk_text(F.col("text"), 2048)).alias("idx", "chunk")).select("doc_id", "idx", F.octet_length("chunk").alias("bytes"), F.md5("chunk").alias("digest"))


@query("messages_to_episodes", f"SELECT 'conv' || conv_id || '-' || turn AS uuid, 'message ' || turn AS name, md5(coalesce(role, '') || ': ' || coalesce(text, '')) AS digest, 'conv' || conv_id AS group_id, {sql_stamp('TIMESTAMP ' + chr(39) + '2024-01-01' + chr(39) + ' + to_hours(conv_id) + to_minutes(turn)', 'reference')} FROM conversations")
def messages_to_episodes(g, spark, d):
    e = ing.messages_to_episodes(spark.read.parquet(f"{d}/conversations.parquet"))
    return e.select("uuid", "name", F.md5("content").alias("digest"), "group_id", stamp("reference"))


def _ingested(spark, d):
    return ing.ingest(ing.messages_to_episodes(spark.read.parquet(f"{d}/conversations.parquet")))


#: The offline extractor in SQL, for turns that fit one chunk (all of them are read; longer ones are chunked in both).
_NAMES = """turn AS (SELECT 'conv' || conv_id || '-' || turn AS episode, 'conv' || conv_id AS group_id, coalesce(role, '') || ': ' || coalesce(text, '') AS content FROM conversations),
  name AS (SELECT DISTINCT episode, group_id, unnest(regexp_extract_all(content, '\\b[A-Z][a-z]{3,}\\b')) AS name FROM turn)"""


@query("ingest_entities")
def ingest_entities(g, spark, d):
    return _ingested(spark, d).entities.select("uuid", "group_id", "name", "episodes", stamp("created_at"))


@query("ingest_edges")
def ingest_edges(g, spark, d):
    return _ingested(spark, d).edges.select("uuid", "src", "dst", "group_id", "name", "fact", F.array_join("episodes", ",").alias("episodes"), stamp("valid_at"))


@query("ingest_mentions")
def ingest_mentions(g, spark, d):
    return _ingested(spark, d).mentions


@query("source_nodes", "SELECT 'src:' || source AS uuid, count(*) AS episodes FROM episodic WHERE source <> '' GROUP BY source")
def source_nodes(g, spark, d):
    nodes, links = ing.sources_of(g.episodic)
    return links.join(nodes.select("uuid"), F.col("dst") == F.col("uuid"), "left_semi").groupBy(F.col("dst").alias("uuid")).agg(F.count("*").alias("episodes"))


@query("skip_known_episodes", "SELECT uuid FROM episodic WHERE group_id <> 'g0'")
def skip_known_episodes(g, spark, d):
    return ing.skip_known(g.episodic, g.episodic.filter("group_id = 'g0'")).select("uuid")


@query("add_triplet", """
WITH t AS (SELECT DISTINCT n_name AS s, r_name AS d FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT (SELECT count(*) FROM entity) + (SELECT count(*) FROM (SELECT lower(s) AS x FROM t UNION SELECT lower(d) FROM t) WHERE x NOT IN (SELECT lower(name) FROM entity WHERE group_id = 'g0')) AS nodes, (SELECT count(*) FROM relates_to) + (SELECT count(*) FROM t) AS edges""")
def add_triplet(g, spark, d):
    n, r = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    t = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src_name"), F.col("r_name").alias("dst_name"), F.lit("LIES_IN").alias("name"), F.concat_ws(" ", "n_name", F.lit("lies in"), "r_name").alias("fact"), F.lit("g0").alias("group_id"), F.to_timestamp(F.lit(_NOW)).alias("valid_at"))
    nodes, edges = ing.add_triplet(g.entity, g.relates_to, t)
    return nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")))


@query("parse_entity_reply", "SELECT n_nationkey, n_name || '/' || 'second' AS names FROM nation")
def parse_entity_reply(g, spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    both = F.concat(F.lit('[{"name": "'), "n_name", F.lit('"}, {"name": "second"}, {"name": " "}]'))
    raw = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit('<think>x</think>{"entities": '), both, F.lit("}"))).when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit('```json\n{"extracted_entities": '), both, F.lit("}\n```"))).when(F.col("n_nationkey") % 4 == 2, both).otherwise(F.concat(F.lit("Entity: \""), "n_name", F.lit("\"\nthe name: second,\nnothing here\nname: x")))
    return n.select("n_nationkey", F.array_join(ing.parse_entity_reply(raw), "/").alias("names"))


def _restated(g):
    """Every returned fact said again a day later under a new id, half of them in other words."""
    again = g.relates_to.filter("name = 'RETURNED'")
    other = F.when(F.element_at(F.split("fact", " "), -1).cast("int") % 2 == 0, F.col("fact")).otherwise(F.concat("fact", F.lit(" again")))
    return again.select(F.concat(F.lit("N"), "uuid").alias("uuid"), "src", "dst", "name", other.alias("fact"), F.expr("valid_at + interval 1 day").alias("valid_at"), F.lit(None).cast("timestamp").alias("invalid_at"), F.lit(None).cast("timestamp").alias("expired_at"), F.array(F.lit("late")).alias("episodes"))


@query("resolve_edges", """
WITH k AS (SELECT uuid, src, dst, name, fact, valid_at, invalid_at FROM relates_to), n AS (SELECT 'N' || uuid AS uuid, src, dst, name, CASE WHEN string_split(fact, ' ')[-1]::INT % 2 = 0 THEN fact ELSE fact || ' again' END AS fact, valid_at + INTERVAL 1 DAY AS valid_at FROM relates_to WHERE name = 'RETURNED'),
p AS (SELECT n.uuid AS n, k.uuid AS k, n.valid_at AS f, k.valid_at AS kf, k.invalid_at AS kt, lower(n.fact) = lower(k.fact) AS same, n.name = k.name AS rel FROM n JOIN k ON least(n.src, n.dst) = least(k.src, k.dst) AND greatest(n.src, n.dst) = greatest(k.src, k.dst)),
twin AS (SELECT n, min(k) AS k FROM p WHERE same GROUP BY n), ends AS (SELECT k, min(f) AS e FROM p WHERE NOT same AND rel AND n NOT IN (SELECT n FROM twin) AND kf < f AND (kt IS NULL OR kt >= f) GROUP BY k)
SELECT state, count(*) AS n, count(invalid_at) AS closed FROM (SELECT CASE WHEN e IS NOT NULL THEN 'closed' WHEN uuid IN (SELECT k FROM twin) THEN 'extended' ELSE 'kept' END AS state, coalesce(e, invalid_at) AS invalid_at FROM k LEFT JOIN ends ON uuid = ends.k UNION ALL SELECT 'new', NULL FROM n WHERE uuid NOT IN (SELECT n FROM twin)) GROUP BY state""")
def resolve_edges(g, spark, d):
    from ..operators import resolve

    out = resolve.resolve_edges(_restated(g), g.relates_to)
    return out.groupBy("state").agg(F.count("*").alias("n"), F.count("invalid_at").alias("closed"))


@query("embed_entities")
def embed_entities(g, spark, d):
    from ..functions import adapters

    return g.entity.select("uuid", adapters.embedding(F.concat_ws(" ", "name", "summary"), adapters.HashEmbedder(16)).alias("embedding"))
