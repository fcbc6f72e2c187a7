"""Lookups, upserts, deletes and statistics over graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def get_node(nodes: DataFrame, uuid: str, group_id: str) -> DataFrame:
    """The node of a key; of several labels the first in lookup order."""
    return nodes.filter((F.col("uuid") == uuid) & (F.col("group_id") == group_id)).orderBy("priority").limit(1)


def get_nodes(nodes: DataFrame, uuids: list[str], group_id: str) -> DataFrame:
    """Nodes of a list of ids with their place in the list; unknown ids are left out."""
    asked = nodes.sparkSession.createDataFrame(list(enumerate(uuids)), "pos int, want string")
    return nodes.filter(F.col("group_id") == group_id).join(F.broadcast(asked), F.col("uuid") == F.col("want")).drop("want")


def exists(table: DataFrame, uuid: str, group_id: str) -> DataFrame:
    """One row with ``found``: whether a row of that key exists."""
    hit = table.filter((F.col("uuid") == uuid) & (F.col("group_id") == group_id)).limit(1)
    return hit.agg((F.count("*") > 0).alias("found"))


def with_endpoints(edges: DataFrame, entity: DataFrame) -> DataFrame:
    """Edges whose both ends exist, with the ends' names."""
    a = entity.select(F.col("uuid").alias("a_id"), F.col("name").alias("src_name"))
    b = entity.select(F.col("uuid").alias("b_id"), F.col("name").alias("dst_name"))
    return edges.join(a, F.col("src") == F.col("a_id")).join(b, F.col("dst") == F.col("b_id")).drop("a_id", "b_id")


def get_edges(edges: DataFrame, entity: DataFrame, uuids: list[str], group_id: str | None = None) -> DataFrame:
    """Edges by id, both ends present."""
    hit = edges.filter(F.col("uuid").isin(uuids))
    if group_id is not None:
        hit = hit.filter(F.col("group_id") == group_id)
    return with_endpoints(hit, entity)


def edges_between(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Directed edges from one node to another."""
    return edges.filter((F.col("src") == src) & (F.col("dst") == dst))


def get_between_nodes(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges between two nodes in either direction, each once."""
    return edges_between(edges, a, b).union(edges_between(edges, b, a)).distinct()


def by_group(table: DataFrame, group_id: str) -> DataFrame:
    return table.filter(F.col("group_id") == group_id)


def group_ids(*tables: DataFrame) -> DataFrame:
    """Distinct non-null group ids."""
    out = None
    for t in tables:
        one = t.select("group_id").dropna()
        out = one if out is None else out.union(one)
    return out.distinct()


def _kept(new: str, old: str) -> Column:
    """The new text unless it is null or empty."""
    return F.coalesce(F.when(F.col(new) != "", F.col(new)), F.col(old))


def last_of(rows: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """The last row of each key, by those of the ``order`` columns that are there."""
    by = [F.col(c).desc_nulls_last() for c in order if c in rows.columns]
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).filter("rn = 1").drop("rn")


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by (uuid, group_id): an empty new name or summary keeps the old one, labels are replaced, ``created_at`` stays.

    All columns of either side stay: one that the new rows lack, or that is null in them, keeps its old value, and rows that are
    not touched stay as they are. Several new rows of a key: the last by ``updated_at`` (then name)
    counts. One full outer join on the key.
    """
    last = last_of(new, ("uuid", "group_id"), "updated_at", "name")
    n = last.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    both = old.join(n, (F.col("uuid") == F.col("n_uuid")) & (F.col("group_id") == F.col("n_group_id")), "full_outer")
    columns = [*old.columns, *[c for c in new.columns if c not in old.columns]]

    def merged(c: str) -> Column:
        if c in ("name", "summary") and c in old.columns and c in new.columns:
            return _kept(f"n_{c}", c).alias(c)
        if c == "created_at" and c in old.columns:
            given = [F.col(x) for x in ("n_created_at", "n_updated_at") if x in n.columns]
            return F.coalesce("created_at", *given).alias(c)
        parts = ([F.col(f"n_{c}")] if c in new.columns else []) + ([F.col(c)] if c in old.columns else [])
        return F.coalesce(*parts).alias(c)

    return both.select(*[merged(c) for c in columns])


def upsert_edges(old: DataFrame, new: DataFrame, entity: DataFrame) -> DataFrame:
    """Merge edges by (uuid, group_id); a new edge without both ends is dropped. The end of validity closes both time axes.

    All columns of either side stay; what a new row lacks keeps its old value (times that a new row has
    are its own, null or not). Several new rows of a key: the last by ``valid_at`` (then fact) counts.
    """
    have = entity.select(F.col("uuid").alias("have"))
    ok = last_of(new, ("uuid", "group_id"), "valid_at", "fact")
    ok = ok.join(have, F.col("src") == F.col("have"), "left_semi").join(have, F.col("dst") == F.col("have"), "left_semi")
    ok = ok.withColumn("expired_at", F.col("invalid_at"))
    n = ok.select(*[F.col(c).alias(f"n_{c}") for c in ok.columns], F.lit(True).alias("is_new"))
    both = old.join(n, (F.col("uuid") == F.col("n_uuid")) & (F.col("group_id") == F.col("n_group_id")), "full_outer")
    columns = [*old.columns, *[c for c in ok.columns if c not in old.columns]]

    def merged(c: str) -> Column:
        if c not in ok.columns:
            return F.col(c)
        if c not in old.columns:
            return F.col(f"n_{c}").alias(c)
        if c in ("created_at", "episodes"):
            return F.coalesce(f"n_{c}", c).alias(c)
        return F.when(F.col("is_new"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*[merged(c) for c in columns])


def upsert_community_edges(old: DataFrame, new: DataFrame, entity: DataFrame, community: DataFrame) -> DataFrame:
    """Add HAS_MEMBER links (src, dst, group_id) from communities to entities or, where there is none of that id, to communities.

    Both ends must be in the link's group. A link that is there already stays as it is; the id is ``src-dst``.
    """
    nodes = lambda t, label: t.select(F.col("uuid").alias("k"), F.col("group_id").alias("g"), F.lit(label).alias("dst_label")).distinct()
    ends = nodes(entity, "entity").unionByName(nodes(community, "community")).groupBy("k", "g").agg(F.max("dst_label").alias("dst_label"))
    heads = community.select(F.col("uuid").alias("c"), F.col("group_id").alias("cg")).distinct()
    ok = new.select("src", "dst", "group_id").distinct().join(heads, (F.col("src") == F.col("c")) & (F.col("group_id") == F.col("cg")), "left_semi")
    ok = ok.join(ends, (F.col("dst") == F.col("k")) & (F.col("group_id") == F.col("g"))).select("src", "dst", "group_id", "dst_label")
    fresh = ok.join(old.select("src", "dst", "group_id"), ["src", "dst", "group_id"], "left_anti")
    return old.unionByName(fresh.withColumn("uuid", F.concat_ws("-", "src", "dst")), allowMissingColumns=True)


def upsert_mentions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add (src, dst, group_id) links that are not there yet; the id is ``src-dst``."""
    fresh = new.select("src", "dst", "group_id").distinct().join(old.select("src", "dst", "group_id"), ["src", "dst", "group_id"], "left_anti")
    return old.select("uuid", "src", "dst", "group_id").unionByName(fresh.select(F.concat_ws("-", "src", "dst").alias("uuid"), "src", "dst", "group_id"))


def delete_nodes(nodes: DataFrame, edges: DataFrame, uuids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of ``uuids`` (column uuid), and edges without any that touch them."""
    gone = uuids.select(F.col("uuid").alias("gone")).distinct()
    left = nodes.join(gone, F.col("uuid") == F.col("gone"), "left_anti")
    rest = edges.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")
    return left, rest


def delete_edges(edges: DataFrame, uuids: list[str], group_id: str | None = None) -> DataFrame:
    hit = F.col("uuid").isin(uuids)
    if group_id is not None:
        hit = hit & (F.col("group_id") == group_id)
    return edges.filter(~hit)


def clear_groups(table: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """The table without the rows of some groups; without any, where none are named."""
    return table.filter(~F.col("group_id").isin(groups)) if groups else table.limit(0)


def graph_stats(nodes: DataFrame, edge_tables: dict[str, DataFrame], group_id: str | None = None) -> DataFrame:
    """(kind, type, n): nodes by label, edges by type, and totals. A null group counts all groups."""
    own = (lambda t: t) if group_id is None else (lambda t: by_group(t, group_id))
    parts = own(nodes).select(F.lit("node").alias("kind"), F.col("label").alias("type"))
    for name, t in edge_tables.items():
        parts = parts.unionByName(own(t).select(F.lit("edge").alias("kind"), F.lit(name).alias("type")))
    return parts.rollup("kind", "type").count().filter("kind is not null").select("kind", F.coalesce("type", F.lit("total")).alias("type"), F.col("count").alias("n"))


def resolve_pointers(edges: DataFrame, uuid_map: DataFrame) -> DataFrame:
    """Edges with ends rewritten through (alias, canonical); an end without an entry stays."""
    a = uuid_map.select(F.col("alias").alias("a1"), F.col("canonical").alias("c1"))
    b = uuid_map.select(F.col("alias").alias("a2"), F.col("canonical").alias("c2"))
    out = edges.join(a, F.col("src") == F.col("a1"), "left").join(b, F.col("dst") == F.col("a2"), "left")
    return out.withColumn("src", F.coalesce("c1", "src")).withColumn("dst", F.coalesce("c2", "dst")).drop("a1", "c1", "a2", "c2")


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with a missing end: (uuid, problem), one row for each missing end."""
    ids = nodes.select(F.col("uuid").alias("id"))
    lost = lambda end: edges.join(ids, F.col(end) == F.col("id"), "left_anti").select("uuid", F.lit(f"missing {end}").alias("problem"))
    return lost("src").unionByName(lost("dst"))


def integrity_report(nodes: DataFrame, edges: DataFrame, entity: DataFrame) -> DataFrame:
    """(problem, n): orphan edge ends, nodes and edges without an embedding, entities without a name."""
    parts = orphan_edges(edges, nodes).select("problem")
    bare = lambda t, col, what: t.filter(F.col(col).isNull() | (F.size(col) == 0)).select(F.lit(what).alias("problem")) if col in t.columns else t.select(F.lit(what).alias("problem"))
    parts = parts.unionByName(bare(entity, "name_embedding", "node without embedding")).unionByName(bare(edges, "fact_embedding", "edge without embedding"))
    parts = parts.unionByName(entity.filter(F.coalesce(F.trim("name"), F.lit("")) == "").select(F.lit("node without name").alias("problem")))
    return parts.groupBy("problem").agg(F.count("*").alias("n"))


def remove_episode(episode: str, entity: DataFrame, edges: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, edges and mentions after an episode goes: edges it created go, and entities that no other episode mentions."""
    counts = mentions.groupBy("dst").agg(F.count("*").alias("n"))
    only = mentions.filter(F.col("src") == episode).join(counts.filter("n = 1").withColumnRenamed("dst", "d1"), F.col("dst") == F.col("d1")).select(F.col("dst").alias("uuid")).distinct()
    left, rest = delete_nodes(entity, edges.filter(F.coalesce(F.get("episodes", F.lit(0)) != episode, F.lit(True))), only)
    return left, rest, mentions.filter(F.col("src") != episode)
