"""Pattern and traversal operators over edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import ensure_checkpoint_dir

#: Rounds of a traversal that one plan holds.
LAZY_ROUNDS = 3


def undirected(edges: DataFrame, *extra: str) -> DataFrame:
    """Both orientations as (a, b)."""
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *extra)
    return one.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), *extra))


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Distinct steps (a, b) along, against or both ways."""
    if direction == "out":
        steps = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    elif direction == "in":
        steps = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    elif direction == "both":
        steps = undirected(edges)
    else:
        raise ValueError(f"no such direction: {direction}")
    return steps


def neighbors(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """Distinct nodes one step from a node, itself left out."""
    return directed(edges, direction).filter((F.col("a") == node) & (F.col("b") != node)).select(F.col("b").alias("uuid")).distinct()


def reach(steps: DataFrame, origins: DataFrame, depth: int) -> DataFrame:
    """(uuid, depth): least number of steps from any origin (column uuid), origins at 0.

    Each round joins the frontier with the steps and keeps what is new; seen nodes are removed by an anti join. Up to
    LAZY_ROUNDS rounds only build a plan. A plan holds the former rounds twice, so a deeper traversal is checkpointed
    to the session's shared folder after each so many, and ends early where nothing new was reached.
    """
    if depth > LAZY_ROUNDS:
        ensure_checkpoint_dir(steps.sparkSession)
    seen = origins.select("uuid").distinct().withColumn("depth", F.lit(0))
    frontier = seen.select("uuid")
    for d in range(1, depth + 1):
        nxt = steps.join(frontier, steps["a"] == frontier["uuid"], "left_semi").select(F.col("b").alias("uuid")).distinct()
        frontier = nxt.join(seen.select(F.col("uuid").alias("s")), F.col("uuid") == F.col("s"), "left_anti")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(d)))
        if d % LAZY_ROUNDS == 0 and d < depth:
            seen = seen.checkpoint()
            frontier = seen.filter(F.col("depth") == d).select("uuid")
            if frontier.isEmpty():
                break
    return seen


def one(spark, uuid: str) -> DataFrame:
    return spark.createDataFrame([(uuid,)], "uuid string")


def neighbors_within(edges: DataFrame, node: str, hops: int) -> DataFrame:
    """Nodes at most ``hops`` (1 to 10) undirected steps away with their distance."""
    hops = min(max(hops, 1), 10)
    return reach(undirected(edges), one(edges.sparkSession, node), hops).filter("depth > 0")


def neighbor_counts(edges: DataFrame, entity: DataFrame | None = None) -> DataFrame:
    """(node, neighbor, edge_count): undirected adjacency with multiplicity, within a group if entities are given."""
    pairs = undirected(edges.filter("src <> dst"))
    if entity is not None:
        g = entity.select(F.col("uuid").alias("id"), "group_id")
        pairs = pairs.join(g.withColumnsRenamed({"id": "ia", "group_id": "ga"}), F.col("a") == F.col("ia")).join(g.withColumnsRenamed({"id": "ib", "group_id": "gb"}), (F.col("b") == F.col("ib")) & (F.col("ga") == F.col("gb")))
    return pairs.groupBy(F.col("a").alias("node"), F.col("b").alias("neighbor")).agg(F.count("*").alias("edge_count"))


def related_nodes(edges: DataFrame, node: str, edge_type: str | None = None) -> DataFrame:
    own = edges if edge_type is None else edges.filter(F.col("name") == edge_type)
    return neighbors(own, node)


def node_bfs(edges: DataFrame, mentions: DataFrame, origins: DataFrame, depth: int, group_of: DataFrame | None = None) -> DataFrame:
    """Entities reached from entity or episode origins along edge direction; a mention takes one step. (uuid, depth >= 1)"""
    steps = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(mentions.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    found = reach(steps, origins, depth).filter("depth > 0")
    if group_of is not None:
        found = found.join(group_of.select(F.col("uuid").alias("g")), F.col("uuid") == F.col("g"), "left_semi")
    return found


def edge_bfs(edges: DataFrame, origins: DataFrame, depth: int) -> DataFrame:
    """Edges on directed paths of at most ``depth`` steps: those that leave a node reached at depth - 1 or less."""
    at = reach(directed(edges, "out"), origins, depth - 1).select(F.col("uuid").alias("n"), F.col("depth").alias("d"))
    return edges.join(at, F.col("src") == F.col("n")).withColumn("depth", F.col("d") + 1).drop("n", "d")


def edges_of(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter((F.col("src") == node) | (F.col("dst") == node))


def shortest_paths(edges: DataFrame, origin: str, depth: int) -> DataFrame:
    """(uuid, depth, path): for every node within reach one shortest directed path, the least in node order; deep searches are cut as in ``reach``."""
    if depth > LAZY_ROUNDS:
        ensure_checkpoint_dir(edges.sparkSession)
    steps = directed(edges, "out").distinct()
    seen = one(edges.sparkSession, origin).select("uuid", F.lit(0).alias("depth"), F.array("uuid").alias("path"))
    frontier = seen
    for d in range(1, depth + 1):
        nxt = steps.join(frontier, steps["a"] == frontier["uuid"]).groupBy("b").agg(F.min("path").alias("before"))
        nxt = nxt.select(F.col("b").alias("uuid"), F.lit(d).alias("depth"), F.concat("before", F.array("b")).alias("path"))
        frontier = nxt.join(seen.select(F.col("uuid").alias("s")), F.col("uuid") == F.col("s"), "left_anti")
        seen = seen.unionByName(frontier)
        if d % LAZY_ROUNDS == 0 and d < depth:
            seen = seen.checkpoint()
            frontier = seen.filter(F.col("depth") == d)
            if frontier.isEmpty():
                break
    return seen


def all_paths(edges: DataFrame, src: str, dst: str, depth: int) -> DataFrame:
    """(path, length): every directed path without repeated edges, by edge ids, of at most ``depth`` steps.

    The last step is a join with edges into the target only, so fans are not expanded a step too far.
    """
    e = edges.select(F.col("uuid").alias("e"), F.col("src").alias("a"), F.col("dst").alias("b"))
    into = e.filter(F.col("b") == dst).withColumnsRenamed({"e": "le", "a": "la", "b": "lb"})
    walk = edges.sparkSession.createDataFrame([(src, [])], "at string, path array<string>")
    out = None
    for d in range(1, depth + 1):
        done = walk.join(into, (F.col("at") == F.col("la")) & ~F.array_contains("path", F.col("le"))).select(F.concat("path", F.array("le")).alias("path"), F.lit(d).alias("length"))
        out = done if out is None else out.unionByName(done)
        if d < depth:
            walk = walk.join(e, (F.col("at") == F.col("a")) & ~F.array_contains("path", F.col("e"))).select(F.col("b").alias("at"), F.concat("path", F.array("e")).alias("path"))
    return out


def mentioned_nodes(mentions: DataFrame, entity: DataFrame, episodes: list[str]) -> DataFrame:
    ids = mentions.filter(F.col("src").isin(episodes)).select(F.col("dst").alias("m")).distinct()
    return entity.join(ids, F.col("uuid") == F.col("m"), "left_semi")


def mention_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy(F.col("dst").alias("uuid")).agg(F.count("*").alias("mentions"))


def edges_of_episode(edges: DataFrame, episode: str) -> DataFrame:
    return edges.filter(F.array_contains("episodes", episode))


def community_members(has_member: DataFrame, entity: DataFrame, community: str) -> DataFrame:
    ids = has_member.filter((F.col("src") == community) & (F.col("dst_label") == "entity")).select(F.col("dst").alias("m"))
    return entity.join(ids, F.col("uuid") == F.col("m"), "left_semi")


def communities_of(has_member: DataFrame, community: DataFrame, nodes: list[str]) -> DataFrame:
    ids = has_member.filter(F.col("dst").isin(nodes)).select(F.col("src").alias("m")).distinct()
    return community.join(ids, F.col("uuid") == F.col("m"), "left_semi")


def inter_community_edges(edges: DataFrame, has_member: DataFrame) -> DataFrame:
    """(c1, c2, edges): how many distinct edges lead from members of one community to members of another."""
    m = has_member.filter("dst_label = 'entity'").select("src", "dst").distinct()
    m1, m2 = m.select(F.col("src").alias("c1"), F.col("dst").alias("n1")), m.select(F.col("src").alias("c2"), F.col("dst").alias("n2"))
    both = edges.select("uuid", "src", "dst").join(m1, F.col("src") == F.col("n1")).join(m2, F.col("dst") == F.col("n2")).filter("c1 <> c2")
    return both.groupBy("c1", "c2").agg(F.countDistinct("uuid").alias("edges"))


def without_duplicate_links(pairs: DataFrame, edges: DataFrame, name: str = "IS_DUPLICATE_OF") -> DataFrame:
    """Pairs (src, dst) not yet linked by an edge of that name."""
    have = edges.filter(F.col("name") == name).select(F.col("src").alias("h1"), F.col("dst").alias("h2"))
    return pairs.join(have, (F.col("src") == F.col("h1")) & (F.col("dst") == F.col("h2")), "left_anti")
