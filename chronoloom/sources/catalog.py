"""Graph tables over the star-schema Parquet files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class Graph:
    """The tables of one graph; every field is a lazy DataFrame."""

    entity: DataFrame
    episodic: DataFrame
    community: DataFrame
    relates_to: DataFrame
    mentions: DataFrame
    has_member: DataFrame

    def nodes(self) -> DataFrame:
        """All nodes as (uuid, name, group_id, label, created_at), label in lookup order."""
        cols = ("uuid", "name", "group_id", "created_at")
        parts = [df.select(*cols, F.lit(label).alias("label"), F.lit(i).alias("priority")) for i, (label, df) in enumerate((("entity", self.entity), ("episodic", self.episodic), ("community", self.community)))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def register(self) -> None:
        """Temp views of the tables' names, for ad-hoc SQL over the graph."""
        for name in ("entity", "episodic", "community", "relates_to", "mentions", "has_member"):
            getattr(self, name).createOrReplaceTempView(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_plus(hours) -> "F.Column":
    return F.timestamp_seconds(F.lit(1704067200) + hours * 3600)


def load_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts, suppliers and customers are entities, orders and conversation turns episodes, nations and regions communities, line items facts and mentions."""
    t = lambda name: read(spark, sf_dir, name)
    part, supp, cust = t("part"), t("supplier"), t("customer")
    no_labels = F.array(F.lit("Part"))
    entity = (
        part.select(F.concat(F.lit("P"), "p_partkey").alias("uuid"), F.col("p_name").alias("name"), F.lit("g0").alias("group_id"), no_labels.alias("labels"), epoch_plus(F.col("p_partkey")).alias("created_at"), F.concat_ws(" ", "p_brand", "p_type").alias("summary"))
        .unionByName(supp.select(F.concat(F.lit("S"), "s_suppkey").alias("uuid"), F.col("s_name").alias("name"), F.lit("g0").alias("group_id"), F.array(F.lit("Supplier")).alias("labels"), epoch_plus(F.col("s_suppkey")).alias("created_at"), F.lit("").alias("summary")))
        .unionByName(cust.select(F.concat(F.lit("C"), "c_custkey").alias("uuid"), F.col("c_name").alias("name"), F.lit("g1").alias("group_id"), F.array(F.lit("Customer")).alias("labels"), epoch_plus(F.col("c_custkey")).alias("created_at"), F.col("c_mktsegment").alias("summary")))
    )
    orders, conv = t("orders"), t("conversations")
    episodic = orders.select(F.concat(F.lit("O"), "o_orderkey").alias("uuid"), F.concat(F.lit("order "), "o_orderkey").alias("name"), F.lit("g0").alias("group_id"), F.col("o_orderpriority").alias("source"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("content"), F.col("o_orderdate").cast("timestamp").alias("valid_at"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    turn_at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    turns = conv.select(F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("uuid"), F.concat(F.lit("turn "), "turn").alias("name"), F.col("role").alias("group_id"), F.lit("message").alias("source"), F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit(""))).alias("content"), turn_at.alias("valid_at"), turn_at.alias("created_at"))
    li = t("lineitem")
    s, p = F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("P"), "l_partkey")
    even = F.col("l_linenumber") % 2 == 0
    facts = li.select(
        F.concat_ws("-", F.concat(F.lit("E"), "l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("uuid"),
        F.when(even, s).otherwise(p).alias("src"),
        F.when(even, p).otherwise(s).alias("dst"),
        F.lit("g0").alias("group_id"),
        F.when(F.col("l_returnflag") == "R", "RETURNED").when(F.col("l_returnflag") == "A", "ACCEPTED").otherwise("OFFERED").alias("name"),
        F.col("l_shipdate").cast("timestamp").alias("valid_at"),
        F.array(F.concat(F.lit("O"), "l_orderkey")).alias("episodes"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )
    nxt = F.lead("valid_at").over(W.partitionBy("src", "dst").orderBy("valid_at", "uuid"))
    relates_to = facts.select("uuid", "src", "dst", "group_id", "name", F.concat_ws(" ", "src", F.lower("name"), "dst", F.lit("qty"), "quantity").alias("fact"), "episodes", F.col("valid_at").alias("created_at"), "valid_at", nxt.alias("invalid_at"), nxt.alias("expired_at"))
    mentions = li.select(F.concat(F.lit("O"), "l_orderkey").alias("src"), p.alias("dst")).distinct().select(F.concat_ws("-", "src", "dst").alias("uuid"), "src", "dst", F.lit("g0").alias("group_id"))
    nation, region = t("nation"), t("region")
    community = (
        nation.select(F.concat(F.lit("N"), "n_nationkey").alias("uuid"), F.col("n_name").alias("name"), F.lit("g0").alias("group_id"), epoch_plus(F.col("n_nationkey")).alias("created_at"), F.lit(0).alias("level"))
        .unionByName(region.select(F.concat(F.lit("R"), "r_regionkey").alias("uuid"), F.col("r_name").alias("name"), F.lit("g0").alias("group_id"), epoch_plus(F.col("r_regionkey")).alias("created_at"), F.lit(1).alias("level")))
    )
    has_member = (
        supp.select(F.concat(F.lit("N"), "s_nationkey").alias("src"), F.concat(F.lit("S"), "s_suppkey").alias("dst"), F.lit("entity").alias("dst_label"))
        .unionByName(cust.select(F.concat(F.lit("N"), "c_nationkey").alias("src"), F.concat(F.lit("C"), "c_custkey").alias("dst"), F.lit("entity").alias("dst_label")))
        .unionByName(nation.select(F.concat(F.lit("R"), "n_regionkey").alias("src"), F.concat(F.lit("N"), "n_nationkey").alias("dst"), F.lit("community").alias("dst_label")))
        .select(F.concat_ws("-", "src", "dst").alias("uuid"), "src", "dst", "dst_label", F.lit("g0").alias("group_id"))
    )
    return Graph(entity, episodic.unionByName(turns), community, relates_to, mentions, has_member)


#: The same tables in plain SQL, for checking against another engine.
SQL_TABLES = {
    "entity": """SELECT 'P' || p_partkey AS uuid, p_name AS name, 'g0' AS group_id, 'Part' AS label, TIMESTAMP '2024-01-01' + to_hours(p_partkey) AS created_at, concat_ws(' ', p_brand, p_type) AS summary FROM part
      UNION ALL SELECT 'S' || s_suppkey, s_name, 'g0', 'Supplier', TIMESTAMP '2024-01-01' + to_hours(s_suppkey), '' FROM supplier
      UNION ALL SELECT 'C' || c_custkey, c_name, 'g1', 'Customer', TIMESTAMP '2024-01-01' + to_hours(c_custkey), c_mktsegment FROM customer""",
    "episodic": """SELECT 'O' || o_orderkey AS uuid, 'order ' || o_orderkey AS name, 'g0' AS group_id, o_orderpriority AS source, concat_ws(' ', o_orderstatus, o_orderpriority) AS content, o_orderdate::TIMESTAMP AS valid_at, o_orderdate::TIMESTAMP AS created_at FROM orders
      UNION ALL SELECT conv_id || '-' || turn, 'turn ' || turn, role, 'message', coalesce(role, '') || ': ' || coalesce(text, ''), TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn), TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) FROM conversations""",
    "facts": """SELECT concat_ws('-', 'E' || l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS uuid, CASE WHEN l_linenumber % 2 = 0 THEN 'S' || l_suppkey ELSE 'P' || l_partkey END AS src,
        CASE WHEN l_linenumber % 2 = 0 THEN 'P' || l_partkey ELSE 'S' || l_suppkey END AS dst, 'g0' AS group_id,
        CASE l_returnflag WHEN 'R' THEN 'RETURNED' WHEN 'A' THEN 'ACCEPTED' ELSE 'OFFERED' END AS name, l_shipdate::TIMESTAMP AS valid_at, ['O' || l_orderkey] AS episodes, l_quantity::INT AS quantity FROM lineitem""",
    "relates_to": """SELECT uuid, src, dst, group_id, name, concat_ws(' ', src, lower(name), dst, 'qty', quantity) AS fact, episodes, valid_at AS created_at, valid_at,
        lead(valid_at) OVER (PARTITION BY src, dst ORDER BY valid_at, uuid) AS invalid_at, lead(valid_at) OVER (PARTITION BY src, dst ORDER BY valid_at, uuid) AS expired_at FROM facts""",
    "mentions": """SELECT src || '-' || dst AS uuid, src, dst, 'g0' AS group_id FROM (SELECT DISTINCT 'O' || l_orderkey AS src, 'P' || l_partkey AS dst FROM lineitem)""",
    "community": """SELECT 'N' || n_nationkey AS uuid, n_name AS name, 'g0' AS group_id, TIMESTAMP '2024-01-01' + to_hours(n_nationkey) AS created_at, 0 AS level FROM nation
      UNION ALL SELECT 'R' || r_regionkey, r_name, 'g0', TIMESTAMP '2024-01-01' + to_hours(r_regionkey), 1 FROM region""",
    "has_member": """SELECT src || '-' || dst AS uuid, src, dst, dst_label, 'g0' AS group_id FROM (
      SELECT 'N' || s_nationkey AS src, 'S' || s_suppkey AS dst, 'entity' AS dst_label FROM supplier UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'entity' FROM customer
      UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey, 'community' FROM nation)""",
}


def with_tables(sql: str) -> str:
    """``sql`` behind the CTEs of the graph tables that it names."""
    need: list[str] = []

    def add(text: str) -> None:
        import re

        for name, body in SQL_TABLES.items():
            if re.search(rf"\b{name}\b", text) and name not in need and body is not text:
                add(body)
                need.append(name)

    add(sql)
    if not need:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL_TABLES[n]})" for n in need)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"
