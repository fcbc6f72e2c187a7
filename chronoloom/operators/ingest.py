"""Episode ingestion: chunks, extraction, resolution, facts and mentions as DataFrame steps."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import dedup, resolve, store

CHUNK_BYTES = 2048
#: An extractor maps a chunk to [(name, type)], a linker a chunk and its names to [(src, dst, relation)].
Extractor = Callable[[str], list[tuple[str, str]]]
Linker = Callable[[str, list[str]], list[tuple[str, str, str]]]


def capitalised(text: str) -> list[tuple[str, str]]:
    """The offline extractor: capitalised words of four letters or more, once each, in order."""
    return [(w, "Entity") for w in dict.fromkeys(re.findall(r"\b[A-Z][a-z]{3,}\b", text))]


def adjacent(text: str, names: list[str]) -> list[tuple[str, str, str]]:
    """The offline linker: each name is related to the next."""
    return [(a, b, "FOLLOWED_BY") for a, b in zip(names, names[1:], strict=False) if a != b]


def messages_to_episodes(messages: DataFrame) -> DataFrame:
    """Conversation turns as episodes: id 'group-turn', content 'role: text', in order of time."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return messages.select(F.concat_ws("-", F.concat(F.lit("conv"), "conv_id"), "turn").alias("uuid"), F.concat(F.lit("message "), "turn").alias("name"), F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit(""))).alias("content"), F.lit("message").alias("source"), F.concat(F.lit("conv"), "conv_id").alias("group_id"), at.alias("reference"))


def skip_known(episodes: DataFrame, known: DataFrame, overwrite: bool = False) -> DataFrame:
    """Episodes whose id is not there yet; all of them if told to overwrite."""
    return episodes if overwrite else episodes.join(known.select("uuid"), "uuid", "left_anti")


def chunks(episodes: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """(episode, group_id, reference, idx, chunk)."""
    return episodes.select(F.col("uuid").alias("episode"), "group_id", "reference", F.posexplode(tx.chunk_text(F.col("content"), most)).alias("idx", "chunk"))


def extract(chunked: DataFrame, extractor: Extractor = capitalised, linker: Linker = adjacent, excluded: tuple[str, ...] = ()) -> DataFrame:
    """One row a chunk with ``names`` (blank and excluded ones dropped) and ``links`` among them; chunks without names are dropped."""

    def run(batches):
        for pdf in batches:
            out = []
            for c in pdf["chunk"]:
                names = [(n.strip(), t) for n, t in extractor(c or "") if n.strip() and t not in excluded]
                have = {n for n, _ in names}
                out.append((names, [x for x in linker(c or "", [n for n, _ in names]) if x[0] in have and x[1] in have and x[0] != x[1]]))
            yield pd.DataFrame({"episode": pdf["episode"], "group_id": pdf["group_id"], "reference": pdf["reference"], "idx": pdf["idx"], "names": [[{"name": n, "type": t} for n, t in a] for a, _ in out], "links": [[{"src": s, "dst": d, "relation": r} for s, d, r in b] for _, b in out]})

    schema = "episode string, group_id string, reference timestamp, idx int, names array<struct<name:string,type:string>>, links array<struct<src:string,dst:string,relation:string>>"
    return chunked.mapInPandas(run, schema).filter(F.size("names") > 0)


def node_id(group, name):
    """The id of an entity: a digest of its group and normalised name, so equal names of a group are one node."""
    return F.substring(F.sha2(F.concat_ws("|", group, tx.normalise_exact(name)), 256), 1, 32)


@dataclass
class Ingested:
    episodes: DataFrame
    entities: DataFrame
    edges: DataFrame
    mentions: DataFrame


def canonical_names(entities: DataFrame, known_entities: DataFrame | None) -> DataFrame:
    """(alias, canonical) of new entities (uuid, name, group_id) that are the same as a known one or as another new one by fuzzy name.

    Known nodes of the group come first (exact, then fuzzy by min-hash and shingle similarity); the rest
    are compared with each other, and the least id of a group of like names stands for it.
    """
    found = None
    rest = entities
    if known_entities is not None:
        others = known_entities.select("uuid", "name", "group_id").join(entities.select("uuid"), "uuid", "left_anti")
        found = dedup.resolve(entities, others).filter("match is not null").select(F.col("uuid").alias("alias"), F.col("match").alias("canonical"))
        rest = entities.join(found.select(F.col("alias").alias("gone")), F.col("uuid") == F.col("gone"), "left_anti")
    named = rest.select("uuid", "group_id", tx.normalise_fuzzy(F.col("name")).alias("n")).filter(tx.high_entropy(F.col("n")))
    # One node stands for each spelling of a group; like spellings are paired through their nodes.
    first = named.groupBy("group_id", "n").agg(F.min("uuid").alias("uuid"))
    equal = named.join(first.toDF("fg", "fn", "fu"), (F.col("group_id") == F.col("fg")) & (F.col("n") == F.col("fn"))).filter("uuid <> fu").select(F.col("fu").alias("a"), F.col("uuid").alias("b"))
    alike = dedup.similar_names(named.select("n"), named.select("n")).filter("a < b").select("a", "b")
    x, y = first.select("uuid", "group_id", "n").toDF("ux", "gx", "nx"), first.select("uuid", "group_id", "n").toDF("uy", "gy", "ny")
    pairs = equal.unionByName(alike.join(x, F.col("a") == F.col("nx")).join(y, (F.col("b") == F.col("ny")) & (F.col("gx") == F.col("gy"))).select(F.col("ux").alias("a"), F.col("uy").alias("b")))
    within = dedup.undirected_map(pairs).filter("alias <> canonical")
    return within if found is None else found.unionByName(within)


def ingest(
    episodes: DataFrame,
    extractor: Extractor = capitalised,
    linker: Linker = adjacent,
    known: DataFrame | None = None,
    known_edges: DataFrame | None = None,
    most: int = CHUNK_BYTES,
    *,
    known_entities: DataFrame | None = None,
    fuzzy: bool = False,
    judge: resolve.Judge | None = None,
) -> Ingested:
    """New nodes, facts and mentions of episodes, resolved within their group.

    Names are one node by exact normalised name and, if ``fuzzy``, by likeness to a known or another new name.
    A fact is one edge for each (src, dst, relation), valid from the first episode that states it. With ``known_edges``
    facts are resolved against them: one stated again stays open and gains the episodes, and only those
    end that ``judge`` finds contradicted. All steps are joins and aggregations by group, episode and name; only
    extraction and an injected judge run Python.
    """
    if known is not None:
        episodes = skip_known(episodes, known)
    found = extract(chunks(episodes, most), extractor, linker)
    names = found.select("episode", "group_id", "reference", F.explode("names").alias("x")).select("episode", "group_id", "reference", "x.name", "x.type")
    names = names.withColumn("uuid", node_id(F.col("group_id"), F.col("name")))
    links = found.select("episode", "group_id", "reference", F.explode("links").alias("x")).select("episode", "group_id", "reference", node_id(F.col("group_id"), F.col("x.src")).alias("src"), node_id(F.col("group_id"), F.col("x.dst")).alias("dst"), F.col("x.relation").alias("name"), F.concat_ws(" ", "x.src", F.lower("x.relation"), "x.dst").alias("fact"))
    if fuzzy:
        same = canonical_names(names.groupBy("uuid", "group_id").agg(F.min("name").alias("name")), known_entities)
        names = names.join(same, F.col("uuid") == F.col("alias"), "left").withColumn("uuid", F.coalesce("canonical", "uuid")).drop("alias", "canonical")
        links = store.resolve_pointers(links, same)
    entities = names.groupBy("uuid", "group_id").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("type")).alias("labels"), F.min("reference").alias("created_at"), F.countDistinct("episode").alias("episodes"))
    mentions = names.select("episode", "uuid", "group_id").distinct().select(F.concat_ws("-", "episode", "uuid").alias("uuid"), F.col("episode").alias("src"), F.col("uuid").alias("dst"), "group_id")
    facts = links.filter("src <> dst").groupBy("group_id", "src", "dst", "name").agg(F.min("reference").alias("valid_at"), F.min_by("fact", F.struct("reference", "fact")).alias("fact"), F.array_sort(F.collect_set("episode")).alias("episodes"))
    edges = facts.select(F.substring(F.sha2(F.concat_ws("|", "group_id", "src", "dst", "name"), 256), 1, 32).alias("uuid"), "src", "dst", "group_id", "name", "fact", "episodes", F.col("valid_at").alias("created_at"), "valid_at", F.lit(None).cast("timestamp").alias("invalid_at"), F.lit(None).cast("timestamp").alias("expired_at"))
    if known_edges is not None:
        edges = resolve.resolve_edges(edges, known_edges, judge, closing=judge is not None).select(*known_edges.columns)
    return Ingested(episodes, entities, edges, mentions)


def add_to_episode(episodes: DataFrame, more: DataFrame, joint: str = "\n") -> DataFrame:
    """Episodes with further text (uuid, content) after their own, a line apart; texts of one episode in order of ``content``. Unknown ids change nothing."""
    extra = more.groupBy(F.col("uuid").alias("m_id")).agg(F.array_join(F.sort_array(F.collect_list("content")), joint).alias("m_text"))
    out = episodes.join(extra, F.col("uuid") == F.col("m_id"), "left")
    return out.withColumn("content", F.when(F.col("m_id").isNull(), F.col("content")).otherwise(F.concat_ws(joint, "content", "m_text"))).drop("m_id", "m_text")


def entity_episodes(entities: DataFrame) -> DataFrame:
    """Entities given by hand (group_id, name, entity_type, attributes map, reference) as episodes that mention them.

    Rows without a group or a name are left out; a blank type reads ``entity``.
    """
    kind = F.coalesce(F.when(F.col("entity_type") != "", F.col("entity_type")), F.lit("entity"))
    pairs = F.transform(F.array_sort(F.map_keys("attributes")), lambda k: F.concat(k, F.lit(":"), F.element_at("attributes", k)))
    said = F.when(F.size("attributes") > 0, F.concat(F.lit(" with attributes: map["), F.array_join(pairs, " "), F.lit("]"))).otherwise("")
    ok = entities.filter((F.coalesce(F.col("group_id"), F.lit("")) != "") & (F.coalesce(F.col("name"), F.lit("")) != ""))
    return ok.select(
        F.concat(F.col("group_id"), F.lit("-entity-"), F.unix_timestamp("reference").cast("string")).alias("uuid"),
        F.concat(F.lit("Entity creation: "), "name").alias("name"),
        F.concat(F.lit("New "), kind, F.lit(" entity: "), F.col("name"), said).alias("content"),
        F.lit("api_entity_ingest").alias("source"),
        "group_id",
        "reference",
    )


def fit_to_persist(nodes: DataFrame, now) -> DataFrame:
    """Nodes that may be written: id, name, group and type are there; missing times are ``now`` and missing metadata is empty."""
    given = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("uuid", "name", "group_id", "type")]
    out = nodes.filter(given[0] & given[1] & given[2] & given[3])
    for c in ("created_at", "updated_at", "valid_from"):
        out = out.withColumn(c, F.coalesce(F.col(c), now))
    return out.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def sources_of(episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source nodes (one for each source name) and SOURCED_FROM links of episodes."""
    nodes = episodes.select("source").filter("source <> ''").distinct().select(F.concat(F.lit("src:"), "source").alias("uuid"), F.col("source").alias("name"))
    return nodes, episodes.filter("source <> ''").select(F.col("uuid").alias("src"), F.concat(F.lit("src:"), "source").alias("dst"))


def add_triplet(entity: DataFrame, edges: DataFrame, triplet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges after (src_name, dst_name, name, fact, group_id, valid_at) rows are added: known names keep their node, a known fact gains nothing."""
    ends = triplet.select("group_id", F.col("src_name").alias("n"), "valid_at").unionByName(triplet.select("group_id", F.col("dst_name").alias("n"), "valid_at"))
    have = entity.groupBy(F.col("group_id").alias("hg"), tx.normalise_exact(F.col("name")).alias("hn")).agg(F.min("uuid").alias("have"))
    ids = ends.groupBy("group_id", tx.normalise_exact(F.col("n")).alias("norm")).agg(F.min("n").alias("name"), F.min("valid_at").alias("created_at"))
    ids = ids.join(have, (F.col("group_id") == F.col("hg")) & (F.col("norm") == F.col("hn")), "left").withColumn("uuid", F.coalesce("have", node_id(F.col("group_id"), F.col("name"))))
    new = ids.filter("have is null").select("uuid", "name", "group_id", "created_at")
    s, d = (ids.select(F.col("group_id").alias(f"{p}g"), F.col("norm").alias(f"{p}n"), F.col("uuid").alias(p)) for p in ("src", "dst"))
    made = triplet.join(s, (F.col("group_id") == F.col("srcg")) & (tx.normalise_exact(F.col("src_name")) == F.col("srcn"))).join(d, (F.col("group_id") == F.col("dstg")) & (tx.normalise_exact(F.col("dst_name")) == F.col("dstn")))
    made = made.select(F.substring(F.sha2(F.concat_ws("|", "group_id", "src", "dst", "name"), 256), 1, 32).alias("uuid"), "src", "dst", "group_id", "name", "fact", "valid_at").dropDuplicates(["uuid"])
    fresh = made.join(edges.select("src", "dst", "name"), ["src", "dst", "name"], "left_anti")
    return entity.select("uuid", "name", "group_id", "created_at").unionByName(new), edges.select("uuid", "src", "dst", "group_id", "name", "fact", "valid_at").unionByName(fresh.select("uuid", "src", "dst", "group_id", "name", "fact", "valid_at"))


def parse_entity_reply(c):
    """Names in a language model's JSON reply: {"entities": [...]}, {"extracted_entities": [...]} or a bare list; else 'name:' lines."""
    j = tx.fenced_json(tx.strip_think(c))
    item = "array<struct<name:string>>"
    obj = F.from_json(j, f"struct<entities:{item},extracted_entities:{item}>")
    lines = F.transform(F.filter(F.split(c, "\n"), lambda x: F.lower(x).rlike("(entity|name)[^:]*:")), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "^[^:]*:", ""), "[\"',]", "")))
    listed = F.transform(F.coalesce(obj["entities"], obj["extracted_entities"], F.from_json(j, item)), lambda x: x["name"])
    return F.coalesce(F.filter(listed, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), F.filter(lines, lambda x: F.length(x) > 2))


def write_tables(result: Ingested, path: str, mode: str = "append") -> None:
    """Sink: one Parquet folder a table, by group."""
    for name in ("episodes", "entities", "edges", "mentions"):
        getattr(result, name).write.mode(mode).partitionBy("group_id").parquet(f"{path}/{name}")


__all__ = ["Ingested", "add_triplet", "chunks", "extract", "ingest", "messages_to_episodes", "node_id", "parse_entity_reply", "skip_known", "sources_of", "store", "write_tables"]
