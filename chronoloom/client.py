"""One object over a graph's tables: add, search, look up, remove."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.adapters import Embedder, HashEmbedder, with_missing_embeddings
from .operators import community as cm
from .operators import filters as fl
from .operators import graph as gr
from .operators import ingest as ing
from .operators import search as se
from .operators import store as st
from .operators.dedup import ensure_checkpoint_dir

ENTITY = "uuid string, group_id string, name string, labels array<string>, summary string, created_at timestamp, embedding array<float>"
EDGE = "uuid string, src string, dst string, group_id string, name string, fact string, episodes array<string>, created_at timestamp, valid_at timestamp, invalid_at timestamp, expired_at timestamp, embedding array<float>"
EPISODE = "uuid string, name string, content string, source string, group_id string, reference timestamp, embedding array<float>"
MENTION = "uuid string, src string, dst string, group_id string"


class Client:
    """Tables are DataFrames and every change makes new ones, so a failed step changes nothing. ``save`` and ``load`` keep them as Parquet versions.

    What models make (names, links, embeddings) is worked out once, when it is added, and written to the session's
    shared folder; searches read it.
    """

    def __init__(self, spark: SparkSession, embedder: Embedder | None = None, extractor=ing.capitalised, linker=ing.adjacent):
        self.spark, self.embedder, self.extractor, self.linker = spark, embedder or HashEmbedder(), extractor, linker
        self.entities, self.edges, self.episodes, self.mentions = (spark.createDataFrame([], s) for s in (ENTITY, EDGE, EPISODE, MENTION))
        self.communities = spark.createDataFrame([], "uuid string, name string, summary string, size int")
        self.members = spark.createDataFrame([], "src string, dst string")

    def _written(self, df: DataFrame) -> DataFrame:
        """``df`` as files in the session's shared folder: what it was made from does not run again."""
        ensure_checkpoint_dir(self.spark)
        return df.checkpoint()

    def _embedded(self, df: DataFrame, text) -> DataFrame:
        """Rows without an embedding get one; the others are not sent to the model."""
        if "embedding" not in df.columns:
            df = df.withColumn("embedding", F.lit(None).cast("array<float>"))
        return with_missing_embeddings(df.withColumn("_text", text), "_text", "embedding", self.embedder).drop("_text")

    def _embed_all(self) -> None:
        """Write the tables, with embeddings of all that is new."""
        self.entities = self._written(self._embedded(self.entities, F.concat_ws(" ", "name", "summary")))
        self.edges = self._written(self._embedded(self.edges, F.concat_ws(" ", "name", "fact")))
        self.episodes = self._written(self._embedded(self.episodes, F.col("content")))
        self.mentions = self._written(self.mentions)

    def add(self, episodes: DataFrame, overwrite: bool = False, fuzzy: bool = True, judge=None) -> ing.Ingested:
        """Ingest episodes that are not there yet (or all, if told to overwrite); ``judge`` tells contradictions among facts."""
        fresh = self._written(ing.skip_known(episodes, self.episodes, overwrite))
        got = ing.ingest(fresh, self.extractor, self.linker, known_edges=self.edges, known_entities=self.entities, fuzzy=fuzzy, judge=judge)
        got = ing.Ingested(got.episodes, self._written(got.entities), self._written(got.edges), self._written(got.mentions))
        new = got.entities.select("uuid", "group_id", "name", "labels", F.lit("").alias("summary"), "created_at")
        self.entities = self.entities.unionByName(new.join(self.entities.select("uuid"), "uuid", "left_anti"), allowMissingColumns=True)
        self.edges = got.edges
        self.mentions = self.mentions.unionByName(got.mentions.join(self.mentions.select("uuid"), "uuid", "left_anti"))
        own = [c for c in self.episodes.columns if c != "embedding"]
        self.episodes = self.episodes.join(fresh.select("uuid"), "uuid", "left_anti").unionByName(fresh.select(*own), allowMissingColumns=True)
        self._embed_all()
        return got

    def add_to_episode(self, episode: str, content: str, fuzzy: bool = True) -> None:
        """More text for an episode: names and facts of the new text are added, and the text is put after the episode's own."""
        known = self.episodes.filter(F.col("uuid") == episode)
        if known.isEmpty():
            raise KeyError(episode)
        own = [c for c in self.episodes.columns if c != "embedding"]
        more = known.withColumn("content", F.lit(content)).select(*own)
        grown = ing.add_to_episode(known.select(*own), more.select("uuid", "content"))
        rest = self.episodes.filter(F.col("uuid") != episode)
        self.episodes = rest
        self.add(more, fuzzy=fuzzy)
        self.episodes = self._written(self._embedded(rest.unionByName(grown, allowMissingColumns=True), F.col("content")))

    def add_entities(self, entities: DataFrame) -> ing.Ingested:
        """Entities given by hand (group_id, name, entity_type, attributes, reference), as episodes that mention them."""
        return self.add(ing.entity_episodes(entities))

    def add_triplet(self, triplet: DataFrame) -> None:
        entities, edges = ing.add_triplet(self.entities, self.edges, triplet)
        none = F.array().cast("array<string>")
        fresh = entities.join(self.entities.select("uuid"), "uuid", "left_anti").select("uuid", "group_id", "name", none.alias("labels"), F.lit("").alias("summary"), "created_at")
        facts = edges.join(self.edges.select("uuid"), "uuid", "left_anti").select("uuid", "src", "dst", "group_id", "name", "fact", none.alias("episodes"), F.col("valid_at").alias("created_at"), "valid_at", F.lit(None).cast("timestamp").alias("invalid_at"), F.lit(None).cast("timestamp").alias("expired_at"))
        self.entities = self.entities.unionByName(fresh, allowMissingColumns=True)
        self.edges = self.edges.unionByName(facts, allowMissingColumns=True)
        self._embed_all()

    def nodes(self) -> DataFrame:
        parts = [(self.entities, "entity", "created_at"), (self.episodes, "episodic", "reference")]
        out = [t.select("uuid", "name", "group_id", F.col(at).alias("created_at"), F.lit(label).alias("label"), F.lit(i).alias("priority")) for i, (t, label, at) in enumerate(parts)]
        return out[0].unionByName(out[1])

    def get_node(self, uuid: str, group_id: str):
        row = st.get_node(self.nodes(), uuid, group_id).head()
        if row is None:
            raise KeyError(uuid)
        return row

    def get_edge(self, uuid: str, group_id: str | None = None):
        row = st.get_edges(self.edges, self.entities, [uuid], group_id).head()
        if row is None:
            raise KeyError(uuid)
        return row

    def get_episodes(self, group_id: str, reference: str, limit: int = 10) -> DataFrame:
        return fl.retrieve_episodes(self.episodes.withColumn("valid_at", F.col("reference")), reference, limit, [group_id])

    def get_nodes_and_edges_by_episode(self, episode: str) -> tuple[DataFrame, DataFrame]:
        return gr.mentioned_nodes(self.mentions, self.entities, [episode]), gr.edges_of_episode(self.edges, episode)

    def remove_episode(self, episode: str) -> None:
        self.entities, self.edges, self.mentions = st.remove_episode(episode, self.entities, self.edges, self.mentions)
        self.episodes = self.episodes.filter(F.col("uuid") != episode)

    def delete_edge(self, uuid: str, group_id: str) -> None:
        self.edges = st.delete_edges(self.edges, [uuid], group_id)

    def clear_graph(self, groups: list[str] | None = None) -> None:
        for name in ("entities", "edges", "episodes", "mentions"):
            setattr(self, name, st.clear_groups(getattr(self, name), groups))

    def search(self, text: str, recipe: str = "combined_hybrid_rrf", group_ids: list[str] | None = None, centre: str | None = None) -> DataFrame:
        """(kind, uuid, score, rank, fact) of the recipe's best hits."""
        own = (lambda t: t.filter(F.col("group_id").isin(group_ids))) if group_ids else (lambda t: t)
        items = lambda t, body: own(t).select("uuid", body.alias("text"), "embedding")
        corpora = {
            "node": se.Corpus(items(self.entities, F.concat_ws(" ", "name", "summary")), self.edges, self.mentions),
            "edge": se.Corpus(items(self.edges, F.concat_ws(" ", "name", "fact"))),
            "episode": se.Corpus(items(self.episodes, F.col("content"))),
        }
        query = self.embedder.embed([text])[0] if se.needs_embedding(recipe) else None
        hits = se.search(corpora, recipe, text, query, centre)
        facts = self.entities.select("uuid", F.coalesce(F.when(F.col("summary") != "", F.col("summary")), F.concat("name", F.lit(" is a "), F.coalesce(F.get("labels", F.lit(0)), F.lit("thing")))).alias("fact"))
        facts = facts.unionByName(self.edges.select("uuid", fl.edge_fact().alias("fact"))).unionByName(self.episodes.select("uuid", F.col("content").alias("fact")))
        return hits.join(facts, "uuid", "left")

    def get_memory(self, messages: list[str], max_facts: int = 10, group_ids: list[str] | None = None) -> list[str]:
        """Facts for a conversation: its non-blank messages are the query; nodes come before edges."""
        text = " ".join(m.strip() for m in messages if m.strip())
        if not text:
            return []
        hits = self.search(text, "combined_hybrid_rrf", group_ids).filter("kind in ('node', 'edge')").orderBy(F.desc("kind"), "rank").limit(max_facts)
        return [r.fact for r in hits.collect()]

    def remove_communities(self) -> None:
        self.communities, self.members = self.communities.limit(0), self.members.limit(0)

    def update_communities(self, rounds: int = 100) -> None:
        adjacency = gr.neighbor_counts(self.edges, self.entities)
        self.communities, self.members = cm.build_communities(cm.label_propagation(adjacency, rounds), self.entities)

    def stats(self, group_id: str | None = None) -> DataFrame:
        return st.graph_stats(self.nodes(), {"relates_to": self.edges, "mentions": self.mentions}, group_id)

    def execute_query(self, sql: str) -> DataFrame:
        for name in ("entities", "edges", "episodes", "mentions", "communities", "members"):
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(sql)

    def save(self, path: str, version: int) -> None:
        for name in ("entities", "edges", "episodes", "mentions", "communities", "members"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/v={version}/{name}")

    def load(self, path: str, version: int) -> None:
        for name in ("entities", "edges", "episodes", "mentions", "communities", "members"):
            df = self.spark.read.schema(getattr(self, name).schema).parquet(f"{path}/v={version}/{name}")
            setattr(self, name, df)
