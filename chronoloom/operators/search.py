"""Retrieval and rank fusion: BM25, vector top-k, RRF, MMR and rerankers."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import vector as vx
from .near import best_of_blocks

K1, B = 1.2, 0.75
RRF_K = 60
MAX_QUERY_WORDS = 128
DEFAULT_LIMIT = 10
MIN_SCORE = 0.6

# Words that the term-frequency reranker leaves out.
STOP_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been have has had do does did will would should could "
    "can may might must shall this that these those i you he she it we they me him her us them my your his its our their"
).split()


def limit_of(n: int) -> int:
    return n if n > 0 else DEFAULT_LIMIT


def query_terms(text: str) -> list[str]:
    """Distinct search terms of a query, in order; none for a blank query or one of too many words."""
    import re

    if not text.strip() or len(text.split()) > MAX_QUERY_WORDS:
        return []
    return list(dict.fromkeys(t for t in re.split("[^a-z0-9]+", text.lower()) if t))


def equals(word: str):
    return lambda x: x == word


def bm25(docs: DataFrame, text: str, limit: int | None = DEFAULT_LIMIT, *, key: str = "uuid", body: str = "text") -> DataFrame:
    """(key, score) of the documents that hold a term of the query, best first, ties by key.

    Okapi BM25 with k1 = 1.2, b = 0.75 and idf = ln(1 + (N - df + .5) / (df + .5)); terms are runs of
    a-z0-9. Term counts are taken inside each row, so no postings are shuffled: one pass sums N,
    the mean length and each df to one row, another scores and keeps the top.
    """
    terms = query_terms(text)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    toks = docs.select(key, tx.search_terms(F.coalesce(F.col(body), F.lit(""))).alias("t"))
    rows = toks.select(key, F.size("t").alias("dl"), *[F.size(F.filter("t", equals(q))).alias(f"tf{i}") for i, q in enumerate(terms)])
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]).head()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0

    def part(i: int) -> Column:
        df, tf = stats[f"df{i}"] or 0, F.col(f"tf{i}")
        idf = float(np.log(1 + (n - df + 0.5) / (df + 0.5)))
        return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl))))

    hit = rows.filter(reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(terms))]))
    out = hit.select(key, reduce(lambda a, b: a + b, [part(i) for i in range(len(terms))]).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit_of(limit))


def inverted_index(docs: DataFrame, *, key: str = "uuid", body: str = "text") -> DataFrame:
    """(term, key, tf, dl): postings, to be written partitioned by term when one corpus serves many queries."""
    toks = docs.select(key, tx.search_terms(F.coalesce(F.col(body), F.lit(""))).alias("t"))
    return toks.select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def contains(docs: DataFrame, text: str, columns: list[str], limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Rows where a column holds the text, case-sensitively, in key order."""
    return docs.filter(reduce(lambda a, b: a | b, [F.col(c).contains(text) for c in columns])).orderBy("uuid").limit(limit_of(limit))


def literal_vector(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def vector_top(docs: DataFrame, query: list[float], limit: int | None = DEFAULT_LIMIT, least: float = 0.0, strict: bool = True, *, key: str = "uuid", vec: str = "embedding") -> DataFrame:
    """(key, score): cosine above ``least`` (or equal, if not strict), best first, ties by key. Rows without a vector take no part."""
    scored = docs.filter(F.size(vec) > 0).select(key, vx.cosine(F.col(vec), literal_vector(query)).alias("score"))
    scored = scored.filter(F.col("score") > least if strict else F.col("score") >= least)
    return scored if limit is None else scored.orderBy(F.desc("score"), key).limit(limit_of(limit))


def ranked(scored: DataFrame, method: str, *, key: str = "uuid") -> DataFrame:
    """(key, rank0, method): places from 0 of a short result list."""
    return scored.select(key, (F.row_number().over(W.orderBy(F.desc("score"), key)) - 1).alias("rank0")).withColumn("method", F.lit(method))


def rrf(lists: list[DataFrame], limit: int | None = None, least: float = 0.0, k: int = RRF_K, *, key: str = "uuid") -> DataFrame:
    """(key, score): sum over ranked lists of 1 / (k + place), best first, ties by key."""
    both = reduce(lambda a, b: a.unionByName(b), lists)
    out = both.groupBy(key).agg(F.sum(1.0 / (F.col("rank0") + k)).alias("score")).filter(F.col("score") >= least)
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit_of(limit))


def mmr(candidates: DataFrame, query: list[float], balance: float = 0.5, least: float = -2.0, *, key: str = "uuid", vec: str = "embedding") -> DataFrame:
    """(key, score): balance * cos(query, d) - (1 - balance) * greatest cosine to another candidate (0 at least).

    Candidates are a bounded result list; they are gathered to one array and compared inside each row.
    """
    balance = balance or 0.5
    unit = candidates.select(key, vx.l2_normalise(F.col(vec)).alias("v"))
    every = unit.agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col("v").alias("v"))).alias("all"))
    q = literal_vector([x / max(1e-300, float(np.linalg.norm(query))) for x in query])
    near = F.aggregate(F.transform(F.filter("all", lambda o: o["k"] != F.col(key)), lambda o: vx.dot(o["v"], F.col("v"))), F.lit(0.0), lambda s, x: F.greatest(s, x))
    out = unit.join(F.broadcast(every)).select(key, (F.lit(balance) * vx.dot(F.col("v"), q) - F.lit(1 - balance) * near).alias("score"))
    return out.filter(F.col("score") >= least)


def mmr_order(vectors: np.ndarray, relevance: np.ndarray, top: int, balance: float) -> list[tuple[int, float]]:
    """Greedy selection: always the candidate with the largest balance * relevance - (1 - balance) * likeness to those chosen; of equals the first."""
    size = np.linalg.norm(vectors, axis=1)
    unit = np.where(size[:, None] > 0, vectors / np.where(size, size, 1)[:, None], 0)
    like = np.full(len(unit), -np.inf)
    left, out = list(range(len(unit))), []
    while left and len(out) < top:
        score = [balance * relevance[i] - (1 - balance) * (like[i] if out else 0.0) for i in left]
        best = int(np.argmax(score))
        i = left.pop(best)
        out.append((i, float(score[best])))
        like = np.maximum(like, unit @ unit[i])
    return out


def mmr_greedy(candidates: DataFrame, top: int = DEFAULT_LIMIT, balance: float = 0.5, *, query: str = "query", key: str = "uuid", vec: str = "embedding", query_vec: str = "query_embedding") -> DataFrame:
    """(query, key, pos, score): greedy MMR within each query's candidate list; a candidate without a vector has relevance 0."""
    balance = balance if balance > 0 else 0.5

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        q = np.asarray(pdf["qv"].iat[0], float)
        dim = len(q)
        x = np.array([np.asarray(v, float) if v is not None and len(v) == dim else np.zeros(dim) for v in pdf["v"]])
        scale = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
        rel = np.where(scale > 0, x @ q / np.where(scale > 0, scale, 1), 0.0)
        chosen = mmr_order(x, rel, top, balance)
        return pd.DataFrame({"query": pdf["query"].iat[0], "key": [pdf["key"].iat[i] for i, _ in chosen], "pos": range(len(chosen)), "score": [s for _, s in chosen]})

    slim = candidates.select(F.col(query).alias("query"), F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("v"), F.col(query_vec).cast("array<double>").alias("qv"))
    kind = {f.name: f.dataType.simpleString() for f in slim.schema}
    return slim.groupBy("query").applyInPandas(run, f"query {kind['query']}, key {kind['key']}, pos int, score double").withColumnRenamed("key", key)


def reranker_terms(c: Column) -> Column:
    return F.filter(tx.search_terms(c), lambda x: (F.length(x) > 2) & ~x.isin(STOP_WORDS))


def local_rerank(docs: DataFrame, text: str, *, key: str = "uuid", body: str = "text") -> DataFrame:
    """(key, score): cosine of raw term frequencies of query and passage."""
    stop = set(STOP_WORDS)
    tf: dict[str, int] = {}
    import re

    for t in re.split("[^a-z0-9]+", text.lower()):
        if len(t) > 2 and t not in stop:
            tf[t] = tf.get(t, 0) + 1
    toks = docs.select(key, reranker_terms(F.coalesce(F.col(body), F.lit(""))).alias("t"))
    # Sum of squared counts in one walk over the sorted terms: the n-th of a run adds 2n - 1.
    start = F.struct(F.lit("").alias("w"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("sq"))

    def step(s, x):
        n = F.when(s["w"] == x, s["n"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("w"), n.alias("n"), (s["sq"] + 2 * n - 1).alias("sq"))

    squares = F.aggregate(F.array_sort("t"), start, step, lambda s: s["sq"])
    size = F.sqrt(squares) * F.lit(float(np.sqrt(sum(n * n for n in tf.values()))))
    common = reduce(lambda a, b: a + b, [F.lit(float(n)) * F.size(F.filter("t", equals(q))) for q, n in tf.items()], F.lit(0.0))
    return toks.select(key, F.when(size > 0, common / size).otherwise(0.0).alias("score"))


def hash_rerank(docs: DataFrame, text: str, *, key: str = "uuid", body: str = "text") -> DataFrame:
    """(key, score): 0.9 if the passage holds the query, else word overlap plus up to 0.1 from the passage's MD5."""
    low = text.lower()
    query = low.split()
    p = F.coalesce(F.col(body), F.lit(""))
    w = tx.words(p)
    hits = F.size(F.filter(w, lambda x: x.isin(query)))
    noise = F.conv(F.substring(F.md5(p), 1, 2), 16, 10).cast("double") / 255.0 * 0.1
    union = F.lit(len(query)) + F.size(w) - hits
    score = F.when((F.size(w) == 0) | F.lit(not query), 0.0).when(F.lower(p).contains(low), 0.9).when(union == 0, 0.0).otherwise(hits / union + noise)
    return docs.select(key, score.alias("score"))


def min_max(scored: DataFrame, *, key: str = "uuid") -> DataFrame:
    """Scores of 0 or more, stretched to 0..1; all equal: 1. One row of extremes is broadcast."""
    kept = scored.filter("score >= 0")
    ends = kept.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return kept.join(F.broadcast(ends)).select(key, F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0).alias("score"))


def judged(answer: Column) -> Column:
    """A yes / no reply as a score: true 0.8, false 0.2, else 0.5."""
    low = F.lower(F.trim(answer))
    return F.when(low.startswith("true"), 0.8).when(low.startswith("false"), 0.2).otherwise(0.5)


def numeric_reply(answer: Column) -> Column:
    """The first number of a reply, held within 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.regexp_extract(answer, r"(-?\d*\.?\d+)", 1).try_cast("double")))


def distance_rerank(found: DataFrame, distances: DataFrame, centre: str, *, key: str = "uuid") -> DataFrame:
    """(key, score): 0.1 for the centre, else 1 / (1 + steps from it); 0 if out of reach."""
    d = distances.select(F.col("uuid").alias("d_id"), "depth")
    return found.select(key).join(d, F.col(key) == F.col("d_id"), "left").select(key, F.when(F.col(key) == centre, 0.1).otherwise(F.coalesce(1.0 / (1 + F.col("depth")), F.lit(0.0))).alias("score"))


def mentions_rerank(found: DataFrame, counts: DataFrame, *, key: str = "uuid") -> DataFrame:
    """(key, score): number of episodes that mention each."""
    c = counts.select(F.col("uuid").alias("c_id"), "mentions")
    return found.select(key).join(c, F.col(key) == F.col("c_id"), "left").select(key, F.coalesce("mentions", F.lit(0)).cast("double").alias("score"))


@dataclass
class Part:
    """How one kind of item is searched for and reranked."""

    methods: tuple[str, ...] = ("bm25", "cosine")
    reranker: str = "rrf"
    balance: float = 0.5
    limit: int = DEFAULT_LIMIT


@dataclass
class Recipe:
    edge: Part | None = None
    node: Part | None = None
    episode: Part | None = None
    community: Part | None = None


def _recipes() -> dict[str, Recipe]:
    bfs = ("bm25", "cosine", "bfs")
    out = {}
    for r in ("rrf", "mmr", "cross_encoder"):
        methods = bfs if r == "cross_encoder" else ("bm25", "cosine")
        p = lambda m=methods, r=r, **kw: Part(m, r, **kw)
        lam = {"balance": 1.0} if r == "mmr" else {}
        episode = Part(("bm25",), "rrf" if r == "mmr" else r)
        out[f"combined_hybrid_{r}"] = Recipe(p(**lam), p(**lam), episode, Part(("bm25", "cosine"), r, **lam))
        out[f"edge_hybrid_{r}"] = Recipe(edge=p())
        out[f"node_hybrid_{r}"] = Recipe(node=p())
        out[f"community_hybrid_{r}"] = Recipe(community=Part(("bm25", "cosine"), r, limit=3 if r == "cross_encoder" else DEFAULT_LIMIT))
    for r in ("node_distance", "episode_mentions"):
        out[f"edge_hybrid_{r}"] = Recipe(edge=Part(reranker=r))
        out[f"node_hybrid_{r}"] = Recipe(node=Part(reranker=r))
    return out


RECIPES = _recipes()


def needs_embedding(recipe: str | Recipe) -> bool:
    """Whether a recipe asks for the query's embedding: by a cosine search or by reranking for diversity."""
    r = RECIPES[recipe] if isinstance(recipe, str) else recipe
    parts = [p for p in (r.edge, r.node, r.episode, r.community) if p is not None]
    return any("cosine" in p.methods or p.reranker == "mmr" for p in parts)


def default_rerank(items: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(uuid, score): distinct items, the first ``limit`` by id, all of score 1."""
    return items.select("uuid").distinct().orderBy("uuid").limit(limit_of(limit)).select("uuid", F.lit(1.0).alias("score"))


@dataclass
class Corpus:
    """What one kind of item offers to a search: (uuid, text, embedding), and for graph methods edges and mention counts."""

    items: DataFrame
    edges: DataFrame | None = None
    mentions: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def search_part(corpus: Corpus, part: Part, text: str, query: list[float] | None, centre: str | None = None, depth: int = 2) -> DataFrame:
    """(uuid, score) of one kind of item: each method finds twice the limit, the reranker orders their union."""
    from . import graph as gr

    lists = []
    if "bm25" in part.methods and text.strip():
        lists.append(ranked(bm25(corpus.items, text, 2 * part.limit), "bm25"))
    if "cosine" in part.methods and query is not None:
        lists.append(ranked(vector_top(corpus.items, query, 2 * part.limit), "cosine"))
    if not lists:
        return corpus.items.select("uuid", F.lit(0.0).alias("score")).limit(0)
    if "bfs" in part.methods and corpus.edges is not None:
        seeds = reduce(lambda a, b: a.union(b), [x.select("uuid") for x in lists]).distinct()
        near = gr.reach(gr.directed(corpus.edges, "out"), seeds, depth).filter("depth > 0").select("uuid", (-F.col("depth")).cast("double").alias("score"))
        lists.append(ranked(near.orderBy(F.desc("score"), "uuid").limit(2 * part.limit), "bfs"))
    fused = rrf(lists)
    found = fused.join(corpus.items, "uuid")
    if part.reranker == "mmr" and query is not None:
        out = mmr(found, query, part.balance)
    elif part.reranker == "cross_encoder":
        out = local_rerank(found, text)
    elif part.reranker == "node_distance" and corpus.edges is not None and centre is not None:
        out = distance_rerank(fused, gr.reach(gr.undirected(corpus.edges), gr.one(fused.sparkSession, centre), 3), centre)
    elif part.reranker == "episode_mentions" and corpus.mentions is not None:
        out = mentions_rerank(fused, gr.mention_counts(corpus.mentions))
    else:
        out = fused
    return out.orderBy(F.desc("score"), "uuid").limit(limit_of(part.limit))


def search(corpora: dict[str, Corpus], recipe: str | Recipe, text: str, query: list[float] | None = None, centre: str | None = None) -> DataFrame:
    """(kind, uuid, score, rank) over all kinds that the recipe and the corpora share; an unknown recipe name is an error."""
    r = RECIPES[recipe] if isinstance(recipe, str) else recipe
    parts = []
    for kind in ("edge", "node", "episode", "community"):
        part = getattr(r, kind)
        if part is not None and kind in corpora:
            one = search_part(corpora[kind], part, text, query, centre)
            parts.append(one.select(F.lit(kind).alias("kind"), "uuid", "score", F.row_number().over(W.orderBy(F.desc("score"), "uuid")).alias("rank")))
    if not parts:
        raise ValueError("the recipe asks for none of the corpora given")
    return reduce(lambda a, b: a.unionByName(b), parts)


#: Rows of a group that meet in one task at a time, on each side.
BLOCK = 20_000


def relevant_pairs(queries: DataFrame, items: DataFrame, limit: int = DEFAULT_LIMIT, least: float = MIN_SCORE) -> DataFrame:
    """(query, uuid, score): for every query row (query, group_id, embedding) its best items of the same group by cosine.

    Queries and items of a group meet in blocks of about BLOCK rows of each, so a group that holds most rows is dealt
    over many tasks. A task multiplies matrices in single precision, works out in double precision what may be among a
    query's best, and keeps only those before they are shuffled. Rows without a group have no items.
    """

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.col("group_id").alias(f"g_{name}")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    def numbers(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    limit = limit_of(limit)
    kinds = {df.schema["embedding"].dataType.simpleString() for df in (queries, items)}
    kind = kinds.pop() if kinds in ({"array<float>"}, {"array<double>"}) else "array<double>"
    sizes = blocks(queries, "qn").join(blocks(items, "n"), F.col("g_qn") == F.col("g_n")).drop("g_n")
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    q = queries.filter("query is not null").join(sizes, F.col("group_id") == F.col("g_qn"))
    x = items.filter("uuid is not null").join(sizes, F.col("group_id") == F.col("g_qn"))
    vec, name = F.col("embedding").cast(kind).alias("embedding"), F.col("g_qn").cast("string").alias("g")
    q = q.select(name, block("query", "qn").alias("qb"), numbers("n").alias("b"), F.lit(0).alias("side"), "query", F.lit(None).cast(items.schema["uuid"].dataType).alias("uuid"), vec)
    x = x.select(name, numbers("qn").alias("qb"), block("uuid", "n").alias("b"), F.lit(1).alias("side"), F.lit(None).cast(queries.schema["query"].dataType).alias("query"), "uuid", vec)
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = q.unionByName(x).repartition(parts, "g", "qb", "b").sortWithinPartitions("g", "qb", "b", "side", "uuid")
    schema = T.StructType([T.StructField("query", queries.schema["query"].dataType), T.StructField("uuid", items.schema["uuid"].dataType), T.StructField("score", T.DoubleType())])
    near = rows.mapInArrow(lambda batches: best_of_blocks(batches, limit, least), schema)
    return near.withColumn("rn", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "uuid"))).filter(F.col("rn") <= limit).drop("rn")


def context_string(facts: DataFrame, entities: DataFrame, episodes: DataFrame, communities: DataFrame) -> DataFrame:
    """One row, ``context``: result lists (each with ``rank``) as JSON sections for a prompt."""

    def section(df: DataFrame, *cols: str) -> DataFrame:
        rows = F.sort_array(F.collect_list(F.struct("rank", F.struct(*cols).alias("x"))))
        return df.agg(F.to_json(F.transform(rows, lambda r: r["x"])).alias("j"))

    parts = (("FACTS", section(facts, "fact", "valid_at", "invalid_at")), ("ENTITIES", section(entities, "entity_name", "summary")), ("EPISODES", section(episodes, "source_description", "content")), ("COMMUNITIES", section(communities, "community_name", "summary")))
    out = None
    for name, df in parts:
        one = df.select(F.concat(F.lit(f"<{name}>\n"), "j", F.lit(f"\n</{name}>")).alias(name))
        out = one if out is None else out.join(one)
    return out.select(F.concat_ws("\n", *[n for n, _ in parts]).alias("context"))
