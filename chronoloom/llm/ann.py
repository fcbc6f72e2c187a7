"""Approximate nearest neighbours by a hierarchical k-means tree (operator 5)."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Frame, first_by_hash, materialise, table

#: Vectors that one k-means tree is fitted on, at most; every vector is indexed.
FIT_ROWS = 20_000
BRANCH = 8
#: Fewest and most vectors that a leaf aims at; between them the size follows the square root of the number of vectors.
LEAF_LEAST, LEAF_MOST = 64, 4_096
#: Vectors of a leaf that one task holds when searching.
BLOCK_ROWS = 4_096
#: Mean recall that calibration asks of held-out queries.
RECALL = 0.95


def leaf_rows_for(total: int) -> int:
    return int(min(LEAF_MOST, max(LEAF_LEAST, 4 * total**0.5)))


class Tree:
    """k-means tree: ``centres[node]``, ``kids[node]`` (empty: leaf), ``leaf[node]``."""

    def __init__(self, rows: np.ndarray, leaf_rows: int, branch: int = BRANCH, seed: int = 7):
        self.centres, self.kids, self.leaf, self.leaves = [rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1])], [[]], [-1], 0
        todo = [(0, rows)]
        rng = np.random.default_rng(seed)
        while todo:
            node, own = todo.pop()
            parts = None
            if len(own) > leaf_rows:
                centres, which = kmeans(own, min(branch, max(2, -(-len(own) // leaf_rows))), rng)
                parts = [own[which == k] for k in range(len(centres))]
            if parts is None or sum(len(p) > 0 for p in parts) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            for p in parts:
                if len(p):
                    self.kids[node].append(len(self.centres))
                    todo.append((len(self.centres), p))
                    self.centres.append(p.mean(axis=0))
                    self.kids.append([])
                    self.leaf.append(-1)
        self.centres = np.array(self.centres)

    def graft(self, leaf: int, sub: Tree) -> None:
        """Put another tree in the place of a leaf; its first leaf takes the number, the others follow the last."""
        at, base = self.leaf.index(leaf), len(self.centres) - 1
        numbers = [leaf, *range(self.leaves, self.leaves + sub.leaves - 1)]
        moved = [numbers[x] if x >= 0 else -1 for x in sub.leaf]
        self.kids[at], self.leaf[at] = [k + base for k in sub.kids[0]], moved[0]
        self.centres = np.concatenate([self.centres, sub.centres[1:]])
        self.kids += [[k + base for k in kids] for kids in sub.kids[1:]]
        self.leaf += moved[1:]
        self.leaves += sub.leaves - 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by nearest centre level by level."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.kids[node]:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[self.kids[node]]
            which = np.argmax(x[rows] @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
            todo += [(kid, rows[which == k]) for k, kid in enumerate(self.kids[node]) if (which == k).any()]
        return out

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves best bin first: a queue of nodes by the inner product of query and centre."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.kids[node]:
                yield self.leaf[node]
            else:
                for kid, s in zip(self.kids[node], self.centres[self.kids[node]] @ q, strict=True):
                    heapq.heappush(queue, (-float(s), kid))


def kmeans(x: np.ndarray, k: int, rng, rounds: int = 12):
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        which = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
        fresh = np.array([x[which == j].mean(axis=0) if (which == j).any() else centres[j] for j in range(k)])
        if np.allclose(fresh, centres):
            break
        centres = fresh
    return centres, which


def calibrate(tree: Tree, sample: np.ndarray, k: int, recall: float = RECALL, queries: int = 400) -> int:
    """Leaves to visit so that held-out queries find ``recall`` of their k true neighbours in the sample: widened until reached."""
    if tree.leaves < 2 or len(sample) < 2:
        return tree.leaves
    step = max(1, len(sample) // queries)
    ask = np.arange(0, len(sample), step)
    home = tree.assign(sample)
    scores = sample[ask] @ sample.T
    scores[np.arange(len(ask)), ask] = -np.inf
    k = min(k, len(sample) - 1)
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    at = np.zeros((len(ask), tree.leaves), np.int64)
    for i, r in enumerate(ask):
        at[i, list(tree.visit(sample[r]))] = np.arange(tree.leaves)
    needed = np.take_along_axis(at, home[true], axis=1)
    for visits in range(1, tree.leaves + 1):
        if (needed < visits).mean() >= recall:
            return visits
    return tree.leaves


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def valid(vec: str) -> str:
    return f"{vec} is not null and size({vec}) > 0 and forall({vec}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vec}, x -> x <> 0)"


SCHEMA = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, *, k: int = 20, every: int = 20, key: str = "vec_id", vec: str = "embedding", fit_rows: int = FIT_ROWS, leaf_rows: int | None = None, recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest rows (largest inner product) of every row whose key is divisible by ``every``: query_id, rank, vec_id, score.

    The tree is fitted on at most ``fit_rows`` vectors (by hash order); leaves that are too large once
    every vector is indexed get a tree of their own, fitted likewise, so leaves do not grow with the table. Equal
    vectors are one entry with its k + 1 smallest ids (more can never be returned), so copies of any
    number cost one row. A query widens its visits best bin first: to the calibrated number of
    leaves, and on until they hold k + 1 entries. Stored vectors move once, to their leaf's block of
    bounded size; queries stream past each block. Each query's own row is left out.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part. An inner
    product asks for equal lengths: vectors of each length are searched among themselves. A null key
    takes no part; repeated keys with one vector count once. With fewer than k candidates
    all are returned. Columns may bear any names. No rows: empty result.
    """
    f = Frame(vectors)
    rows = f.df.select(F.col(f.at(key)).cast("long").alias("id"), F.col(f.at(vec)).cast("array<double>").alias("v")).filter("id is not null").filter(valid("v"))
    out = vectors.sparkSession.createDataFrame([], SCHEMA)
    for r in sorted(rows.groupBy(F.size("v").alias("n")).count().collect()):
        out = out.unionByName(search_length(rows.filter(F.size("v") == r["n"]), r["n"], k, every, fit_rows, leaf_rows, recall))
    return out


def grown(tree: Tree, entries: DataFrame, sizes: dict[int, int], dim: int, fit_rows: int, leaf_rows: int) -> bool:
    """Graft a tree onto every leaf of more than four times ``leaf_rows``, each fitted in a task of its own on at most ``fit_rows`` of its vectors."""
    large = sorted(leaf for leaf, n in sizes.items() if n > 4 * leaf_rows)
    if not large:
        return False
    drawn = first_by_hash(entries.filter(F.col("leaf").isin(large)).select("leaf", "h", "v"), "leaf", "h", fit_rows).select("leaf", "v")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf = int(pdf["leaf"].iloc[0])
        own = np.stack(pdf["v"].to_numpy())[np.lexsort(np.stack(pdf["v"].to_numpy()).T)]
        return pd.DataFrame({"leaf": [leaf], "tree": [pickle.dumps(Tree(own, max(2, leaf_rows * len(own) // sizes[leaf] + 1)))]})

    subs = {r["leaf"]: pickle.loads(r["tree"]) for r in drawn.groupBy("leaf").applyInPandas(fit, "leaf int, tree binary").toLocalIterator()}
    for leaf in large:
        if leaf in subs:
            tree.graft(leaf, subs[leaf])
    return any(sub.leaves > 1 for sub in subs.values())


def search_length(rows: DataFrame, dim: int, k: int, every: int, fit_rows: int, leaf_rows: int | None, recall: float) -> DataFrame:
    """``search`` over (id, v) rows of one length."""
    spark = rows.sparkSession
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("h", F.xxhash64("v"))
    # The window's row limit is applied before the shuffle too, so a vector's ids are never gathered whole.
    first = rows.distinct().withColumn("n", F.row_number().over(W.partitionBy("h", "v").orderBy("id"))).filter(f"n <= {k + 1}")
    entries = materialise(first.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    asked = materialise(rows.filter(f"id % {every} = 0").select("id", "h", "v").distinct(), "queries")
    total = entries.count()
    leaf_rows = leaf_rows or leaf_rows_for(total)
    sample = entries.select("v", F.xxhash64("h").alias("o")).orderBy("o", "v").limit(fit_rows).select("v").toArrow()["v"].combine_chunks()
    sample = as_matrix(sample, dim)
    tree = Tree(sample, max(2, min(leaf_rows, leaf_rows * len(sample) // max(total, 1) + 1)))
    placed = "v array<double>, h long, ids array<long>, leaf int"
    while True:
        shared = spark.sparkContext.broadcast(tree)

        def place(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = shared.value.assign(as_matrix(batch.column(0), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["v", "h", "ids", "leaf"])

        indexed = materialise(entries.select("v", "h", "ids").mapInArrow(place, placed), "leaves")
        sizes = {r["leaf"]: r["n"] for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        if not grown(tree, indexed, sizes, dim, fit_rows, leaf_rows):
            break
    visits = calibrate(tree, sample, k, recall)
    aim_at = spark.sparkContext.broadcast((tree, np.array([sizes.get(x, 0) for x in range(tree.leaves)])))
    # Queries with equal vectors are searched once, under the smallest of their ids.
    unique = materialise(asked.groupBy("h", "v").agg(F.min("id").alias("q")), "asked")

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held = aim_at.value
        for batch in batches:
            which, leaves, blocks = [], [], []
            for i, q in enumerate(as_matrix(batch.column(1), dim)):
                seen = found = 0
                for leaf in tree.visit(q):
                    if seen >= visits and found > k:
                        break
                    seen, found = seen + 1, found + held[leaf]
                    n = -(-held[leaf] // BLOCK_ROWS)
                    which += [i] * n
                    leaves += [leaf] * n
                    blocks += range(n)
            at = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), pa.array(blocks, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], names=["leaf", "block", "q", "v"])

    aimed = unique.select("q", "v").mapInArrow(aim, "leaf int, block int, q long, v array<double>").select("leaf", "block", "q", "v", F.lit(None).cast("array<long>").alias("ids"))
    counts = spark.createDataFrame([(int(x), -(-n // BLOCK_ROWS)) for x, n in sizes.items()], "leaf int, blocks int")
    stored = indexed.join(F.broadcast(counts), "leaf").select("leaf", F.pmod("h", "blocks").cast("int").alias("block"), F.lit(None).cast("long").alias("q"), "v", "ids")
    met = stored.unionByName(aimed).repartition("leaf", "block").sortWithinPartitions("leaf", "block", F.col("q").asc_nulls_first())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come block by block, stored vectors before queries: one block is held, queries stream past it."""
        here, points, ids, joined = None, [], [], None
        for batch in batches:
            if not len(batch):
                continue
            leaf, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((leaf[1:] != leaf[:-1]) | (block[1:] != block[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if (leaf[lo], block[lo]) != here:
                    here, points, ids, joined = (leaf[lo], block[lo]), [], [], None
                part = batch.slice(lo, hi - lo)
                n = part.column(2).null_count
                if n:
                    points.append(as_matrix(part.column(3).slice(0, n), dim))
                    ids += part.column(4).slice(0, n).to_pylist()
                    joined = None
                if n == len(part) or not ids:
                    continue
                if joined is None:
                    joined = np.concatenate(points)
                near, scores = nearest(as_matrix(part.column(3).slice(n), dim), joined, ids, k + 1)
                yield pa.RecordBatch.from_arrays([part.column(2).slice(n), pa.array(near, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], names=["q", "ids", "scores"])

    found = met.mapInArrow(scan, "q long, ids array<long>, scores array<double>")
    # Lists of k + 1 are merged in two steps, so one query's lists never meet unmerged; a merged list is no longer than its parts.
    pairs = F.arrays_zip((F.transform("scores", lambda x: -x)).alias("s"), F.col("ids").alias("i"))
    merged = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c))), 1, k + 1)
    lists = found.select("q", F.spark_partition_id().alias("p"), pairs.alias("near")).groupBy("q", "p").agg(merged("near").alias("near")).groupBy("q").agg(merged("near").alias("near"))
    of = unique.select(F.col("h").alias("u_h"), F.col("v").alias("u_v"), "q").join(lists, "q").drop("q")
    hits = asked.join(of, (F.col("h") == F.col("u_h")) & (F.col("v") == F.col("u_v")))
    own = F.slice(F.filter("near", lambda x: x["i"] != F.col("id")), 1, k)
    return hits.select(F.col("id").alias("query_id"), F.posexplode(own).alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def nearest(q: np.ndarray, p: np.ndarray, ids: np.ndarray, keep: int) -> tuple[list, list]:
    """For every query the ids and exact scores of the ``keep`` best entries, best first, ties to the smaller id; an entry may carry several ids."""
    first = np.array([x[0] for x in ids])
    several = np.array([len(x) > 1 for x in ids])
    top = min(keep, len(p))
    out_ids, out_scores = [], []
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        rough = part @ p.T
        near = np.argpartition(-rough, top - 1, axis=1)[:, :top]
        cut = np.take_along_axis(rough, near, axis=1).min(axis=1) - 1e-9
        tied = (rough >= cut[:, None]).sum(axis=1) > top
        exact = np.einsum("qkd,qd->qk", p[near], part)
        chosen = first[near]
        order = np.lexsort((chosen, -exact), axis=1)
        chosen, exact = np.take_along_axis(chosen, order, axis=1), np.take_along_axis(exact, order, axis=1)
        plain = ~(tied | several[near].any(axis=1))
        for i in range(len(part)):
            if plain[i]:
                out_ids.append(chosen[i])
                out_scores.append(exact[i])
                continue
            at = np.flatnonzero(rough[i] >= cut[i])
            score = np.einsum("kd,qd->qk", p[at], part[i : i + 1])[0]
            rows = sorted((-s, int(d)) for s, n in zip(score, at, strict=True) for d in ids[n])[:keep]
            out_ids.append(np.array([d for _, d in rows]))
            out_scores.append(np.array([-s for s, _ in rows]))
    return out_ids, out_scores


def op5_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
