"""Entity resolution: min-hash candidates, exact and fuzzy matches, canonical maps."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx

PERMUTATIONS, BAND, THRESHOLD = 32, 4, 0.9


def shingle_hash(seed: Column, shingle: Column) -> Column:
    """First 8 bytes of SHA-256 of 'seed:shingle' as hex, whose text order is the number's order."""
    return F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), shingle), 256), 1, 16)


def minhash(names: DataFrame, key: str = "uuid", name: str = "name") -> DataFrame:
    """(key, seed, h): the least shingle hash for every seed; names without shingles have none."""
    sh = names.select(F.col(key), F.explode(F.array_distinct(tx.shingles(tx.normalise_fuzzy(F.col(name))))).alias("s"))
    # Every distinct shingle is hashed once a seed, not once a name.
    hashed = sh.select("s").distinct().select("s", F.explode(F.sequence(F.lit(0), F.lit(PERMUTATIONS - 1))).alias("seed")).select(F.col("s").alias("hs"), "seed", shingle_hash(F.col("seed"), F.col("s")).alias("h"))
    return sh.join(hashed, F.col("s") == F.col("hs")).groupBy(key, "seed").agg(F.min("h").alias("h"))


def least_hashes():
    """A function from a set of shingles to its min-hashes; a shingle is hashed once."""
    known: dict[str, np.ndarray] = {}

    def hashes(shingle: str) -> np.ndarray:
        if shingle not in known:
            known[shingle] = np.array([int(hashlib.sha256(f"{seed}:{shingle}".encode()).hexdigest()[:16], 16) for seed in range(PERMUTATIONS)], np.uint64)
        return known[shingle]

    return lambda shingles: np.min([hashes(x) for x in shingles], axis=0)


def shingle_set(name: str) -> set[str]:
    """The set of ``tx.shingles`` of a name."""
    s = name.replace(" ", "")
    return {s} if len(s) == 1 else {s[i : i + 3] for i in range(len(s) - 2)}


def band_keys(named: DataFrame) -> DataFrame:
    """(uuid, keys): the bands of ``minhash`` for rows (uuid, s) of shingle sets, worked out inside the row."""

    def run(frames):
        least_of = least_hashes()

        def keys(shingles) -> list[str]:
            least = least_of(shingles)
            return [f"{i // BAND}:{least[i : i + BAND].tobytes().hex()}" for i in range(0, PERMUTATIONS, BAND)]

        for pdf in frames:
            yield pd.DataFrame({"uuid": pdf["uuid"], "keys": [keys(x) for x in pdf["s"]]})

    return named.select("uuid", "s").mapInPandas(run, "uuid string, keys array<string>")


def sharing_bands(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, j) of names whose signatures agree in a band, worked out inside the row."""

    def run(batches):
        least_of = least_hashes()
        for batch in batches:
            known: dict[str, int] = {}
            a, b = ([known.setdefault(x, len(known)) for x in batch.column(c).to_pylist()] for c in "ab")
            least = np.array([least_of(shingle_set(x)) for x in known]).reshape(-1, PERMUTATIONS // BAND, BAND)
            keep = (least[a] == least[b]).all(axis=2).any(axis=1)
            yield batch.filter(pa.array(keep))

    return pairs.select("a", "b", "j").mapInArrow(run, "a string, b string, j double")


def bands(signatures: DataFrame, key: str = "uuid") -> DataFrame:
    """(key, band, value): runs of BAND hashes of a signature."""
    parts = F.sort_array(F.collect_list(F.struct("seed", "h")))
    return signatures.groupBy(key, F.expr(f"seed div {BAND}").alias("band")).agg(F.concat_ws("", F.transform(parts, lambda x: x["h"])).alias("value"))


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of names (uuid, name) that share a band. Names are compared by distinct text, so copies of a name meet once."""
    l = bands(minhash(left.select(tx.normalise_fuzzy(F.col("name")).alias("uuid")).distinct().withColumn("name", F.col("uuid"))))  # noqa: E741
    r = bands(minhash(right.select(tx.normalise_fuzzy(F.col("name")).alias("uuid")).distinct().withColumn("name", F.col("uuid"))))
    r = r.withColumnsRenamed({"uuid": "b", "band": "rb", "value": "rv"})
    return l.join(r, (F.col("band") == F.col("rb")) & (F.col("value") == F.col("rv"))).select(F.col("uuid").alias("a"), "b").distinct()


def one_apart(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of names (n, s) whose shingle sets are equal or differ in one shingle, which one of them has and the other lacks.

    A set is looked up by the XOR of its hashes, whole and without each of its shingles, against whole ones of the other
    side, so little but what fits meets, however alike all names are. Chance collisions are left to the caller.
    """

    def keys(df: DataFrame, name: str, whole: list[int], less: list[int]) -> DataFrame:
        sums = df.select(F.col("n").alias(name), F.transform("s", lambda x: F.xxhash64(x)).alias("h")).withColumn("k", F.aggregate("h", F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(x)))
        full = F.transform(F.array(*map(F.lit, whole)), lambda side: F.struct(F.col("k").alias("k"), side.alias("side")))
        cut = F.transform("h", lambda x: F.struct(F.col("k").bitwiseXOR(x).alias("k"), F.lit(less[0]).alias("side")))
        return sums.select(name, F.explode(F.concat(full, cut)).alias(f"{name}_k")).select(name, F.col(f"{name}_k.k").alias(f"{name}_k"), F.col(f"{name}_k.side").alias(f"{name}_side"))

    # Side 0: the left name is whole; side 1: it lacks one, and the right name is whole.
    x, y = keys(left, "a", [0], [1]), keys(right, "b", [0, 1], [0])
    return x.join(y, (F.col("a_k") == F.col("b_k")) & (F.col("a_side") == F.col("b_side"))).select("a", "b")


#: Keys that a long name has for one number of differing shingles, at most, and places that count how often shingles occur.
KEYS, PLACES = 64, 1 << 16


def shared_rare(left: DataFrame, right: DataFrame, least: float, long: int) -> DataFrame:
    """(a, b) of names (n, s) of ``long`` shingles or more; those whose similarity is ``least`` or more are all among them.

    Shingles stand in one order from rare to common. Where the larger of two similar sets has m shingles, at most
    D = m - ceil(least * m) are not shared, so among the first D + k of each k are the same, and the sets meet by the XOR of
    these, one key for each choice. k is as large as KEYS allows: names that are alike but for some places must agree in
    nearly all of them, where one rare shingle in common says little. Chance collisions are left to the caller.
    """
    count = lambda m: int(np.ceil(least * m - 1e-9))
    sides = [df.select("n", F.xxhash64("n").alias("id"), F.transform("s", lambda x: F.xxhash64(x)).alias("h")) for df in (left, right)]
    every = sides[0].select(F.explode("h").alias("x")).unionByName(sides[1].select(F.explode("h").alias("x")))
    often = every.groupBy(F.pmod("x", F.lit(PLACES)).alias("place")).agg(F.count("*").alias("k")).toArrow()
    counts = np.zeros(PLACES, np.int64)
    counts[often.column("place").to_numpy()] = often.column("k").to_numpy()

    def choices(n: int):
        """(D, which of the n shingles each key has) for every D of a larger or equal set that n shingles may be similar to."""
        m, last = n, -1
        while m == n or count(m) <= n:
            if (d := m - count(m)) != last:
                first = next(x for x in range(long, m + 1) if x - count(x) == d)
                k = max([1, *(k for k in range(1, count(first) + 1) if comb(d + k, k) <= KEYS)])
                yield d, np.array(list(combinations(range(n - count(m) + k), k)))
                last = d
            m += 1

    def run(batches):
        known = {}
        for batch in batches:
            ids, h = batch.column("id").to_numpy(), batch.column("h")
            lens, h = pc.list_value_length(h).to_numpy(zero_copy_only=False), h.flatten().to_numpy()
            h = h[np.lexsort((h, counts[h % PLACES], np.repeat(np.arange(len(lens)), lens)))]
            starts = np.cumsum(lens) - lens
            for n in np.unique(lens).tolist():
                rows = np.flatnonzero(lens == n)
                sets = h[starts[rows][:, None] + np.arange(n)]
                if n not in known:
                    known[n] = list(choices(n))
                for d, which in known[n]:
                    keys = np.full((len(rows), len(which)), d, np.int64) * np.int64(0x1E3779B97F4A7C15)
                    for column in which.T:
                        keys ^= sets[:, column]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[rows], len(which))), pa.array(keys.ravel())], names=["id", "key"])

    x, y = (side.select("id", "h").mapInArrow(run, "id long, key long") for side in sides)
    met = x.toDF("x", "k").join(y.toDF("y", "key"), F.col("k") == F.col("key")).select("x", "y").distinct()
    a, b = (side.select("id", F.col("n").alias(name)) for side, name in zip(sides, "ab"))
    return met.join(a, F.col("x") == F.col("id")).drop("id").join(b, F.col("y") == F.col("id")).select("a", "b")


def similar_names(left: DataFrame, right: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """(a, b, j) of normalised names (column n) whose shingle similarity is ``least`` or more; nothing is lost.

    Sets of n and m shingles that alike differ in at most (1 - least) / (1 + least) * (n + m) of them. Where one
    has fewer than ``2 * least / (1 - least)`` (18 for 0.9) that is one at most: see ``one_apart``. Two sets of so many
    or more are found by ``shared_rare``.
    """
    long = int(np.ceil(2 * least / max(1 - least, 1e-9) - 1e-6))
    sets = lambda df: df.select("n").distinct().withColumn("s", F.array_distinct(tx.shingles(F.col("n")))).filter(F.size("s") > 0)
    l, r = sets(left), sets(right)  # noqa: E741
    short = one_apart(l.filter(F.size("s") <= long), r.filter(F.size("s") <= long))
    # Written once: counted, then keyed, then looked up.
    l, r = (stored(x.filter(F.size("s") >= long)) for x in (l, r))  # noqa: E741
    pairs = short if l.isEmpty() or r.isEmpty() else short.unionByName(shared_rare(l, r, least, long))

    def run(batches):
        for batch in batches:
            sets = [[shingle_set(x) for x in batch.column(c).to_pylist()] for c in "ab"]
            both = np.array([len(x & y) for x, y in zip(*sets)], np.int64)
            j = both / (np.array([len(x) + len(y) for x, y in zip(*sets)], np.int64) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(j)], names=["a", "b", "j"]).filter(pa.array(j >= least))

    return pairs.mapInArrow(run, "a string, b string, j double").distinct()


def resolve(extracted: DataFrame, existing: DataFrame) -> DataFrame:
    """(uuid, match, how): exact when one existing node has the normalised name, ``ambiguous`` when several do, else the best fuzzy match.

    Fuzzy matches need a name of high entropy, shingle similarity of 0.9 and a common min-hash band; ties go to the smaller id.
    Where both sides have a ``group_id``, matches stay within it.
    """
    grouped = "group_id" in extracted.columns and "group_id" in existing.columns
    group = lambda name: (F.coalesce("group_id", F.lit("")) if grouped else F.lit("")).alias(name)
    e = extracted.select("uuid", group("g"), tx.normalise_exact(F.col("name")).alias("exact"), tx.normalise_fuzzy(F.col("name")).alias("fuzzy"))
    x = existing.select(F.col("uuid").alias("m"), group("xg"), tx.normalise_exact(F.col("name")).alias("x_exact"), tx.normalise_fuzzy(F.col("name")).alias("x_fuzzy"))
    names = x.groupBy("x_exact", "xg").agg(F.count("*").alias("n"), F.min("m").alias("one"))
    hit = e.join(names, (F.col("exact") == F.col("x_exact")) & (F.col("g") == F.col("xg")), "left")
    done = hit.filter(F.col("n").isNotNull()).select("uuid", F.when(F.col("n") == 1, F.col("one")).alias("match"), F.when(F.col("n") == 1, "exact").otherwise("ambiguous").alias("how"))
    # Stored before the costly filter, which would else be taken to all names, and after it, as it is used twice.
    rest = stored(stored(hit.filter("n is null").select("uuid", "g", "fuzzy")).filter(tx.high_entropy(F.col("fuzzy"))))
    # Used twice below: written once to the shared folder.
    pairs = similar_names(rest.select(F.col("fuzzy").alias("n")), x.select(F.col("x_fuzzy").alias("n"))).checkpoint()
    # Equal sets have equal signatures, so only the other pairs need theirs.
    alike, others = pairs.filter("j = 1"), pairs.filter("j < 1")
    pairs = alike.unionByName(sharing_bands(others))
    least = x.groupBy("x_fuzzy", "xg").agg(F.min("m").alias("m"))
    best = pairs.join(least, F.col("b") == F.col("x_fuzzy")).groupBy("a", F.col("xg").alias("bg")).agg(F.min_by("m", F.struct(-F.col("j"), "m")).alias("m"))
    fuzzy = rest.join(best, (F.col("fuzzy") == F.col("a")) & (F.col("g") == F.col("bg"))).select("uuid", F.col("m").alias("match"), F.lit("fuzzy").alias("how"))
    return done.unionByName(fuzzy)


def word_overlap_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b, of distinct names with a word in common, through the words themselves."""
    w = nodes.select("name").distinct().select("name", F.explode(F.array_distinct(tx.words(F.col("name")))).alias("w"))
    return w.select(F.col("name").alias("a"), F.col("w").alias("wa")).join(w.select(F.col("name").alias("b"), "w"), (F.col("wa") == F.col("w")) & (F.col("a") < F.col("b"))).select("a", "b").distinct()


def similar_edges(edges: DataFrame, least: float = 0.6) -> DataFrame:
    """(a, b), a < b: edges of the same ends that share a word of their fact besides the ends', or whose embeddings are close."""
    x = edges.select(F.col("uuid").alias("a"), "src", "dst", F.col("text").alias("ta"), F.col("embedding").alias("ea"))
    y = edges.select(F.col("uuid").alias("b"), F.col("src").alias("s2"), F.col("dst").alias("d2"), F.col("text").alias("tb"), F.col("embedding").alias("eb"))
    both = x.join(y, (F.col("src") == F.col("s2")) & (F.col("dst") == F.col("d2")) & (F.col("a") < F.col("b")))
    near = tx.word_overlap(F.col("ta"), F.col("tb")) | (vx.cosine(F.col("ea"), F.col("eb")) >= least)
    return both.filter(F.coalesce(near, F.lit(False))).select("a", "b")


def similar_edge_links(edges: DataFrame, least: float = 0.6) -> DataFrame:
    """Links (a, b), a < b, that connect what ``similar_edges`` pairs: a star through each word that facts of the same ends share.

    A pair of ends with many facts costs a row for each word of a fact, never all pairs; only facts with
    embeddings are compared two by two.
    """
    held = edges.select("uuid", "src", "dst", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("w"))
    first = held.groupBy(F.col("src").alias("s2"), F.col("dst").alias("d2"), F.col("w").alias("w2")).agg(F.min("uuid").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = held.join(first, (F.col("src") == F.col("s2")) & (F.col("dst") == F.col("d2")) & (F.col("w") == F.col("w2"))).filter("uuid <> a").select("a", F.col("uuid").alias("b"))
    near = similar_edges(edges.filter(F.size("embedding") > 0), least)
    return stars.unionByName(near).distinct()


def split_key(name: str) -> Column:
    """A join key by which rows are dealt anew on both sides, even where minima by that column already lie in their place.

    Only joins whose two sides are both shuffled for them can be split by adaptive execution, so that the links of one
    hub need not meet in one task; the minima are narrow and pre-aggregated.
    """
    return F.struct(F.col(name).alias("k"))


def undirected_map(pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """(alias, canonical): the least id of each connected component of the pairs (a, b).

    Large-star and small-star steps in turn: every node hangs its larger neighbours, then its smaller ones, on the
    least of its neighbourhood, which settles in a number of rounds that grows with the logarithm of the longest
    chain. A round is checkpointed to the session's shared folder; one that does not settle is an error.
    """
    spark = pairs.sparkSession
    ensure_checkpoint_dir(spark)
    pairs = pairs.select("a", "b").distinct().checkpoint()
    nodes = pairs.select(F.col("a").alias("alias")).union(pairs.select("b")).distinct()
    links = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    for _ in range(rounds):
        # Settled once every node hangs on one other, and none that something hangs on hangs itself.
        once = links.agg((F.count("*") == F.countDistinct("a")).alias("once")).head()["once"]
        if once and links.join(links.select(F.col("b").alias("top")).distinct(), F.col("a") == F.col("top"), "left_semi").isEmpty():
            break
        both = links.union(links.select("b", "a"))
        low = both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("a"), F.min("b")).alias("m"))
        large = both.join(low, split_key("a") == split_key("k")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = large.join(low, split_key("a") == split_key("k")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        links = small.select("x.a", "x.b").filter("a <> b").distinct().checkpoint()
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(links, F.col("alias") == F.col("a"), "left").select("alias", F.coalesce("b", "alias").alias("canonical"))


def directed_map(pairs: DataFrame) -> DataFrame:
    """(alias, canonical) where each alias points to one parent (the last given, by ``pos``): chains are followed to their root by pointer doubling.

    A pointer into a cycle ends at the cycle's least id. As many rounds as the logarithm of the number of aliases
    follow any chain to its end; what still moves then stands on a cycle.
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    p = pairs.groupBy("alias").agg(F.max_by("parent", "pos").alias("to"), F.least(F.min("alias"), F.max_by("parent", "pos")).alias("low")).checkpoint()
    ahead = lambda: p.select(F.col("alias").alias("n_alias"), F.col("to").alias("n_to"), F.col("low").alias("n_low"))
    for _ in range(p.count().bit_length() + 1):
        step = p.join(ahead(), F.col("to") == F.col("n_alias"), "left")
        step = step.select("alias", F.coalesce("n_to", "to").alias("to"), F.least("low", F.coalesce("n_low", "low")).alias("low"), F.col("n_to").isNotNull().alias("moved")).checkpoint()
        p = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    return p.join(ahead(), F.col("to") == F.col("n_alias"), "left").select("alias", F.coalesce("n_low", "to").alias("canonical"))


def ensure_checkpoint_dir(spark) -> None:
    """Use the session's ``spark.checkpoint.dir``; only a session on one machine without one gets a local folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.sparkContext.setCheckpointDir(path)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the session's shared folder; of long tables it takes a part of what a checkpoint does."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merge_edges(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """One edge of each group: the canonical one, its empty text and name filled from the first member that has them."""
    m = edges.join(canonical.withColumnRenamed("alias", "al"), F.col("uuid") == F.col("al"), "left").withColumn("root", F.coalesce("canonical", "uuid"))
    some = lambda c: F.min_by(c, F.when(F.col(c) != "", F.struct((F.col("uuid") != F.col("root")).alias("other"), F.col("uuid"))))
    return m.groupBy(F.col("root").alias("uuid")).agg(F.min("src").alias("src"), F.min("dst").alias("dst"), some("name").alias("name"), some("text").alias("text"), F.count("*").alias("members"))


def duplicate_edges(pairs: DataFrame) -> DataFrame:
    """IS_DUPLICATE_OF edges of (src, dst, src_name, dst_name); a node is no duplicate of itself."""
    return pairs.filter("src <> dst").select("src", "dst", F.lit("IS_DUPLICATE_OF").alias("name"), F.concat("src_name", F.lit(" is a duplicate of "), "dst_name").alias("fact"))


def by_episode(items: DataFrame, canonical: DataFrame) -> DataFrame:
    """(episode, uuid): distinct canonical ids of each episode's items."""
    m = items.join(canonical.withColumnRenamed("alias", "al"), F.col("uuid") == F.col("al"), "left")
    return m.select("episode", F.coalesce("canonical", "uuid").alias("uuid")).distinct()


def first_of(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in an order; rows without a key are left out."""
    return rows.filter(F.coalesce(F.col(key), F.lit("")) != "").withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("rn = 1").drop("rn")
