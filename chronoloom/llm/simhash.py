"""SimHash fingerprints and covering locality-sensitive hashing (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Frame, materialise, table
from .graphs import components

BITS = 64
#: XXH64 seed of a shingle.
SEED = 42
#: Lower-cases A-Z only, byte by byte.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: BYTE_BITS[v] holds the eight bits of v, highest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_digests(text: str | None, words: int) -> np.ndarray:
    """XXH64 (big-endian bytes, one row of 8 a shingle) of a text's word shingles, repeats included.

    Words are maximal runs of bytes that are not ASCII white space, A-Z lower-cased. A text of
    fewer words is one shingle; one without words has none.
    """
    toks = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not toks:
        return np.zeros((0, 8), np.uint8)
    digest = xxhash.xxh64_digest
    if len(toks) <= words:
        raw = digest(b" ".join(toks), SEED)
    else:
        line = b" ".join(toks)
        ends = np.cumsum([len(t) + 1 for t in toks]) - 1
        starts = [0, *(ends[: len(toks) - words] + 1).tolist()]
        raw = b"".join([digest(line[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)])
    return np.frombuffer(raw, np.uint8).reshape(-1, 8)


def fingerprint(digests: np.ndarray) -> int:
    """The 64-bit SimHash: a bit is set if it is set in over half of the digests."""
    n = len(digests)
    if n == 0:
        return 0
    if n < 64:
        ones = np.unpackbits(digests, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(digests[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2**(radius+1) - 1 masks such that any ``radius`` bit positions are all clear in some mask.

    Position i carries a non-zero vector m(i) over GF(2) of radius + 1 components, dealt in turn;
    mask v keeps i where <m(i), v> = 1. Any ``radius`` vectors leave a non-zero v orthogonal to all,
    so a pair that differs in at most ``radius`` bits agrees under mask v.
    """
    n = (1 << (radius + 1)) - 1
    carried = [i % n + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(carried) if (m & v).bit_count() & 1) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, *, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the key as it is and the fingerprint as a signed 64-bit integer, one row a document."""
    f = Frame(docs)
    slim = f.df.select(F.col(f.at(key)).alias("id"), F.col(f.at(text)).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [signed(fingerprint(shingle_digests(t.as_py(), words))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, fp bigint")


def covering_groups(distinct: DataFrame, radius: int = 2, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) and groups (reps): every two of ``distinct`` (fp, rep) within ``radius`` <= 2 bits are a pair or stand in a group.

    Tables: one for each covering mask, keyed by the masked fingerprint; a pair within the radius
    shares a bucket of some table. A bucket of two is compared directly. In a larger one each member
    goes to itself and to every fingerprint one flip of a masked-out bit away: two members share such
    a neighbour exactly if they differ in at most two of those bits. At most 65 different
    fingerprints can share a neighbour, so its group is small whatever the size of the bucket;
    pairs of a bucket are never listed.
    """
    if not 0 <= radius <= 2:
        raise ValueError("one-flip neighbourhoods are exact up to radius 2")
    masks = covering_masks(radius)
    flips = [[1 << i for i in range(BITS) if not m >> i & 1] for m in masks]
    tables = F.array(*[F.struct(F.lit(t).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for t, m in enumerate(masks)])
    dealt = distinct.select("fp", "rep", F.explode(tables).alias("x")).select("fp", "rep", "x.t", "x.k")
    size = dealt.groupBy("t", "k").agg(F.count("*").alias("n"), F.min(F.struct("fp", "rep")).alias("lo"), F.max(F.struct("fp", "rep")).alias("hi")).filter("n > 1")
    size = materialise(size, "buckets", rows and len(masks) * rows // 2)
    twos = size.filter("n = 2").filter(F.bit_count(F.col("lo.fp").bitwiseXOR(F.col("hi.fp"))) <= radius).select(F.col("lo.rep").alias("a"), F.col("hi.rep").alias("b"))
    large = size.filter("n > 2").select(F.col("t").alias("bt"), F.col("k").alias("bk"))
    members = dealt.join(large, (F.col("t") == F.col("bt")) & (F.col("k") == F.col("bk")), "left_semi")
    if radius == 0:
        raise ValueError("equal fingerprints are already one row")
    near = F.transform(F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(x)) for x in fl]) for fl in flips]), F.col("t") + 1), lambda x: F.col("fp").bitwiseXOR(x))
    # radius 1: a neighbour must be one of the two members itself.
    probes = members.select("fp", "rep", F.explode(near).alias("v"))
    groups = probes.groupBy("v").agg(F.collect_set("rep").alias("reps"), F.max((F.col("v") == F.col("fp")).cast("int")).alias("own"))
    groups = groups.filter(F.size("reps") > 1)
    if radius == 1:
        groups = groups.filter("own = 1")
    return twos, groups.select("reps")


def covering_links(distinct: DataFrame, radius: int = 2, rows: int | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``distinct`` (fp, rep) within ``radius`` <= 2 bits: ``covering_groups``, a star over each group."""
    twos, groups = covering_groups(distinct, radius, rows)
    stars = groups.select(F.array_min("reps").alias("b"), F.explode("reps").alias("a")).filter("a <> b").select("a", "b")
    return twos.unionByName(stars)


def near_groups(docs: DataFrame, *, words: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest key reachable).

    Documents of one fingerprint are one node (its smallest key), so a group of copies of any size
    costs one row in the link tables. Null and wordless texts have fingerprint zero and are linked
    like any other. Repeated keys stay repeated; a null key is linked by its fingerprint and only
    takes part in no minimum. An empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, words=words, key=key, text=text), "prints")
    rows = prints.count()
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("rep")).filter("rep is not null"), "distinct", rows)
    comps = components(covering_links(distinct, radius, rows)).filter("node <> component")
    roots = distinct.join(comps, distinct["rep"] == comps["node"], "left").select(F.col("fp").alias("d_fp"), F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(roots, prints["fp"] == roots["d_fp"], "left")
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
