"""Near-duplicate removal by word-shingle similarity: SimHash covering links first, then an exact prefix join (the stage form of operator 10)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Frame, lean, materialise, text_buffer
from .graphs import components
from .shingles import distinct_in_rows, each_slice, simhashes
from .simhash import covering_links
from .tokens import mixed

WORDS, SIMILARITY = 5, 0.8
#: Counters of the shingle sketch that orders shingles from rare to common, in blocks that one row holds. Fixed, whatever the input.
COUNTERS, BLOCK = 1 << 20, 1 << 14
#: Partial sums of one block of counters.
SPREAD = 8
#: A shingle that the sketch puts at more documents than this is dealt to several tasks, each with a pivot of its own.
HOT = 1 << 14
#: Two sets of 32 shingles or more whose 128-bit SimHashes differ in more bits than this are not compared. At similarity
#: 0.8 the bits differ independently with probability 0.152: 19.4 of 128 expected, and over 44 with probability 1e-9.
SKETCH_BITS, SKETCH_LEAST = 44, 32
#: Members of a bucket that one task compares with all its others, at most; larger buckets are dealt in blocks.
BLOCK_MEMBERS = 4096
#: Bits of the filter by which texts are chosen for their shingle sets (2 MB, whatever the input).
FILTER_BITS = 1 << 24


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    f = Frame(docs)
    return f.df.select(F.col(f.at(key)).cast("long").alias("id"), F.col(f.at(text)).cast("string").alias("text")).filter("id is not null")


def _i64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _levels(counts: np.ndarray) -> np.ndarray:
    """A byte for each counter: its logarithm, in eighths of a doubling."""
    return np.minimum(255, 8 * np.log2(1 + counts)).astype(np.uint8)


def sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, d, fp, fp2, m) of every text, and in rows of their own (block, counts) one task's counts of shingles by hash.

    ``d`` is a 64-bit digest of the word sequence, ``fp`` and ``fp2`` SimHashes of the distinct shingles, ``m`` their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "d", "fp", "fp2", "m", "block", "counts"]
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            for i, h, starts, d in each_slice(data, offs, words):
                h, starts = distinct_in_rows(h, starts)
                counts += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
                n = len(d)
                cols = [batch.column(0).slice(i, n), *[pa.array(_i64(x)) for x in (d, simhashes(h, starts), simhashes(mixed(h), starts))], pa.array(np.diff(starts).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if counts.any():
            n = COUNTERS // BLOCK
            packed = pa.array([zlib.compress(counts[b * BLOCK : (b + 1) * BLOCK].tobytes(), 1) for b in range(n)], pa.binary())
            task = TaskContext.get().partitionId() % SPREAD
            numbers = pa.array(np.arange(n, dtype=np.int32) * SPREAD + task)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.int32()), numbers, packed], names=names)

    return _texts(docs, key, text).mapInArrow(lean(run), "id bigint, d bigint, fp bigint, fp2 bigint, m int, block int, counts binary")


def shingle_levels(made: DataFrame) -> np.ndarray:
    """One byte for each counter, from the summed counts of all tasks; blocks are summed in tasks of their own, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.int64)
                sums[b] = sums[b] + part if b in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["block", "counts"])

    parts = made.filter("block is not null").select("block", "counts").repartition("block").mapInArrow(lean(run), "block int, counts binary")
    total = np.zeros(COUNTERS, np.int64)
    for row in parts.toLocalIterator():
        b = row["block"] // SPREAD
        total[b * BLOCK : (b + 1) * BLOCK] += np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return _levels(total)


def least_overlap(m: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that a set of ``m`` shares at least with any set of that similarity."""
    return np.ceil(similarity * m - 1e-9).astype(np.int64)


def tokens(docs: DataFrame, key: str, text: str, words: int, similarity: float, levels: np.ndarray) -> DataFrame:
    """(s, p, d): the prefix of every text's shingles, from rare to common; p packs the hot share, place and number of shingles.

    Two sets at the similarity share a shingle among the first m - ceil(similarity * m) + 1 of either, whatever the
    order, as long as it is one order for all. Equal texts of one batch are written once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    hot = int(_levels(np.array([HOT]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            for _, h, starts, d in each_slice(data, offs, words):
                h, starts = distinct_in_rows(h, starts)
                once = np.zeros(len(d), bool)
                once[np.unique(d, return_index=True)[1]] = True
                m = np.diff(starts)
                row = np.repeat(np.arange(len(m)), m)
                lv = level[(h >> np.uint64(44)).astype(np.int64)]
                order = np.lexsort((h, lv, row))
                h, lv = h[order], lv[order]
                place = np.arange(len(h)) - np.repeat(starts[:-1], m)
                keep = (place <= (m - least_overlap(m, similarity))[row]) & once[row]
                h, lv, place, row = h[keep], lv[keep].astype(np.float64), place[keep], row[keep]
                deals = np.clip(2 ** (lv / 8) / HOT, 1, 500).astype(np.uint64)
                own = mixed(d[row]) % np.maximum(deals, np.uint64(1))
                deal = np.where(lv > hot, own.astype(np.int64) + 1, 0)
                p = (deal << 54) | (place << 28) | m[row]
                yield pa.RecordBatch.from_arrays([pa.array(_i64(h)), pa.array(p), pa.array(_i64(d[row]))], names=["s", "p", "d"])

    return _texts(docs, key, text).select("id", "text").mapInArrow(lean(run), "s bigint, p bigint, d bigint")


def _fits(similarity: float, m, i, n, j):
    """Whether sets of m and n shingles, whose first shared one stands at i and j, may reach the similarity (numbers, arrays or columns)."""
    low, high = (F.least, F.greatest) if isinstance(m, Column) else (np.minimum, np.maximum)
    return (low(m, n) >= similarity * high(m, n) - 1e-9) & (low(m - i, n - j) >= similarity / (1 + similarity) * (m + n) - 1e-9)


def shared_tokens(prefixes: DataFrame, similarity: float) -> DataFrame:
    """(s, p, d, pivot): rows of shingles that two texts or more have; pivot: the text with the earliest place, if the two may be similar.

    One pass over sorted rows; of a bucket only its first row is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # (s, deal, p, d) of the open bucket's first row, and whether that row is still unwritten
        last, waiting = None, False
        for batch in batches:
            s, p, d = (batch.column(k).to_numpy() for k in range(3))
            same = np.zeros(len(s), bool)
            same[1:] = (s[1:] == s[:-1]) & (p[1:] == p[:-1]) & (d[1:] == d[:-1])
            if last is not None and len(s):
                same[0] = (s[0], p[0], d[0]) == last
            s, p, d = s[~same], p[~same], d[~same]
            if not len(s):
                continue
            last = (s[-1], p[-1], d[-1])
            if head is not None:
                s, p, d = (np.concatenate([[x], y]) for x, y in zip(head, (s, p, d), strict=True))
            deal = p >> 54
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (deal[1:] != deal[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(s)))
            run_of = np.cumsum(new) - 1
            put = (size[run_of] > 1) | (deal > 0)
            if head is not None and not waiting:
                put[0] = False
                put[1 : size[0]] = True
            # The last bucket may go on: its first row waits if it is alone so far.
            alone = size[-1] == 1 and deal[-1] == 0 and not (len(first) == 1 and head is not None and not waiting)
            lead = first[run_of]
            m, i = p & ((1 << 28) - 1), (p >> 28) & ((1 << 26) - 1)
            near = _fits(similarity, m[lead], i[lead], m, i) & (d != d[lead])
            head, waiting = (s[lead[-1]], p[lead[-1]], d[lead[-1]]), bool(alone)
            yield pa.RecordBatch.from_arrays([pa.array(s[put]), pa.array(p[put]), pa.array(d[put]), pa.array(d[lead][put], mask=~near[put])], names=["s", "p", "d", "pivot"])

    deal = F.shiftright("p", 54)
    sorted_rows = prefixes.repartition("s", deal).sortWithinPartitions("s", "p", "d")
    return sorted_rows.mapInArrow(lean(run), "s bigint, p bigint, d bigint, pivot bigint")


def chosen_sets(docs: DataFrame, key: str, text: str, words: int, ids: DataFrame) -> DataFrame:
    """(d, shingles): distinct shingle hashes (32 bits) of the texts whose id is in ``ids``, and a few more.

    The ids become a filter of fixed size that every task holds, so no text is shuffled; where
    ids outgrow it, more texts pass than needed.
    """
    slot = F.xxhash64("id").bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.expr("shiftleft(1L, cast(h & 31 as int))")
    words_of = ids.select(slot.alias("h")).groupBy(F.shiftright("h", 5).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    bitmap[words_of.column("w").to_numpy()] = words_of.column("bits").to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            h = batch.column(0).to_numpy()
            some = np.flatnonzero((bits[h >> 5] >> (h & 31).astype(np.uint32)) & np.uint32(1))
            if not len(some):
                continue
            data, offs = text_buffer(batch.column(1).take(pa.array(some)))
            for _, g, starts, d in each_slice(data, offs, words):
                g, starts = distinct_in_rows(g & np.uint64(0xFFFFFFFF), starts)
                sets = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(g.astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(_i64(d)), sets], names=["d", "shingles"])

    rows = _texts(docs, key, text).select(slot.cast("long").alias("h"), "text")
    return rows.mapInArrow(lean(run), "d bigint, shingles array<int>")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets are as similar, by exact Jaccard similarity."""
    once = sets.groupBy("d").agg(F.first("shingles").alias("x"))
    left, right = once.toDF("da", "sa"), once.toDF("db", "sb")
    both = pairs.join(left, F.col("a") == F.col("da")).join(right, F.col("b") == F.col("db"))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b")


def sketches_agree(m, n, x, y) -> Column:
    """Not ruled out by 128-bit SimHashes (columns x, y of structs fp, fp2)."""
    bits = F.bit_count(F.col(f"{x}fp").bitwiseXOR(F.col(f"{y}fp"))) + F.bit_count(F.col(f"{x}fp2").bitwiseXOR(F.col(f"{y}fp2")))
    return (F.least(m, n) < SKETCH_LEAST) | (bits <= SKETCH_BITS)


def first_pairs(shared: DataFrame, nodes: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Candidate pairs (a, b) that cost no more than a row for each row read: covering-LSH links of SimHashes, and each bucket's pivot with its members."""
    firsts = materialise(nodes.groupBy("fp").agg(F.min("d").alias("least"), F.count("*").alias("n")), "firsts")
    links = covering_links(firsts.select("fp", F.col("least").alias("rep")), radius)
    alike = firsts.filter("n > 1").select(F.col("fp").alias("e_fp"), "least")
    equal = nodes.join(alike, F.col("fp") == F.col("e_fp")).filter("d <> least").select(F.col("least").alias("a"), F.col("d").alias("b"))
    met = shared.filter("pivot is not null").select(F.col("pivot").alias("a"), F.col("d").alias("b"))
    pairs = links.unionByName(equal).unionByName(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x = nodes.select(F.col("d").alias("xd"), F.col("m").alias("xm"), F.col("fp").alias("xfp"), F.col("fp2").alias("xfp2"))
    y = nodes.select(F.col("d").alias("yd"), F.col("m").alias("ym"), F.col("fp").alias("yfp"), F.col("fp2").alias("yfp2"))
    sized = F.least("xm", "ym") >= similarity * F.greatest("xm", "ym") - 1e-9
    both = pairs.join(x, F.col("a") == F.col("xd")).join(y, F.col("b") == F.col("yd"))
    return both.filter(sized & sketches_agree(F.col("xm"), F.col("ym"), "x", "y")).select("a", "b")


def open_pairs(shared: DataFrame, nodes: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts in different groups that share a prefix shingle and may be similar: none is left out.

    Of every two texts in different groups one stands outside the bucket's largest group, so only
    such strays meet all others. Places, sizes and SimHashes are compared inside the join; a large
    bucket is dealt in blocks to several tasks.
    """
    labelled = nodes.join(groups, F.col("d") == F.col("node"), "left").select(F.col("d").alias("l_d"), "fp", "fp2", F.coalesce("component", "d").alias("g"))
    rows = shared.join(labelled, F.col("d") == F.col("l_d"))
    rows = rows.select("s", "d", "g", "fp", "fp2", F.col("p").bitwiseAND(F.lit((1 << 28) - 1)).alias("m"), F.shiftright("p", 28).bitwiseAND(F.lit((1 << 26) - 1)).alias("i"))
    rows = materialise(rows, "labelled")
    sizes = rows.groupBy("s", "g").agg(F.count("*").alias("n")).groupBy(F.col("s").alias("o_s")).agg(F.max_by("g", F.struct("n", "g")).alias("main"), F.count("*").alias("gs"), F.sum("n").alias("n")).filter("gs > 1")
    held = materialise(rows.join(sizes, F.col("s") == F.col("o_s")).select("s", "d", "g", "fp", "fp2", "m", "i", (F.col("g") != F.col("main")).alias("stray"), F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int").alias("blocks")), "open")
    x = held.filter(F.col("i") <= F.col("m") - F.ceil(2 * similarity / (1 + similarity) * F.col("m") - 1e-9)).withColumn("blk", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int")).drop("blocks")
    y = held.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    x, y = x.toDF(*[f"x{c}" for c in x.columns]), y.toDF(*[f"y{c}" for c in y.columns])
    col = F.col
    smaller = (col("xm") < col("ym")) | ((col("xm") == col("ym")) & (col("xd") < col("yd")))
    meets = (col("xs") == col("ys")) & (col("xblk") == col("yblk")) & (col("xg") != col("yg")) & smaller
    meets = meets & _fits(similarity, col("xm"), col("xi"), col("ym"), col("yi")) & sketches_agree(col("xm"), col("ym"), "x", "y")
    both = x.filter("xstray").join(y, meets).unionByName(x.filter("not xstray").join(y.filter("ystray"), meets))
    return both.select(F.least("xd", "yd").alias("a"), F.greatest("xd", "yd").alias("b")).distinct()


def similar_links(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY, radius: int = 2, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, d) of every document, d being the digest of its word sequence, (d, rep) with its smallest id, and links (a, b) between digests that connect all similar texts.

    First candidates: SimHashes within ``radius`` bits through covering LSH, and each prefix bucket's members with its
    pivot (the member with the fewest rare shingles, the original among its copies). They cost a row
    for each row read and bring together large groups of copies. Then every pair of texts that
    are not connected yet, share a prefix shingle and can be similar by their sizes, places and SimHashes is
    compared. Every candidate is checked by exact Jaccard similarity. A prefix join finds all pairs;
    the SimHash comparison loses one in 1e9 of those at the threshold.
    """
    made = materialise(sketches(docs, key, text, words), "sketches")
    levels = shingle_levels(made)
    own = made.filter("block is null").select("id", "d", "fp", "fp2", "m")
    nodes = materialise(own.groupBy("d").agg(F.min("id").alias("rep"), F.min("fp").alias("fp"), F.min("fp2").alias("fp2"), F.min("m").alias("m")), "nodes")
    shared = materialise(shared_tokens(tokens(docs, key, text, words, similarity, levels), similarity), "shared")

    def checked(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("e")).unionByName(pairs.select(F.col("b").alias("e"))).distinct()
        ids = nodes.join(ends, F.col("d") == F.col("e"), "left_semi").select(F.col("rep").alias("id"))
        sets = materialise(chosen_sets(docs, key, text, words, ids), "sets")
        return materialise(similar(pairs, sets, similarity), "links")

    pairs = materialise(first_pairs(shared, nodes, similarity, radius), "pairs")
    groups = components(checked(pairs))
    more = materialise(open_pairs(shared, nodes, groups, similarity).join(pairs, ["a", "b"], "left_anti"), "pairs")
    star = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return own.select("id", "d"), nodes.select("d", "rep"), star if more.isEmpty() else star.unionByName(checked(more))


def duplicate_ids(docs: DataFrame, **options) -> DataFrame:
    """(id, component) of every document that is not the smallest id of its group of near duplicates."""
    of, nodes, links = similar_links(docs, **options)
    # Distinct texts find their group's smallest id first; the tables end between the steps, so that joins on a large group can be split.
    grouped = materialise(nodes.join(components(links), F.col("d") == F.col("node")).select("d", "rep", F.col("component").alias("c")), "grouped")
    least = materialise(grouped.groupBy(F.col("c").alias("k")).agg(F.min("rep").alias("least")), "least")
    named = materialise(grouped.join(least, F.col("c") == F.col("k")).select(F.col("d").alias("n_d"), "least"), "named")
    firsts = materialise(nodes.join(named, F.col("d") == F.col("n_d"), "left").select(F.col("d").alias("f_d"), F.coalesce("least", "rep").alias("component")), "firsts")
    return of.join(firsts, F.col("d") == F.col("f_d")).filter("id <> component").select("id", "component").distinct()


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group of near duplicates (its smallest key), with all columns.

    Groups are connected by similarity of 0.8 or more of five-word shingles. Null and wordless texts
    are equal to each other. A key that repeats stays once; rows without a key cannot be named by
    a decision and stay. Columns may bear any names, also those used inside. An empty table gives an empty result.
    """
    f = Frame(docs)
    gone = materialise(duplicate_ids(docs, key=key, text=text, **options).select(F.col("id").alias("g_id")), "gone")
    left = f.df.join(gone, F.col(f.at(key)).cast("long") == F.col("g_id"), "left_anti")
    again = f.df.select(F.col(f.at(key)).cast("long").alias("x_id")).groupBy("x_id").agg(F.count("*").alias("n")).filter("n > 1 and x_id is not null").select("x_id")
    again = materialise(again, "again")
    if again.isEmpty():
        return left.toDF(*f.names)
    is_again = F.col(f.at(key)).cast("long") == F.col("x_id")
    once = left.join(again, is_again, "left_anti")
    first = left.join(again, is_again, "left_semi").dropDuplicates([f.at(key)])
    return once.unionByName(first).toDF(*f.names)
