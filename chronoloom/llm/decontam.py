"""Benchmark decontamination by latent semantic retrieval (operator 8)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Frame, lean, slices, table, text_buffer
from .tokens import find_words

#: Hashed terms (2**TERM_BITS) and latent dimensions.
TERM_BITS, DIMENSIONS = 14, 36
#: Leading directions left out of the map: they tell languages and boilerplate apart, which every passage of a kind shares.
LEADING = 4
#: Non-zero entries of a term in the random matrix of the decomposition.
NONZEROS = 2
#: Words of a corpus passage when the space is fitted.
PASSAGE = 32
#: Words summed at once, and window lengths: windows begin every quarter of their length, so any stretch of
#: that length lies within an eighth of one. An item is matched at the length nearest its own.
STEP, WINDOWS = 4, (4, 8, 16, 32, 48)
#: Cosine from which a window is compared with an item word by word.
COSINE = 0.5
#: Share of a window's idf weight that must lie on the item's terms before words are compared in order.
OVERLAP = 0.4
#: Share of the item's words, in order, that makes a copy; and that makes a paraphrase if the answer is there too.
COPY, PARAPHRASE = 0.75, 0.5
#: Without an answer column, an item's answer is taken to be its rarest words, so many; this share must be present.
ANSWER_WORDS, ANSWER_SHARE = 6, 0.6
#: Windows of items that one pass over the documents carries (broadcast, 2 kB each); an item beyond that stands alone.
BLOCK_PARTS = 16_384


def terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TERM_BITS)).astype(np.uint16)


def block_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index at which each run of ``size`` words begins, text by text, and each text's first run."""
    counts = -(-np.diff(first) // size)
    begin = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(counts)), counts)
    return first[text] + (np.arange(begin[-1]) - begin[text]) * size, begin


def block_sums(table: np.ndarray, ids: np.ndarray, first: np.ndarray, starts: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of ``table[ids]`` over runs of STEP words; ``table`` ends in a zero row, which fills a text's last run."""
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    ends = first[text + 1]
    none = len(table) - 1
    out = np.zeros((len(starts), table.shape[1]), np.float32)
    for lo in range(0, len(starts), 2048):
        s, e = starts[lo : lo + 2048], ends[lo : lo + 2048]
        for k in range(STEP):
            at = np.minimum(s + k, len(ids) - 1)
            out[lo : lo + 2048] += table.take(np.where(s + k < e, ids[at], none), axis=0)
    return out


def sparse_signs(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """A sparse random matrix: every term has NONZEROS columns with a sign each."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMENSIONS, (NONZEROS, 1 << TERM_BITS)), rng.choice([-1.0, 1.0], (NONZEROS, 1 << TERM_BITS))


def sketch(docs: DataFrame, *, text: str = "text", seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """One pass of the randomised decomposition over all passages of all documents.

    With T the passages' term counts and G a sparse random matrix, every task adds up T'(TG) and the
    passage frequency of each term over the rows it reads; the sums of the tasks meet by term.
    A task's sums are 2 MB whatever it reads, and are shuffled once; what reaches the driver is terms x
    (dimensions + 1) numbers, whatever the corpus.
    """
    f = Frame(docs)
    columns, signs = sparse_signs(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back, df, passages = np.zeros((DIMENSIONS, 1 << TERM_BITS)), np.zeros(1 << TERM_BITS, np.int64), 0
        for batch in batches:
            data, offs = text_buffer(batch.column(0))
            for i, j in slices(offs, 1 << 20):
                w = find_words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                if not len(w.hash):
                    continue
                ids = terms(w.hash)
                starts, _ = block_starts(w.first, PASSAGE)
                n, sizes = len(starts), np.diff(np.append(starts, len(ids)))
                of = np.repeat(np.arange(n), sizes)
                sums = sum(np.bincount(columns[z][ids] * n + of, signs[z][ids], DIMENSIONS * n) for z in range(NONZEROS)).reshape(DIMENSIONS, n)
                for k in range(DIMENSIONS):
                    back[k] += np.bincount(ids, np.repeat(sums[k], sizes), 1 << TERM_BITS)
                order = np.argsort(ids, kind="stable")
                own, at = ids[order], of[order]
                fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1])])
                df += np.bincount(own[fresh], minlength=len(df))
                passages += n
        live = np.flatnonzero(df)
        names = ["term", "df", *[f"y{k}" for k in range(DIMENSIONS)]]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(live, -1).astype(np.int32)), pa.array(np.append(df[live], passages)), *[pa.array(np.append(back[k, live], 0).astype(np.float32)) for k in range(DIMENSIONS)]], names=names)

    ys = [f"y{k}" for k in range(DIMENSIONS)]
    schema = "term int, df long, " + ", ".join(f"{y} float" for y in ys)
    slim = f.df.select(F.col(f.at(text)).cast("string").alias("text"))
    got = slim.mapInArrow(lean(run), schema).groupBy("term").agg(F.sum("df").alias("df"), *[F.sum(F.col(y).cast("double")).alias(y) for y in ys]).toArrow()
    back, df, passages = np.zeros((1 << TERM_BITS, DIMENSIONS)), np.zeros(1 << TERM_BITS), 0
    at = got["term"].to_numpy()
    real = at >= 0
    if (~real).any():
        passages = int(got["df"].to_numpy()[~real].sum())
    df[at[real]] = got["df"].to_numpy()[real]
    for k, y in enumerate(ys):
        back[at[real], k] = got[y].to_numpy()[real]
    return back, df, passages


@dataclass
class Space:
    """idf of every term and the map from terms to the latent space (one zero row more than terms)."""

    idf: np.ndarray
    project: np.ndarray


def fit_space(docs: DataFrame, *, text: str = "text") -> Space:
    """TF-IDF weights and latent directions of all passages: with D the idf weights, the left singular vectors of D T'(TG) span the leading right singular space of TD; each direction is scaled to unit spread."""
    back, df, passages = sketch(docs, text=text)
    idf = np.log((passages + 1.0) / (df + 0.5)).clip(0.1)
    u, s, _ = np.linalg.svd(back * idf[:, None], full_matrices=False)
    scale = 1 / np.sqrt(np.maximum(s, s[0] * 1e-9)) if s[0] > 0 else np.zeros(len(s))
    project = (idf[:, None] * u * scale)[:, LEADING:].astype(np.float32)
    return Space(idf, np.concatenate([project, np.zeros((1, project.shape[1]), np.float32)]))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-12)


def common_length(a: list[int], masks: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence of ``a`` and the item whose words' positions are in ``masks`` (bit-parallel)."""
    v = full = (1 << n) - 1
    for x in a:
        m = masks.get(x)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


@dataclass
class Item:
    id: int
    words: list[int]
    masks: dict[int, int]
    answer: frozenset
    given: bool


@dataclass
class Probe:
    """A block of benchmark items, ready to be searched for: latent passages by window length."""

    space: Space
    items: list[Item]
    vectors: dict[int, np.ndarray]
    owner: dict[int, np.ndarray]
    holds: dict[int, np.ndarray]


def make_probe(space: Space, rows: list[tuple]) -> Probe:
    """rows: (item_id, text, answer or None). An item longer than the longest window is searched for by its parts."""
    items, vectors, owner, parts = [], defaultdict(list), defaultdict(list), defaultdict(list)
    for item_id, text, answer in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        hashes = find_words(data, np.array([0, len(data)])).hash
        if item_id is None or not len(hashes):
            continue
        ids = terms(hashes)
        words = hashes.tolist()
        masks: dict[int, int] = {}
        for i, h in enumerate(words):
            masks[h] = masks.get(h, 0) | 1 << i
        if answer:
            raw = np.frombuffer(answer.encode(), np.uint8)
            key = frozenset(find_words(raw, np.array([0, len(raw)])).hash.tolist())
        else:
            rare = sorted(set(zip(space.idf[ids].tolist(), words, strict=True)), reverse=True)
            key = frozenset(h for _, h in rare[:ANSWER_WORDS])
        size = min(WINDOWS, key=lambda s: abs(s - len(words)))
        for lo in range(0, max(1, len(words) - size // 2), size):
            part = ids[lo : lo + size] if len(words) > size * 3 // 2 else ids
            vectors[size].append(space.project[part].sum(axis=0))
            owner[size].append(len(items))
            parts[size].append(part)
            if len(words) <= size * 3 // 2:
                break
        items.append(Item(item_id, words, masks, key, bool(answer)))
    holds = {}
    for size, some in parts.items():
        holds[size] = np.zeros((len(some), 1 << TERM_BITS - 3), np.uint8)
        for i, part in enumerate(some):
            np.bitwise_or.at(holds[size][i], part >> 3, np.uint8(1) << (part & 7).astype(np.uint8))
    return Probe(space, items, {k: unit(np.array(v, np.float32)) for k, v in vectors.items()}, {k: np.array(v) for k, v in owner.items()}, holds)


def find_leaks(data: np.ndarray, offs: np.ndarray, probe: Probe) -> list[tuple]:
    """(row, item, share of the item's words in order, cosine, start byte, stop byte, kind) of every leak in a slice of texts."""
    w = find_words(data, offs)
    if not len(w.hash) or not probe.items:
        return []
    ids = terms(w.hash)
    starts, begin = block_starts(w.first, STEP)
    sums = block_sums(probe.space.project, ids, w.first, starts, begin)
    text_of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    weight = probe.space.idf[ids].astype(np.float32)
    near: dict[tuple[int, int], list[tuple[float, int, int]]] = defaultdict(list)
    for size, vectors in probe.vectors.items():
        blocks = size // STEP
        at = np.flatnonzero((np.arange(len(starts)) - begin[text_of]) % max(1, blocks // 4) == 0)
        last = begin[text_of[at] + 1]
        for lo in range(0, len(at), 4096):
            b, stop = at[lo : lo + 4096], last[lo : lo + 4096]
            x = sums[b]
            for k in range(1, blocks):
                x += np.where((b + k < stop)[:, None], sums[np.minimum(b + k, len(sums) - 1)], 0)
            scores = unit(x) @ vectors.T
            r, c = np.nonzero(scores >= COSINE)
            for some in range(0, len(r), 8192):
                rr, cc = r[some : some + 8192], c[some : some + 8192]
                words = starts[b[rr]][:, None] + np.arange(size)
                inside = words < w.first[text_of[b[rr]] + 1][:, None]
                words = np.minimum(words, len(ids) - 1)
                gain = weight[words] * inside
                held = ids[words]
                hit = probe.holds[size][cc[:, None], held >> 3] >> (held & 7).astype(np.uint8) & np.uint8(1)
                for i in np.flatnonzero(np.einsum("ij,ij->i", gain, hit) >= OVERLAP * gain.sum(axis=1)):
                    block = b[rr[i]]
                    near[int(text_of[block]), int(probe.owner[size][cc[i]])].append((float(scores[rr[i], cc[i]]), int(starts[block]), size))
    out = []
    for (row, k), found in near.items():
        item, best = probe.items[k], None
        n = len(item.words)
        seen: set[int] = set()
        for cosine, begin_word, size in sorted(found, reverse=True):
            pad = n if n > size * 3 // 2 else (n + 1) // 2
            lo, hi = max(w.first[row], begin_word - pad), min(w.first[row + 1], begin_word + size + pad)
            if lo // STEP in seen:
                continue
            seen.add(lo // STEP)
            segment = w.hash[lo:hi].tolist()
            common = common_length(segment, item.masks, n) / n
            if best is None or common > best[0]:
                best = (common, cosine, lo, hi, segment)
        common, cosine, lo, hi, segment = best
        answered = len(item.answer & set(segment)) >= ANSWER_SHARE * len(item.answer)
        alike = "paraphrase with answer" if item.given else "paraphrase with rarest words"
        kind = "copy" if common >= COPY else alike if common >= PARAPHRASE and answered else None
        if kind:
            hit = [i for i in range(lo, hi) if int(w.hash[i]) in item.masks]
            out.append((row, item.id, common, cosine, int(w.start[hit[0]] - offs[row]), int(w.end[hit[-1]] - offs[row]), kind))
    return out


def probes(space: Space, benchmark: DataFrame, *, key: str = "item_id", text: str = "text", answer: str = "answer") -> Iterator[Probe]:
    """The benchmark in blocks of BLOCK_PARTS windows, in order of key."""
    f = Frame(benchmark)
    has = any(n.lower() == answer for n in f.names)
    rows = f.df.select(F.col(f.at(key)).cast("long").alias("k"), F.col(f.at(text)).cast("string").alias("t"), (F.col(f.at(answer)).cast("string") if has else F.lit(None).cast("string")).alias("a")).distinct().orderBy("k", "t", "a")
    block, parts = [], 0
    for r in rows.toLocalIterator():
        more = 1 + len((r["t"] or "").split()) // min(WINDOWS[-1], 24)
        if block and parts + more > BLOCK_PARTS:
            yield make_probe(space, block)
            block, parts = [], 0
        block.append((r["k"], r["t"], r["a"]))
        parts += more
    if block:
        yield make_probe(space, block)


LEAK_SCHEMA = "doc_id long, item_id long, lcs double, cosine double, start int, stop int, kind string"


def leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every (document, benchmark item) where the item stands in the document, as a copy or a paraphrase, with its byte range.

    All windows of all whole texts are searched; texts are read twice (fit, search) and never
    shuffled. ``kind`` says what was checked: the item's words in order alone (copy), or half of them and the
    answer, or, where the benchmark has none, the item's rarest words. Null and empty texts or items
    match nothing; repeated documents are listed each time; columns may bear any names; an empty benchmark or
    table gives no row.
    """
    spark, f = docs.sparkSession, Frame(docs)
    slim = f.df.select(F.col(f.at(key)).cast("long").alias("id"), F.col(f.at(text)).cast("string").alias("text"))
    out = spark.createDataFrame([], LEAK_SCHEMA)
    for probe in probes(fit_space(docs, text=text), benchmark):
        shared = spark.sparkContext.broadcast(probe)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offs = text_buffer(batch.column(1))
                for i, j in slices(offs, 1 << 20):
                    found = find_leaks(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shared.value)
                    ids = batch.column(0).slice(i, j - i).take(pa.array([r[0] for r in found], pa.int64()))
                    cols = list(zip(*found, strict=True)) or [[]] * 7
                    yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.string())], names=["doc_id", "item_id", "lcs", "cosine", "start", "stop", "kind"])

        out = out.unionByName(slim.mapInArrow(lean(run), LEAK_SCHEMA))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents in which no benchmark item stands, with all their columns, whatever their names.

    Null and empty texts stay, and so do repeated rows; an empty benchmark keeps all.
    """
    f = Frame(docs)
    out, at = f.df, int(f.at(text)[1:])
    for probe in probes(fit_space(docs, text=text), benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(probe)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offs = text_buffer(batch.column(at))
                for i, j in slices(offs, 1 << 20):
                    clean = np.ones(j - i, bool)
                    clean[[r[0] for r in find_leaks(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shared.value)]] = False
                    yield batch.slice(i, j - i).filter(pa.array(clean))

        out = out.mapInArrow(lean(run), T.StructType(out.schema.fields))
    return out.toDF(*f.names)


def op8_decontam(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
