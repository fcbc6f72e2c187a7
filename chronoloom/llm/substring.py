"""Removal of repeated lines, paragraphs and sentences (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Frame, materialise, slices, table, text_buffer
from .tokens import BASE, INVERSE, SLICE, find_words, mixed, powers

#: A second, independent base: a unit's digest has 128 bits.
BASE_2 = 0xC2B2AE3D27D4EB4F
INVERSE_2 = pow(BASE_2, -1, 1 << 64)
#: A unit runs on over the following sentences (lines, paragraphs) until it has so many words: shorter ones recur by chance.
#: With 1, every single sentence, line or paragraph is a unit.
MIN_WORDS = 20
KINDS = ("line", "paragraph", "sentence")


def unit_breaks(low: np.ndarray, kind: str) -> np.ndarray:
    """Where a unit ends (the byte after its last), by kind: line, paragraph or sentence."""
    nl = low == 10
    if kind == "line":
        return np.flatnonzero(nl) + 1
    if kind == "paragraph":
        return np.flatnonzero(nl[1:] & nl[:-1]) + 2
    if kind == "sentence":
        stop = (low == 46) | (low == 33) | (low == 63)
        gap = (low == 32) | nl | (low == 9) | (low == 13)
        return np.concatenate([np.flatnonzero(nl) + 1, np.flatnonzero(stop[:-1] & gap[1:]) + 1])
    raise ValueError(f"no such unit: {kind}")


def find_units(data: np.ndarray, offs: np.ndarray, kind: str, least: int):
    """(row, start, end, words, digest pair) of the units: from every sentence (line, paragraph) on, as many as hold ``least`` words.

    A unit is normalised to its sequence of lower-cased words: case, punctuation and spacing do
    not count. Offsets run from its first word's first byte to the byte after its last, in the text.
    """
    w = find_words(data, offs)
    cuts = np.union1d(unit_breaks(w.low, kind) if len(data) > 1 else np.zeros(0, np.int64), offs)
    first = np.unique(np.searchsorted(w.start, cuts))
    first = first[first < len(w.start)]
    ends = np.append(first[1:], len(w.start))
    at = np.searchsorted(ends, first + least)
    keep = at < len(ends)
    first, last = first[keep], ends[at[keep]]
    inside = last <= w.first[w.row[first] + 1]
    first, last = first[inside], last[inside]
    digests = []
    for base, inverse in ((BASE, INVERSE), (BASE_2, INVERSE_2)):
        sums = np.zeros(len(w.hash) + 1, np.uint64)
        np.cumsum(w.hash * powers(base, len(w.hash)), out=sums[1:])
        tag = (last - first).astype(np.uint64) + np.uint64(KINDS.index(kind) << 48)
        digests.append(mixed((sums[last] - sums[first]) * powers(inverse, len(w.hash) + 1)[first] + tag).view(np.int64))
    row = w.row[first]
    return row, w.start[first] - offs[row], w.end[last - 1] - offs[row], last - first, *digests


UNIT_SCHEMA = "d1 bigint, d2 bigint, doc_id bigint, text_id bigint, kind tinyint, start int, stop int, words int"


def units(docs: DataFrame, kinds: tuple[str, ...], least: int, key: str, text: str) -> DataFrame:
    """Units of all texts; ``text_id`` (a hash of the text) tells rows of one id apart."""
    f = Frame(docs)
    slim = f.df.select(F.col(f.at(key)).cast("long").alias("id"), F.col(f.at(text)).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffer(batch.column(2))
            for i, j in slices(offs, SLICE):
                lo, hi = offs[i], offs[j]
                for kind in kinds:
                    row, start, stop, words, d1, d2 = find_units(data[lo:hi], offs[i : j + 1] - lo, kind, least)
                    ids, texts = (batch.column(c).slice(i, j - i).take(pa.array(row)) for c in (0, 1))
                    numbers = [pa.array(x.astype(np.int32)) for x in (start, stop, words)]
                    yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), ids, texts, pa.array(np.full(len(row), KINDS.index(kind), np.int8)), *numbers], names=["d1", "d2", "doc_id", "text_id", "kind", "start", "stop", "words"])

    return slim.select("id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, UNIT_SCHEMA)


def repeated_units(docs: DataFrame, *, kinds: tuple[str, ...] = KINDS, least: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every unit to remove: doc_id, kind, start and stop (byte offsets in the original text), words, and where its first occurrence is kept.

    Units of all documents are grouped by digest, each kind by itself; the occurrence of the smallest
    (doc_id, start) stays and every other one is listed, also within one document unless it overlaps the
    kept one. Units overlap, as each sentence (line, paragraph) begins one. Digests are pre-aggregated to a
    count and a minimum before the shuffle, so a unit in a third of all rows costs one row a task.
    Null and empty texts have no units. A null doc_id ranks after all others. Repeated rows (same
    id, same text) keep one occurrence of a unit as a pair (doc_id, start) and list no other; of
    different texts of one id the first by ``text_id`` keeps. Columns may bear any names.
    """
    found = materialise(units(docs, kinds, least, key, text), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "text_id", "start", "stop")
    groups = found.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(rank).alias("keep")).filter("n > 1")
    # A table of its own, so that the join on a very frequent unit can be split.
    groups = materialise(groups.select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), "keep", F.col("n").alias("occurrences")), "groups")
    out = found.join(groups, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")))
    here = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_id") == F.col("keep.text_id"))
    out = out.filter(~(here & (F.col("start") < F.col("keep.stop"))))
    names = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    kept = (F.col("keep.doc_id").alias("kept_doc_id"), F.col("keep.start").alias("kept_start"))
    return out.select("doc_id", "text_id", names.alias("kind"), "start", "stop", "words", *kept, "occurrences")


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the given byte ranges."""
    out, at = [], 0
    for s, e in sorted(spans):
        out.append(raw[at : max(at, s)])
        at = max(at, e)
    return b"".join([*out, raw[at:]])


def without_repeats(docs: DataFrame, *, kinds: tuple[str, ...] = KINDS, least: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with repeated units cut out of their texts; all columns stay, ``removed`` lists the cut byte ranges.

    The ranges of one text are gathered, which its own length bounds. Rows of one id are told apart by
    their texts; equal rows are cut alike. A null text stays. An input column named ``removed`` is replaced.
    """
    f = Frame(docs)
    spans = repeated_units(docs, kinds=kinds, least=least, key=key, text=text)
    spans = spans.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_id").alias("gone_text")).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("removed"))
    of = F.col(f.at(key)).cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.col(f.at(text)).cast("string")) == F.col("gone_text"))
    kept = [(f"c{i}", n) for i, n in enumerate(f.names) if n.lower() != "removed"]
    at = [c for c, _ in kept].index(f.at(text))
    joined = f.df.join(spans, of, "left").select(*[c for c, _ in kept], "removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            new = [t.as_py() if not s.is_valid else cut_spans(t.as_py().encode(), [(x["start"], x["stop"]) for x in s.as_py()]).decode() for t, s in zip(texts, batch.column(len(kept)), strict=True)]
            cols = batch.columns
            cols[at] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return joined.mapInArrow(run, joined.schema).toDF(*[n for _, n in kept], "removed")


def op3_substring(spark, sf_dir: str) -> DataFrame:
    """Repeated lines, paragraphs and sentences of all documents."""
    return repeated_units(table(spark, sf_dir, "documents")).drop("text_id")
