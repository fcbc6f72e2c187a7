"""Language identification by segmentation-marginalised unigrams (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Frame, first_by_hash, lean, slices, table, text_buffer
from .tokens import BASE, INVERSE, SLICE, Words, cut_at_gaps, find_words, lowered, powers

#: The public vocabulary; a parameter of every function that reads it.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Training documents of a language, at most (in order of a hash of their ids).
PER_LANGUAGE = 400
#: Longest word, in bytes with its mark, that is learnt from. Words of any length are scored whole.
LEARNT_BYTES = 32
#: Marks the start of a word, as the vocabulary's meta symbol does.
SPACE = 0x20
#: Words whose probabilities a task keeps for the texts to come.
KEPT_WORDS = 1 << 18
#: Rows whose crc32(key) mod FOLDS is HELD_OUT are never learnt from.
FOLDS, HELD_OUT = 5, 0

_LETTER = np.zeros(128, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes of words: all but ASCII white space.
_INK = np.ones(256, bool)
_INK[[9, 10, 11, 12, 13, 32]] = False


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Every piece of the vocabulary, lower-cased as texts are, with the word mark as a space; every single byte is one too, so each text has a segmentation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            raw = p.replace("▁", " ").encode()
            found.add(lowered(np.frombuffer(raw, np.uint8)).tobytes())
    return sorted(found)


def piece_key(raw: bytes) -> int:
    return sum((c + 1) * pow(BASE, i, 1 << 64) for i, c in enumerate(raw)) % (1 << 64)


class Lookup:
    """Piece numbers by polynomial hash, in an open table probed with whole arrays; ``sizes`` are the lengths that pieces have."""

    BITS = 20

    def __init__(self, pieces: list[bytes]):
        self.size = 1 << self.BITS
        self.keys, self.ids = np.zeros(self.size, np.uint64), np.full(self.size, len(pieces), np.int32)
        self.sizes = sorted({len(p) for p in pieces})
        self.depth = 0
        for i, p in enumerate(pieces):
            k = piece_key(p)
            at, steps = (k * 0xD6E8FEB86659FD93 % (1 << 64)) >> (64 - self.BITS), 1
            while self.ids[at] != len(pieces):
                at, steps = (at + 1) % self.size, steps + 1
            self.keys[at], self.ids[at] = k, i
            self.depth = max(self.depth, steps)
        self.none = len(pieces)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.ids[at], self.none)
        for step in range(1, self.depth):
            here = (at + step) & (self.size - 1)
            out = np.where((out == self.none) & (self.keys[here] == keys), self.ids[here], out)
        return out


def marked(low: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Words as rows of bytes, the word mark first; zeros after a shorter word."""
    width = int(length.max()) if len(length) else 0
    at = start[:, None] + np.arange(width)
    inside = np.arange(width) < length[:, None]
    body = np.where(inside, low[np.where(inside, at, 0)], 0).astype(np.uint8) if width else np.zeros((len(start), 0), np.uint8)
    return np.concatenate([np.full((len(start), 1), SPACE, np.uint8), body], axis=1)


def prefix_sums(rows: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all beginnings of each row."""
    sums = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * powers(BASE, rows.shape[1]), axis=1, out=sums[:, 1:])
    return sums


def pieces_ending(sums: np.ndarray, t: int, size: int, lookup: Lookup) -> np.ndarray:
    """The piece at the last ``size`` of the first ``t`` bytes of each row (or ``lookup.none``)."""
    return lookup.find((sums[:, t] - sums[:, t - size]) * powers(INVERSE, t + 1)[t - size])


def score_words(rows: np.ndarray, length: np.ndarray, lookup: Lookup, table: np.ndarray) -> np.ndarray:
    """log P(word | language): the forward sum over all segmentations of each row's first ``length`` bytes.

    Sums are kept over the longest piece's reach and scaled as they go, so words may be of any length.
    """
    n, width, k = len(rows), rows.shape[1], table.shape[1]
    reach = lookup.sizes[-1]
    out, scale = np.zeros((n, k)), np.zeros((n, k))
    f = np.zeros((reach + 1, n, k))
    f[0] = 1
    sums = prefix_sums(rows)
    for t in range(1, width + 1):
        now = np.zeros((n, k))
        for size in lookup.sizes:
            if size > t:
                break
            i = pieces_ending(sums, t, size, lookup)
            hit = np.flatnonzero(i != lookup.none)
            if len(hit) == n:
                now += f[(t - size) % (reach + 1)] * table[i]
            elif len(hit):
                now[hit] += f[(t - size) % (reach + 1)][hit] * table[i[hit]]
        f[t % (reach + 1)] = now
        if t % 8 == 0:
            top = f.max(axis=0)
            f /= top
            scale += np.log(top)
        done = length == t
        if done.any():
            out[done] = np.log(f[t % (reach + 1)][done]) + scale[done]
    return out


@dataclass
class Model:
    """Languages, piece probabilities (one row a piece, last row 0) and the lookup; keeps the probabilities of words it has seen."""

    languages: list[str]
    table: np.ndarray
    lookup: Lookup

    def __post_init__(self):
        self.seen, self.known = np.zeros(0, np.uint64), np.zeros((0, len(self.languages)))

    def __getstate__(self):
        return {"languages": self.languages, "table": self.table, "lookup": self.lookup}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def words(self, w: Words) -> np.ndarray:
        """log P(word | language) of every word; a distinct word is worked out once."""
        keys, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.seen, keys), max(len(self.seen) - 1, 0))
        old = self.seen[at] == keys if len(self.seen) else np.zeros(len(keys), bool)
        scores = np.empty((len(keys), len(self.languages)))
        scores[old] = self.known[at[old]] if old.any() else 0
        fresh = np.flatnonzero(~old)
        start, length = w.start[first[fresh]], (w.end - w.start)[first[fresh]]
        order = np.argsort(length, kind="stable")
        lo = 0
        while lo < len(order):
            # As many words of like length as make a small matrix; a giant word stands alone.
            hi = lo + max(1, int(np.searchsorted(np.arange(1, len(order) - lo + 1) * (length[order[lo:]] + 1), 1 << 17, side="right")))
            own = order[lo:hi]
            scores[fresh[own]] = score_words(marked(w.low, start[own], length[own]), length[own] + 1, self.lookup, self.table)
            lo = hi
        if len(fresh):
            if len(self.seen) + len(fresh) > KEPT_WORDS:
                self.seen, self.known = keys[:KEPT_WORDS], scores[:KEPT_WORDS]
            else:
                place = np.searchsorted(self.seen, keys[fresh])
                self.seen, self.known = np.insert(self.seen, place, keys[fresh]), np.insert(self.known, place, scores[fresh], axis=0)
        return scores[which]

    def log_likelihoods(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log P(text | language), number of words) of every text; a long text is read in pieces that end at white space."""
        n, k = len(offs) - 1, len(self.languages)
        total, words = np.zeros((n, k)), np.zeros(n, np.int64)
        cuts = [(0, len(data))] if n != 1 else cut_at_gaps(data, _INK, SLICE)
        for lo, hi in cuts:
            w = find_words(data[lo:hi], offs if n != 1 else np.array([0, hi - lo]), _INK)
            scores = self.words(w)
            for j in range(k):
                total[:, j] += np.bincount(w.row, scores[:, j], n)
            words += np.diff(w.first)
        return total, words


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, n): words of (lang, text) rows of up to LEARNT_BYTES bytes with the mark, lower-cased, and how often they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            for i, j in slices(offs, SLICE):
                part = data[offs[i] : offs[j]]
                w = find_words(part, offs[i : j + 1] - offs[i], _INK)
                short = np.flatnonzero(w.end - w.start < LEARNT_BYTES)
                langs = batch.column(0).slice(i, j - i).take(pa.array(w.row[short]))
                found = pa.table({"lang": langs, "word": pa.array([w.low[a:b].tobytes() for a, b in zip(w.start[short], w.end[short], strict=True)], pa.binary())})
                counted = found.group_by(["lang", "word"]).aggregate([([], "count_all")])
                yield from counted.rename_columns(["lang", "word", "n"]).to_batches()

    return texts.mapInArrow(lean(run), "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(counts: dict[str, dict[bytes, int]], pieces: list[bytes], rounds: int = 4, chunk: int = 2_048) -> Model:
    """Expectation-maximisation of each language's piece probabilities over the words of its training texts."""
    lookup, languages = Lookup(pieces), sorted(counts)
    words = sorted({w for k in languages for w in counts[k]}, key=lambda w: (len(w), w))
    size, v, reach = np.array([len(p) for p in pieces]), len(pieces), lookup.sizes[-1]
    table = np.zeros((v + 1, len(languages)))
    table[:v] = (0.05 ** size)[:, None]
    for _ in range(rounds):
        got = np.zeros((v + 1, len(languages)))
        for lo in range(0, len(words), chunk):
            own = words[lo : lo + chunk]
            length = np.array([len(w) for w in own])
            buffer = np.frombuffer(b"".join(own), np.uint8)
            rows = marked(buffer, np.cumsum(length) - length, length)
            length, width, sums = length + 1, rows.shape[1], prefix_sums(rows)
            ids = {(t, s): pieces_ending(sums, t, s, lookup) for t in range(1, width + 1) for s in lookup.sizes if s <= min(t, reach)}
            f, b = np.zeros((2, width + 1, len(own), len(languages)))
            f[0] = 1
            for t in range(1, width + 1):
                for s in (s for s in lookup.sizes if s <= t):
                    f[t] += f[t - s] * table[ids[t, s]]
            b[length, np.arange(len(own))] = 1
            for t in range(width - 1, -1, -1):
                add = sum(b[t + s] * table[ids[t + s, s]] for s in lookup.sizes if t + s <= width)
                b[t][t < length] = add[t < length]
            often = np.array([[counts[k].get(w, 0) for k in languages] for w in own])
            share = often / f[length, np.arange(len(own))]
            for (t, s), i in ids.items():
                hit = np.flatnonzero(i != lookup.none)
                mass = f[t - s][hit] * b[t][hit] * table[i[hit]] * share[hit]
                for k in range(len(languages)):
                    got[:, k] += np.bincount(i[hit], mass[:, k], v + 1)
        # Every piece keeps a little mass, a single byte more than a long piece.
        got[:v] += 0.01 * (0.5**size)[:, None] + 1e-4
        got[v] = 0
        table = got / got.sum(axis=0)
    return Model(languages, table, lookup)


def posteriors(total: np.ndarray) -> np.ndarray:
    """Language probabilities of texts, with equal priors."""
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def held_out(key) -> "F.Column":
    return (F.crc32(key.cast("string").cast("binary")) % FOLDS) == HELD_OUT


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, vocabulary: str = VOCABULARY) -> Model:
    """Fit on at most ``per_language`` labelled documents a language, outside the held-out fold, chosen by a hash of the key.

    Ids are chosen before any text is read; the chosen texts are whole and counted where they lie: the
    driver gets distinct words with their counts. Null keys, languages and texts are not learnt from.
    """
    f = Frame(docs)
    k, lab = F.col(f.at(key)), F.col(f.at(lang))
    ids = f.df.select(k.alias("id"), lab.alias("lang")).filter("id is not null and lang is not null").filter(~held_out(F.col("id"))).distinct()
    ids = first_by_hash(ids, "lang", "id", per_language)
    chosen = f.df.select(k.alias("id"), lab.alias("lang"), F.col(f.at(text)).cast("string").alias("text")).filter("text is not null").join(F.broadcast(ids.select("id", "lang")), ["id", "lang"])
    counts: dict[str, dict[bytes, int]] = {}
    found = count_words(chosen.select("lang", "text")).toArrow()
    for lang_name, word, n in zip(*(found.column(c).to_pylist() for c in range(3)), strict=True):
        counts.setdefault(lang_name, {})[word] = n
    return fit(counts, load_pieces(vocabulary))


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """All input columns plus ``lang_pred`` and ``score`` (of the predicted language, 0 to 1); the text alone decides.

    ``und`` with score 0 where the text is null or has no letter, or no language was learnt. Ties go to the
    first language by name. Input columns of the output names are replaced. Long texts are scored whole.
    """
    f = Frame(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [(f"c{i}", n) for i, n in enumerate(f.names) if n.lower() not in ("lang_pred", "score")]
    at = [c for c, _ in kept].index(f.at(text))
    df = f.df.select(*[c for c, _ in kept])
    schema = T.StructType(list(df.schema.fields)).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(at)
            data, offs = text_buffer(texts)
            for i, j in slices(offs, SLICE):
                part, edges = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                told = has_letter(part, edges) & bool(m.languages)
                p = posteriors(m.log_likelihoods(part, edges)[0]) if told.any() else None
                best = p.argmax(axis=1) if told.any() else None
                pred = [m.languages[best[r]] if told[r] else "und" for r in range(j - i)]
                score = [float(p[r, best[r]]) if told[r] else 0.0 for r in range(j - i)]
                own = batch.slice(i, j - i).columns
                yield pa.RecordBatch.from_arrays([*own, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[c for c, _ in kept] + ["lang_pred", "score"])

    return df.mapInArrow(lean(run), schema).toDF(*[n for _, n in kept], "lang_pred", "score")


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    sums = np.concatenate([[0], np.cumsum((data < 128) & _LETTER[data & 127])])
    found = sums[offs[1:]] > sums[offs[:-1]]
    for r in np.flatnonzero(~found & (np.diff(offs) > 0)):
        found[r] = any(c.isalpha() for c in data[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "replace"))
    return found


def op6_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Documents whose language is told with a score of ``least`` or more, with their own columns; the others are rejected."""
    names = docs.columns
    f = Frame(docs)
    inner = f.df.withColumnRenamed(f.at("text"), "text")
    out = identify(inner, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score")
    return out.toDF(*names)
