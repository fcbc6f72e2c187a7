"""Toxicity scores: boosted trees over dense features, calibrated (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic, boost, isotonic
from .common import Frame, first_by_hash, slices, table, text_buffer
from .tokens import BASE, INVERSE, Words, find_words, mixed, powers, word_hashes

#: Labelled documents of each label that the model learns from, at most (in order of a hash of their ids).
PER_LABEL = 2_000
FOLDS, HELD_OUT = 5, 0
#: Fixed seed insults; the lexicon learnt from the training rows is added to them.
SEED_WORDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "dumb", "imbecile", "abruti", "crétin", "connard", "dummkopf", "trottel", "idioten", "abschaum", "estúpido", "imbécil", "basura", "escoria")
#: Fixed second-person pronouns of the four languages.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "tu", "toi", "te", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tú", "ti", "usted", "ustedes", "vosotros", "tus")
#: Digits and signs that stand for letters in disguised words (fixed).
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
#: Lengths, in bytes, of the word beginnings that a lexicon may hold.
STEMS = (4, 5, 6)
#: Words on either side within which a pronoun counts as near a listed word.
NEAR = 5
#: A listed unit stands in at least so many toxic training documents, and so many times as often in them as in others.
LEAST_DOCS, LEAST_RATIO = 8, 6.0
FEATURES = ("listed per word", "listed", "any listed", "densest window", "learnt weight per word", "second person near listed", "second person", "capitals", "exclamation", "question", "other punctuation", "disguised words", "disguised listed", "repeated letters", "words", "letters per word")

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *map(ord, "@$!|+*")]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLEAR = np.arange(256, dtype=np.uint8)
for _a, _b in DISGUISE.items():
    _CLEAR[ord(_a)] = ord(_b)


def stem_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the first ``size`` bytes of words longer than that; tagged so that no stem equals a whole word."""
    long = np.flatnonzero(w.end - w.start > size)
    sums = np.zeros(len(w.low) + 1, np.uint64)
    np.cumsum((w.low.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(w.low)), out=sums[1:])
    s = w.start[long]
    return long, mixed((sums[s + size] - sums[s]) * powers(INVERSE, len(w.low) + 1)[s] + np.uint64(size * 0xA24BAED4963EE407 % (1 << 64)))


@dataclass
class Lexicon:
    """Sorted hashes of listed units (whole words and stems) with their weights; word hashes of pronouns."""

    keys: np.ndarray
    weights: np.ndarray
    pronouns: np.ndarray

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.weights[at], 0.0)

    def word_weights(self, w: Words) -> np.ndarray:
        """The weight of each word: the largest of its own and its stems'; 0 if none is listed."""
        out = self.weigh(w.hash)
        for size in STEMS:
            at, h = stem_hashes(w, size)
            out[at] = np.maximum(out[at], self.weigh(h))
        return out


def document_units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, unit hash) pairs: whole words and stems."""
    w = find_words(data, offs, _PLAIN)
    rows, hashes = [w.row], [w.hash]
    for size in STEMS:
        at, h = stem_hashes(w, size)
        rows.append(w.row[at])
        hashes.append(h)
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[fresh], hashes[fresh]


def unit_counts(texts: list[str], y: np.ndarray, fold: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Units that stand in LEAST_DOCS toxic texts or more, and counts[label, fold, unit] of the texts that hold them; a slice of texts at a time."""
    found = [np.zeros(0, np.uint64)]
    toxic = np.flatnonzero(y == 1)
    data, offs = as_buffer([texts[i] for i in toxic])
    for i, j in slices(offs, 1 << 19):
        found.append(document_units(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[1])
    keys, n = np.unique(np.concatenate(found), return_counts=True)
    keys = keys[n >= LEAST_DOCS]
    counts = np.zeros((2, parts, len(keys)))
    data, offs = as_buffer(texts)
    for i, j in slices(offs, 1 << 19):
        if not len(keys):
            break
        rows, hashes = document_units(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = keys[at] == hashes
        rows, at = rows[hit] + i, at[hit]
        np.add.at(counts, (y[rows].astype(int), fold[rows], at), 1)
    return keys, counts


def learn_lexicon(keys: np.ndarray, toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> Lexicon:
    """Units that stand in toxic training documents far more often than in others, weighted by the log of the ratio; and the seed words."""
    ratio = ((toxic + 0.5) / (n_toxic + 1)) / ((other + 0.5) / (n_other + 1))
    listed = (toxic >= LEAST_DOCS) & (ratio >= LEAST_RATIO)
    weights = dict(zip(keys[listed].tolist(), np.log(ratio[listed]).tolist(), strict=True))
    for word in SEED_WORDS:
        for h in word_hashes(word).tolist():
            weights.setdefault(h, float(np.log(LEAST_RATIO)))
    order = np.array(sorted(weights), np.uint64)
    return Lexicon(order, np.array([weights[int(k)] for k in order]), np.unique(np.concatenate([word_hashes(p) for p in SECOND_PERSON])))


def seed_lexicon() -> Lexicon:
    none = np.zeros(0)
    return learn_lexicon(np.zeros(0, np.uint64), none, none, 0, 0)


def per_row(row: np.ndarray, values, n: int) -> np.ndarray:
    return np.bincount(row, values, n) if len(row) else np.zeros(n)


def features(data: np.ndarray, offs: np.ndarray, lex: Lexicon, window: int = 50) -> np.ndarray:
    """FEATURES of every text, whatever its length; an empty text has all zeros."""
    n = len(offs) - 1
    w = find_words(data, offs, _PLAIN)
    words = np.maximum(1, np.diff(w.first))
    weight = lex.word_weights(w)
    hit = weight > 0
    hits = per_row(w.row, hit, n)
    pronoun = np.isin(w.hash, lex.pronouns)
    run = np.concatenate([[0], np.cumsum(pronoun)])
    at = np.flatnonzero(hit)
    lo, hi = np.maximum(w.first[w.row[at]], at - NEAR), np.minimum(w.first[w.row[at] + 1], at + NEAR + 1)
    near = per_row(w.row[at], run[hi] - run[lo] > 0, n)
    # The most listed words among any ``window`` words that end in a listed one.
    sums = np.concatenate([[0], np.cumsum(hit)])
    densest = np.zeros(n)
    np.maximum.at(densest, w.row[at], sums[at + 1] - sums[np.maximum(w.first[w.row[at]], at + 1 - window)])
    # Words with digits or signs among their letters, read with those as letters.
    t = find_words(data, offs, _TOKEN)
    is_letter = np.concatenate([[0], np.cumsum(_PLAIN[t.low])])
    letters, size = is_letter[t.end] - is_letter[t.start], t.end - t.start
    odd = np.flatnonzero((letters > 0) & (letters < size) & _PLAIN[t.low[t.start]] & (_PLAIN[t.low[t.end - 1]] | (size - letters > 1)) | (letters > 1) & ~_PLAIN[t.low[t.start]])
    clear = find_words(data, offs, _TOKEN, low=_CLEAR[t.low])
    clear_hit = np.zeros(len(t.start), bool)
    if len(clear.start) == len(t.start):
        clear_hit = lex.word_weights(clear) > 0
    chars = np.diff(offs)
    byte_row = np.repeat(np.arange(n), chars)

    def count(mask):
        return per_row(byte_row[mask], None, n) / np.maximum(1, chars)

    upper = (data >= 65) & (data <= 90)
    same = np.zeros(len(data), bool)
    if len(data) > 2:
        same[2:] = (w.low[2:] == w.low[1:-1]) & (w.low[1:-1] == w.low[:-2]) & _PLAIN[w.low[2:]]
    other = ((data >= 33) & (data <= 47) | (data >= 58) & (data <= 64) | (data >= 91) & (data <= 96) | (data >= 123) & (data <= 126)) & (data != 33) & (data != 63) & (data != 44) & (data != 46)
    columns = [hits / words, np.log1p(hits), hits > 0, densest, per_row(w.row, weight, n) / words, near / words, per_row(w.row, pronoun, n) / words, count(upper), count(data == 33), count(data == 63), count(other), per_row(t.row[odd], None, n) / words, per_row(t.row[odd], clear_hit[odd], n) / words, count(same), np.log1p(np.diff(w.first)), per_row(w.row, w.end - w.start, n) / words]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


def text_features(texts: list[str], lex: Lexicon) -> np.ndarray:
    data, offs = as_buffer(texts)
    return np.concatenate([features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lex) for i, j in slices(offs, 1 << 19)])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    scale: Isotonic

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return self.scale(self.trees.margins(features(data, offs, self.lexicon)))


def as_buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])


def fit(texts: list[str], y: np.ndarray, parts: int = 4, share: float | None = None) -> Model:
    """Lexicon, trees and calibration; the lexicon that a fold's features use is learnt on the other folds, and the trees' margins for calibration are out of fold too. ``share``: of toxic rows among all, if the given ones are no fair sample."""
    y = np.asarray(y, float)
    if not len(texts):
        return Model(seed_lexicon(), Boosted([np.zeros(0)] * len(FEATURES), [], 0.0), isotonic(np.zeros(0), y))
    fold = np.arange(len(texts)) % parts
    keys, counts = unit_counts(texts, y, fold, parts)
    sizes = np.array([[((y == v) & (fold == k)).sum() for k in range(parts)] for v in (0, 1)], float)

    def lexicon(skip: int | None) -> Lexicon:
        use = np.arange(parts) != (-1 if skip is None else skip)
        return learn_lexicon(keys, counts[1][use].sum(axis=0), counts[0][use].sum(axis=0), sizes[1][use].sum(), sizes[0][use].sum())

    x = np.zeros((len(texts), len(FEATURES)))
    for k in range(parts):
        own, lex = np.flatnonzero(fold == k), lexicon(k)
        if len(own):
            x[own] = text_features([texts[i] for i in own], lex)
    margin = np.zeros(len(y))
    for k in range(parts):
        if (fold == k).any():
            margin[fold == k] = boost(x[fold != k], y[fold != k]).margins(x[fold == k])
    here = y.mean()
    weight = np.where(y == 1, share / max(here, 1e-9), (1 - share) / max(1 - here, 1e-9)) if share is not None else None
    return Model(lexicon(None), boost(x, y), isotonic(margin, y, weight))


def held_out(key):
    return (F.crc32(key.cast("string").cast("binary")) % FOLDS) == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """Fit on at most ``per_label`` documents of each label outside the held-out fold, by a hash of the key.

    Labels are drawn evenly; the calibration weighs them by their shares among all rows that may be learnt from, so
    scores are for the corpus's odds. Null keys, labels and texts are not learnt from; of repeated
    labels of a key the larger counts.
    """
    f, g = Frame(docs), Frame(labels)
    ids = g.df.select(F.col(g.at(key)).alias("id"), F.col(g.at(label)).alias("y")).filter("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    ids = ids.filter(~held_out(F.col("id")))
    share = ids.agg(F.avg(F.col("y").cast("double")).alias("s")).head()["s"]
    ids = first_by_hash(ids, "y", "id", per_label)
    chosen = f.df.select(F.col(f.at(key)).alias("id"), F.col(f.at(text)).cast("string").alias("text")).filter("text is not null").join(F.broadcast(ids), "id")
    got = chosen.select(F.md5(F.col("id").cast("string")).alias("o"), "text", "y").toArrow().sort_by([("o", "ascending"), ("text", "ascending")])
    return fit(got["text"].to_pylist(), np.array(got["y"].to_pylist(), float), share=share)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) for every document, scored whole; a null text scores as an empty one.

    Repeated rows and null keys stay; other columns, whatever their names, are left out.
    """
    f = Frame(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = f.df.select(F.col(f.at(key)).alias(key), F.col(f.at(text)).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            got = [shared.value.score(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in slices(offs, 1 << 20)]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[key, "score", "predicted"])

    return slim.mapInArrow(run, f"`{key}` {slim.schema[key].dataType.simpleString()}, score double, predicted int")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
