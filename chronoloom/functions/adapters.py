"""Contracts for models that are injected, offline stand-ins, and the wrappers around their calls."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LanguageModel(Protocol):
    def chat(self, messages: list[dict]) -> str: ...


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class CrossEncoder(Protocol):
    def score(self, query: str, passages: list[str]) -> list[float]: ...


class HashEmbedder:
    """An offline embedder: signed hashed words, unit length; a text without words is all zeros."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for w in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in v))
            out.append([x / size for x in v] if size else v)
        return out


def embedding(c: Column, embedder: Embedder, batch: int = 100) -> Column:
    """Vectors of a text column, ``batch`` texts a call."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        texts, out = [t or "" for t in s], []
        for i in range(0, len(texts), batch):
            out += embedder.embed(texts[i : i + batch])
        return pd.Series(out, index=s.index, dtype=object)

    return run(c)


def with_missing_embeddings(df: DataFrame, text: str, vec: str, embedder: Embedder) -> DataFrame:
    """Rows whose vector is null or empty get one; the others are not sent to the embedder."""
    bare = F.col(vec).isNull() | (F.size(vec) == 0)
    return df.filter(~bare).unionByName(df.filter(bare).withColumn(vec, embedding(F.col(text), embedder)))


def cross_scores(pairs: DataFrame, encoder: CrossEncoder, batch: int = 10, default: float = 0.5) -> DataFrame:
    """(query, passage) rows with ``score``; a call that fails or answers short counts ``default`` for what is missing."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            scores = pd.Series(default, index=pdf.index, dtype=float)
            for query, rows in pdf.groupby("query", sort=False):
                for i in range(0, len(rows), batch):
                    part = rows.iloc[i : i + batch]
                    try:
                        got = list(encoder.score(query, list(part["passage"])))
                    except Exception:  # noqa: BLE001  a model's failure costs a default score, not the query
                        got = []
                    scores.loc[part.index] = (got + [default] * len(part))[: len(part)]
            yield pdf.assign(score=scores)

    return pairs.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", score double")


def in_batches(df: DataFrame, call: Callable[[list[dict]], list[str]], column: str, batch: int = 24) -> DataFrame:
    """``column`` filled by calls over ``batch`` rows (as dictionaries) each: attribute or summary extraction."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            out: list[str] = []
            for i in range(0, len(pdf), batch):
                rows = pdf.iloc[i : i + batch].to_dict("records")
                got = call(rows)
                out += (got + [None] * len(rows))[: len(rows)]
            yield pdf.assign(**{column: out})

    kept = [f for f in df.schema if f.name != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{column}` string"
    return df.drop(column).mapInPandas(run, schema)


class Retrying:
    """Repeats a failing call: ``tries`` more times with growing delays."""

    def __init__(self, call: Callable, tries: int = 3, initial: float = 1.0, factor: float = 2.0, most: float = 60.0, retriable: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep):
        self.call, self.tries, self.initial, self.factor, self.most, self.retriable, self.sleep = call, tries, initial, factor, most, retriable, sleep

    def __call__(self, *args, **kwargs):
        for n in range(self.tries + 1):
            try:
                return self.call(*args, **kwargs)
            except Exception as e:
                if n == self.tries or not self.retriable(e):
                    raise
                self.sleep(min(self.most, self.initial * self.factor**n))


class CircuitOpen(RuntimeError):
    pass


class CircuitBreaker:
    """Refuses calls for ``rest`` seconds once at least ``least`` calls failed at ``ratio`` or more; one trial call then closes or reopens it."""

    def __init__(self, call: Callable, least: int = 3, ratio: float = 0.6, rest: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.call, self.least, self.ratio, self.rest, self.clock = call, least, ratio, rest, clock
        self.total = self.failed = 0
        self.opened: float | None = None

    def __call__(self, *args, **kwargs):
        if self.opened is not None and self.clock() - self.opened < self.rest:
            raise CircuitOpen("too many calls failed")
        trial = self.opened is not None
        try:
            out = self.call(*args, **kwargs)
        except Exception:
            self.total, self.failed = self.total + 1, self.failed + 1
            if trial or self.total >= self.least and self.failed / self.total >= self.ratio:
                self.opened = self.clock()
            raise
        self.total, self.failed = (0, 0) if trial else (self.total + 1, self.failed)
        self.opened = None
        return out


class Router:
    """Picks a call by usage (case-insensitive) and falls back to the default one if it fails."""

    def __init__(self, default: Callable, rules: dict[str, Callable] | None = None):
        self.default, self.rules = default, {k.lower(): v for k, v in (rules or {}).items()}

    def __call__(self, usage: str | None, *args, **kwargs):
        chosen = self.rules.get((usage or "").lower(), self.default)
        try:
            return chosen(*args, **kwargs)
        except Exception:
            if chosen is self.default:
                raise
            return self.default(*args, **kwargs)


class TimedCache:
    """Values by key for ``seconds``."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.held = seconds, clock, {}

    def get(self, key, make: Callable):
        now = self.clock()
        if key not in self.held or now - self.held[key][0] > self.seconds:
            self.held[key] = (now, make())
        return self.held[key][1]


def joined(a: str, b: str) -> str:
    """Two replies with their longest common suffix / prefix written once."""
    n = next(n for n in range(min(len(a), len(b)), -1, -1) if a.endswith(b[:n]))
    return a + b[n:]


def json_until_valid(chat: Callable[[list[dict]], str], messages: list[dict], tries: int = 8):
    """A reply that reads as JSON: the model is asked to go on, and its parts are joined, until it does."""
    text = ""
    for _ in range(tries):
        asked = messages if not text else [*messages, {"role": "assistant", "content": text}, {"role": "user", "content": "Continue exactly where you stopped."}]
        part = re.sub(r"(?s)<think>.*?</think>", "", chat(asked))
        for candidate in (joined(text, part), part):
            body = re.search(r"(?s)```(?:json)?\s*(.*?)\s*```", candidate)
            for t in (body[1] if body else candidate, candidate[: candidate.rfind("}") + 1]):
                try:
                    return json.loads(t)
                except ValueError:
                    pass
        text = joined(text, part)
    raise ValueError(f"no JSON after {tries} replies")


def rows_until_valid(chat: Callable[[list[dict]], str], messages: list[dict], columns: list[str], sep: str = "\t", tries: int = 4) -> list[dict]:
    """A delimited reply as rows: tags are stripped, a last line cut short is dropped, and the question is put again if no row fits."""
    for _ in range(tries):
        lines = [x for x in re.sub(r"(?s)<think>.*?</think>|```\w*", "", chat(messages)).strip("\n").split("\n") if x.strip()]
        head = [h.strip().lower() for h in lines[0].split(sep)] if lines else []
        if lines and set(columns) <= set(head):
            rows = [dict(zip(head, r.split(sep), strict=True)) for r in lines[1:] if len(r.split(sep)) == len(head)]
            if rows or len(lines) == 1:
                return [{c: r[c].strip() for c in columns} for r in rows]
    raise ValueError(f"no usable rows after {tries} replies")
